"""Databases as named immutable snapshots, statements that make new ones, and transactions over them.

A table is a lazy DataFrame beside its declared columns and constraints. A statement builds the whole new snapshot, checks
the constraints as set queries, and only then publishes it; readers keep the snapshot that they have.
"""

from __future__ import annotations

import re
import threading
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lakemill.plans import builder
from lakemill.plans.dialect import Select, Statement, parse
from lakemill.plans.errors import CheckViolation, EngineError, ForeignKeyViolation, NameError_, NotNullViolation, ShapeError, TransactionAborted, UniqueViolation, mapped

TYPES = {"int": "int", "integer": "int", "bigint": "bigint", "int64": "bigint", "float": "double", "real": "double", "double": "double", "varchar": "string", "string": "string", "text": "string", "json": "string", "boolean": "boolean", "bool": "boolean", "date": "date", "time": "bigint", "timestamp": "timestamp_ntz"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Snapshots after which a table's lineage is cut, where the session has a checkpoint folder.
CUT_AFTER = 8


@dataclass(frozen=True)
class Table:
    df: DataFrame
    columns: tuple[dict, ...]
    constraints: tuple[dict, ...] = ()
    indexes: tuple[dict, ...] = ()
    next_id: int = 1
    changes: int = 0

    def names(self) -> list[str]:
        return [c["name"] for c in self.columns]

    def of_kind(self, *kinds: str) -> list[dict]:
        return [c for c in self.constraints if c["kind"] in kinds]


@dataclass
class Result:
    kind: str
    rows: DataFrame | None = None
    count: int = 0
    notice: str = ""


#: Helper columns have names that no identifier can have.
_ORDER = "order of rows"


def _given(column: str) -> str:
    return f"given {column}"


def micros_of(text: str) -> int:
    """Microseconds since midnight of 'HH:MM[:SS[.ffffff]]'."""
    m = re.fullmatch(r"([01]?\d|2[0-3]):([0-5]\d)(?::([0-5]\d)(?:\.(\d{1,6}))?)?", text.strip())
    if not m:
        raise ShapeError(f"{text!r} is no time of day")
    h, minute, second, part = m.groups()
    return ((int(h) * 60 + int(minute)) * 60 + int(second or 0)) * 1_000_000 + int((part or "").ljust(6, "0"))


def _names_in(e) -> set[str]:
    """The columns that an expression names."""
    if isinstance(e, tuple) and e[:1] == ("col",):
        return {e[1].split(".")[-1]}
    return set().union(*map(_names_in, e)) if isinstance(e, tuple | list) else set()


def _same(a: str, b: str, keys: list[str], others: list[str]):
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}") == F.col(f"{b}.{o}") for k, o in zip(keys, others, strict=True)])


@dataclass
class Database:
    spark: SparkSession
    tables: dict[str, Table] = field(default_factory=dict)
    state: str = "autocommit"
    saved: list[tuple[str, dict[str, Table]]] = field(default_factory=list)
    begun: dict[str, Table] | None = None

    @classmethod
    def over_parquet(cls, spark: SparkSession, folder: str, names: list[str] | None = None) -> Database:
        """A database over Parquet tables; a table's file is opened when a statement first names it."""
        db = cls(spark)
        db.folder, db.files = folder, set(names or TABLES)
        return db

    #: One statement at a time changes a database; readers keep their snapshots.
    lock: threading.RLock = field(default_factory=threading.RLock, repr=False, compare=False)
    folder: str = ""
    files: set[str] = field(default_factory=set)

    def table(self, name: str) -> Table:
        if name not in self.tables and name in self.files:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            self.tables[name] = Table(df, tuple({"name": f.name, "type": f.dataType.simpleString(), "nullable": True, "default": None, "auto": False} for f in df.schema))
        if name not in self.tables:
            raise NameError_(f"table {name} not found")
        return self.tables[name]

    def execute(self, text: str) -> Result:
        """Runs a script; the last statement's result. The first failure stops it and leaves its statement undone."""
        out = Result("noop")
        with self.lock:
            for s in parse(text):
                out = self._one(s)
        return out

    def _one(self, s) -> Result:
        kind = "select" if isinstance(s, Select) else s.kind
        if kind in ("begin", "commit", "rollback", "savepoint", "release", "rollback_to"):
            return self._control(s)
        if self.state == "aborted":
            raise TransactionAborted("the transaction is aborted; roll back first")
        before = dict(self.tables)
        try:
            if kind == "select":
                return Result("selected", builder.select(s, lambda n: self.table(n).df))
            if kind not in ("create", "drop", "drop_index", "show_indexes"):
                if s.table not in self.tables and s.table not in self.files and s.args.get("soft") and kind != "create_index":
                    return Result("noop")
                self.table(s.table)
            return getattr(self, f"_{kind}")(s.table, **s.args)
        except Exception as e:
            self.tables = before
            if self.state == "explicit":
                self.state = "aborted"
            if (known := mapped(e)) is not None:
                raise known from e
            raise

    def _control(self, s: Statement) -> Result:
        if s.kind == "begin":
            if self.state != "autocommit":
                return Result("notice", notice="already in a transaction")
            self.begun, self.saved, self.state = dict(self.tables), [], "explicit"
        elif s.kind in ("commit", "rollback"):
            if self.state == "autocommit":
                return Result("notice", notice="no transaction")
            undone = s.kind == "rollback" or self.state == "aborted"
            if undone:
                self.tables = self.begun or {}
            self.begun, self.saved, self.state = None, [], "autocommit"
            return Result("rolled back" if undone else "committed")
        else:
            if self.state == "autocommit" or (self.state == "aborted" and s.kind != "rollback_to"):
                raise EngineError(f"{s.kind} needs an open transaction")
            if s.kind == "savepoint":
                self.saved.append((s.table, dict(self.tables)))
            else:
                at = max((k for k, (n, _) in enumerate(self.saved) if n == s.table), default=None)
                if at is None:
                    raise NameError_(f"savepoint {s.table} not found")
                if s.kind == "release":
                    del self.saved[at:]
                else:
                    self.tables, self.state = dict(self.saved[at][1]), "explicit"
                    del self.saved[at + 1 :]
        return Result(s.kind)

    # Guards: each is a set query that needs one row to fail.

    def _publish(self, name: str, table: Table, check: bool = True, new: DataFrame | None = None) -> None:
        """``new``: the only rows that the last snapshot did not hold, where a statement knows them."""
        if check:
            self._guard(name, table, new)
        changes = table.changes + 1
        if changes % CUT_AFTER == 0 and not self.spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            table = replace(table, df=table.df.checkpoint())
        self.tables[name] = replace(table, changes=changes)

    def _guard(self, name: str, table: Table, new: DataFrame | None = None) -> None:
        """Row checks and foreign keys see the new rows alone; uniqueness compares them with each other and, by a semi join,
        with the stored keys. A CHECK that is NOT VALID binds new rows only."""
        rows = table.df if new is None else new
        for c in table.columns:
            if not c["nullable"] and rows.where(F.col(c["name"]).isNull()).limit(1).count():
                raise NotNullViolation(f"{name}.{c['name']} is null")
        for c in table.constraints:
            if c["kind"] == "check" and (new is not None or c.get("valid", True)):
                self._guard_check(name, rows, c)
            elif c["kind"] in ("unique", "primary"):
                keys = c["columns"]
                if c["kind"] == "primary" and rows.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])).limit(1).count():
                    raise NotNullViolation(f"{name}: null in primary key {keys}")
                own = rows.dropna(subset=keys)
                repeats = own.groupBy(*keys).count().where("count > 1")
                if new is not None and name in self.tables:
                    stored = self.tables[name].df.select(*keys)
                    repeats = repeats.select(*keys).union(stored.alias("c").join(own.select(*keys).alias("p"), _same("c", "p", keys, keys), "left_semi"))
                if repeats.limit(1).count():
                    raise UniqueViolation(f"{name}: {c['name'] or keys} repeats")
            elif c["kind"] == "foreign":
                parent = (table if c["parent"] == name else self.table(c["parent"])).df
                child = rows.dropna(subset=c["columns"])
                if child.alias("c").join(parent.alias("p"), _same("c", "p", c["columns"], c["keys"]), "left_anti").limit(1).count():
                    raise ForeignKeyViolation(f"{name}: {c['name'] or c['columns']} has no row in {c['parent']}")

    def _guard_check(self, name: str, df: DataFrame, c: dict) -> None:
        if df.where(~builder.column(c["expr"], df)).limit(1).count():
            raise CheckViolation(f"{name}: check {c['name'] or ''} fails")

    def _children(self, parent: str):
        return [(n, t, c) for n, t in list(self.tables.items()) for c in t.of_kind("foreign") if c["parent"] == parent]

    # Rows.

    def _cast(self, e, col: dict, df: DataFrame | None = None):
        value = builder.column(e, self.spark.range(0) if df is None else df)
        if col["type"] == "time" and e[0] == "lit" and isinstance(e[1], str):
            return F.lit(micros_of(e[1]))
        if e[0] == "lit" and isinstance(e[1], str) and TYPES.get(col["type"], col["type"]) in ("int", "bigint", "double", "boolean"):
            raise ShapeError(f"{col['name']}: text where a {col['type']} is needed")
        value = value.cast(TYPES.get(col["type"], col["type"]))
        return value

    def _insert(self, name: str, columns=None, rows=None, select=None, defaults=False) -> Result:
        table = self.table(name)
        auto = next((c for c in table.columns if c["auto"]), None)
        given = columns or ([] if defaults else table.names())
        if unknown := [c for c in given if c not in table.names()]:
            raise NameError_(f"{name} has no column {unknown[0]}")
        if len(set(given)) < len(given):
            raise NameError_(f"{name}: a column is named twice")
        if auto and auto["name"] in given:
            raise ShapeError(f"{auto['name']} is numbered by the table")
        one = self.spark.range(1)
        if select is not None:
            new = builder.select(select, lambda n: self.table(n).df)
            if len(new.columns) != len(given):
                raise ShapeError(f"{len(new.columns)} values for {len(given)} columns")
            new = new.toDF(*[_given(c) for c in given])
        else:
            own = [c for n in given for c in table.columns if c["name"] == n]
            for r in rows or []:
                if len(r) != len(given):
                    raise ShapeError(f"{len(r)} values for {len(given)} columns")
            kinds = {c["name"]: table.df.schema[c["name"]].dataType for c in own}
            arrays = [F.struct(F.lit(k).alias(_ORDER), *[self._cast(e, c).cast(kinds[c["name"]]).alias(_given(c["name"])) for e, c in zip(r, own, strict=True)]) for k, r in enumerate(rows or [[]])]
            new = one.select(F.explode(F.array(*arrays)).alias("r")).select("r.*")
        number = None
        if auto:
            order = _ORDER if _ORDER in new.columns else F.xxhash64(*[F.col(_given(c)) for c in given])
            number = F.row_number().over(Window.orderBy(order)) + F.lit(table.next_id - 1)
        items = []
        for c in table.columns:
            kind = table.df.schema[c["name"]].dataType
            value = number if c["auto"] else F.col(_given(c["name"])) if c["name"] in given else F.lit(None) if c["default"] is None else self._cast(c["default"], c)
            items.append(value.cast(kind).alias(c["name"]))
        new = new.select(*items)
        if select is None:
            new.collect()  # the statement's own values: what can't be computed fails here, not in a later reader
        for c in table.columns:
            if c["type"] == "json" and new.where(F.col(c["name"]).isNotNull() & F.try_parse_json(c["name"]).isNull()).limit(1).count():
                raise ShapeError(f"{name}.{c['name']}: malformed JSON")
        n = new.count() if select is not None else len(rows or [[]])
        self._publish(name, replace(table, df=table.df.unionByName(new), next_id=table.next_id + n), new=new)
        return Result("inserted", count=n)

    def _predicate(self, table: Table, alias: str, where):
        df = table.df.alias(alias)
        return df, F.lit(True) if where is None else F.coalesce(builder.column(where, df), F.lit(False))

    def _update(self, name: str, set=None, where=None, alias=None) -> Result:  # noqa: A002
        table = self.table(name)
        df, hit = self._predicate(table, alias or name, where)
        by = {c["name"]: c for c in table.columns}
        for c, _ in set:
            if c not in by:
                raise NameError_(f"{name} has no column {c}")
            if by[c]["auto"]:
                raise ShapeError(f"{c} is numbered by the table")
        new = {c: F.when(hit, self._cast(e, by[c], df).cast(table.df.schema[c].dataType)).otherwise(F.col(c)) for c, e in set}
        count = df.where(hit).count()
        after = df.select(*[new.get(c, F.col(c)).alias(c) for c in table.names()])
        pairs = df.where(hit).select(*[F.col(c).alias(f"old_{c}") for c in table.names()], *[new.get(c, F.col(c)).alias(f"new_{c}") for c in table.names()])
        self._publish(name, replace(table, df=after), check=False)
        for child, t, fk in self._children(name):
            if not {c for c, _ in set} & {*fk["keys"]}:
                continue
            t = self.tables[child]
            gone = pairs.where(reduce(lambda a, b: a | b, [~F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}")) for k in fk["keys"]])).select(*[c for k in fk["keys"] for c in (f"old_{k}", f"new_{k}")]).distinct()
            met = t.df.alias("c").join(gone.alias("g"), _same("c", "g", fk["columns"], [f"old_{k}" for k in fk["keys"]]), "left")
            if fk["update"] == "restrict":
                if met.where(F.col(f"g.old_{fk['keys'][0]}").isNotNull()).limit(1).count():
                    raise ForeignKeyViolation(f"{child} refers to {name}")
                continue
            moved = {c: F.when(F.col(f"g.old_{k}").isNotNull(), F.col(f"g.new_{k}") if fk["update"] == "cascade" else F.lit(None)).otherwise(F.col(f"c.{c}")) for c, k in zip(fk["columns"], fk["keys"], strict=True)}
            self._publish(child, replace(t, df=met.select(*[moved.get(c, F.col(f"c.{c}")).alias(c) for c in t.names()])))
        changed = after.alias(alias or name) if where is None else pairs.select(*[F.col(f"new_{c}").alias(c) for c in table.names()])
        for c in table.of_kind("check"):
            if not c.get("valid", True):
                self._guard_check(name, changed, c)
        self._guard(name, self.tables[name])
        return Result("updated", count=count)

    def _delete(self, name: str, where=None, alias=None) -> Result:
        table = self.table(name)
        df, hit = self._predicate(table, alias or name, where)
        gone = df.where(hit)
        count = gone.count()
        self._remove(name, replace(table, df=df.where(~hit).select(*table.names())), gone)
        return Result("deleted", count=count)

    def _remove(self, name: str, after: Table, gone: DataFrame, depth: int = 0) -> None:
        """Publishes a table without the rows ``gone`` and settles its children, cascading until nothing is left to go."""
        self._publish(name, after, check=False)
        for child, _, fk in self._children(name):
            t = self.tables[child]
            keys = gone.select(*[F.col(k).alias(f"gone_{k}") for k in fk["keys"]]).dropna().distinct()
            others = [f"gone_{k}" for k in fk["keys"]]
            met = t.df.alias("c").join(keys.alias("g"), _same("c", "g", fk["columns"], others), "left_semi")
            if not met.limit(1).count():
                continue
            if fk["delete"] == "restrict":
                raise ForeignKeyViolation(f"{child} refers to {name}")
            if fk["delete"] == "null":
                joined = t.df.alias("c").join(keys.alias("g"), _same("c", "g", fk["columns"], others), "left")
                nulls = {c: F.when(F.col(f"g.{others[0]}").isNull(), F.col(f"c.{c}")) for c in fk["columns"]}
                self._publish(child, replace(t, df=joined.select(*[nulls.get(c, F.col(f"c.{c}")).alias(c) for c in t.names()])))
            else:
                rest = t.df.alias("c").join(keys.alias("g"), _same("c", "g", fk["columns"], others), "left_anti")
                self._remove(child, replace(t, df=rest), met, depth + 1)

    # Definitions.

    def _create(self, name: str, soft=False, columns=(), constraints=()) -> Result:
        if name in self.tables or name in self.files:
            if soft:
                return Result("noop")
            raise NameError_(f"table {name} exists")
        if len({c["name"] for c in columns}) < len(columns):
            raise NameError_(f"{name}: a column is named twice")
        if sum(c["auto"] for c in columns) > 1:
            raise ShapeError(f"{name}: more than one numbered column")
        if sum(c["kind"] == "primary" for c in constraints) > 1:
            raise ShapeError(f"{name}: more than one primary key")
        if bad := [c["type"] for c in columns if c["type"] not in TYPES]:
            raise ShapeError(f"unknown type {bad[0]}")
        schema = T.StructType()
        for c in columns:
            schema.add(c["name"], T._parse_datatype_string(TYPES[c["type"]]) if TYPES[c["type"]] != "timestamp_ntz" else T.TimestampNTZType(), metadata={"logical": c["type"]})
        for c in constraints:
            self._known(name, [x["name"] for x in columns], c)
        self.tables[name] = Table(self.spark.createDataFrame([], schema), tuple(columns), tuple(constraints))
        return Result("table created")

    def _known(self, name: str, names: list[str], c: dict) -> None:
        if unknown := [k for k in c.get("columns", ()) if k not in names]:
            raise NameError_(f"{name} has no column {unknown[0]}")
        if c["kind"] == "foreign" and c["parent"] != name:
            parent = self.table(c["parent"])
            if not any(set(x["columns"]) == set(c["keys"]) for x in parent.of_kind("unique", "primary")):
                raise ForeignKeyViolation(f"{c['parent']} {c['keys']} is neither primary key nor unique")

    def _drop(self, name: str, soft=False) -> Result:
        if name not in self.tables and name not in self.files:
            if soft:
                return Result("noop")
            raise NameError_(f"table {name} not found")
        if any(n != name for n, _, _ in self._children(name)):
            raise ForeignKeyViolation(f"another table refers to {name}")
        self.tables.pop(name, None)
        self.files.discard(name)
        return Result("table dropped")

    def _add_column(self, name: str, column=None, constraints=(), guard=False, soft=False) -> Result:
        table = self.table(name)
        if column["name"] in table.names():
            if guard:
                return Result("noop")
            raise NameError_(f"{name}.{column['name']} exists")
        kind = T.TimestampNTZType() if TYPES[column["type"]] == "timestamp_ntz" else T._parse_datatype_string(TYPES[column["type"]])
        value = F.lit(None) if column["default"] is None else self._cast(column["default"], column)
        after = replace(table, df=table.df.withColumn(column["name"], value.cast(kind)), columns=(*table.columns, column), constraints=(*table.constraints, *constraints))
        self._publish(name, after)
        return Result("column added")

    def _column_of(self, name: str, column: str) -> Table:
        table = self.table(name)
        if column not in table.names():
            raise NameError_(f"{name} has no column {column}")
        return table

    def _drop_column(self, name: str, /, soft=False, guard=False, **args) -> Result:
        column = args["name"]
        if guard and column not in self.table(name).names():
            return Result("noop")
        table = self._column_of(name, column)
        if any(column in c.get("columns", ()) for c in table.of_kind("primary")) or any(column in fk["keys"] for _, _, fk in self._children(name)):
            raise ShapeError(f"{column} is a key")
        kept = tuple(c for c in table.constraints if column not in c.get("columns", ()) and not (c["kind"] == "check" and column in _names_in(c["expr"])))
        self._publish(name, replace(table, df=table.df.drop(column), columns=tuple(c for c in table.columns if c["name"] != column), constraints=kept))
        return Result("column dropped")

    def _rename_column(self, name: str, /, soft=False, to="", **args) -> Result:
        old = args["name"]
        table = self._column_of(name, old)
        if to in table.names():
            raise NameError_(f"{name}.{to} exists")
        swap = lambda xs: [to if x == old else x for x in xs]

        def walk(e):
            return ("col", to) if e == ("col", old) else type(e)(walk(x) for x in e) if isinstance(e, tuple | list) else e

        own = tuple(c | ({"columns": swap(c["columns"])} if "columns" in c else {}) | ({"expr": walk(c["expr"])} if "expr" in c else {}) for c in table.constraints)
        indexes = tuple(i | {"columns": swap(i["columns"])} for i in table.indexes)
        self.tables[name] = replace(table, df=table.df.withColumnRenamed(old, to), columns=tuple(c | {"name": to} if c["name"] == old else c for c in table.columns), constraints=own, indexes=indexes)
        for child, t, fk in self._children(name):
            self.tables[child] = replace(self.tables[child], constraints=tuple(c | {"keys": swap(c["keys"])} if c is fk else c for c in self.tables[child].constraints))
        return Result("column renamed")

    def _rename_table(self, name: str, soft=False, to="") -> Result:
        if to in self.tables or to in self.files:
            raise NameError_(f"table {to} exists")
        self.tables[to] = self.tables.pop(name)
        self.files.discard(name)
        for n, t in list(self.tables.items()):
            self.tables[n] = replace(t, constraints=tuple(c | {"parent": to} if c.get("parent") == name else c for c in t.constraints))
        return Result("table renamed")

    def _alter_column(self, name: str, column: str, **change) -> Result:
        table = self._column_of(name, column)
        self.tables[name] = replace(table, columns=tuple(c | change if c["name"] == column else c for c in table.columns))
        return Result("column altered")

    def _set_default(self, table: str, soft=False, default=None, **args) -> Result:
        return self._alter_column(table, args["name"], default=default)

    def _drop_not_null(self, table: str, soft=False, **args) -> Result:
        if any(args["name"] in c["columns"] for c in self.table(table).of_kind("primary")):
            raise ShapeError(f"{args['name']} is in the primary key")
        return self._alter_column(table, args["name"], nullable=True)

    def _add_constraint(self, table: str, soft=False, **c) -> Result:
        t = self.table(table)
        self._known(table, t.names(), c)
        if c["kind"] == "primary" and t.of_kind("primary"):
            raise ShapeError(f"{table} has a primary key")
        if c["name"] and any(x["name"] == c["name"] for x in t.constraints):
            raise NameError_(f"constraint {c['name']} exists")
        self._publish(table, replace(t, constraints=(*t.constraints, c)))
        return Result("constraint added")

    def _drop_constraint(self, table: str, soft=False, guard=False, **args) -> Result:
        t = self.table(table)
        kept = tuple(c for c in t.constraints if c["name"] != args["name"])
        if len(kept) == len(t.constraints):
            if guard:
                return Result("noop")
            raise NameError_(f"constraint {args['name']} not found")
        self.tables[table] = replace(t, constraints=kept)
        return Result("constraint dropped")

    def _drop_primary(self, table: str, soft=False) -> Result:
        t = self.table(table)
        if not t.of_kind("primary"):
            raise NameError_(f"{table} has no primary key")
        self.tables[table] = replace(t, constraints=tuple(c for c in t.constraints if c["kind"] != "primary"))
        return Result("constraint dropped")

    def _validate(self, table: str, soft=False, **args) -> Result:
        t = self.table(table)
        for c in t.constraints:
            if c["name"] == args["name"]:
                if c["kind"] == "check":
                    self._guard_check(table, t.df, c)
                self.tables[table] = replace(t, constraints=tuple(x | {"valid": True} if x is c else x for x in t.constraints))
                return Result("constraint validated")
        raise NameError_(f"constraint {args['name']} not found")

    def _create_index(self, table: str, index="", columns=(), soft=False, using="hash") -> Result:
        t = self.table(table)
        if any(i["index"] == index for x in self.tables.values() for i in x.indexes):
            if soft:
                return Result("noop")
            raise NameError_(f"index {index} exists")
        for c in columns:
            self._column_of(table, c)
        self.tables[table] = replace(t, indexes=(*t.indexes, {"index": index, "columns": list(columns), "kind": using}))
        return Result("index created")

    def _drop_index(self, table: str, index="", soft=False) -> Result:
        for n, t in self.tables.items():
            if (not table or n == table) and any(i["index"] == index for i in t.indexes):
                self.tables[n] = replace(t, indexes=tuple(i for i in t.indexes if i["index"] != index))
                return Result("index dropped")
        if soft:
            return Result("noop")
        raise NameError_(f"index {index} not found")

    def _show_indexes(self, table: str) -> Result:
        rows = [(i["index"], n, ",".join(i["columns"]), i["kind"]) for n, t in sorted(self.tables.items()) if not table or n == table for i in t.indexes]
        return Result("indexes", self.spark.createDataFrame(rows, "index_name string, table_name string, columns string, kind string"))

    # Catalog.

    def list_tables(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in sorted({*self.tables, *self.files})], "table_name string")

    def describe(self, name: str) -> DataFrame:
        t = self.table(name)
        keys = {k for c in t.of_kind("primary") for k in c["columns"]}
        rows = [(c["name"], c["type"], c["nullable"] and c["name"] not in keys, c["name"] in keys, c["auto"]) for c in t.columns]
        return self.spark.createDataFrame(rows, "column_name string, type string, nullable boolean, primary_key boolean, auto_increment boolean")

    def constraints(self) -> DataFrame:
        """(table_name, constraint_name, kind, columns, parent, parent_columns, on_delete, on_update, valid) of every table."""
        rows = [
            (n, c["name"], c["kind"], ",".join(c.get("columns", ())) or ",".join(sorted(_names_in(c.get("expr")))), c.get("parent"), ",".join(c.get("keys", ())) or None, c.get("delete"), c.get("update"), c.get("valid", True))
            for n, t in sorted(self.tables.items()) for c in t.constraints
        ]
        return self.spark.createDataFrame(rows, "table_name string, constraint_name string, kind string, columns string, parent string, parent_columns string, on_delete string, on_update string, valid boolean")

    def defaults(self) -> DataFrame:
        """(table_name, column_name, default): columns with a default, which is shown as parsed."""
        rows = [(n, c["name"], repr(c["default"][1] if c["default"][0] == "lit" else c["default"])) for n, t in sorted(self.tables.items()) for c in t.columns if c["default"] is not None]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, default string")
