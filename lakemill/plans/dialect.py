"""The SQL dialect: text to statements. Type names and minor keywords are not reserved, so they can name columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any


class ParseError(ValueError):
    pass


_TOKEN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/|(?P<str>'[^']*'|"[^"]*")|(?P<num>\d+\.\d+|\d+)|(?P<id>[A-Za-z_]\w*)|(?P<op>->>|->|\#>>|\#>|@>|<@|<>|!=|<=|>=|[-+*/=<>(),.;?])""", re.S)
AGGREGATES = {"count", "sum", "avg", "min", "max"}
_STOP = set("from where group having order limit offset join inner left right full cross on using union intersect except as set values and or not in between like is then when else end asc desc".split())
_LEVEL = {"or": 1, "and": 2, "=": 4, "<>": 4, "!=": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "@>": 4, "<@": 4, "in": 4, "between": 4, "like": 4, "is": 4, "not": 4, "+": 5, "-": 5, "*": 6, "/": 6, "->": 7, "->>": 7, "#>": 7, "#>>": 7, "?": 7}


@dataclass
class Select:
    items: list | None
    source: list = field(default_factory=list)
    distinct: bool = False
    where: Any = None
    group: list = field(default_factory=list)
    having: Any = None
    order: list = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    combined: list = field(default_factory=list)


@dataclass
class Statement:
    kind: str
    table: str = ""
    args: dict = field(default_factory=dict)


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ParseError(f"unexpected {text[at]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def word(self, k: int = 0) -> str:
        if self.at + k >= len(self.tokens):
            return ""
        kind, t = self.tokens[self.at + k]
        return t.lower() if kind in ("id", "op") else ""

    def take(self, *words: str) -> bool:
        if all(self.word(k) == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise ParseError(f"expected {' '.join(words)} at {self.rest()}")

    def rest(self) -> str:
        return " ".join(t for _, t in self.tokens[self.at : self.at + 5]) or "the end"

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "id":
            raise ParseError(f"expected a name at {self.rest()}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def names(self) -> list[str]:
        self.need("(")
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        self.need(")")
        return out

    def expr(self, least: int = 0):
        left = self.atom()
        while (op := self.word()) and (level := _LEVEL.get(op, -1)) > least:
            negated = op == "not"
            if negated and self.word(1) not in ("in", "between", "like"):
                break
            self.at += 1 + negated
            op = self.tokens[self.at - 1][1].lower()
            if op == "is":
                negated = self.take("not")
                self.need("null")
                left = ("isnull", left)
            elif op == "in":
                self.need("(")
                items = [self.expr()]
                while self.take(","):
                    items.append(self.expr())
                self.need(")")
                left = ("in", left, items)
            elif op == "between":
                low = self.expr(4)
                self.need("and")
                left = ("between", left, low, self.expr(4))
            else:
                left = (op, left, self.expr(level))
            if negated:
                left = ("not", left)
        return left

    def atom(self):
        if self.at >= len(self.tokens):
            raise ParseError("unexpected end")
        kind, t = self.tokens[self.at]
        w = t.lower()
        if kind == "str":
            self.at += 1
            return ("lit", t[1:-1])
        if kind == "num":
            self.at += 1
            return ("lit", float(t) if "." in t else int(t))
        if self.take("("):
            inner = self.expr()
            self.need(")")
            return inner
        if self.take("not"):
            return ("not", self.expr(3))
        if self.take("-"):
            return ("-", ("lit", 0), self.expr(6))
        if kind != "id":
            raise ParseError(f"unexpected {t!r}")
        if w in ("true", "false", "null"):
            self.at += 1
            return ("lit", {"true": True, "false": False, "null": None}[w])
        if self.take("case"):
            base = None if self.word() == "when" else self.expr()
            arms, other = [], None
            while self.take("when"):
                test = self.expr()
                self.need("then")
                arms.append((test if base is None else ("=", base, test), self.expr()))
            if self.take("else"):
                other = self.expr()
            self.need("end")
            return ("case", arms, other)
        self.at += 1
        if self.take("("):
            if w not in AGGREGATES:
                raise ParseError(f"unknown function {t}")
            if w == "count" and self.take("*"):
                arg = None
            else:
                arg = self.expr()
            self.need(")")
            return ("agg", w, arg)
        return ("col", f"{t}.{self.name()}" if self.take(".") else t)

    def alias(self) -> str | None:
        if self.take("as") or (self.at < len(self.tokens) and self.tokens[self.at][0] == "id" and self.word() not in _STOP):
            return self.name()
        return None

    def table(self) -> tuple[str, str]:
        name = self.name()
        return name, self.alias() or name

    def select(self) -> Select:
        out = self.block()
        while self.word() in ("union", "intersect", "except"):
            op = self.word()
            self.at += 1
            out.combined.append((op, self.take("all"), self.block()))
        if self.take("order", "by"):
            while True:
                e = self.expr()
                down = self.take("desc") or (self.take("asc") and False)
                out.order.append((e, down))
                if not self.take(","):
                    break
        if self.take("limit"):
            out.limit = self.number()
        if self.take("offset"):
            out.offset = self.number()
        return out

    def number(self) -> int:
        kind, t = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "num" or "." in t:
            raise ParseError(f"expected a whole number at {self.rest()}")
        self.at += 1
        return int(t)

    def block(self) -> Select:
        self.need("select")
        out = Select(None, distinct=self.take("distinct"))
        if not self.take("*"):
            out.items = []
            while True:
                out.items.append((self.expr(), self.alias()))
                if not self.take(","):
                    break
        self.need("from")
        out.source.append(("cross", *self.table(), None, None))
        while True:
            kind = next((k for k in ("inner", "left", "right", "full", "cross") if self.word() == k), None)
            if self.take(","):
                out.source.append(("cross", *self.table(), None, None))
                continue
            if kind:
                self.at += 1
                self.take("outer")
            if not self.take("join"):
                break
            t = self.table()
            on = using = None
            if kind != "cross":
                if self.take("using"):
                    using = self.names()
                else:
                    self.need("on")
                    on = self.expr()
            out.source.append((kind or "inner", *t, on, using))
        if self.take("where"):
            out.where = self.expr()
        if self.take("group", "by"):
            out.group.append(self.expr())
            while self.take(","):
                out.group.append(self.expr())
        if self.take("having"):
            out.having = self.expr()
        return out

    def row(self) -> list:
        self.need("(")
        out = [self.expr()]
        while self.take(","):
            out.append(self.expr())
        self.need(")")
        return out

    def constraint(self) -> dict | None:
        name = self.name() if self.take("constraint") else None
        if self.take("primary", "key"):
            return {"kind": "primary", "name": name, "columns": self.names()}
        if self.take("unique"):
            return {"kind": "unique", "name": name, "columns": self.names()}
        if self.take("check"):
            self.need("(")
            e = self.expr()
            self.need(")")
            return {"kind": "check", "name": name, "expr": e, "valid": not self.take("not", "valid")}
        if self.take("foreign", "key"):
            cols = self.names()
            self.need("references")
            return {"kind": "foreign", "name": name, "columns": cols, **self.references()}
        return None

    def references(self) -> dict:
        out = {"parent": self.name(), "keys": self.names(), "delete": "restrict", "update": "restrict"}
        while self.take("on"):
            event = self.name().lower()
            for action in (("cascade",), ("set", "null"), ("no", "action"), ("restrict",), ("set", "default")):
                if self.take(*action):
                    out[event] = {"cascade": "cascade", "set null": "null"}.get(" ".join(action), "restrict")
                    break
        return out

    def column(self) -> tuple[dict, list[dict]]:
        out, extra = {"name": self.name(), "type": self.name().lower(), "nullable": True, "default": None, "auto": False}, []
        while True:
            if self.take("not", "null"):
                out["nullable"] = False
            elif self.take("null"):
                pass
            elif self.take("default"):
                out["default"] = self.expr(4)
            elif self.take("auto_increment"):
                out["auto"] = True
            elif self.take("primary", "key"):
                out["nullable"] = False
                extra.append({"kind": "primary", "name": None, "columns": [out["name"]]})
            elif self.take("unique"):
                extra.append({"kind": "unique", "name": None, "columns": [out["name"]]})
            elif self.take("references"):
                extra.append({"kind": "foreign", "name": None, "columns": [out["name"]], **self.references()})
            else:
                return out, extra

    def statement(self):
        if self.word() == "select":
            return self.select()
        if self.take("insert", "into"):
            table, cols = self.name(), None
            if self.word() == "(":
                cols = self.names()
            if self.take("default", "values"):
                return Statement("insert", table, {"columns": cols, "defaults": True})
            if self.word() == "select":
                return Statement("insert", table, {"columns": cols, "select": self.select()})
            self.need("values")
            rows = [self.row()]
            while self.take(","):
                rows.append(self.row())
            return Statement("insert", table, {"columns": cols, "rows": rows})
        if self.take("update"):
            table, alias = self.table()
            self.need("set")
            sets = []
            while True:
                c = self.name()
                self.need("=")
                sets.append((c, self.expr()))
                if not self.take(","):
                    break
            return Statement("update", table, {"alias": alias, "set": sets, "where": self.expr() if self.take("where") else None})
        if self.take("delete", "from"):
            table, alias = self.table()
            return Statement("delete", table, {"alias": alias, "where": self.expr() if self.take("where") else None})
        if self.take("create", "table"):
            soft = self.take("if", "not", "exists")
            table, columns, constraints = self.name(), [], []
            self.need("(")
            while True:
                if (c := self.constraint()) is not None:
                    constraints.append(c)
                else:
                    col, extra = self.column()
                    columns.append(col)
                    constraints += extra
                if not self.take(","):
                    break
            self.need(")")
            return Statement("create", table, {"soft": soft, "columns": columns, "constraints": constraints})
        if self.take("drop", "table"):
            soft = self.take("if", "exists")
            return Statement("drop", self.name(), {"soft": soft})
        if self.take("create", "index"):
            soft = self.take("if", "not", "exists")
            index = self.name()
            self.need("on")
            table, cols = self.name(), self.names()
            return Statement("create_index", table, {"index": index, "columns": cols, "soft": soft, "using": self.name().lower() if self.take("using") else "hash"})
        if self.take("drop", "index"):
            soft = self.take("if", "exists")
            index = self.name()
            return Statement("drop_index", self.name() if self.take("on") else "", {"index": index, "soft": soft})
        if self.take("show", "indexes"):
            return Statement("show_indexes", self.name() if self.take("from") else "")
        if self.take("alter", "table"):
            soft = self.take("if", "exists")
            return self.alter(self.name(), soft)
        for words, kind in ((("begin",), "begin"), (("commit",), "commit"), (("savepoint",), "savepoint"), (("release",), "release"), (("rollback",), "rollback")):
            if self.take(*words):
                self.take("transaction")
                if kind == "rollback" and self.take("to"):
                    self.take("savepoint")
                    return Statement("rollback_to", self.name())
                if kind == "release":
                    self.take("savepoint")
                return Statement(kind, self.name() if kind in ("savepoint", "release") else "")
        raise ParseError(f"unknown statement at {self.rest()}")

    def alter(self, table: str, soft: bool) -> Statement:
        args: dict[str, Any] = {"soft": soft}
        if self.take("add"):
            if (c := self.constraint()) is not None:
                return Statement("add_constraint", table, args | c)
            self.take("column")
            guard = self.take("if", "not", "exists")
            col, extra = self.column()
            return Statement("add_column", table, args | {"column": col, "constraints": extra, "guard": guard})
        if self.take("drop", "constraint"):
            guard = self.take("if", "exists")
            return Statement("drop_constraint", table, args | {"name": self.name(), "guard": guard})
        if self.take("drop", "primary", "key"):
            return Statement("drop_primary", table, args)
        if self.take("drop"):
            self.take("column")
            guard = self.take("if", "exists")
            return Statement("drop_column", table, args | {"name": self.name(), "guard": guard})
        if self.take("rename", "to"):
            return Statement("rename_table", table, args | {"to": self.name()})
        if self.take("rename"):
            self.take("column")
            name = self.name()
            self.need("to")
            return Statement("rename_column", table, args | {"name": name, "to": self.name()})
        if self.take("validate", "constraint"):
            return Statement("validate", table, args | {"name": self.name()})
        self.need("alter")
        self.take("column")
        name = self.name()
        if self.take("set", "default"):
            return Statement("set_default", table, args | {"name": name, "default": self.expr()})
        if self.take("drop", "default"):
            return Statement("set_default", table, args | {"name": name, "default": None})
        self.need("drop", "not", "null")
        return Statement("drop_not_null", table, args | {"name": name})


def parse(text: str) -> list:
    """All statements of a script, split by semicolons."""
    p, out = Parser(text), []
    while p.at < len(p.tokens):
        if p.take(";"):
            continue
        out.append(p.statement())
        if p.at < len(p.tokens):
            p.need(";")
    if not out:
        raise ParseError("nothing to execute")
    return out
