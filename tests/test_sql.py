"""Statements of the dialect: results, constraints, transactions and errors on small tables."""

import pytest
from pyspark.sql import functions as F

from lakemill.plans.dialect import ParseError, parse
from lakemill.plans.errors import CheckViolation, EngineError, ForeignKeyViolation, NameError_, NotNullViolation, ShapeError, TransactionAborted, UniqueViolation
from lakemill.plans.session import Database


@pytest.fixture
def db(spark):
    return Database(spark)


def rows(db, sql):
    return [tuple(r) for r in db.execute(sql).rows.collect()]


def one(db, expr):
    return rows(db, f"select {expr} as v from one")[0][0]


@pytest.fixture
def row(db):
    db.execute("create table one (id int, n bigint, f float, s string, j json, z bigint); insert into one (id, n, f, s, j) values (1, 7, 2.5, 'abc', '{\"a\": {\"b\": [1, \"x\", null]}, \"k\": \"v\", \"t\": true, \"e\": null}')")
    return db


@pytest.mark.parametrize(
    ("expr", "value"),
    [
        ("n + 1 * 2", 9), ("(n + 1) * 2", 16), ("0 - n", -7), ("n / 2", 3), ("(0 - n) / 2", -3), ("f * 2.0", 5.0), ("n = 7 and f > 2.0", True),
        ("not n = 7", False), ("z = 1", None), ("z is null", True), ("z is not null", False), ("z = 1 and false", False), ("z = 1 or true", True),
        ("n in (1, 7)", True), ("n in (1, z)", None), ("n not in (1, 2)", True), ("n between 7 and 8", True), ("n not between 1 and 6", True), ("z between 1 and 2", None),
        ("s like 'a%'", True), ("s like '_b_'", True), ("s not like '%z%'", True), ("s like 'A%'", False),
        ("case when n > 5 then 'big' else 'small' end", "big"), ("case n when 1 then 'one' end", None), ("case z when z then 1 else 2 end", 2),
        ("j -> 'k'", '"v"'), ("j ->> 'k'", "v"), ("j -> 'a'", '{"b":[1,"x",null]}'), ("j #> '{a,b,0}'", "1"), ("j #>> '{a,b,1}'", "x"), ("j #>> '{a,b,2}'", None),
        ("j -> 'none'", None), ("j -> 'e'", None), ("j ? 'k'", True), ("j ? 'b'", False), ("j @> '{\"k\": \"v\"}'", True), ("j @> '{\"a\": {\"b\": [\"x\"]}}'", True),
        ("j @> '{\"t\": 1}'", False), ("'{\"t\": true}' <@ j", True), ("j @> '{}'", True),
    ],
)
def test_expressions(row, expr, value):
    assert one(row, expr) == value


def test_division_by_zero(row):
    assert one(row, "f / 0.0") == float("inf")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        one(row, "n / 0")


def test_grouping_ordering_and_limits(db):
    db.execute("create table t (id int, g string, v bigint); insert into t values (1, 'a', 10), (2, 'a', null), (3, 'b', 5), (4, null, 1), (5, null, 2)")
    assert rows(db, "select g, count(*) as n, count(v) as m, sum(v) as s, avg(v) as a, min(v) as lo, max(v) as hi from t group by g order by g") == [(None, 2, 2, 3, 1.5, 1, 2), ("a", 2, 1, 10, 10.0, 10, 10), ("b", 1, 1, 5, 5.0, 5, 5)]
    assert rows(db, "select g from t group by g having sum(v) > 4 order by g desc") == [("b",), ("a",)]
    assert rows(db, "select id from t order by v desc limit 2 offset 1") == [(3,), (5,)]
    assert rows(db, "select id from t order by v limit 1") == [(2,)]
    assert rows(db, "select distinct g from t order by g") == [(None,), ("a",), ("b",)]
    assert rows(db, "select count(*) as n, sum(v) as s from t where id > 9") == [(0, None)]
    assert rows(db, "select sum(v) + 1 as s from t") == [(19,)]


def test_joins_with_null_keys(db):
    db.execute("create table l (id int, a int); create table r (id int, b int); insert into l values (1, 10), (2, 20), (null, 30); insert into r values (2, 5), (3, 6), (null, 7)")
    assert rows(db, "select a, b from l join r on l.id = r.id") == [(20, 5)]
    assert sorted(rows(db, "select a, b from l left join r on l.id = r.id"), key=str) == [(10, None), (20, 5), (30, None)]
    assert len(rows(db, "select a, b from l full join r on l.id = r.id")) == 5
    assert len(rows(db, "select a, b from l right join r on l.id = r.id and a > 20")) == 3
    assert len(rows(db, "select a, b from l cross join r")) == 9 and len(rows(db, "select a, b from l, r where a > 10")) == 6
    assert rows(db, "select x.a as p, y.a as q from l x join l y on x.id < y.id") == [(10, 20)]
    assert len(db.execute("select * from l join r using (id)").rows.columns) == 4


def test_defaults_and_numbering(db):
    db.execute("create table t (id int not null auto_increment, theme string default 'dark', size int default 14)")
    assert db.execute("insert into t default values").count == 1
    assert db.execute("insert into t (size) values (1), (2)").count == 2
    assert rows(db, "select id, theme, size from t order by id") == [(1, "dark", 14), (2, "dark", 1), (3, "dark", 2)]
    for bad in ("insert into t (id) values (9)", "insert into t (size) values (1, 2)", "insert into t (size, size) values (1, 2)", "insert into t (nothing) values (1)"):
        with pytest.raises(EngineError):
            db.execute(bad)
    assert rows(db, "select count(*) as n from t") == [(3,)]


def test_update_sees_old_values_and_delete_keeps_unknown(db):
    db.execute("create table t (a int, b int); insert into t values (1, 2), (3, 4), (null, 5)")
    assert db.execute("update t set a = b, b = a where a < 3").count == 1
    assert sorted(rows(db, "select a, b from t"), key=str) == [(2, 1), (3, 4), (None, 5)]
    assert db.execute("delete from t where a > 1").count == 2
    assert rows(db, "select a, b from t") == [(None, 5)]
    assert db.execute("insert into t select b, b from t").count == 1
    assert db.execute("delete from t").count == 2 and rows(db, "select a from t") == []


def test_constraints_leave_the_table_as_it_was(db):
    db.execute("create table u (id bigint primary key, mail string unique, age int not null, constraint grown check (age > 17), unique (mail, age)); insert into u values (1, 'a', 20), (2, null, 30), (3, null, 30)")
    for bad, kind in (("insert into u values (1, 'b', 20)", UniqueViolation), ("insert into u values (4, 'a', 20)", UniqueViolation), ("insert into u values (4, 'c', null)", NotNullViolation), ("insert into u values (4, 'c', 3)", CheckViolation), ("update u set age = 1 where id = 1", CheckViolation), ("insert into u values (null, 'd', 40)", NotNullViolation), ("insert into u values ('x', 'd', 40)", ShapeError)):
        with pytest.raises(kind):
            db.execute(bad)
    assert rows(db, "select count(*) as n from u") == [(3,)]


@pytest.mark.parametrize("action", ["cascade", "set null", "restrict", "no action", "set default"])
def test_foreign_keys(db, action):
    db.execute(f"create table p (id int primary key); create table c (id int, pid int references p (id) on delete {action} on update {action}); insert into p values (1), (2); insert into c values (10, 1), (11, 2), (12, null)")
    with pytest.raises(ForeignKeyViolation):
        db.execute("insert into c values (13, 9)")
    if action in ("cascade", "set null"):
        db.execute("delete from p where id = 1")
        assert sorted(rows(db, "select id, pid from c"), key=str) == ([(11, 2), (12, None)] if action == "cascade" else [(10, None), (11, 2), (12, None)])
        db.execute("update p set id = 5 where id = 2")
        assert rows(db, "select pid from c where id = 11") == [(5,) if action == "cascade" else (None,)]
    else:
        for bad in ("delete from p where id = 1", "update p set id = 5 where id = 2", "drop table p"):
            with pytest.raises(ForeignKeyViolation):
                db.execute(bad)


def test_alterations(db):
    db.execute("create table t (id int, name string); insert into t values (1, 'a'), (2, 'b'); alter table t add column score int default 42; alter table t rename column name to label")
    assert rows(db, "select id, label, score from t order by id") == [(1, "a", 42), (2, "b", 42)]
    db.execute("alter table t alter column score set default 7; insert into t (id) values (3); alter table t alter column score drop default; insert into t (id) values (4)")
    assert rows(db, "select score from t where id > 2 order by id") == [(7,), (None,)]
    db.execute("alter table t add constraint small check (id < 4) not valid")
    with pytest.raises(CheckViolation):
        db.execute("alter table t validate constraint small")
    db.execute("alter table t drop constraint small; alter table t add unique (id); alter table t drop column score; alter table t rename to s")
    assert db.execute("select * from s").rows.columns == ["id", "label"]
    with pytest.raises(UniqueViolation):
        db.execute("insert into s values (1, 'z')")
    assert db.execute("alter table if exists gone drop column x").kind == "noop" and db.execute("drop table if exists gone").kind == "noop"
    db.execute("create index i on s (id) using btree; create index j on s (label)")
    assert [r[0] for r in rows(db, "show indexes from s")] == ["i", "j"]
    db.execute("drop index i on s")
    with pytest.raises(NameError_):
        db.execute("drop index i on s")


def test_transactions_and_savepoints(db):
    db.execute("create table t (id int); begin; insert into t values (1); savepoint a; insert into t values (2); savepoint b; insert into t values (3); rollback to b")
    assert rows(db, "select count(*) as n from t") == [(2,)]
    db.execute("rollback to a; commit")
    assert rows(db, "select id from t") == [(1,)]
    db.execute("begin; insert into t values (2)")
    with pytest.raises(NameError_):
        db.execute("insert into nowhere values (1)")
    with pytest.raises(TransactionAborted):
        db.execute("select id from t")
    assert db.execute("commit").kind == "rolled back"
    assert rows(db, "select id from t") == [(1,)]
    assert db.execute("commit").kind == "notice"
    with pytest.raises(EngineError):
        db.execute("savepoint x")


def test_readers_keep_their_snapshot(db):
    db.execute("create table t (id int); insert into t values (1)")
    before = db.execute("select id from t").rows
    db.execute("insert into t values (2)")
    assert before.count() == 1 and len(rows(db, "select id from t")) == 2


@pytest.mark.parametrize("bad", ["", "select", "select a", "select a from", "frobnicate t", "select f(a) from t", "select a from t limit 1.5", "insert into t", "select a from t where a ~ 1", "create table t (a int"])
def test_malformed_statements(bad):
    with pytest.raises(ParseError):
        parse(bad)


def test_precedence_and_comments():
    assert parse("select a + b * c from t -- end\n")[0].items[0][0] == ("+", ("col", "a"), ("*", ("col", "b"), ("col", "c")))
    assert parse("select a or b and not c = d /* x */ from t")[0].items[0][0] == ("or", ("col", "a"), ("and", ("col", "b"), ("not", ("=", ("col", "c"), ("col", "d")))))


def test_columns_named_by_type_words(db):
    db.execute("create table t (text string, date int, key int); insert into t values ('x', 1, 2)")
    assert rows(db, "select text, date, key from t") == [("x", 1, 2)]


def test_filters_and_columns_reach_the_scan(spark):
    db = Database.over_parquet(spark, "/root/testdata/sf0.001")
    plan = spark._jvm.PythonSQLUtils.explainString(db.execute("select l_orderkey from lineitem where l_quantity > 49.0").rows._jdf.queryExecution(), "formatted")
    assert "GreaterThan(l_quantity,49.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_operators_on_null_rows(spark):
    from lakemill.operators import relops as R

    a, b = spark.createDataFrame([(1, None), (1, None), (2, 3)], "a int, b int"), spark.createDataFrame([(1, None)], "x int, y int")
    assert [tuple(r) for r in R.intersect(a, b, True).collect()] == [(1, None), (1, None)] and R.intersect(a, b).count() == 1
    assert [tuple(r) for r in R.except_(a, b, True).collect()] == [(2, 3)]
    assert R.union(a, b).count() == 2 and R.union(a, b, True).count() == 4
    assert R.aggregate(a, ["b"], n=F.count(F.lit(1))).count() == 2


def test_saving_over_its_own_folder_keeps_every_row(spark, tmp_path):
    from lakemill.sources.tables import save_database

    spark.range(5).selectExpr("id as r_regionkey", "cast(id as string) as r_name").write.parquet(str(tmp_path / "region.parquet"))
    db = Database.over_parquet(spark, str(tmp_path), ["region"])
    db.execute("delete from region where r_regionkey = 2; insert into region values (9, 'new')")
    save_database(db, str(tmp_path))
    save_database(db, str(tmp_path))
    again = Database.over_parquet(spark, str(tmp_path), ["region"])
    for own in (db, again):
        assert rows(own, "select r_regionkey from region order by r_regionkey") == [(0,), (1,), (3,), (4,), (9,)]
    assert [p.name for p in tmp_path.iterdir()] == ["region.parquet"]


def test_checks_that_are_not_valid_bind_new_rows(db):
    db.execute("create table t (id int, n int); insert into t values (1, 1), (50, 2); alter table t add constraint small check (id < 10) not valid")
    for bad in ("insert into t values (60, 3)", "update t set id = 70 where n = 1"):
        with pytest.raises(CheckViolation):
            db.execute(bad)
    assert db.execute("insert into t values (2, 3)").count == 1 and rows(db, "select count(*) as n from t") == [(3,)]


def test_division_in_joins_values_and_defaults(db):
    db.execute("create table p (x float, k int default 7 / 2); create table q (y float, j int); insert into p (x) values (1.0 / 4.0), (3.0); insert into q values (1.5, 3), (9.0, 4)")
    assert rows(db, "select x, k from p order by x") == [(0.25, 3), (3.0, 3)]
    assert rows(db, "select p.x as x from p join q on p.x / 2.0 = q.y") == [(3.0,)]
    assert rows(db, "select q.j as j from p join q on p.k / 2 = q.j / 3 and x > 1.0 order by j") == [(3,), (4,)]


@pytest.mark.parametrize(
    ("kind", "on"),
    [
        ("inner", "p.x = q.x or p.y = q.y"),
        ("full", "p.x = q.x or p.y = q.y"),
        ("left", "(p.x = q.x or p.y + 1 = q.y or y2 = q.x) and p.x < 3"),
        ("right", "p.x = q.x and p.y < 2 or p.x = q.x and q.y > 1 or p.y = q.x and not q.y = 1"),
    ],
)
def test_joins_on_either_of_two_equalities_compare_no_pairs_without_a_key(db, spark, kind, on):
    db.execute("create table p (x int, y int, y2 int); insert into p values (1, 1, 2), (1, 1, 2), (2, null, 1), (null, 2, 3), (null, null, null), (5, 6, 7), (3, 1, 1); create table q (x int, y int); insert into q values (1, 1), (1, 2), (null, 2), (null, null), (2, 1), (1, 1), (8, 9), (3, 3)")
    got = db.execute(f"select p.x as a, p.y as b, p.y2 as e, q.x as c, q.y as d from p {kind} join q on {on}").rows
    want = db.table("p").df.alias("p").join(db.table("q").df.alias("q"), F.expr(on), kind).select("p.x", "p.y", "p.y2", "q.x", "q.y")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert "NestedLoop" not in (plan := got._jdf.queryExecution().sparkPlan().toString()) and "Cartesian" not in plan
    if kind != "inner":
        return
    again = db.execute(f"select p.x as a, o.x as c from p {kind} join q on {on} join p o on o.x = q.y or o.y = p.x").rows
    assert "NestedLoop" not in again._jdf.queryExecution().sparkPlan().toString()
    want = db.table("p").df.alias("p").join(db.table("q").df.alias("q"), F.expr(on), kind).join(db.table("p").df.alias("o"), F.expr("o.x = q.y or o.y = p.x")).select("p.x", "o.x")
    assert sorted(map(repr, map(tuple, again.collect()))) == sorted(map(repr, map(tuple, want.collect())))


@pytest.fixture(scope="module")
def few_keys(spark, tmp_path_factory):
    """Two small files of which a join on k meets in very many pairs."""
    folder = tmp_path_factory.mktemp("few")
    for name, seed in (("supplier", 1), ("customer", 2)):
        spark.range(0, 20000, 1, 1).select(F.col("id").alias("i"), (F.col("id") % 5).alias("k"), F.rand(seed).alias("v")).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def shares(df):
    """Rows of each task of a join, in order."""
    return sorted(r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())


def test_joins_of_small_files_on_few_keys_fill_several_tasks(spark, few_keys):
    import duckdb

    got = Database.over_parquet(spark, few_keys).execute("select s.i as a, c.i as b from supplier s join customer c on s.k = c.k and s.v > c.v").rows
    own = shares(got)
    want = duckdb.connect().execute(f"select count(*) from '{few_keys}/supplier.parquet/*.parquet' s join '{few_keys}/customer.parquet/*.parquet' c on s.k = c.k and s.v > c.v").fetchall()
    assert sum(own) == want[0][0] and len(own) >= 8 and own[-1] < sum(own) / 4


def test_self_joins_on_few_keys_fill_several_tasks(spark, few_keys):
    own = shares(Database.over_parquet(spark, few_keys).execute("select a.i as x, b.i as y from supplier a join supplier b on a.k = b.k").rows)
    assert sum(own) == 5 * 4000**2 and len(own) >= 8 and own[-1] < sum(own) / 4


@pytest.mark.parametrize("kind", ["inner", "left", "right", "full", "cross"])
def test_dealing_a_join_out_keeps_its_rows(spark, monkeypatch, kind):
    from lakemill.operators import relops as R

    a, b = spark.sql("select * from values (1, 1), (1, 1), (2, null), (null, 4), (7, 0) t(x, y)"), spark.sql("select * from values (1, 0), (1, 2), (1, 0), (null, 4), (9, 9) t(u, w)")
    on = None if kind == "cross" else (F.col("x") == F.col("u")) & (F.col("y") > F.col("w"))
    want = a.crossJoin(b) if on is None else a.join(b, on, kind)
    monkeypatch.setattr(R, "FEW_PAIRS", 0)
    got = R.join(a, b, on, kind)
    assert ("Repartition " in got._jdf.queryExecution().optimizedPlan().toString()) == (kind != "full")
    assert got.columns == want.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_any_column_name_takes_values(db):
    db.execute("create table t (k int, r string); insert into t values (1, 'a'), (2, 'b')")
    assert rows(db, "select k, r from t order by k") == [(1, "a"), (2, "b")]


def test_dropping_a_column_drops_its_checks(db):
    db.execute("create table t (id int, age int, constraint grown check (age > 17 and id > 0)); alter table t drop column age; insert into t values (1)")
    assert rows(db, "select id from t") == [(1,)] and db.constraints().count() == 0


def test_times_of_day(db):
    db.execute("create table t (id int, at time); insert into t values (1, '10:30:00'), (2, '00:00:01.5'), (3, null)")
    assert rows(db, "select id, at from t order by id") == [(1, 37_800_000_000), (2, 1_500_000), (3, None)]
    with pytest.raises(ShapeError):
        db.execute("insert into t values (4, '25:00')")


def test_json_keys_and_paths_from_columns(db):
    db.execute("create table t (id int, j json, k string, p string, n int); insert into t values (1, '{\"a\": {\"b\": [1, \"x\"]}}', 'a', '{a,b,1}', 0), (2, '[5, 6]', 'a', '{1}', 1), (3, null, 'a', '{}', 0)")
    assert rows(db, "select j -> k as v, j ->> k as w from t order by id") == [('{"b":[1,"x"]}', '{"b":[1,"x"]}'), (None, None), (None, None)]
    assert rows(db, "select j -> n as v, j #> p as w, j #>> p as x, j ? k as y from t order by id") == [(None, '"x"', "x", True), ("6", "6", "6", False), (None, None, None, None)]


def test_errors_of_names_shapes_and_arithmetic(db):
    from lakemill.plans.errors import ArithmeticFault

    db.execute("create table t (id int, g int); create table u (id int); insert into t values (1, 0)")
    for bad, kind, says in (("select nothing from t", NameError_, "nothing"), ("select id from t join u on t.id = u.id", NameError_, "id"), ("select id, count(*) as n from t group by g", ShapeError, "GROUP BY"), ("insert into t values (1 / 0, 2)", ArithmeticFault, "zero")):
        with pytest.raises(kind, match=says):
            db.execute(bad)
    assert rows(db, "select t.g as g, count(*) as n from t group by g") == [(0, 1)]
    assert rows(db, "select g, count(*) + 1 as n, 5 as five from t group by t.g") == [(0, 2, 5)]


def test_the_catalog_lists_constraints_and_defaults(db):
    db.execute("create table p (id int primary key, n int default 4); create table c (id int, pid int references p (id) on delete cascade, constraint small check (id < 10))")
    got = {(r.table_name, r.kind, r.columns, r.parent, r.on_delete) for r in db.constraints().collect()}
    assert got == {("p", "primary", "id", None, None), ("c", "foreign", "pid", "p", "cascade"), ("c", "check", "id", None, None)}
    assert [tuple(r) for r in db.defaults().collect()] == [("p", "n", "4")]


def test_one_writer_at_a_time(db):
    from concurrent.futures import ThreadPoolExecutor

    db.execute("create table t (id int not null auto_increment, v int)")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: db.execute(f"insert into t (v) values ({k})"), range(8)))
    assert rows(db, "select count(*) as n, min(id) as lo, max(id) as hi from t") == [(8, 1, 8)]
