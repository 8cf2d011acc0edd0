import json

import pytest
from pyspark.sql import functions as F

from lakemill.plans.errors import EngineError, NameError_
from lakemill.plans.registry import Registry, Shell
from lakemill.sources.tables import append, json_rows, read_table, run_script, save_database, statements, write_table
from lakemill.streaming.frames import read_stream, windowed, write_stream


def test_tables_are_written_appended_and_read(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    write_table(spark.range(10), path, sort=["id"])
    append(spark.range(10, 12), path)
    assert sorted(r.id for r in read_table(spark, path).collect()) == list(range(12))
    write_table(spark.range(3).selectExpr("id", "id % 2 as k"), f"file://{tmp_path}/c", "csv", by=["k"])
    assert read_table(spark, f"file://{tmp_path}/c", "csv", "id long").count() == 3


def test_scripts_split_outside_strings():
    assert statements("-- a comment; no statement\nselect 'a;b' from t;\n\nselect 1 from t") == ["select 'a;b' from t", "select 1 from t"]


def test_a_script_runs_and_the_database_is_saved(spark, tmp_path):
    db = Registry(spark).create("shop")
    out = run_script(db, "create table t (id int, name string); insert into t values (1, 'x;y'), (2, null); select name from t order by id;")
    assert [r.name for r in out[-1].rows.collect()] == [None, "x;y"][::-1]
    save_database(db, f"file://{tmp_path}/db")
    assert read_table(spark, f"file://{tmp_path}/db/t.parquet").count() == 2


def test_rows_for_clients_keep_large_integers_and_drop_infinities(spark):
    df = spark.sql("select 9007199254740993L as big, 5L as small, double('inf') as f, 1.5D as g, date'1970-01-03' as d, timestamp_ntz'1970-01-01 00:00:01' as t")
    assert json.loads(json_rows(df).first()["json"]) == {"big": "9007199254740993", "small": 5, "f": None, "g": 1.5, "d": 2, "t": 1_000_000}


def test_database_names(spark):
    registry = Registry(spark)
    registry.create("a1")
    for bad in ("", "1a", "a-b", "a" * 64, "a1"):
        with pytest.raises(NameError_):
            registry.create(bad)
    with pytest.raises(NameError_):
        registry.get("b")
    assert registry.names() == ["a1"]


def test_the_shell_answers_commands_and_statements(spark):
    shell = Shell(Registry(spark).create("s"))
    assert "table created" in shell.run("create table t (id int)")
    shell.run("insert into t values (7)")
    assert "7" in shell.run("select id from t") and "t" in shell.run(r"\dt") and "int" in shell.run(r"\d t")
    assert "on" in shell.run(r"\timing") and " s" in shell.run("select id from t")
    assert "Scan" in shell.run(r"\explain select id from t") and shell.run(r"\help")
    with pytest.raises(EngineError):
        shell.run("select id from nowhere")
    shell.run(r"\q")
    assert not shell.open


def test_windows_over_a_stream_equal_the_batch(spark, tmp_path):
    rows = spark.range(100).select((F.lit(0) + F.col("id")).cast("timestamp").alias("ts"), (F.col("id") % 3).alias("k"), "id")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = windowed(read_stream(spark, f"{tmp_path}/in", rows.schema), "ts", "10 seconds", "5 seconds", ["k"], n=F.count(F.lit(1)), s=F.sum("id"))
    write_stream(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    own = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("start", "k", "n", "s").collect()}
    batch = {tuple(r) for r in windowed(rows, "ts", "10 seconds", "5 seconds", ["k"], n=F.count(F.lit(1)), s=F.sum("id")).select("start", "k", "n", "s").collect()}
    assert own <= batch and len(own) >= 27 - 3
