"""Tables in and out: files of any format that Spark knows, snapshots, statements from scripts, rows for clients."""

from __future__ import annotations

import uuid
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.plans.session import Database, Result

#: Whole numbers beyond this don't survive a client's doubles.
SAFE_INTEGER = 2**53


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", by: list[str] | None = None, sort: list[str] | None = None) -> None:
    """Writes a table; ``sort`` clusters each file, so that later lookups and ranges on those columns skip row groups."""
    if sort:
        df = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    writer = df.write.format(kind).mode(mode)
    (writer.partitionBy(*by) if by else writer).save(path)


def append(df: DataFrame, path: str) -> None:
    """A heap insert: adds rows to a stored table without reading it."""
    write_table(df, path, mode="append")


def save_database(db: Database, folder: str, names: list[str] | None = None) -> None:
    """Writes the current snapshot of each named table (all: those that statements have touched) under a folder.

    A snapshot may still read the very files that it replaces: every table is written beside its place first and moved there
    only when all are complete. The database then reads what was saved; snapshots that read replaced files end with them.
    """
    spark = db.spark
    Path_ = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    moves = []
    for name in names or sorted(db.tables):
        fresh = f"{folder}/.{name}.parquet-{uuid.uuid4().hex}"
        write_table(db.table(name).df, fresh)
        moves.append((name, Path_(fresh), Path_(f"{folder}/{name}.parquet")))
    for name, fresh, place in moves:
        store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        old = Path_(f"{folder}/.{name}.parquet-{uuid.uuid4().hex}")
        if store.exists(place) and not store.rename(place, old):
            raise OSError(f"{place} could not be moved away")
        if not store.rename(fresh, place):
            store.rename(old, place)
            raise OSError(f"{fresh} could not be moved to {place}")
        store.delete(old, True)
        spark.catalog.refreshByPath(str(place.toString()))
        db.tables[name] = replace(db.tables[name], df=spark.read.schema(db.tables[name].df.schema).parquet(place.toString()))


def statements(script: str) -> list[str]:
    """The statements of a script: lines that are comments go, and semicolons outside strings part the rest."""
    text = "\n".join(line for line in script.splitlines() if not line.lstrip().startswith("--"))
    out, own, quote = [], [], ""
    for ch in text:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        if ch == ";" and not quote:
            out.append("".join(own).strip())
            own = []
        else:
            own.append(ch)
    return [s for s in [*out, "".join(own).strip()] if s]


def run_script(db: Database, script: str | Path) -> list[Result]:
    """Runs a script, text or a file, statement by statement; the first failure stops it."""
    text = script.read_text() if isinstance(script, Path) else script
    return [db.execute(s) for s in statements(text)]


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text for each row: integers beyond 2^53 as text, non-finite numbers as null, dates as day counts, times of day
    and timestamps as microseconds, JSON columns (marked so in their metadata) inlined."""

    def value(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if f.metadata.get("logical") == "json":
            c = F.try_parse_json(c)
        elif isinstance(f.dataType, T.LongType | T.DecimalType):
            c = F.when(F.abs(c.cast("decimal(38,0)")) > SAFE_INTEGER, F.try_parse_json(F.concat(F.lit('"'), c.cast("string"), F.lit('"')))).otherwise(F.try_parse_json(c.cast("string")))
        elif isinstance(f.dataType, T.FloatType | T.DoubleType):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        elif isinstance(f.dataType, T.DateType):
            c = F.unix_date(c)
        elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            c = F.unix_micros(c.cast("timestamp"))
        return c.alias(f.name)

    return df.select(F.to_json(F.struct(*[value(f) for f in df.schema]), {"ignoreNullFields": "false"}).alias("json"))


def render(df: DataFrame, rows: int = 20) -> str:
    """A table for a terminal: at most so many rows."""
    return df._show_string(rows, False)
