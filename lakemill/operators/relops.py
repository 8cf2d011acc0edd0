"""Relational operators as functions from DataFrames to lazy DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "cross": "cross", "semi": "left_semi", "anti": "left_anti"}


#: A side of a join that Spark takes for no more bytes than these may be sent whole to all tasks.
SENT_WHOLE = 16 << 20
#: Sides whose bytes multiply to fewer meet in too few pairs to deal them out.
FEW_PAIRS = 1 << 34
#: A table of so many bytes for each core is read in enough tasks by itself.
READ_BY_A_TASK = 128 << 20


def filter_(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows where the predicate is true; false and null drop."""
    return df.where(predicate)


def project(df: DataFrame, **items: Column) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in items.items()])


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _dealt(left: DataFrame, right: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Both sides as they are, or the smaller sent whole and the other dealt over several tasks a core. Two tables of a few MB
    can meet in billions of pairs, while Spark, which counts bytes, reads each in one task and gathers a key's rows in one."""
    sides, may = [left, right], {"inner": [1, 0], "cross": [1, 0], "left": [1], "right": [0]}.get(kind)
    if may is None or left.isStreaming or right.isStreaming:
        return left, right
    spark, size = left.sparkSession, [_bytes(df) for df in sides]
    cores = spark.sparkContext.defaultParallelism
    whole = min(may, key=size.__getitem__)
    if size[whole] <= SENT_WHOLE and size[0] * size[1] >= FEW_PAIRS and size[1 - whole] < cores * READ_BY_A_TASK:
        sides[whole], sides[1 - whole] = F.broadcast(sides[whole]), sides[1 - whole].repartition(max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return sides[0], sides[1]


def join(left: DataFrame, right: DataFrame, on: Column | None = None, kind: str = "inner", residual: Column | None = None) -> DataFrame:
    """Any join kind on any condition; Catalyst takes the equalities out of it. A residual is part of the condition."""
    left, right = _dealt(left, right, "cross" if on is None else kind)
    if on is None:
        return left.crossJoin(right)
    return left.join(right, on if residual is None else on & residual, JOINS[kind])


def join_any(left: DataFrame, right: DataFrame, arms: list[Column], kind: str = "inner") -> DataFrame:
    """A join on any of several conditions, of which each holds an equality: Catalyst finds no key in an OR and would compare
    all pairs. One join for each, with a pair in the first that is true for it; outer rows are those that no condition takes."""
    parts = [join(left, right, reduce(lambda own, before: own & ~F.coalesce(before, F.lit(False)), arms[:k], arm)) for k, arm in enumerate(arms)]
    if kind in ("left", "full"):
        alone = reduce(lambda rows, arm: join(rows, right, arm, "anti"), arms, left)
        parts.append(alone.select("*", *[F.lit(None).cast(f.dataType) for f in right.schema]))
    if kind in ("right", "full"):
        alone = reduce(lambda rows, arm: join(rows, left, arm, "anti"), arms, right)
        parts.append(alone.select(*[F.lit(None).cast(f.dataType) for f in left.schema], "*"))
    return reduce(DataFrame.union, parts)


def join_using(left: DataFrame, right: DataFrame, columns: list[str], kind: str = "inner") -> DataFrame:
    """Equality on the named columns of both sides, both copies kept."""
    return join(left, right, reduce(lambda a, b: a & b, [left[c] == right[c] for c in columns]), kind)


def aggregate(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    named = [c.alias(n) for n, c in aggs.items()]
    return df.groupBy(*by).agg(*named) if named else df.select(*by).distinct()


def sort(df: DataFrame, *keys: str) -> DataFrame:
    """'-name' is descending; nulls come first ascending and last descending."""
    return df.orderBy(*[F.col(k[1:]).desc_nulls_last() if k[0] == "-" else F.col(k).asc_nulls_first() for k in keys])


def limit(df: DataFrame, n: int | None = None, offset: int = 0) -> DataFrame:
    df = df.offset(offset) if offset else df
    return df if n is None else df.limit(n)


def distinct_sorted_by(df: DataFrame, columns: list[str], hidden: str) -> DataFrame:
    """DISTINCT ordered by a column that is not kept: each row by the least of its hidden keys."""
    return df.groupBy(*columns).agg(F.min(hidden).alias("__key")).orderBy(F.col("__key").asc_nulls_first(), *columns).select(*columns)


def union(left: DataFrame, right: DataFrame, all_: bool = False) -> DataFrame:
    both = left.union(right)
    return both if all_ else both.distinct()


def _matching(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    names = [f"__r{k}" for k in range(len(left.columns))]
    other = right.toDF(*names)
    return left.join(other, reduce(lambda a, b: a & b, [left[c].eqNullSafe(other[n]) for c, n in zip(left.columns, names, strict=True)]), kind)


def intersect(left: DataFrame, right: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    """ANSI INTERSECT, or every left row that the right side has, duplicates kept; nulls match nulls."""
    return _matching(left, right, "left_semi") if keep_duplicates else left.intersect(right)


def except_(left: DataFrame, right: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    return _matching(left, right, "left_anti") if keep_duplicates else left.subtract(right)


def index_search(df: DataFrame, **keys) -> DataFrame:
    """Rows of a composite key; the scan prunes by Parquet statistics."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in keys.items()]))


def index_range(df: DataFrame, columns: list[str], low: tuple, high: tuple) -> DataFrame:
    """Inclusive at both ends, lexicographic for several columns; the first column's bounds reach the scan."""
    first = F.col(columns[0]).between(low[0], high[0])
    if len(columns) == 1:
        return df.where(first)
    lows, highs = (F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(columns, end, strict=True)]) for end in (low, high))
    return df.where(first & F.struct(*columns).between(lows, highs))
