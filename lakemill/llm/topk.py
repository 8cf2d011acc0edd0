"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length (Euclidean norm), longest first, in blocks of bounded size. A first block gives each query
a threshold: its k-th best score so far. For every other block the threshold becomes a local cosine threshold
t = threshold / (|q| longest): over 1, the block is pruned for the query, before either is sent anywhere; near 1, only candidates whose coordinate on the
query's largest axis lies in the range that the cosine bound allows are left; otherwise candidates too short for the
threshold go. What is left is verified with exact products.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakemill.llm.batches import slices
from lakemill.llm.store import materialise
from lakemill.llm.vectors import doubles, valid

_COORDINATE = 0.5  # local cosine thresholds from which one coordinate prunes better than lengths
_SCORES = "query_uid long, query_id long, vec_id long, score long"
_RATIO = 1.01  # lengths within this ratio share a bucket
_SCORED = 1 << 21  # products held at a time
_NO_ID = 2**63 - 1  # inside this module a row without an id has this one


def _whole(scale: float):
    def run(batches):
        for batch in slices(batches, 2048):
            rows = [np.floor(scale * np.array(v, np.float64)) for v in batch.column(2).to_pylist()]
            if any(len(v) and np.abs(v).max() >= 2.0**62 for v in rows):
                raise ValueError("a scaled component is beyond 64 bits")
            norms = np.array([np.sqrt((v * v).sum()) for v in rows])
            bucket = np.where(norms > 0, -np.floor(np.log(np.where(norms > 0, norms, 1)) / math.log(_RATIO)), np.iinfo(np.int32).max).astype(np.int32)
            ints = [v.astype("<i2" if not len(v) or np.abs(v).max() < 2.0**15 else "<i8").tobytes() for v in rows]
            columns = [batch.column(0), batch.column(1), pa.array([len(v) for v in rows], pa.int32()), pa.array(norms), pa.array(bucket), pa.array(ints, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "vec_id", "dim", "norm", "bucket", "ints"])

    return run


def _rows(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Whole vectors, stored in 16 bits where that is enough for one."""
    if not dim:
        return np.zeros((len(column), 0))
    raw = column.to_pylist()
    out = np.empty((len(raw), dim), np.int64)
    short = np.array([len(x) == 2 * dim for x in raw])
    for at, kind in ((np.flatnonzero(short), "<i2"), (np.flatnonzero(~short), "<i8")):
        if len(at):
            out[at] = np.frombuffer(b"".join([raw[k] for k in at]), kind).reshape(-1, dim)
    return out


def exact_kind(dim: int, queries: np.ndarray, candidates: np.ndarray) -> type:
    """Doubles where no sum can pass 2^53, integers otherwise."""
    bound = max(1, dim) * float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0))
    if bound >= 2.0**63:
        raise ValueError("a score can be beyond 64 bits")
    return np.float64 if bound < 2.0**53 else np.int64


def _search(k: int):
    def run(key, queries, candidates):
        found: list[tuple[np.ndarray, ...]] = []
        if queries.num_rows and candidates.num_rows:
            dim = queries["dim"][0].as_py()
            q, p = _rows(queries["ints"], dim), _rows(candidates["ints"], dim)
            kind = exact_kind(dim, q, p)
            norm, uids, own = (candidates[c].to_numpy() for c in ("norm", "uid", "vec_id"))
            order = np.lexsort((own, -norm))
            p, norm, uids, own = p[order].astype(kind), norm[order], uids[order], own[order]
            asked, size = queries["uid"].to_numpy(), queries["norm"].to_numpy()
            least = np.nextafter(queries["least"].to_numpy().astype(float), -np.inf)  # NaN: none yet; never above the whole number
            top = size * norm[0] * (1 + 1e-9)
            local = np.where(top > 0, least / np.where(top > 0, top, 1), 0.0)

            def keep(at: int, some: np.ndarray, score: np.ndarray):
                """The best of some candidates for a query; ties beyond the k-th go by id."""
                good = np.flatnonzero(~(score < least[at]))
                good = good[uids[some[good]] != asked[at]]
                if len(good) > k:
                    good = good[score[good] >= np.partition(score[good], len(good) - k)[len(good) - k]]
                good = good[np.lexsort((own[some[good]], -score[good]))][:k]
                found.append((np.full(len(good), at), some[good], score[good].astype(np.int64)))

            by_axis: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            unit = None
            whole = []
            for at in np.flatnonzero(~(top < least)):
                some = None
                if local[at] >= _COORDINATE:
                    unit = p / np.where(norm > 0, norm, 1)[:, None] if unit is None else unit
                    axis = int(np.abs(q[at]).argmax())
                    if axis not in by_axis:
                        by = np.argsort(unit[:, axis], kind="stable")
                        by_axis[axis] = by, unit[by, axis]
                    by, values = by_axis[axis]
                    cosine, mine = min(local[at], 1.0), q[at, axis] / size[at]
                    wide = np.sqrt(max(0.0, (1 - cosine**2) * (1 - mine**2))) + 1e-9
                    low = -np.inf if mine <= -cosine else mine * cosine - wide  # the axis' far end lies within the cone
                    high = np.inf if mine >= cosine else mine * cosine + wide
                    some = by[np.searchsorted(values, low) : np.searchsorted(values, high, "right")]
                elif local[at] > 0:
                    some = np.arange(np.searchsorted(-norm * size[at] * (1 + 1e-9), -least[at], "right"))
                if some is None or 2 * len(some) > len(p):
                    whole.append(at)  # little to prune: products in tiles
                elif len(some):
                    keep(at, some, p[some] @ q[at].astype(kind))
            every, tile = np.arange(len(p)), max(1, _SCORED // len(p))
            for s in range(0, len(whole), tile):
                for at, score in zip(whole[s : s + tile], q[whole[s : s + tile]].astype(kind) @ p.T, strict=True):
                    keep(at, every, score)
        a, b, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        if not len(a):
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_uid", "query_id", "vec_id", "score")})
        ids = candidates["vec_id"].take(pa.array(order[b]))
        return pa.table({"query_uid": pa.array(asked[a]), "query_id": queries["vec_id"].take(pa.array(a)), "vec_id": pc.if_else(pc.equal(ids, _NO_ID), pa.scalar(None, pa.int64()), ids), "score": pa.array(score)})

    return run


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_uid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(counts: list[tuple[int, int, int, float]], rows: int) -> list[tuple[int, int, int, int, int, float]]:
    """(dim, bucket, first block, blocks, longest of the block): neighbouring buckets, longest first, share a block of up to
    ``rows`` vectors; a bucket of more is dealt to several. Lengths have at most some 4,600 buckets in a dimension."""
    out, block, held, last, own = [], -1, 0, None, []
    for dim, bucket, n, longest in sorted(counts):
        if dim != last or held + n > rows:
            block, held, last, own = block + 1, 0, dim, []
        parts = -(-n // rows)
        head = own[0] if own else longest
        own.append(head)
        out.append((dim, bucket, block, parts, head))
        held += n
        if parts > 1:
            block, held = block + parts - 1, rows + 1
    return out


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", embedding_col: str = "embedding", block: int | None = None, query_block: int = 8192, block_bytes: int = 1 << 25) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all other rows for each row whose id is divisible by ``every``.

    Components become floor(scale * x); ties go to the smaller id, no id last. Vectors that are null or hold null or
    non-finite components take no part; vectors meet only those of their own dimension. Rows that repeat an id, or have none,
    are rows of their own. No rows in, none out; extra columns are not read.

    No task holds more than a block of candidates (``block`` rows; where it isn't given, enough blocks to keep every core
    busy twice, of at most ``block_bytes``) and a block of queries. A query is sent only to blocks whose longest vector could
    reach its threshold, and a block only to those shares of the queries that still need it.
    """
    spark = vectors.sparkSession
    rows = doubles(vectors.where(valid(embedding_col)).select(F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("vec_id"), F.col(embedding_col).alias("v")), "v")
    packed = materialise(rows.mapInArrow(_whole(scale), "uid long, vec_id long, dim int, norm double, bucket int, ints binary"), "whole")
    counts = [tuple(r) for r in packed.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).select("dim", "bucket", "n", "longest").collect()]
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    widest = max(c[0] for c in counts)
    size = block or min(max(512, -(-sum(c[2] for c in counts) // (2 * spark.sparkContext.defaultParallelism))), max(512, block_bytes // (8 * max(widest, 1))))
    where = spark.createDataFrame(_blocks(counts, size), "dim int, bucket int, base int, parts int, longest double")
    heads = F.broadcast(where.groupBy("dim").agg(F.min("base").alias("block")))
    blocks = packed.join(F.broadcast(where), ["dim", "bucket"]).withColumn("block", F.col("base") + F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    spread = where.select("dim", "longest", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("parts") - 1)).alias("block"))
    bounds = spread.groupBy("dim", "block").agg(F.max("longest").alias("longest")).join(heads, ["dim", "block"], "left_anti")
    queries = packed.where((F.col("vec_id") % every == 0) & (F.col("vec_id") != _NO_ID)).drop("bucket")
    shares = max(1, -(-queries.count() // query_block))
    queries = queries.withColumn("share", F.pmod(F.xxhash64("uid"), F.lit(shares)).cast("int"))

    def searched(asked: DataFrame) -> DataFrame:
        keys = ["block", "share"]
        needed = materialise(asked.select("block", "share").distinct(), "needed").withColumnRenamed("block", "of")  # written: its size is known to the join
        offered = blocks.join(needed, F.col("block") == F.col("of")).select(*keys, "uid", "vec_id", "norm", "ints")
        asked = asked.select(*[F.col(c).alias(c) for c in (*keys, "uid", "vec_id", "dim", "norm", "ints", "least")])  # new columns: both sides come from one table
        return asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(_search(k), _SCORES)

    opening = materialise(searched(queries.join(heads, "dim").withColumn("least", F.lit(None).cast("long"))), "opening")
    least = opening.groupBy("query_uid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least")).withColumnRenamed("query_uid", "uid")
    # A length bound prunes positive thresholds only; the products' bound |q| * longest is never below 0.
    can = F.col("least").isNull() | (F.col("least") <= F.col("norm") * F.col("longest") * (1 + 1e-9))
    asked = materialise(queries.join(least, "uid", "left").join(F.broadcast(bounds), "dim").where(can).drop("longest"), "asked")
    return _best(opening.union(searched(asked)), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
