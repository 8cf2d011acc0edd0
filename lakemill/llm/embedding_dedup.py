"""Near duplicates among vectors by collision-counting projections.

On a Gaussian axis the projections of two unit vectors are bivariate normal with their cosine as correlation, whatever the
data. Windows in the middle of an axis hold most of all vectors, so they tell little; its ends hold few. Each end of many
axes therefore keeps a sorted list of the vectors beyond a threshold, chosen so that lists have about sqrt(2 N) members, and
there are as many lists as a pair just at the wanted cosine needs to share one with the wanted probability. A vector is in a
dozen lists at any N: what is shuffled grows with the rows, the work as N^1.5.

Within a list, a pair must lie in a window centred at either value. Collisions in query-centred windows on further axes are
counted for each pair, and only pairs with enough of them are verified in double precision. The count is the largest that
keeps the wanted recall for a pair just at the threshold, by the binomial law; closer pairs collide more often.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.batches import slices
from lakemill.llm.graph import components
from lakemill.llm.store import materialise
from lakemill.llm.vectors import doubles, matrix, valid

AXES, SEED, STEPS = 20, 20_240, 6
_FIRST, _OTHER = 4.0, 1.6  # half windows, in deviations of a pair at the threshold
_TILE, _CHUNK, _PAIRS = 256, 512, 1 << 13
RECALL = 0.998  # of sharing a list, and of reaching the count


def least_count(axes: int = AXES, recall: float = RECALL, half: float = _OTHER) -> int:
    """The largest count of collisions that a pair at the threshold reaches with probability ``recall``."""
    p, above = math.erf(half / math.sqrt(2)), 0.0
    for count in range(axes, -1, -1):
        above += math.comb(axes, count) * p**count * (1 - p) ** (axes - count)
        if above >= recall:
            return count
    return 0


def both_beyond(tau: float, cosine: float) -> float:
    """The probability that both of two standard normals of this correlation are over ``tau``."""
    c = min(max(cosine, -1 + 1e-9), 1 - 1e-9)
    x = np.linspace(tau, tau + 10, 4001)
    rest = np.array([0.5 * math.erfc(z / math.sqrt(2)) for z in (tau - c * x) / math.sqrt(1 - c * c)])
    y = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * rest
    return float(((y[1:] + y[:-1]) / 2).sum() * (x[1] - x[0]))


def lists_for(total: int, cosine: float, recall: float = RECALL) -> tuple[float, int, int]:
    """(threshold, number of lists, members expected in each) for so many vectors."""
    members = max(512.0, math.sqrt(2 * total))
    tau = NormalDist().inv_cdf(1 - min(0.1, members / max(total, 1)))
    return tau, math.ceil(math.log(1 / (1 - recall)) / both_beyond(tau, cosine)), math.ceil(members)


@lru_cache(64)
def axes_of(dim: int, chunk: int, many: int = _CHUNK) -> np.ndarray:
    """Gaussian axes as columns, fixed for each dimension and chunk."""
    return np.random.default_rng((SEED, dim, chunk + 1)).standard_normal((dim, many))


def _unit(column: pa.Array, dim: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and unit vectors in doubles, by dimension."""
    out = {}
    for d in np.unique(dim):
        at = np.flatnonzero(dim == d)
        v = matrix(column.take(pa.array(at)), "<f8", int(d))
        v = v / np.abs(v).max(axis=1, keepdims=True)
        out[int(d)] = at, v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    return out


def _members(unit: np.ndarray, tau: float, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, value) of every membership, by row and list. List 2j is the upper end of axis j, 2j + 1 the lower."""
    rows, ends, values = [], [], []
    for chunk in range(-(-lists // (2 * _CHUNK))):
        p = unit @ axes_of(unit.shape[1], chunk)
        for end, q in enumerate((p, -p)):
            r, c = np.nonzero(q > tau)
            rows.append(r)
            ends.append(2 * (chunk * _CHUNK + c) + end)
            values.append(q[r, c])
    rows, ends, values = map(np.concatenate, (rows, ends, values))
    own = np.flatnonzero(ends < lists)
    own = own[np.lexsort((ends[own], rows[own]))]
    return rows[own], ends[own], values[own]


def _sizes(tau: float, lists: int):
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in slices(batches, 2048):
            for dim, (_, unit) in _unit(batch.column(1), batch.column(0).to_numpy()).items():
                total[dim] = total.get(dim, 0) + np.bincount(_members(unit, tau, lists)[1], minlength=lists)
        for dim, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), dim), pa.int32()), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["dim", "list", "n"])

    return run


_SENT = "dim int, list int, left int, right int, own int, value double, id long, weight long, lists binary, vec binary"


def _entries(tau: float, lists: int, parts: dict[tuple[int, int], int]):
    """Each vector under each of its lists; a list of several parts meets itself part by part."""

    def run(batches):
        for batch in slices(batches, 1024):
            ids = batch.column(2).to_numpy()
            for dim, (at, unit) in _unit(batch.column(1), batch.column(0).to_numpy()).items():
                rows, ends, values = _members(unit, tau, lists)
                edge = np.searchsorted(rows, np.arange(len(at) + 1))
                own_lists = [ends[s:e].astype("<i4").tobytes() for s, e in zip(edge[:-1], edge[1:], strict=True)]
                n = np.array([parts.get((dim, e), 1) for e in ends.tolist()], np.int64)
                own = ((ids[at][rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % np.maximum(n, 1)
                k = np.repeat(np.arange(len(rows)), n)
                other = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
                left, right, pick = np.minimum(own[k], other), np.maximum(own[k], other), pa.array(at[rows[k]])
                columns = [pa.array(np.full(len(k), dim), pa.int32()), pa.array(ends[k], pa.int32()), pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(own[k], pa.int32()), pa.array(values[k])]
                columns += [batch.column(2).take(pick), batch.column(3).take(pick), pa.array(own_lists, pa.binary()).take(pa.array(rows[k])), batch.column(1).take(pick)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SENT.split(", ")])

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
        while (root != root[root]).any():
            root = root[root]
    return root


def _earlier(lists: pa.Array, now: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's lists before ``now``, padded so that paddings of the two results never agree."""
    own = [np.frombuffer(x, "<i4") for x in lists.to_pylist()]
    own = [x[: np.searchsorted(x, now)] for x in own]
    a = np.full((len(own), max(map(len, own), default=0)), -1, np.int32)
    for k, x in enumerate(own):
        a[k, : len(x)] = x
    return a, np.where(a < 0, -2, a)


def _pairs(cosine: float, least: int):
    width = math.sqrt(max(2 - 2 * cosine, 1e-12))

    def run(key, rows):
        rows = rows.sort_by("value").combine_chunks()
        dim, now, left, right = (k.as_py() for k in key)
        own, ids, weight, value = (rows[c].to_numpy() for c in ("own", "id", "weight", "value"))
        unit = _unit(rows["vec"].combine_chunks(), np.full(len(ids), dim))[dim][1]
        codes = np.clip(np.rint(unit @ axes_of(dim, -1, AXES) / (_OTHER * width / STEPS)), -63, 63).astype(np.int8)
        before, again = _earlier(rows["lists"].combine_chunks(), now)
        x, y = np.flatnonzero(own == left), np.flatnonzero(own == right)
        cy, at_y = np.ascontiguousarray(codes[y].T), value[y]
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in range(0, len(x) if len(y) else 0, _TILE):
            tile = x[s : s + _TILE]
            lo, hi = np.searchsorted(at_y, value[tile[0]] - _FIRST * width), np.searchsorted(at_y, value[tile[-1]] + _FIRST * width, "right")
            count, gap = np.zeros((len(tile), hi - lo), np.int8), np.empty((len(tile), hi - lo), np.int8)
            for j in range(AXES):
                np.subtract(codes[tile, j, None], cy[j, None, lo:hi], out=gap)
                np.abs(gap, out=gap)
                count += gap <= STEPS + 1  # a step more for rounding
            i, j = np.nonzero(count >= least)
            a, b = tile[i], y[lo + j]
            if left == right:
                a, b = a[a < b], b[a < b]
            for t in range(0, len(a), _PAIRS):
                p, q = a[t : t + _PAIRS], b[t : t + _PAIRS]
                new = ~(before[p][:, :, None] == again[q][:, None, :]).any(axis=(1, 2))  # met in an earlier list: counted there
                p, q = p[new], q[new]
                ok = np.einsum("ij,ij->i", unit[p], unit[q]) >= cosine
                found_a.append(p[ok])
                found_b.append(q[ok])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        n = np.bincount(a, weight[b], len(ids)).astype(np.int64) + np.bincount(b, weight[a], len(ids)).astype(np.int64)
        root, some = _roots(len(ids), a, b), np.flatnonzero(n)
        return pa.table({"id": pa.array(ids[some]), "root": pa.array(ids[root[some]]), "n": pa.array(n[some])})

    return run


def _packed(batches):
    for batch in slices(batches, 2048):
        rows = [np.array(v, "<f8") for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([len(v) for v in rows], pa.int32()), pa.array([v.tobytes() for v in rows], pa.binary()), batch.column(0), batch.column(2)], names=["dim", "vec", "id", "weight"])


def embedding_components(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", embedding_col: str = "embedding", block: int | None = None, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Equal vectors meet before the search, so copies cost one row each and link with each other. Vectors that are null,
    empty or zero, or hold null or non-finite components link with nothing; vectors meet only those of their own dimension.
    Rows, not ids, are linked: rows that repeat an id, or have none, have links of their own; component_id is the smallest id
    of any row reachable, null where none has one, and kept compares it with the row's id, null with null being equal. No
    rows in, none out. Extra columns are not read.

    A list of more than ``block`` members (unless given, twice what is expected and 4,096 at least) is met in pairs of parts, each one task's work. A task leaves numbers of links and
    a spanning forest, never the pairs; a pair counts in the first list that it shares.
    """
    rows = doubles(vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec_id"), F.col(embedding_col).alias("v"), valid(embedding_col).alias("ok")), "v")
    rows = rows.withColumn("v", F.when(F.col("ok") & F.exists("v", lambda x: x != 0), F.transform("v", lambda x: x + F.lit(0.0))))
    rows = materialise(rows.select("uid", "vec_id", F.when(F.col("v").isNotNull(), F.sha2(F.to_json("v").cast("binary"), 256)).alias("same"), "v"), "vectors")
    groups = rows.where("same is not null").groupBy("same").agg(F.min("uid").alias("id"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    groups = materialise(groups, "same")
    chosen = rows.join(groups.select("id", "weight"), F.col("uid") == F.col("id")).select("id", "v", "weight")
    packed = materialise(chosen.mapInArrow(_packed, "dim int, vec binary, id long, weight long"), "packed")
    tau, lists, members = lists_for(packed.count(), cosine, recall)
    block = block or max(4096, 2 * members)
    sizes = packed.select("dim", "vec").mapInArrow(_sizes(tau, lists), "dim int, list int, n long").groupBy("dim", "list").agg(F.sum("n").alias("n"))
    parts = {(r["dim"], r["list"]): -(-r["n"] // block) for r in sizes.where(F.col("n") > block).collect()}  # few: lists grow with sqrt(N)
    sent = packed.mapInArrow(_entries(tau, lists, parts), _SENT)
    links = materialise(sent.groupBy("dim", "list", "left", "right").applyInArrow(_pairs(cosine, least_count(recall=recall)), "id long, root long, n long"), "links")
    found = components(links, "id", "root")
    near = links.groupBy("id").agg(F.sum("n").alias("near"))
    named = groups.join(near, "id", "left").join(found, F.col("id") == F.col("node"), "left")
    named = named.select("same", "least", (F.coalesce("near", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component_id", "id").alias("root"))
    labels = named.groupBy(F.col("root").alias("of_root")).agg(F.min("least").alias("component"))
    named = named.join(labels, F.col("root") == F.col("of_root")).select(F.col("same").alias("of"), "links", "component")
    named = materialise(named, "named")
    keyed = rows.select("uid", "vec_id", F.coalesce("same", F.col("uid").cast("string")).alias("key"))  # rows that link with nothing don't share a key
    out = keyed.join(named, F.col("key") == F.col("of"), "left")
    component = F.when(F.col("of").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
