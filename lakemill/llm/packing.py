"""Packing documents into sequences of fixed length as a cutting-stock problem.

A document of more than one sequence fills whole sequences first; what is left of each is an item, and the items' lengths
make a histogram of at most 1,023 entries. Column generation solves the linear program over patterns (how many items of each
length share a sequence), a knapsack by dynamic programming pricing new ones. Whole parts of the pattern counts are kept;
the rest, at most one sequence for each pattern of the basis, is filled largest first. Items ranked within their length then
take their places by arithmetic, on the executors; the driver sees the histogram and the patterns alone.
"""

from __future__ import annotations

import warnings
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakemill.llm.batches import slices
from lakemill.llm.store import materialise
from lakemill.llm.tokens import encoder, public_path

TOKENIZER = "byte_bpe_50k.json"
LENGTH, END = 1024, 0


def best_pattern(lengths: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of lengths (ascending) that fits, as counts.

    What fits c is one item of more than two thirds of c beside the rest, or splits in two that fit two thirds each: so all
    rooms of a half more than those known are found at once.
    """
    item = np.full(room + 1, -np.inf)
    item[lengths] = values
    best, parts, known_at = np.zeros(room + 1), np.zeros(room + 1, np.int64), np.zeros(room + 1, np.int64)
    whole = item.copy()  # of a part: the best where that is known, else one item
    best[:2] = whole[:2] = 0.0, max(item[1], 0.0)
    known, needed = 1, 2 * room // 3
    while known < room:
        first, last = (known + 1, min((3 * known + 2) // 2, needed)) if known < needed else (room, room)
        least = min(last // 2, first)
        split = np.lib.stride_tricks.sliding_window_view(whole[first - least : last + 1], least + 1) + best[least::-1]
        at = split.argmax(axis=1)
        best[first : last + 1] = split[np.arange(len(at)), at]
        parts[first : last + 1], known_at[first : last + 1] = least - at, known
        whole[first : last + 1] = best[first : last + 1]
        known = last
    counts, left = np.zeros(room + 1), [room]
    while left:
        c = left.pop()
        if c <= 1:
            counts[c] += c and item[1] > 0
            continue
        q = int(parts[c])
        left.append(q)
        if c - q > known_at[c]:
            counts[c - q] += 1
        else:
            left.append(c - q)
    return best[room], counts[lengths]


def first_basis(lengths: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """As many patterns as lengths, each filled largest first and used until one length's demand is met.

    That length is in no later pattern, so the patterns are triangular and thus a basis.
    """
    left, patterns, x = demand.astype(float).copy(), np.zeros((len(lengths),) * 2), np.zeros(len(lengths))
    open_ = np.ones(len(lengths), bool)
    for p in range(len(lengths)):
        free, own = room, patterns[p]
        live = np.flatnonzero(open_)
        while live.size:
            k = live[-1]
            n = max(1, min(free // lengths[k], int(left[k]) or 1))
            own[k] = n
            free -= n * lengths[k]
            live = live[:-1]
            live = live[lengths[live] <= free]
        used = np.flatnonzero(own)
        ratio = left[used] / own[used]
        x[p] = ratio.min()
        left[used] = np.maximum(left[used] - x[p] * own[used], 0)
        open_[used[ratio.argmin()]] = False
    return patterns, x


def inverted(matrix: np.ndarray) -> np.ndarray | None:
    """The inverse by Gauss-Jordan steps, or None; a threaded library may block in a driver that has started a JVM."""
    m = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(m)])
    for k in range(m):
        p = k + int(np.abs(work[k:, k]).argmax())
        if abs(work[p, k]) < 1e-9:
            return None
        if p != k:
            work[[k, p]] = work[[p, k]]
        work[k] /= work[k, k]
        rows = np.flatnonzero(work[:, k])
        rows = rows[rows != k]
        work[rows] -= work[rows, k, None] * work[k]
    return work[:, m:].copy()


def column_generation(lengths: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-4, most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns by row, how often each) of an optimal basis, to a relative ``gap``, or half a sequence, of the better of two
    bounds: the one that the duals prove and the items' whole length.

    Should rounding errors or ``most`` columns end the search before, a warning names the gap that was reached.
    """
    patterns, x = first_basis(lengths, demand, room)
    inverse = inverted(patterns.T)
    if inverse is None:
        return patterns.astype(np.int64), x
    least = float((lengths * demand).sum()) / room
    duals, sound = inverse.sum(axis=0), (patterns.copy(), x.copy())
    for turn in range(most):
        value, column = best_pattern(lengths, duals, room)
        bound = max(x.sum() / max(value, 1.0), least)
        if value <= 1 + 1e-9 or x.sum() - bound <= max(gap * x.sum(), 0.5 if gap else 1e-6):
            return patterns.astype(np.int64), x
        some = np.flatnonzero(column)  # few: no dense product, whose threads would wait for Spark's
        step = (inverse[:, some] * column[some]).sum(axis=1)
        up = np.flatnonzero(step > 1e-7)
        ratio = x[up] / step[up]
        theta = max(0.0, float(ratio.min()))
        ties = up[ratio <= theta + 1e-9]
        out = ties[int(step[ties].argmax())]  # the largest pivot keeps the basis well conditioned
        x -= theta * step
        x[out] = theta
        np.maximum(x, 0, out=x)
        row = inverse[out] / step[out]
        moved = np.flatnonzero(np.abs(step) > 1e-12)  # a tenth of the rows, mostly
        inverse[moved] -= np.outer(step[moved], row)
        inverse[out] = row
        duals += row * (1 - value)
        patterns[out] = column
        if turn % 200 == 199:  # against rounding errors; a basis that has lost its rank ends the search at the last sound one
            inverse = inverted(patterns.T)
            if inverse is None:
                patterns, x = sound
                break
            x, duals = np.maximum((inverse * demand).sum(axis=1), 0), inverse.sum(axis=0)
            sound = patterns.copy(), x.copy()
    warnings.warn(f"column generation ended within {x.sum() / bound - 1:.2g} of its bound", stacklevel=2)
    return patterns.astype(np.int64), x


def plan(histogram: dict[int, int], room: int = LENGTH) -> tuple[dict[int, np.ndarray], int]:
    """For each item length, rows (first rank, first sequence, items in a sequence, sequences, offset) by rank, and the number of sequences.

    Every rank of every length has exactly one place.
    """
    if not histogram:
        return {}, 0
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[k] for k in lengths.tolist()], np.int64)
    patterns, x = column_generation(lengths, demand.astype(float), room)
    times = np.floor(x + 1e-7).astype(np.int64)
    left = demand - times @ patterns
    for k in np.flatnonzero(left < 0):
        for p in np.flatnonzero((patterns[:, k] > 0) & (times > 0)):
            if left[k] < 0:
                fewer = min(int(times[p]), -(int(left[k]) // int(patterns[p, k])))
                times[p] -= fewer
                left += fewer * patterns[p]
    rows, rank, sequence = defaultdict(list), dict.fromkeys(lengths.tolist(), 0), 0

    def place(counts, copies):
        nonlocal sequence
        offset = 0
        for k in np.flatnonzero(counts)[::-1]:
            own, n = int(lengths[k]), int(counts[k])
            rows[own].append((rank[own], sequence, n, copies, offset))
            rank[own] += n * copies
            offset += n * own
        sequence += copies

    for p in np.flatnonzero(times > 0):
        place(patterns[p], int(times[p]))
    while left.any():
        counts, free = np.zeros(len(lengths), np.int64), room
        while (fits := np.flatnonzero((left > 0) & (lengths <= free))).size:
            k = fits[-1]
            n = min(int(left[k]), free // int(lengths[k]))
            counts[k] += n
            left[k] -= n
            free -= n * int(lengths[k])
        copies = 1 + (int((left[counts > 0] // counts[counts > 0]).min()) if counts.any() else 0)
        left -= (copies - 1) * counts
        place(counts, copies)
    return {k: np.array(r, np.int64) for k, r in rows.items()}, sequence


def _encode(path: str, end: int, room: int):
    def run(batches):
        own, before = encoder(path), 0
        for batch in slices(batches):
            n, crcs, full_before = [], [], []
            for text in batch.column(1).to_pylist():
                ids = np.append(own.ids(text), np.uint32(end)).astype("<u4")
                n.append(len(ids))
                crcs.append([zlib.crc32(ids[k : k + room].tobytes()) for k in range(0, len(ids), room)])
                full_before.append(before)
                before += len(ids) // room
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(full_before, pa.int64())], names=["doc_id", "n", "crcs", "full_before"])

    return run


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pieces(places: dict[int, np.ndarray], packed: int, room: int):
    def run(batches):
        for batch in slices(batches, 4096):
            n, full, rank = (batch.column(c).fill_null(0).to_numpy() for c in ("n", "full", "rank"))
            crcs = batch.column("crcs")
            count = (n + room - 1) // room
            doc = np.repeat(np.arange(len(n)), count)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            length = np.minimum(room, n[doc] - room * k)
            sequence, offset = packed + full[doc] + k, np.zeros(len(doc), np.int64)
            items = np.flatnonzero(length < room)
            for own in np.unique(length[items]):
                at = items[length[items] == own]
                rows, r = places[int(own)], rank[doc[at]]
                row = rows[np.searchsorted(rows[:, 0], r, "right") - 1]
                place, slot = np.divmod(r - row[:, 0], row[:, 2])
                sequence[at], offset[at] = row[:, 1] + place, row[:, 4] + slot * own
            columns = [batch.column("doc_id").take(pa.array(doc)), room * k, length, crcs.flatten(), n[doc], sequence, offset]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[f.split()[0] for f in _PIECES.split(", ")])

    return run


def _ranked(items: DataFrame, counts: dict[int, int], target: int) -> DataFrame:
    """(uid, rank): ranks from 0 within each length. A length of more than ``target`` items is dealt to several tasks by a
    hash, whose sizes are added up on the driver: at most 1,023 and one for each ``target`` items."""
    spark = items.sparkSession
    parts = {k: -(-n // target) for k, n in counts.items()}
    by = F.create_map(*[F.lit(x) for k, v in parts.items() if v > 1 for x in (k, v)]) if any(v > 1 for v in parts.values()) else None
    share = F.coalesce(by[F.col("item")], F.lit(1)) if by is not None else F.lit(1)
    dealt = items.withColumn("deal", F.pmod(F.xxhash64("uid"), share).cast("int"))
    base, at = [], defaultdict(int)
    for row in dealt.groupBy("item", "deal").agg(F.count(F.lit(1)).alias("n")).orderBy("item", "deal").collect():
        base.append((row["item"], row["deal"], at[row["item"]]))
        at[row["item"]] += row["n"]
    bases = spark.createDataFrame(base, "item long, deal int, base long")
    own = F.row_number().over(Window.partitionBy("item", "deal").orderBy("uid")) - 1
    return dealt.withColumn("own", own).join(F.broadcast(bases), ["item", "deal"]).select("uid", (F.col("base") + F.col("own")).alias("rank"))


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = END, room: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", deals: int = 8192) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts are empty and so of one token, ``end``. Every row of ``docs`` is packed, repeated ids and null ids as they
    are; other columns are not read. Pieces of a sequence lie without gaps from offset 0. No rows in, none out.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or public_path(TOKENIZER)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    coded = rows.mapInArrow(_encode(tokenizer, end, room), "doc_id long, n long, crcs array<long>, full_before long")
    coded = materialise(coded.select(F.monotonically_increasing_id().alias("uid"), F.spark_partition_id().alias("task"), "*"), "coded")
    items = coded.select("uid", (F.col("n") % room).alias("item")).where("item > 0")
    histogram = {r["item"]: r["n"] for r in items.groupBy("item").agg(F.count(F.lit(1)).alias("n")).collect()}
    places, packed = plan(histogram, room)
    total = sum(histogram.values())
    ranks = _ranked(items, histogram, max(256, total // deals)) if histogram else items.select("uid", F.col("item").alias("rank"))
    tasks = coded.groupBy("task").agg(F.sum(F.floor(F.col("n") / room)).alias("whole"))
    tasks = tasks.select(F.col("task").alias("of"), (F.sum("whole").over(Window.orderBy("task")) - F.col("whole")).alias("first"))
    placed = coded.join(tasks, coded.task == tasks.of).join(ranks, "uid", "left")
    ready = placed.select("doc_id", "n", "crcs", (F.col("first") + F.col("full_before")).alias("full"), "rank")
    return ready.mapInArrow(_pieces(places, packed, room), _PIECES)
