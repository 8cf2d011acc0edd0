"""Near duplicates by SimHash, with pigeonring-filtered candidates.

A 64-bit fingerprint is a ring of eight 8-bit segments. If two fingerprints differ in at most 3 bits, the pigeonring
principle gives a start i from which every chain of l consecutive segments differs in at most floor(3 l / 8) bits: 0, 0, 1,
1, 1, 2, 2, 3 for l = 1..8. So two segments match exactly and, among the next three, at most one differs, by one bit: for
each start and each choice of that segment, the other four segments form a 32-bit key. Pairs meet only under such a key,
then pass the budgets of all chains of that start, and only then the full Hamming check.

64 bits and 3 differences find only the closest of near copies: five-word shingles with a Jaccard similarity of 0.8 differ in
some 15 % of the bits. ``near_duplicate_components`` therefore adds wide fingerprints of 512 bits over such shingles: pairs
meet where one of 36 segments of 14 bits is equal, then chains of 64-bit words from there on must stay within budgets in
proportion (and a margin, as wide fingerprints estimate), the whole ring last. Pairs far below the bits of the threshold are
links; of those around it, the shingles themselves decide, in blocks of texts of bounded size. Long runs of one key give
spanning forests alone, so that rows stay in proportion to texts however many pairs a family has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.batches import slices
from lakemill.llm.graph import components
from lakemill.llm.store import materialise

BITS, SEGMENTS, WIDTH = 64, 8, 8
_CHUNK = 1 << 16
#: Runs of one key up to this length are compared by shifted copies; longer ones by a search that emits a forest, from
#: _LONG on within parts that agree in one more segment.
_SHORT, _LONG = 32, 2048


#: Wide fingerprints: 64-bit words, segments that are keys, and their bits.
WIDE, KEYS, KEY_BITS = 8, 36, 14
#: Wide fingerprints nearer than the threshold's bits by SURE deviations link, those farther by DOUBT don't; the shingles
#: decide between. Texts of doubtful pairs meet in blocks of two parts of about so many bytes, and so many pairs.
SURE, DOUBT = 3.0, 3.0
BLOCK_BYTES, BLOCK_PAIRS = 8 << 20, 1 << 20
_SPREAD = np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hashes(own: list[bytes], words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence where there are fewer words."""
    from xxhash import xxh64_intdigest

    shingles: Iterator[bytes] = map(b" ".join, zip(*(own[k:] for k in range(words)), strict=False)) if len(own) >= words else iter([b" ".join(own)])
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64, count=max(1, len(own) - words + 1))


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many rows set each bit, from the most significant."""
    ones = np.zeros(BITS * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), _CHUNK // hashes.shape[1]):
        part = hashes[at : at + _CHUNK // hashes.shape[1]].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int64)
    return ones


def _simhash(own: list[bytes], words: int, seed: int = 42) -> int:
    if not own:
        return 0
    hashes = _hashes(own, words, seed)
    return int.from_bytes(np.packbits(2 * _ones(hashes[:, None]) > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash over word shingles; 0 where there is no word."""
    return _simhash(_words_of(text), words, seed)


def _wide(own: list[bytes], words: int) -> bytes:
    if not own:
        return bytes(8 * WIDE)
    h = np.unique(_hashes(own, words))[:, None] + _SPREAD[None, :]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.packbits(2 * _ones(h ^ (h >> np.uint64(31))) > len(h)).tobytes()


def wide_fingerprint(text: str | None, words: int = 5) -> bytes:
    """512-bit SimHash over the set of word shingles; zero where there is no word."""
    return _wide(_words_of(text), words)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id long, fp long) for every document; fp holds the 64 bits as a signed long."""

    def run(batches):
        for batch in slices(batches):
            fps = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, fp long")


def _key_columns():
    """For each start i and skipped segment, the key's number and its four segments in one long."""
    seg = [F.shiftrightunsigned("fp", WIDTH * k).bitwiseAND(F.lit(255)) for k in range(SEGMENTS)]
    for i in range(SEGMENTS):
        ring = [(i + k) % SEGMENTS for k in range(5)]
        for skipped in (2, 3, 4):
            key = F.lit(i * 3 + skipped - 2).cast("long")
            for k in range(5):
                if k != skipped:
                    key = F.shiftleft(key, WIDTH).bitwiseOR(seg[ring[k]])
            yield key


def _chain_masks(start: int) -> list[tuple[np.uint64, int]]:
    mask, out = 0, []
    for k in range(SEGMENTS):
        mask |= 255 << (WIDTH * ((start + k) % SEGMENTS))
        out.append((np.uint64(mask), 3 * (k + 1) // SEGMENTS))
    return out


def _linked(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which differences x pass every chain's budget from their start, the last chain being the whole ring."""
    ok = np.zeros(len(x), bool)
    for i in range(SEGMENTS):
        at = np.flatnonzero(start == i)
        for mask, most in _chain_masks(i):
            at = at[np.bitwise_count(x[at] & mask) <= most]
            if not len(at):
                break
        ok[at] = True
    return ok


def _forest(fp: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that join what is joined by pairs within the chains' budgets: at most len(fp) - 1 of them."""
    left = np.arange(len(fp))
    a, b = [], []
    while len(left):
        seed, left = left[0], left[1:]
        front = np.array([seed])
        while len(front) and len(left):
            hit, at = np.zeros(len(left), bool), 0
            while at < len(front):
                rest = np.flatnonzero(~hit)
                if not len(rest):
                    break
                some = front[at : at + max(1, (1 << 18) // len(rest))]
                at += len(some)
                x = (fp[some][:, None] ^ fp[left[rest]][None, :]).ravel()
                hit[rest[np.flatnonzero(_linked(x, np.full(len(x), start))) % len(rest)]] = True
            front, left = left[hit], left[~hit]
            a.append(np.full(len(front), seed))
            b.append(front)
    return (np.concatenate(a), np.concatenate(b)) if a else (left, left)


def _forest_of_run(fp: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within a run of the key of that number. Its four segments are equal, so a pair at 3 bits or fewer agrees in one
    of the other four as well: a very long run is searched within the parts of each."""
    start, skipped = divmod(number, 3)
    if len(fp) <= _LONG:
        return _forest(fp, start)
    out_a, out_b = [], []
    for k in (skipped + 2, 5, 6, 7):
        own = (fp >> np.uint64(WIDTH * ((start + k) % SEGMENTS))) & np.uint64(255)
        order = np.argsort(own, kind="stable")
        edge = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1], True])
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            a, b = _forest(fp[order[s:e]], start)
            out_a.append(order[s:e][a])
            out_b.append(order[s:e][b])
    return np.concatenate(out_a), np.concatenate(out_b)


def _links_of_runs(keys: np.ndarray, fps: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys (sorted)."""
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    length = np.diff(edge)
    out_a, out_b = [], []
    for at in np.flatnonzero(length > _SHORT):
        s, e = edge[at], edge[at + 1]
        a, b = _forest_of_run(fps[s:e], int(keys[s] >> 32))
        out_a.append(ids[s:e][a])
        out_b.append(ids[s:e][b])
    short = np.repeat((length > 1) & (length <= _SHORT), length)
    keys, fps, ids = keys[short], fps[short], ids[short]
    start = ((keys >> 32) // 3).astype(np.int64)
    for d in range(1, min(_SHORT, len(keys))):
        same = np.flatnonzero(keys[d:] == keys[:-d])
        if not len(same):
            break
        same = same[_linked(fps[same] ^ fps[same + d], start[same])]
        out_a.append(ids[same])
        out_b.append(ids[same + d])
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (ids[:0], ids[:0])


def _whole_runs(batches, read):
    """Streams rows sorted by key, the first of the arrays that ``read`` gives; the last run of a batch waits for the next."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        new = read(batch)
        if not len(new[0]):
            continue
        cut = int(np.searchsorted(new[0], new[0][-1]))
        if cut or (held and held[-1][0][-1] != new[0][-1]):
            yield [np.concatenate(x) for x in zip(*held, [x[:cut] for x in new], strict=True)]
            held = []
        held.append([x[cut:] for x in new])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _links(batches):
    def read(batch):
        k, f, i = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        return [k, f.view(np.uint64), i]

    for run in _whole_runs(batches, read):
        a, b = _links_of_runs(*run)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): ids joined at Hamming distance 3 or less; ``distinct`` holds (fp, id), each fp once.

    Not all pairs: within a long run of one key only a spanning forest leaves the task, so the rows out stay in
    proportion to the rows in, and every connection remains.
    """
    keyed = distinct.select("fp", "id", F.explode(F.array(*_key_columns())).alias("k")).select("k", "fp", "id")
    return keyed.repartition("k").sortWithinPartitions("k").mapInArrow(_links, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Null and empty texts have fingerprint zero and link with each other. Rows, not ids, are linked: rows that repeat an id
    belong where their own texts do, and rows without an id are linked like any other; component_id is the smallest id of
    any row reachable, null where none has one. Equal fingerprints meet before any candidate search, so copies cost one row
    each. No rows in, none out; extra columns of ``docs`` are not read.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, words), "simhash")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(links(distinct.select("fp", F.col("fp").alias("id"))))
    named = _labelled(distinct.withColumn("id", F.col("fp")), found).select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``nodes`` (id, least, ...) with root, the node that names the component, and component_id, its smallest document."""
    rooted = nodes.join(found.withColumnRenamed("component_id", "root"), F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")
    rooted = materialise(rooted, "rooted")
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")


def differing(similarity: float, margin: float = 0.0) -> int:
    """Bits of a wide fingerprint that texts of this Jaccard similarity differ in, and ``margin`` deviations more."""
    n, p = BITS * WIDE, math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(n * p + margin * math.sqrt(n * p * (1 - p)))


def _within(a: np.ndarray, b: np.ndarray, start: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two arrays of wide fingerprints stay within the budgets of the chains from their starting words, and the
    bits that these differ in."""
    at, total = np.arange(len(start)), np.zeros(len(start), np.int64)
    for length in range(1, WIDE + 1):
        word = (start[at] + length - 1) % WIDE
        total = total + np.bitwise_count(a[at, word] ^ b[at, word])
        own = length * most / WIDE
        ok = total <= (most if length == WIDE else own + 3 * math.sqrt(own))
        at, total = at[ok], total[ok]
        if not len(at):
            break
    return at, total


def _wide_forest(fp: np.ndarray, start: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that join what is joined by pairs within ``most`` bits: at most len(fp) - 1 of them."""
    left = np.arange(len(fp))
    a, b = [], []
    while len(left):
        seed, left = left[0], left[1:]
        front = np.array([seed])
        while len(front) and len(left):
            hit, at = np.zeros(len(left), bool), 0
            while at < len(front):
                rest = np.flatnonzero(~hit)
                if not len(rest):
                    break
                some = front[at : at + max(1, (1 << 18) // len(rest))]
                at += len(some)
                x, y = np.repeat(some, len(rest)), np.tile(rest, len(some))
                hit[y[_within(fp[x], fp[left[y]], np.full(len(x), start), most)[0]]] = True
            front, left = left[hit], left[~hit]
            a.append(np.full(len(front), seed))
            b.append(front)
    return (np.concatenate(a), np.concatenate(b)) if a else (left, left)


def _wide_keys(batches):
    """Each wide fingerprint under each of its segments."""
    weigh = (1 << np.arange(KEY_BITS - 1, -1, -1)).astype(np.int64)
    for batch in slices(batches, 1024):
        raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, 8 * WIDE)
        bits = np.unpackbits(raw, axis=1)[:, : KEYS * KEY_BITS].reshape(-1, KEYS, KEY_BITS)
        keys = bits @ weigh + (np.arange(KEYS) << KEY_BITS)
        at = pa.array(np.repeat(np.arange(len(raw)), KEYS))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(at), batch.column(1).take(at)], names=["k", "wide", "id"])


def _doubtful_of_run(fp: np.ndarray, group: np.ndarray, start: int, most: int, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (positions) of a long run within ``most`` bits whose groups differ, and whose labels do by then, some at a time."""
    n = len(fp)
    step = max(1, (1 << 18) // n)
    for at in range(0, n, step):
        x, y = (v.ravel() for v in np.meshgrid(np.arange(at, min(n, at + step)), np.arange(at, n), indexing="ij"))
        apart = (x < y) & (group[x] != group[y])
        if label is not None:
            apart &= label[x] != label[y]
        x, y = x[apart], y[apart]
        some, _ = _within(fp[x], fp[y], np.full(len(x), start), most)
        yield x[some], y[some]


def _doubtful_forest(fp: np.ndarray, group: np.ndarray, start: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that join what doubtful pairs of a long run join, each from the smallest position: at most
    len(fp) - 1 of them, and every position that has a doubtful pair is in one."""
    label = np.arange(len(fp))
    for x, y in _doubtful_of_run(fp, group, start, most, label):
        while (apart := label[x] != label[y]).any():
            x, y = label[x[apart]], label[y[apart]]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while ((up := label[label]) != label).any():
                label[:] = up
    at = np.flatnonzero(label != np.arange(len(fp)))
    return label[at], at


def _wide_links(sure: int, most: int):
    """Pairs within ``sure`` bits, and with sure false those within ``most`` bits. Of a long run spanning forests: of the sure
    ones, and of the doubtful ones that these do not join. Their links start at the smallest ids, so that most keys of a
    family give the same."""

    def batch(a, b, near):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(near)], names=["a", "b", "sure"])

    def of_runs(keys, fps, ids):
        edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        length = np.diff(edge)
        start_of = (keys >> KEY_BITS) * KEY_BITS // BITS
        for at in np.flatnonzero(length > _SHORT):
            order = edge[at] + np.argsort(ids[edge[at] : edge[at + 1]])
            own, own_ids, start = fps[order], ids[order], int(start_of[edge[at]])
            a, b = _wide_forest(own, start, sure)
            yield batch(own_ids[a], own_ids[b], np.ones(len(a), bool))
            group = np.arange(len(own))
            group[b] = a
            a, b = _doubtful_forest(own, group, start, most)
            yield batch(own_ids[a], own_ids[b], np.zeros(len(a), bool))
        short = np.repeat((length > 1) & (length <= _SHORT), length)
        keys, fps, ids, start = keys[short], fps[short], ids[short], start_of[short]
        for d in range(1, min(_SHORT, len(keys))):
            same = np.flatnonzero(keys[d:] == keys[:-d])
            if not len(same):
                break
            some, total = _within(fps[same], fps[same + d], start[same], most)
            yield batch(ids[same[some]], ids[same[some] + d], total <= sure)

    def read(batch):
        fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u8").reshape(-1, WIDE).astype(np.uint64)
        return [batch.column(0).to_numpy(zero_copy_only=False), fps, batch.column(2).to_numpy(zero_copy_only=False)]

    def run(batches):
        for own in _whole_runs(batches, read):
            yield from of_runs(*own)

    return run


def _similar(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray | None, similarity: float) -> Iterator[tuple[int, int]]:
    """Links (positions) that join what exact similarity joins between unlike roots, at most one for each root but the first.

    With sides (0 and 1) only texts of unlike sides are compared: those of like sides meet elsewhere. A text is compared with
    all that no link has reached, their shared shingles counted at once."""
    sizes = np.array([len(x) for x in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    lay = lambda at: (at, np.concatenate([own[i] for i in at]) if len(at) else flat[:0])
    laid = {0: lay(np.arange(len(sets)))} if side is None else {k: lay(np.flatnonzero(side != k)) for k in (0, 1)}
    of = {r: np.flatnonzero(root == r) for r in np.unique(root).tolist()}
    left, mark = np.ones(len(sets), bool), np.zeros(len(names), np.int32)
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        front = of[int(root[seed])].tolist()
        left[front] = False
        while front:
            x = front.pop()
            k = 0 if side is None else int(side[x])
            if 2 * left[laid[k][0]].sum() <= len(laid[k][0]):  # those that are reached go from time to time
                laid[k] = lay(laid[k][0][left[laid[k][0]]])
            at, held = laid[k]
            if not len(at):
                continue
            mark[own[x]] = 1
            shared = np.add.reduceat(mark[held], np.cumsum(sizes[at]) - sizes[at])
            mark[own[x]] = 0
            for y in at[left[at] & (shared >= similarity * (sizes[x] + sizes[at] - shared))].tolist():
                if left[y]:
                    new = of[int(root[y])]
                    left[new] = False
                    front += new.tolist()
                    yield x, y


def _verify(similarity: float, words: int):
    """Links between texts of unlike roots whose sets of shingles are that similar, of each block a spanning forest.

    Rows come by block (grp, i, j): a text's part, id, root and text."""

    def run(batches):
        def links_of(block, rows):
            part, ids, roots, sets = zip(*rows, strict=True)
            side = None if block[1] == block[2] else (np.array(part) == block[2]).astype(int)
            found = list(_similar(sets, np.array(roots), side, similarity)) if len(set(roots)) > 1 else []
            a, b = ([ids[pair[k]] for pair in found] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        block, rows = None, []
        for batch in slices(batches):
            for *own, part, id_, root, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != block:
                    if rows:
                        yield links_of(block, rows)
                    block, rows = own, []
                rows.append((part, id_, root, np.unique(_hashes(_words_of(text), words))))
        if rows:
            yield links_of(block, rows)

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """Pairs (a, b) that join what exact similarity joins among the ends of ``pairs`` (a, b, of groups ra and rb).

    All ends in one connected set of groups are compared, but for those of one group. A large set's texts are dealt into
    parts and each two parts are a block, so that a block's texts and pairs stay bounded and a text is sent to as many blocks
    as its set has parts. ``nodes`` (id, text_key, n_bytes) name their texts in ``texts`` (text_key, text).
    """
    groups = components(pairs.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("component_id").alias("grp"))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("ra").alias("root")), F.struct(F.col("b").alias("id"), F.col("rb").alias("root")))).alias("end")).select("end.*").distinct()
    ends = materialise(ends.join(groups, "root").join(nodes.select("id", "text_key", "n_bytes"), "id"), "doubtful-nodes")
    parts = ends.groupBy("grp").agg(F.sum("n_bytes").alias("size"), F.count(F.lit(1)).alias("texts"))
    parts = parts.select("grp", F.ceil(F.greatest(F.col("size") / BLOCK_BYTES, F.col("texts") / math.sqrt(2 * BLOCK_PAIRS))).cast("long").alias("n")).where("n > 1")
    dealt = ends.join(parts, "grp", "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long"))).withColumn("part", F.pmod(F.xxhash64("id"), F.col("n")))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    placed = materialise(dealt.select("grp", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "id", "root"), "doubtful-blocks")
    named = texts.join(ends.select("text_key").distinct(), "text_key", "left_semi").groupBy("text_key").agg(F.min("text").alias("text"))
    named = materialise(ends.select("id", "text_key").join(named, "text_key").select("id", "text"), "doubtful-texts")
    sent = placed.join(named, "id").select("grp", "i", "j", "part", "id", "root", "text")
    return sent.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(_verify(similarity, words), "a long, b long")


def near_duplicate_components(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, component_id, root, and the columns ``keep``) for every row: documents joined as near duplicates. ``root``
    names the component also where no row of it has an id.

    Texts link where the sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more. Candidates are
    pairs that ``simhash_components`` would link and pairs that share a key of their wide fingerprints (right at 0.8 with
    probability 0.98, at 0.9 nearly always). Wide fingerprints nearer than ``differing`` less SURE deviations are links by
    themselves; of the texts of the rest, up to DOUBT deviations beyond it, exact similarity decides. Pairs of wide fingerprints that meet
    by chance are N^2 / 900 checks of some words each: at N of 10^9 raise KEY_BITS. Only texts of doubtful pairs travel while
    Spark finds the list of these small enough to broadcast; beyond that one join shuffles all texts once.
    Nulls, repeats and extra columns as in ``simhash_components``.
    """

    def both(batches):
        for batch in slices(batches):
            own = [_words_of(t) for t in batch.column(1).to_pylist()]
            fps = np.fromiter((_simhash(w, 3) for w in own), np.uint64, len(own))
            columns = [batch.column(0), pa.array(fps.view(np.int64)), pa.array([_wide(w, words) for w in own], pa.binary()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "wide", *batch.schema.names[2:]])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"), F.xxhash64(text).alias("text_key"), F.octet_length(text).cast("long").alias("n_bytes"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    kinds = dict(rows.dtypes)
    fps = materialise(rows.mapInArrow(both, "doc_id long, fp long, wide binary, text_key long, n_bytes long" + "".join(f", `kept_{c}` {kinds[f'kept_{c}']}" for c in keep)), "simhash")
    nodes = fps.groupBy("fp", "wide").agg(F.min("doc_id").alias("least"), F.min("text_key").alias("text_key"), F.max("n_bytes").alias("n_bytes")).withColumn("id", F.monotonically_increasing_id())
    nodes = materialise(nodes, "simhash-nodes")
    narrow = materialise(nodes.groupBy("fp").agg(F.min("id").alias("id")), "simhash-narrow")
    wide = materialise(nodes.groupBy("wide").agg(F.min("id").alias("id")), "simhash-wide")
    keyed = wide.select("wide", "id").mapInArrow(_wide_keys, "k long, wide binary, id long").repartition("k").sortWithinPartitions("k")
    near = keyed.mapInArrow(_wide_links(differing(similarity, -SURE), differing(similarity, DOUBT)), "a long, b long, sure boolean")
    near = near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sure").alias("sure"))
    near = materialise(near, "simhash-pairs")
    same = [nodes.alias("n").join(x.alias("x"), by).where("n.id <> x.id").select(F.col("n.id").alias("a"), F.col("x.id").alias("b")) for x, by in ((narrow, "fp"), (wide, "wide"))]
    sure = components(near.where("sure").select("a", "b").union(same[1]))
    pairs = near.where("not sure").select("a", "b").union(links(narrow)).union(same[0])
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(sure.select(F.col("node").alias(end), F.col("component_id").alias(f"r{end}")), end, "left").withColumn(f"r{end}", F.coalesce(f"r{end}", end))
    pairs = materialise(pairs.select("a", "b", "ra", "rb"), "doubtful")
    more = _verified(pairs, nodes, rows.select("text_key", F.col("t").alias("text")), similarity, words)
    found = components(sure.select(F.col("node").alias("a"), F.col("component_id").alias("b")).union(more))
    named = _labelled(nodes.select("fp", "wide", "least", "id"), found).select("fp", "wide", "component_id", "root")
    return fps.join(named, ["fp", "wide"]).select("doc_id", "component_id", "root", *[F.col(f"kept_{c}").alias(c) for c in keep])


def one_of_each(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one for each group of near duplicates: that of the smallest id, rows without one coming last, and
    among several of that id always the same (by a hash of the whole row).

    Rows that repeat an id with a different text are different documents. Of equal rows one stays.
    """
    key = F.xxhash64(*[F.col(c) for c in docs.columns])
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), key.alias("row_key"))
    found = materialise(near_duplicate_components(keyed, similarity, words, keep=("row_key",)), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    stay = found.groupBy("root").agg(first).select(F.col("first.doc_id").alias("of"), F.col("first.row_key").alias("of_row")).hint("shuffle_hash")  # no bound: never broadcast
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("own"), key.alias("own_row"))
    kept = rows.join(stay, F.col("own").eqNullSafe(F.col("of")) & (F.col("own_row") == F.col("of_row")), "left_semi")
    if found.groupBy("doc_id", "row_key").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["own", "own_row"])
    return kept.select("row.*")
