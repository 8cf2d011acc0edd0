"""Token ids in files: canonical length-limited Huffman codes of ids, in independent blocks with bit-offset checkpoints.

A file is a Parquet table of blocks, so any store that Spark writes will do and lost tasks are written again. A block holds
whole documents: their ids, numbers of token ids and first token's place in the whole, the bit string of all its token ids,
and the bit offset of every 1,024th. The code is in the lengths of the codes alone (canonical), kept in each block as the
digest of the lengths and once beside the blocks in full. Tables decode many stretches between checkpoints side by side.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm.batches import slices
from lakemill.llm.store import fresh_path, remove
from lakemill.llm.tokens import encoder, public_path

TOKENIZER = "word_bpe_49k.json"
LONGEST, STRIDE, BLOCK, IDS = 20, 1024, 1 << 16, 1 << 16
PART = 50_000  # documents of a part at most, about


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits by package-merge; 0 where the count is 0."""
    lengths = np.zeros(len(counts), np.uint8)
    symbols = np.flatnonzero(counts)
    n = len(symbols)
    if n > 1 << longest:
        raise ValueError(f"{n} symbols need codes of more than {longest} bits")
    if n < 2:
        lengths[symbols] = 1
        return lengths
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    weights = counts[symbols].astype(np.int64)
    level, kinds = weights, []
    for _ in range(longest):
        merged = np.concatenate([weights, level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)]) if kinds else weights
        order = np.argsort(merged, kind="stable")
        kinds.append(order < n)
        level = merged[order]
    take, own = 2 * n - 2, np.zeros(n + 1, np.int64)
    for kind in reversed(kinds):
        single = int(kind[:take].sum())
        own[single] += 1
        take = 2 * (take - single)
    lengths[symbols] = own[::-1].cumsum()[::-1][1:]
    return lengths


def canonical(lengths: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes by symbol, symbol by window, length by window): codes rise with (length, symbol)."""
    symbols = np.flatnonzero(lengths)
    symbols = symbols[np.lexsort((symbols, lengths[symbols]))]
    own = lengths[symbols].astype(np.int64)
    spans = 1 << (longest - own)
    codes = np.zeros(len(lengths), np.uint64)
    codes[symbols] = (np.cumsum(spans) - spans) >> (longest - own)
    by_window, length = np.zeros(1 << longest, np.uint16), np.ones(1 << longest, np.uint8)
    by_window[: spans.sum()], length[: spans.sum()] = np.repeat(symbols, spans), np.repeat(own, spans)
    return codes, by_window, length


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit string (whole 64-bit words, big-endian) and the bit offset of every STRIDE-th id."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    words = np.zeros((int(end[-1]) + 63) // 64 + 1, np.uint64)
    word, room = at >> 6, 64 - (at & 63) - size
    code = codes[ids]
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    within = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    words[word[first]] = np.add.reduceat(within, first)
    over = np.flatnonzero(room < 0)
    words[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
    return words[:-1].astype(">u8").tobytes() if not words[-1] else words.astype(">u8").tobytes(), at[::STRIDE]


def unpack_bits(payloads: list[bytes], marks: list[np.ndarray], counts: list[int], by_window: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """The ids of each payload; all stretches of all payloads move forward together, one id a step."""
    lanes = [(n + STRIDE - 1) // STRIDE for n in counts]
    base = np.cumsum([0, *(len(p) + 8 for p in payloads)])
    data = b"".join(p + bytes(8) for p in payloads)
    if not sum(lanes):
        return [np.zeros(0, np.uint16) for _ in counts]
    bit = np.concatenate([np.asarray(m, np.int64) + 8 * b for m, b in zip(marks, base, strict=False)])
    left = np.concatenate([np.minimum(STRIDE, n - STRIDE * np.arange(k)) for n, k in zip(counts, lanes, strict=True)])
    windows = np.ndarray((len(data) - 3,), ">u4", data, 0, (1,))
    order = np.argsort(-left, kind="stable")
    bit, active = bit[order], np.searchsorted(-left[order], -np.arange(STRIDE), "left")
    out = np.zeros((STRIDE, len(bit)), np.uint16)
    shift, mask = np.uint32(32 - LONGEST), np.uint32((1 << LONGEST) - 1)
    for step in range(int(left.max())):
        k = active[step]
        b = bit[:k]
        w = ((windows[b >> 3].astype(np.uint64) << (b & 7).astype(np.uint64)) >> np.uint64(shift)).astype(np.uint32) & mask
        out[step, :k] = by_window[w]
        b += length[w]
    rows = np.empty((len(bit), STRIDE), np.uint16)
    rows[order] = out.T
    ends = np.cumsum([0, *lanes])
    return [rows[s:e].ravel()[:n] for s, e, n in zip(ends[:-1], ends[1:], counts, strict=True)]


def _tokenise(path: str, end: int, bounds: np.ndarray):
    def run(batches):
        own = encoder(path)
        tail = np.array([end], "<u2").tobytes()
        for batch in slices(batches):
            found = [own.ids(t) for t in batch.column(1).to_pylist()]
            if any(x.dtype.itemsize > 2 and x.size and x.max() >= IDS for x in found):
                raise ValueError(f"a token id is {IDS} or more: the files keep 16 bits")
            ids = [x.astype("<u2").tobytes() + tail for x in found]
            part = np.searchsorted(bounds, batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column(0), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["part", "doc_id", "n", "ids"])

    return run


def _place(batches):
    """Adds each document's first token's place within its part; a task holds one part, sorted."""
    at = 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        start = at + np.cumsum(n) - n
        at += int(n.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start)], names=[*batch.schema.names, "start"])


def _histogram(batches):
    total = np.zeros(IDS, np.int64)
    for batch in slices(batches):
        total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=IDS)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])


_FILE = "part int, start long, doc_ids array<long>, counts array<long>, n long, marks binary, payload binary"


def _encode(lengths: np.ndarray, offsets: dict[int, int]):
    def run(batches):
        codes = canonical(lengths)[0]

        def block(rows):
            part, start = rows[0][0], rows[0][3]
            ids = np.concatenate([np.frombuffer(r[4], "<u2") for r in rows])
            payload, marks = pack_bits(ids, lengths, codes)
            return part, offsets[part] + start, [r[1] for r in rows], [r[2] for r in rows], len(ids), marks.astype("<i8").tobytes(), payload

        def batch_of(blocks):
            types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks, strict=True), types, strict=True)], names=[f.split()[0] for f in _FILE.split(", ")])

        held, n = [], 0
        for batch in slices(batches):
            blocks = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "start", "ids")), strict=True):
                if held and (row[0] != held[0][0] or n + row[2] > BLOCK or row[3] != held[-1][3] + held[-1][2]):
                    blocks.append(block(held))
                    held, n = [], 0
                held.append(row)
                n += row[2]
            if blocks:
                yield batch_of(blocks)
        if held:
            yield batch_of([block(held)])

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text (null: empty), appends ``end``, and writes files at ``path``: blocks/ and code/.

    The ids are the tokenizers library's; see ``tokens.Encoder`` for the second route to the same ids and what holds the two
    together. Ids must be under 65,536. An empty table gives empty files.

    Documents lie in ascending id order, null ids first; rows of equal id in the order of their ids' bytes. The parts are
    ranges of the id found from the id column alone, so texts are tokenised once and only ids travel.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or public_path(TOKENIZER)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 20 * parts)).first()[0] or []
    bounds = np.unique(np.array(cuts if parts > 1 else [], np.int64))
    n_parts = len(bounds) + 1
    ids = rows.mapInArrow(_tokenise(tokenizer, end, bounds), "part int, doc_id long, n long, ids binary")
    placed = ids.repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", "doc_id", "ids").mapInArrow(_place, "part int, doc_id long, n long, ids binary, start long")
    kept = fresh_path(spark, "ids")
    placed.write.parquet(kept)
    placed = spark.read.schema("part int, doc_id long, n long, ids binary, start long").parquet(kept)
    counts = np.zeros(IDS, np.int64)
    for row in placed.select("ids").mapInArrow(_histogram, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    offsets, at = {}, 0
    for row in placed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        offsets[row["part"]], at = at, at + row["n"]
    lengths = code_lengths(counts)
    spark.range(1).select(F.lit(bytearray(lengths.tobytes())).alias("lengths"), F.lit(LONGEST).alias("longest"), F.lit(STRIDE).alias("stride")).write.parquet(f"{path}/code")
    placed.select("part", "doc_id", "n", "start", "ids").mapInArrow(_encode(lengths, offsets), _FILE).write.partitionBy("part").parquet(f"{path}/blocks")
    remove(spark, kept)


def _decode(lengths: np.ndarray):
    def run(batches):
        _, by_window, length = canonical(lengths)
        for batch in slices(batches):
            at = 0
            while at < batch.num_rows:
                some, tokens = [], 0
                while at < batch.num_rows and tokens < 1 << 21:
                    some.append(at)
                    tokens += batch.column("n")[at].as_py()
                    at += 1
                own = batch.take(pa.array(some))
                texts = unpack_bits(own.column("payload").to_pylist(), [np.frombuffer(m, "<i8") for m in own.column("marks").to_pylist()], own.column("n").to_pylist(), by_window, length)
                out = []
                for first, doc_ids, counts, ids in zip(own.column("start").to_pylist(), own.column("doc_ids").to_pylist(), own.column("counts").to_pylist(), texts, strict=True):
                    place = 0
                    for doc_id, n in zip(doc_ids, counts, strict=True):
                        out.append((doc_id, first + place, n, zlib.crc32(ids[place : place + n].astype("<u4").tobytes()), ids[place : place + n]))
                        place += n
                yield out

    return run


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files at ``path``, and its ids if asked for."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/code").first()["lengths"]), np.uint8)
    decode = _decode(lengths)

    def run(batches):
        for rows in decode(batches):
            columns = list(zip(*rows, strict=True))[: 4 + with_ids]
            types = [pa.int64()] * 4 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return spark.read.schema(_FILE).parquet(f"{path}/blocks").select("start", "doc_ids", "counts", "n", "marks", "payload").mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str | None = None, end: int = 2) -> DataFrame:
    """Writes the ids of ``docs`` in the shared folder and returns what :func:`read_ids` finds there: a row for each row of
    ``docs``, null and repeated ids included, none for none. Other columns are not read."""
    path = fresh_path(docs.sparkSession, "huffman")
    write_ids(docs, path, tokenizer, end)
    return read_ids(docs.sparkSession, path)
