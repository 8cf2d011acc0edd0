"""Token counts through a digest cache: only texts that were never counted with this tokenizer are encoded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.batches import slices
from lakemill.llm.store import exists, fresh_path, materialise
from lakemill.llm.tokens import encoder, public_path, version_digest

TOKENIZER = "byte_bpe_50k.json"
_CACHE = "tokenizer string, digest binary, n_tokens long"
#: Bits of a filter of digests. Its size is fixed; where digests outgrow it, more texts travel, and results stay the same.
FILTER_BITS = 1 << 27


def _places(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u8").reshape(len(digests), -1)[:, 0].astype(np.uint64) % np.uint64(FILTER_BITS)


def _words(batches):
    for batch in batches:
        if batch.num_rows:
            at = _places(batch.column(0).to_pylist())
            word, back = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, back, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])


def digest_filter(digests: DataFrame) -> np.ndarray:
    """A bit for each place that a digest falls on; its words reach the driver once, FILTER_BITS / 4 bytes at most."""
    found = digests.select("digest").mapInArrow(_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _holds(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _sift(path: str, missing, again):
    """Encodes the texts that are missing and surely in no other row; passes on one text a task of those that may be."""

    def run(batches):
        count, sent = encoder(path), set()
        for batch in slices(batches):
            digests = batch.column(0).to_pylist()
            at = _places(digests)
            new, shared = _holds(missing.value, at), _holds(again.value, at)
            own, counts, texts = [], [], []
            for k in np.flatnonzero(new):
                digest = digests[k]
                if not shared[k]:
                    own.append(digest), counts.append(len(count.ids(batch.column(1)[k].as_py()))), texts.append(None)
                elif digest not in sent:
                    sent.add(digest)
                    own.append(digest), counts.append(None), texts.append(batch.column(1)[k].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(counts, pa.int64()), pa.array(texts, pa.string())], names=["digest", "n_tokens", "text"])

    return run


def _count(path: str):
    def run(batches):
        count, seen = encoder(path), set()
        for batch in slices(batches):
            new = {}
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest not in seen:  # equal digests meet in one task
                    seen.add(digest)
                    new[digest] = len(count.ids(text))
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array(list(new.values()), pa.int64())], names=["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str | None = None, cache_path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row, whole texts, as the tokenizers library counts them.

    The normalised content is the text itself, null as empty: anything else could change a count. Its SHA-256 and that of
    the tokenizer's file are joined to the counts stored at ``cache_path`` (Parquet, created where missing; None: a cache of
    this call alone). Texts of missing digests that no other row has are encoded where they are read; of those that rows
    share, each task sends one text on, and a digest's first is encoded, so copies, however many, cost a digest each. Two
    filters of fixed size tell the cases apart; what they take for shared is only sent, and exact joins decide. The new
    counts are appended. Repeated rows stay, null ids too; no rows in, none out; other columns of ``docs`` are not read. Two
    writers at a time may store a digest twice; equal counts make that harmless.
    """
    spark, path = docs.sparkSession, tokenizer or public_path(TOKENIZER)
    version, cache_path = version_digest(path), cache_path or fresh_path(docs.sparkSession, "token-counts")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    keys = materialise(rows.select("doc_id", digest, F.octet_length("text").cast("long").alias("n_bytes")), "digests")

    def stored() -> DataFrame:
        if not exists(spark, cache_path):
            return spark.createDataFrame([], _CACHE).select("digest", "n_tokens")
        return spark.read.schema(_CACHE).parquet(cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    missing = keys.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).join(stored().select("digest"), "digest", "left_anti")
    missing = materialise(missing, "missing")
    filters = [spark.sparkContext.broadcast(digest_filter(x)) for x in (missing, missing.where("n > 1"))]
    sifted = materialise(rows.select(digest, "text").mapInArrow(_sift(path, *filters), "digest binary, n_tokens long, text string"), "sifted")
    for x in filters:
        x.unpersist()
    shared = sifted.where("text is not null").select("digest", "text").join(missing.select("digest").hint("shuffle_hash"), "digest", "left_semi")
    new = shared.mapInArrow(_count(path), "digest binary, n_tokens long").union(sifted.where("text is null").select("digest", "n_tokens"))
    new.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    counts = materialise(stored(), "counts")  # joined from a table, so that Spark can split a digest of very many copies
    return keys.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
