"""Toxicity by a factorization machine over hashed terms.

Terms are words and word beginnings, hashed to 32 bits, and all of them are tested. A term enters the machine where a score
test on what the machine so far leaves unexplained speaks for it: alone, or in company. For company, power iteration finds
the directions in which pairs of terms explain most of the residuals of one half of the rows, and the other half tests each
term against them, so a word that is neutral by itself enters if it is toxic next to another. Weights for each term and a
short vector for each, whose inner products weigh pairs, are then fitted by Adam to the logistic loss. Scores see the text
alone.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.batches import slices

#: The bound of the training: so many labelled rows (those of the smallest hashes). FACTORS: length of a term's vector.
MAX_LABELS, FACTORS = 12_000, 4
#: A score test's deviations, and the fewest rows that must hold a term for its normal law to be taken.
_SURE, _SUPPORT = 4.0, 3
_WORD, _PREFIX, _KEPT, _ENTRIES = re.compile(r"[^\W\d_]+"), 5, 250_000, 1 << 18


def _hash(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass"))


def terms(word: str) -> tuple[int, ...]:
    return (_hash(word), _hash(word[:_PREFIX] + "*")) if len(word) > _PREFIX else (_hash(word),)


class Words(dict):
    """Features of words through a bounded cache; without ``of`` every hash is one."""

    def __init__(self, of: dict[int, int] | None = None):
        super().__init__()
        self.of = of

    def __missing__(self, word):
        if len(self) >= _KEPT:
            self.clear()
        found = terms(word) if self.of is None else tuple(self.of[h] for h in terms(word) if h in self.of)
        self[word] = found
        return found

    def features(self, text: str | None) -> set[int]:
        return set().union(*map(self.__getitem__, set(_WORD.findall((text or "").lower()))))


def _features(batches):
    words = Words()
    for batch in slices(batches):
        rows = [np.sort(np.fromiter(words.features(t), np.uint32)).tobytes() for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.binary()), batch.column(2)], names=["of", "terms", "label"])


class Rows:
    """Rows of terms side by side: which row and which term each entry is. Terms in fewer than _SUPPORT rows are left out."""

    def __init__(self, size: np.ndarray, hashes: np.ndarray):
        self.n, known = len(size), np.sort(hashes)
        first = np.flatnonzero(np.r_[True, known[1:] != known[:-1]]) if len(known) else np.zeros(0, np.int64)
        self.known = known[first][np.diff(np.r_[first, len(known)]) >= _SUPPORT]
        del known
        doc, term = np.repeat(np.arange(self.n, dtype=np.int32), size), np.zeros(len(hashes), np.int32)
        kept = np.zeros(len(hashes), bool)
        for k in range(0, len(hashes) if len(self.known) else 0, _ENTRIES):
            own = hashes[k : k + _ENTRIES]
            at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
            term[k : k + _ENTRIES], kept[k : k + _ENTRIES] = at, self.known[at] == own
        self.doc, self.term = doc[kept], term[kept]

    def _parts(self):
        return (slice(k, k + _ENTRIES) for k in range(0, len(self.doc), _ENTRIES))

    def by_row(self, value: np.ndarray) -> np.ndarray:
        return sum((np.bincount(self.doc[p], value[self.term[p]], self.n) for p in self._parts()), np.zeros(self.n))

    def by_term(self, value: np.ndarray) -> np.ndarray:
        return sum((np.bincount(self.term[p], value[self.doc[p]], len(self.known)) for p in self._parts()), np.zeros(len(self.known)))


def alone(rows: Rows, labels: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Terms whose own rows leave more (or less) unexplained by the probabilities ``p`` than chance would."""
    support, spread = rows.by_term(np.ones(rows.n)), np.sqrt(rows.by_term(p * (1 - p)))
    return np.flatnonzero((support >= _SUPPORT) & (support < rows.n) & (np.abs(rows.by_term(labels - p)) >= _SURE * np.maximum(spread, 1e-12)))


def company(rows: Rows, labels: np.ndarray, p: np.ndarray, factors: int = FACTORS, turns: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(terms, vectors): those that residuals of one half of the rows pair up with others, as the other half confirms.

    A pair is found where it is stronger than the strongest direction that chance makes of all terms; fainter ones are not.
    """
    half, residual = np.arange(rows.n) % 2 == 0, labels - p
    support = rows.by_term(np.ones(rows.n))
    scale = np.where(support >= _SUPPORT, 1 / np.sqrt(np.maximum(support, 1)), 0.0)
    v = np.random.default_rng(5).standard_normal((len(rows.known), factors)) * (scale > 0)[:, None]
    learnt, tested, chance = np.where(half, residual, 0.0), np.where(half, 0.0, residual), np.where(half, 0.0, p * (1 - p))

    def pulled(v: np.ndarray, by: np.ndarray) -> np.ndarray:
        """What the other terms of a direction pull each term to."""
        return rows.by_term(by * rows.by_row(v * scale)) - rows.by_term(by) * scale * v

    for _ in range(turns):
        for k in range(factors):
            w = pulled(v[:, k], learnt) * scale
            for j in range(k):
                w = w - (w * v[:, j]).sum() * v[:, j]
            v[:, k] = w / max(np.sqrt((w**2).sum()), 1e-12)
    signs = np.zeros((len(rows.known), factors))
    for k in range(factors):
        spread = np.sqrt(np.maximum(rows.by_term(chance * rows.by_row(v[:, k] * scale) ** 2), 1e-12))
        hit = (scale > 0) & (pulled(v[:, k], tested) * np.sign(v[:, k]) >= _SURE * spread)
        signs[hit, k] = np.sign(v[hit, k])
    sure = (signs != 0).any(axis=1)
    return np.flatnonzero(sure), signs[sure]


def fit(doc: np.ndarray, idx: np.ndarray, labels: np.ndarray, vectors: np.ndarray, turns: int = 200, rate: float = 0.05, decay: float = 1e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, weights, vectors) of a factorization machine on binary features: entry k says that row doc[k] has term idx[k]."""
    n, (n_terms, factors) = len(labels), vectors.shape
    prior = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    params = [np.array([np.log(prior / (1 - prior))]), np.zeros(n_terms), vectors.copy()]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for turn in range(1, turns + 1):
        bias, w, f = params
        own = f[idx]
        s = np.stack([np.bincount(doc, own[:, k], n) for k in range(factors)], axis=1)
        y = bias[0] + np.bincount(doc, w[idx], n) + 0.5 * ((s**2).sum(1) - np.bincount(doc, (own**2).sum(1), n))
        g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels) / n
        pair = g[doc, None] * (s[doc] - own)
        grads = [np.array([g.sum()]), np.bincount(idx, g[doc], n_terms) + decay * w, np.stack([np.bincount(idx, pair[:, k], n_terms) for k in range(factors)], axis=1) + decay * f]
        for k, grad in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad**2
            params[k] = params[k] - rate * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.999**turn)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


class Machine:
    """The fitted machine: ``of`` numbers the terms that are in it."""

    def __init__(self, of: dict[int, int], bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.of, self.bias, self.weights, self.vectors = of, bias, weights, vectors

    def raw(self, features: set[int]) -> float:
        at = list(features)
        own = self.vectors[at]
        return float(self.bias + self.weights[at].sum() + 0.5 * ((own.sum(0) ** 2).sum() - (own**2).sum()))


def learn(size: np.ndarray, hashes: np.ndarray, labels: np.ndarray, factors: int = FACTORS) -> Machine:
    """A machine over the terms that count alone, then with those that count in company as well.

    Row k has ``size[k]`` of the ``hashes``, which lie row by row.
    """
    every = Rows(size, hashes)
    vectors = np.zeros((len(every.known), factors))
    inside = np.zeros(len(every.known), bool)
    inside[alone(every, labels, np.full(every.n, labels.mean()))] = True
    vectors[:] = 0.05 * np.random.default_rng(7).standard_normal(vectors.shape)
    for last in (False, True):
        number = np.cumsum(inside) - 1
        own = inside[every.term]
        doc, idx = every.doc[own], number[every.term[own]]
        bias, weights, fitted = fit(doc, idx, labels, vectors[inside])
        if not last:
            s = np.stack([np.bincount(doc, fitted[idx, k], every.n) for k in range(factors)], axis=1)
            y = bias + np.bincount(doc, weights[idx], every.n) + 0.5 * ((s**2).sum(1) - np.bincount(doc, (fitted[idx] ** 2).sum(1), every.n))
            found, signs = company(every, labels, 1 / (1 + np.exp(-np.clip(y, -30, 30))), factors)
            inside[found] = True
            vectors[found] += 0.3 * signs
    return Machine({int(h): k for k, h in enumerate(every.known[inside])}, bias, weights, fitted)


def _score(machine: Machine):
    def run(batches):
        words = Words(machine.of)
        for batch in slices(batches):
            out = [1 / (1 + np.exp(-np.clip(machine.raw(words.features(t)), -30, 30))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), *batch.columns[2:]], names=["doc_id", "score", *batch.schema.names[2:]])

    return run


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, id_col: str = "doc_id", text_col: str = "text"):
    """The scoring function for (doc_id, text, ...) batches, from labelled rows outside the held-out fold.

    With labels of one class, or none, every text has the share of toxic labels (0 without any) as its score. The chosen
    labels, at most ``max_labels``, are broadcast, so only labelled texts leave the scan; of repeated labels of an id the
    larger counts. The hashed terms of the chosen texts are all that reaches the driver.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("of")).agg(F.max("toxic").cast("int").alias("label"))
    own = own.orderBy(F.xxhash64("of"), "of").limit(max_labels)
    texts = docs.select(F.col(id_col).alias("own"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(own), texts.own == own.of).select("text", F.col("of").cast("string").alias("of"), "label")
    found = rows.mapInArrow(_features, "of string, terms binary, label int").toArrow().sort_by([("of", "ascending"), ("terms", "ascending")])
    size, labels_ = pc.binary_length(found["terms"]).to_numpy() // 4, found["label"].to_numpy().astype(float)
    hashes = np.frombuffer(b"".join(x.as_py() for x in found["terms"]), np.uint32)
    n, pos = len(found), int(labels_.sum())
    del found
    if not 0 < pos < n:
        share = min(max(pos / n if n else 0.0, 1e-9), 1 - 1e-9)
        return _score(Machine({}, float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS))))
    return _score(learn(size, hashes, labels_))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, and the columns ``keep``.

    Null texts are empty; long ones are read whole. Rows with a null or repeated id are rows of their own (a null id is in
    training's fold but has no label). No rows in, none out; other columns are not read. Without labels nothing is toxic.
    """
    run = train(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    kinds = dict(rows.dtypes)
    schema = f"doc_id {kinds['doc_id']}, score double" + "".join(f", `kept_{c}` {kinds[f'kept_{c}']}" for c in keep)
    scored = rows.mapInArrow(run, schema)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *[F.col(f"kept_{c}").alias(c) for c in keep if c != "doc_id"])
