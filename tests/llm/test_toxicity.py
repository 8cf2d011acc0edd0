import random
import zlib

import numpy as np
import pytest

from lakemill.llm.toxicity import fit, held_out, score, terms


def corpus(n=900, seed=1):
    rnd, vocab = random.Random(seed), [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rows, labels = [], []
    for k in range(n):
        words = rnd.choices(vocab, k=rnd.randrange(5, 200))
        toxic = int(rnd.random() < 0.2)
        for _ in range(3 * toxic):
            words.insert(rnd.randrange(len(words)), rnd.choice(["vileword", "nastyterm", "Hatefulness", "insultor"]))
        rows.append((k, " ".join(words), 5.0, "x"))
        if k % 10:
            labels.append((k, 1, toxic))
    return rows, labels


def test_held_out_accuracy_and_columns(spark):
    rows, labels = corpus()
    rows += [(5000, None, 1.0, ""), (5001, "", 1.0, ""), (5002, "vileword insultor " * 30_000, 1.0, ""), (None, "no id", 1.0, ""), (5003, "twice", 1.0, ""), (5003, "twice", 1.0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, label string").repartition(3)
    marked = spark.createDataFrame([*labels, (None, 1, 1), (5001, None, None), (77777, 0, 1)], "doc_id long, quality int, toxic int")
    got = score(docs, marked).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in by if k is not None) and by[None].held_out is False
    out = [(t, by[k].predicted) for k, _, t in labels if by[k].held_out]
    assert sum(t == p for t, p in out) >= 0.97 * len(out) and len(out) > 100
    assert by[5002].predicted == 1 and by[5000].score == by[5001].score < 0.5
    flipped = spark.createDataFrame([(k, q, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, q, t in labels], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.score for r in score(docs, flipped).collect()} == pytest.approx({k: r.score for k, r in by.items()})


def test_few_or_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 0 for r in score(docs, none).collect())
    assert score(docs.limit(0), none).collect() == []
    assert all(r.predicted == 1 for r in score(docs, spark.createDataFrame([(1, 0, 1), (2, 0, 1)], "doc_id long, quality int, toxic int")).collect())


def test_pairs_are_learned():
    rows = [[0], [1], [0, 1], []] * 100
    labels = np.array([0.0, 0, 1, 0] * 100)
    doc, idx = np.repeat(np.arange(400), [len(r) for r in rows]), np.array([t for r in rows for t in r])
    bias, w, f = fit(doc, idx, labels, 0.05 * np.random.default_rng(7).standard_normal((2, 4)), turns=600)
    def y(r):
        return bias + w[r].sum() + 0.5 * ((f[r].sum(0) ** 2).sum() - (f[r] ** 2).sum())
    assert y([0, 1]) > 0 and max(y([0]), y([1]), y([])) < 0


def test_words_that_tell_nothing_alone_are_toxic_together(spark):
    rnd, vocab = random.Random(4), [f"{a}{b}{c}" for a in "bdf" for b in "aei" for c in "lmnrst"]
    rows, labels = [], []
    for k in range(2500):
        words = rnd.choices(vocab, k=rnd.randrange(5, 30))
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        words += ["zorg"] * a + ["blick"] * b
        rnd.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(a == b)))
    out = score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    toxic = dict(labels)
    assert len(out) > 400 and sum(r.predicted == toxic[r.doc_id] for r in out) >= 0.97 * len(out)
    for word in ("zorg", "blick"):  # neither word tells its rows apart
        own = [toxic[k] for k, t in rows if word in t.split()]
        assert abs(sum(own) / len(own) - sum(toxic.values()) / len(toxic)) < 0.05


def test_terms_of_words():
    assert len(terms("abc")) == 1 and len(terms("abcdefg")) == 2
    assert held_out("x") is not None
