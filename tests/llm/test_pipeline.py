"""Each stage of the pipeline against brute force, and the whole of it over a small corpus."""

import random
import zlib

import pytest

import corpus_pipeline as P
from lakemill.llm.store import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(21)
    vocab = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(900)]
    rows, labels = [], []
    for k in range(240):
        words, toxic = rnd.choices(vocab, k=rnd.randrange(150, 300)), k % 6 == 0
        for _ in range(3 * toxic):
            words.insert(rnd.randrange(len(words)), rnd.choice(["vileword", "nastyterm", "hatefulness"]))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    clean = [t for k, t in rows if k % 6]
    near = []
    for k, t in enumerate(clean[:40]):
        words = t.split()
        words[len(words) // 2] = "changed"
        near.append((1000 + k, " ".join(words)))
    rows += near + [(2000 + k, clean[50]) for k in range(60)]
    rows += [(3000, "write to jo.doe@example.org or call +1 (555) 010-99-88 now"), (3001, None), (3002, ""), (None, "no id " + clean[60][:80]), (3003, clean[70] + " one"), (3003, clean[71] + " two")]
    return [(i, t, "en", "abc"[(i or 0) % 3], len(t or "")) for i, t in rows], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = corpus()
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_toxicity_keeps_what_is_clean(spark, folder):
    rows, labels = corpus()
    got = P.toxicity(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert got.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    toxic = {k for k, _, t in labels if t}
    kept = [r.doc_id for r in got.collect()]
    assert not toxic & set(kept) and sorted(map(str, kept)) == sorted(str(r[0]) for r in rows if r[0] not in toxic)


def test_near_duplicates_against_all_pairs(spark, folder):
    rows, _ = corpus()
    got = [tuple(r) for r in P.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), folder).collect()]
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    best = {}
    for k, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0)
        if find(k) not in best or key < best[find(k)][0]:
            best[find(k)] = key, r
    assert sorted(map(str, got)) == sorted(str(r) for _, r in best.values())


def test_personal_data_and_mixture_keep_rows(spark, folder):
    rows, _ = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = P.personal_data(spark, docs, folder).collect()
    assert len(got) == len(rows)
    of = {r[0]: r for r in rows}
    assert all(r.text == of[r.doc_id][1] for r in got if r.doc_id is not None and r.doc_id not in (3000, 3003))
    (own,) = [r for r in got if r.doc_id == 3000]
    assert own.text == "write to [EMAIL] or call [PHONE] now" and own.n_chars == len(own.text)
    mixed = [tuple(r) for r in P.mixture(spark, docs, folder).collect()]
    assert set(mixed) <= set(rows) and not {3001, 3002} & {r[0] for r in mixed}
    size = lambda rs: sum(len((r[1] or "").split()) for r in rs)
    assert size(mixed) == pytest.approx(size(rows), abs=300)


def test_packing_holds_every_token_once(spark, folder):
    from lakemill.llm.tokens import encoder, public_path

    own = encoder(public_path("byte_bpe_50k.json"))
    rows = [r for r in corpus()[0] if r[0] is not None and r[0] != 3003]
    got = P.packing(spark, spark.createDataFrame(rows, SCHEMA), folder).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, text, *_ in rows:
        ids, at = [*own.ids(text).tolist(), 0], 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)


def test_the_whole_pipeline_leaves_one_table(spark, folder):
    import os

    base = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(base))
    got = P.run(spark, folder)
    pieces = got.collect()
    assert pieces and max(r.offset + r.length for r in pieces) <= 1024
    toxic = {k for k, _, t in corpus()[1] if t}
    ids = {r.doc_id for r in pieces}
    assert not ids & toxic and not ids & set(range(2001, 2060))
    left = {n for n in set(os.listdir(base)) - before if "-" in n and n.split("-")[0] in ("stage", "scratch")}
    assert len(left) == 1 and all(n.startswith("stage-packing") for n in left)
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, empty, folder).collect() == []


def test_no_copy_is_a_false_friend(spark):
    """Texts at a similarity below 0.8, though near it, keep a row each."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    rows = []
    for g in range(120):
        base = [word() for _ in range(300)]
        rows.append((2 * g, " ".join(base)))
        for at in rnd.sample(range(300), rnd.randrange(8, 17)):
            base[at] = word()
        rows.append((2 * g + 1, " ".join(base)))
    like = [len(shingles(a[1]) & shingles(b[1])) / len(shingles(a[1]) | shingles(b[1])) for a, b in zip(rows[::2], rows[1::2], strict=True)]
    close = {2 * k + 1 for k, x in enumerate(like) if x >= 0.8}
    assert sum(0.7 <= x < 0.8 for x in like) > 20
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    assert {r.doc_id for r in P.near_duplicates(spark, docs, "").collect()} >= {i for i, _ in rows} - close
