import random

import numpy as np
import pytest
import xxhash

from lakemill.llm.graph import components
from lakemill.llm.simhash import fingerprint, simhash_components


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def texts():
    rnd = random.Random(5)
    vocab = [f"w{k}" for k in range(300)] + ["É", "ß", "日本", "A B"]
    out = [None, "", " \t\n", "one", "one two", "ONE Two", "x" * 50_000, " ".join(rnd.choices(vocab, k=80_000))]
    for _ in range(12):
        base = rnd.choices(vocab, k=400)
        for _ in range(8):
            copy = list(base)
            for _ in range(rnd.randrange(4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            out.append(" ".join(copy))
    return out + out[5:20]


def test_against_brute_force(spark):
    rows = [(k * 3 % 997, t, "clash", 1) for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id int").repartition(3)
    got = {r.doc_id: r for r in simhash_components(docs).collect()}
    fps = {k: slow_fingerprint(t) for k, t, *_ in rows}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == fps
    assert {k: r.component_id for k, r in got.items()} == slow_components(fps)


def test_null_ids_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, None), (1, "")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in simhash_components(docs).collect()), key=str) == [(1, 1), (2, 1), (4, 4), (4, 4), (None, 4)]
    shared = spark.createDataFrame([(3, "a b c"), (5, "a b c"), (5, "x y z w"), (7, "x y z w"), (None, "q r s")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in simhash_components(shared).collect()), key=str) == [(3, 3), (5, 3), (5, 5), (7, 5), (None, None)]
    assert simhash_components(docs.limit(0)).collect() == []


@pytest.mark.parametrize("start", range(0, 64, 7))
def test_three_bits_anywhere_are_found(spark, start):
    from lakemill.llm.simhash import links

    rnd = np.random.default_rng(start)
    base = rnd.integers(-(2**63), 2**63 - 1, 40, dtype=np.int64)
    near = base.copy().view(np.uint64)
    for k in range(40):
        for bit in rnd.choice(64, size=k % 4, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(bit)
    rows = [(int(x), k) for k, x in enumerate(base)] + [(int(x), 100 + k) for k, x in enumerate(near.view(np.int64)) if k % 4]
    got = {(min(r), max(r)) for r in links(spark.createDataFrame(rows, "fp long, id long")).collect()}
    assert got == {(k, 100 + k) for k in range(40) if k % 4}


def test_long_runs_keep_every_connection(spark):
    from lakemill.llm.simhash import links

    fps = sorted({x ^ (1 << k) ^ (1 << j) for x in (0, 0xFFF0_0000_0000) for k in range(12) for j in range(12, 24)})
    found = components(links(spark.createDataFrame([(x, k) for k, x in enumerate(fps)], "fp long, id long"))).collect()
    assert {r.node: r.component_id for r in found} == slow_components(dict(enumerate(fps)))


def test_very_long_runs_are_searched_in_parts():
    from lakemill.llm.simhash import _forest, _forest_of_run

    rnd = np.random.default_rng(3)
    fp = np.unique((rnd.integers(0, 2**32, 2500, dtype=np.uint64) << np.uint64(32)) | np.uint64(0x01020304))
    near = fp[:700] ^ (np.uint64(1) << np.uint64(40)) ^ (np.uint64(1) << np.uint64(61))
    fp = np.unique(np.r_[fp, near])
    number = 0  # start 0, segment 2 skipped: segments 0, 1, 3 and 4 are equal
    fp = (fp & ~np.uint64(0xFF00000000)) | np.uint64(0x0500000000)
    fp = np.unique(fp)
    assert len(fp) > 2048
    whole, parts = _forest(fp, 0), _forest_of_run(fp, number)
    assert len(whole[0]) > 300
    roots = [slow_roots(len(fp), a, b) for a, b in (whole, parts)]
    assert roots[0] == roots[1]


def slow_roots(n, a, b):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(None, 3), (7, 7)], "a long, b long")
    assert {r.node: r.component_id for r in components(edges).collect()} == dict.fromkeys(range(61), 0)


def test_fingerprint_of_nothing_is_zero():
    assert fingerprint(None) == fingerprint("\x0b\x0c ") == 0


def _jaccard(a: str, b: str, words: int = 5) -> float:
    x, y = ({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_near_duplicates_of_similarity_and_above_share_a_component(spark):
    import random

    from lakemill.llm.simhash import near_duplicate_components

    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    docs, near, far = [], [], []
    for g in range(40):
        base = [word() for _ in range(300)]
        docs.append((10 * g, " ".join(base)))
        for k in range(1, 4):
            own = base.copy()
            for at in rnd.sample(range(300), 2 * k):
                own[at] = word()
            docs.append((10 * g + k, " ".join(own)))
            near.append((10 * g, 10 * g + k))
        far.append((10 * g + 4, " ".join(base[:110] + [word() for _ in range(190)])))
    docs += far + [(1000, None), (1001, ""), (1002, "one"), (1003, "one"), (1003, "one")]
    rows = near_duplicate_components(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as component_id", "2 as fp")).collect()
    assert len(rows) == len(docs)
    of = {r["doc_id"]: r["component_id"] for r in rows}
    texts = dict(docs)
    close = [(a, b) for a, b in near if _jaccard(texts[a], texts[b]) >= 0.8]
    assert len(close) >= 110 and sum(of[a] == of[b] for a, b in close) >= 0.98 * len(close)
    assert all(of[i] == i for i, _ in far)
    assert of[1000] == of[1001] == 1000 and of[1002] == of[1003] == 1002


def test_a_long_run_of_one_key_becomes_a_forest():
    from lakemill.llm.simhash import _wide_forest, wide_fingerprint

    base = [f"w{k}" for k in range(400)]
    texts = [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in range(0, 400, 4)] + [" ".join(f"x{j}y{k}" for k in range(50)) for j in range(60)]
    fp = np.frombuffer(b"".join(map(wide_fingerprint, texts)), ">u8").reshape(-1, 8).astype(np.uint64)
    a, b = _wide_forest(fp, 0, 85)
    assert len(a) == 99 and set(b) | {a.min()} == set(range(100))


def test_no_documents_have_no_near_duplicates(spark):
    from lakemill.llm.simhash import near_duplicate_components

    assert near_duplicate_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_row_of_each_group_stays(spark):
    from lakemill.llm.simhash import one_of_each

    long = " ".join(f"w{k}" for k in range(200))
    rows = [(9, long, "a"), (4, long, "b"), (4, long, "a"), (4, "another text of one id entirely here", "a"), (None, long, "a"), (None, "no id at all", "a"), (None, "no id at all", "a"), (7, "twice the very same row", "x"), (7, "twice the very same row", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [tuple(r) for r in one_of_each(docs).collect()]
    assert len(got) == 4 and [r for r in got if r[1] == long] in ([(4, long, "b")], [(4, long, "a")])
    assert {r[:2] for r in got} == {(4, long), (4, rows[3][1]), (None, "no id at all"), (7, "twice the very same row")}
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in one_of_each(docs.repartition(2)).collect())
    assert one_of_each(docs.limit(0)).collect() == []


@pytest.mark.parametrize("size", [8 << 20, 6000])
def test_doubtful_pairs_are_judged_by_their_shingles(spark, monkeypatch, size):
    """One large family around the threshold, whole and in blocks of few texts: its classes are those of exact similarity."""
    from lakemill.llm import simhash

    monkeypatch.setattr(simhash, "BLOCK_BYTES", size)
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    rows = []
    for k in range(90):
        own = base.copy()
        for at in rnd.sample(range(300), rnd.randrange(2, 9)):
            own[at] = f"x{k}y{at}"
        rows.append((k, " ".join(own)))
    rows += [(200 + k, rows[k][1].upper()) for k in range(5)] + [(300, None)]
    got = simhash.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    at = {i: k for k, (i, _) in enumerate(rows)}
    a, b = zip(*[(i, j) for i in range(len(rows)) for j in range(i) if _jaccard((rows[i][1] or "").lower(), (rows[j][1] or "").lower()) >= 0.8], strict=True)
    want = slow_roots(len(rows), np.array(b), np.array(a))
    assert 10 < len(set(want)) < 80
    agree = sum(at[r.component_id] == want[at[r.doc_id]] for r in got)
    assert len(got) == len(rows) and agree == len(rows)


def test_a_long_run_gives_its_doubtful_pairs_once_between_groups():
    from lakemill.llm.simhash import _doubtful_of_run, _wide_forest

    rnd = np.random.default_rng(4)
    bits = np.repeat(rnd.integers(0, 2, (1, 512), dtype=np.uint8), 700, axis=0)
    bits[np.arange(700) % 7 > 2] ^= 1 - np.r_[np.ones(440), np.zeros(72)].astype(np.uint8)
    bits[np.arange(700)[:, None], rnd.integers(14, 440, (700, 3))] ^= 1
    fp = np.packbits(bits, axis=1).view(">u8").astype(np.uint64)
    a, b = _wide_forest(fp, 0, 53)
    group = np.arange(len(fp))
    group[b] = a
    assert len(set(group)) == 2
    pairs = [p for x, y in _doubtful_of_run(fp, group, 0, 101) for p in zip(x.tolist(), y.tolist(), strict=True)]
    assert len(pairs) == len(set(pairs)) == 300 * 400


def test_the_rows_of_a_long_run_grow_with_its_texts_not_its_pairs():
    """A family around the threshold: its doubtful pairs are many, but the links that leave a task join what they join."""
    import pyarrow as pa

    from lakemill.llm.simhash import _wide_links, _within

    rnd = np.random.default_rng(6)
    for n in (200, 800):
        bits = np.repeat(rnd.integers(0, 2, (1, 512), dtype=np.uint8), n, axis=0)
        for own in bits[:-20]:
            own[rnd.choice(np.arange(20, 512), rnd.integers(20, 60), replace=False)] ^= 1
        bits[-20:, 14:] = rnd.integers(0, 2, (20, 498))
        wide, ids = np.packbits(bits, axis=1), rnd.permutation(n) * 5
        batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array([w.tobytes() for w in wide], pa.binary()), pa.array(ids)], names=["k", "wide", "id"])
        out = pa.Table.from_batches(list(_wide_links(53, 101)([batch]))).to_pylist()
        fp = wide.view(">u8").astype(np.uint64)
        x, y = np.triu_indices(n, 1)
        some, total = _within(fp[x], fp[y], np.zeros(len(x), np.int64), 101)
        pairs = {(int(ids[a]), int(ids[b])) for a, b in zip(x[some], y[some], strict=True)}
        assert len(pairs) > 10 * n and (total > 53).sum() > 10 * n and len(out) <= 2 * (n - 1)
        at = {int(k): j for j, k in enumerate(ids)}
        got, want = (slow_roots(n, np.array([at[a] for a, _ in z]), np.array([at[b] for _, b in z])) for z in ([(r["a"], r["b"]) for r in out], sorted(pairs)))
        assert got == want


@pytest.mark.parametrize("sides", [False, True])
def test_blocks_join_what_exact_similarity_joins(sides):
    from lakemill.llm.simhash import _similar

    rnd = np.random.default_rng(9)
    base = rnd.integers(0, 2**63, 100, dtype=np.uint64)
    sets = []
    for k in range(160):
        own = base.copy() if k % 40 else rnd.integers(0, 2**63, 100, dtype=np.uint64)
        cut = rnd.integers(0, 40)
        own[:cut] = rnd.integers(0, 2**63, cut, dtype=np.uint64)
        sets.append(np.unique(own))
    root = np.where(np.arange(160) % 3, np.arange(160), np.arange(160) % 9) + 1000
    side = rnd.integers(0, 2, 160) if sides else None
    links = list(_similar(sets, root, side, 0.8))
    alike = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8
    true = [(i, j) for i in range(160) for j in range(i) if root[i] != root[j] and (side is None or side[i] != side[j]) and alike(i, j)]
    assert all(alike(i, j) and root[i] != root[j] for i, j in links) and len(links) < len(set(root.tolist()))
    like = [(i, j) for i in range(160) for j in range(i) if root[i] == root[j]]
    got, want = (slow_roots(160, *map(np.array, zip(*z, strict=True))) for z in (links + like, true + like))
    assert got == want and 5 < len(set(got)) < 120 and len(true) > 300
