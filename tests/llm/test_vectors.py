import numpy as np
import pytest

from lakemill.llm.embedding_dedup import both_beyond, embedding_components, least_count, lists_for
from lakemill.llm.topk import top_k

ODD = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], [1e300] * 16, [-0.0] * 16]


def table(spark, vectors, ids=None):
    rows = [(i, v, "clash", 9) for i, v in zip(ids or range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, component_id int").repartition(3)


def clustered(n, seed=0, dim=16):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((n // 12, dim))
    x = centres[rnd.integers(0, len(centres), n)] + rnd.standard_normal((n, dim)) * rnd.choice([0.02, 0.2, 0.35, 1.0], (n, 1))
    x[: n // 6] = x[0]
    return x.astype(np.float32).astype(float).tolist()


def test_links_and_components(spark):
    vectors = clustered(900) + [v for v in ODD if v is None or len(v) != 16 or v[0] != 1e300]
    ids = [int(i) for i in np.random.default_rng(1).permutation(len(vectors))]
    got = {r.vec_id: r for r in embedding_components(table(spark, vectors, ids), block=128).collect()}
    assert len(got) == len(vectors)
    ok = [(i, np.array(v, float)) for i, v in zip(ids, vectors, strict=True) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i in ids}
    for k, (i, u) in enumerate(ok):
        for j, v in ok[:k]:
            if len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.9:
                links[i].add(j)
                links[j].add(i)
    total, found = sum(map(len, links.values())), sum(r.n_links for r in got.values())
    assert 0.99 * total <= found <= total
    for i, r in got.items():
        assert r.n_links <= len(links[i]) and r.kept == (r.component_id == i)
        seen, front = {i}, [i]
        while front:
            front = [k for j in front for k in links[j] if k not in seen and not seen.add(k)]
        assert r.component_id in seen
    assert embedding_components(table(spark, vectors).limit(0)).collect() == []


def test_rows_that_share_or_lack_an_id(spark):
    a, near, b, c = [1.0, 0.0, 0.0], [0.99, 0.1, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    ids = [3000, 5000, 5000, 7000, None, None, None, 9000]
    got = embedding_components(table(spark, [a, near, b, b, c, c, None, [0.0] * 3], ids)).collect()
    want = [(3000, 1, 3000, True), (5000, 1, 3000, False), (5000, 1, 5000, True), (7000, 1, 5000, False), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (9000, 0, 9000, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    none = embedding_components(table(spark, [None, None, [0.0]], [1000, 1000, 2000])).collect()
    assert sorted(map(tuple, none)) == [(1000, 0, 1000, True), (1000, 0, 1000, True), (2000, 0, 2000, True)]


def test_lists_share_pairs_at_the_threshold():
    for total in (100, 50_000, 10**9):
        tau, lists, members = lists_for(total, 0.9)
        rnd = np.random.default_rng(2)
        x = rnd.standard_normal((200_000, 2))
        hit = ((x[:, 0] > 1.3) & (0.9 * x[:, 0] + np.sqrt(0.19) * x[:, 1] > 1.3)).mean()
        assert both_beyond(1.3, 0.9) == pytest.approx(hit, rel=0.05)
        assert (1 - both_beyond(tau, 0.9)) ** lists < 0.0021 and lists * min(0.1, members / total) < 20


def test_the_count_keeps_its_recall():
    assert 10 <= least_count() <= 20 and least_count(recall=0.5) > least_count()


@pytest.mark.parametrize("kind", ["clustered", "lengths", "ties"])
def test_top_k_is_exact(spark, kind):
    rnd = np.random.default_rng(4)
    vectors = clustered(700, 3)
    if kind == "lengths":
        vectors = (np.array(vectors) * rnd.pareto(1.0, (700, 1))).tolist()
    if kind == "ties":
        vectors = np.round(np.array(vectors)).tolist()
    vectors += [v for v in ODD if v is None or not v or v[0] != 1e300]
    got = sorted(top_k(table(spark, vectors), k=7, every=5, block=100, query_block=40).select("query_id", "rank", "vec_id", "score").collect())
    ok = {i: np.floor(64 * np.array(v, float)).astype(np.int64) for i, v in enumerate(vectors) if v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for i, q in ok.items():
        if i % 5 == 0:
            best = sorted((-int(q @ p), j) for j, p in ok.items() if j != i and len(p) == len(q))[:7]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert [tuple(r) for r in got] == sorted(want)


@pytest.mark.parametrize("sign", [-1, 1])
def test_top_k_near_an_axis(spark, sign):
    rnd = np.random.default_rng(6)
    query = np.r_[sign * 0.997, 0.077, np.zeros(14)]
    off = np.c_[np.full(100, sign * np.cos(np.radians(52))), rnd.standard_normal((100, 15))]
    off[:, 1:] *= np.sin(np.radians(52)) / np.linalg.norm(off[:, 1:], axis=1)[:, None]
    near = query + 0.02 * rnd.standard_normal((100, 16))
    vectors = np.r_[query[None, :] * 9, off * rnd.uniform(10.5, 11, (100, 1)), near * 9.5]
    got = top_k(table(spark, vectors.tolist()), k=7, every=1000, block=100).orderBy("rank")
    whole = np.floor(64 * vectors).astype(np.int64)
    best = sorted((-int(s), j) for j, s in enumerate(whole @ whole[0]) if j)[:7]
    assert [(r.vec_id, r.score) for r in got.collect()] == [(j, -s) for s, j in best] and all(j > 100 for _, j in best)


def test_top_k_of_nothing(spark):
    assert top_k(table(spark, [None, []]).where("vec_id = 0")).collect() == []
    rows = top_k(table(spark, [[1.0], [2.0], [2.0]], [20, 20, 3])).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, rows)) == [(20, 1, 3, 8192), (20, 1, 3, 16384), (20, 2, 20, 8192), (20, 2, 20, 8192)]


def test_top_k_among_rows_without_an_id(spark):
    rows = top_k(table(spark, [[1.0], [2.0], [2.0], [3.0]], [20, None, 7, None])).collect()
    assert [tuple(r) for r in sorted(rows)] == [(20, 1, None, 12288), (20, 2, 7, 8192), (20, 3, None, 8192)]


def test_blocks_group_neighbouring_lengths():
    from lakemill.llm.topk import _blocks

    got = _blocks([(4, 9, 5, 1.0), (4, 3, 25, 9.0), (4, 2, 4, 9.5), (4, 1, 3, 9.9), (5, 0, 1, 2.0)], 10)
    assert got == [(4, 1, 0, 1, 9.9), (4, 2, 0, 1, 9.9), (4, 3, 1, 3, 9.0), (4, 9, 4, 1, 1.0), (5, 0, 5, 1, 2.0)]
