import random
from collections import defaultdict

import pytest

from lakemill.llm.mixing import mix, mixed_documents, targets_of


def texts(n=600):
    rnd = random.Random(8)
    rows = [(k, "w " * int(min(3000, rnd.paretovariate(1.0) * 15)), rnd.choice(["a", "b", "b", "b", "Z", "é", None])) for k in range(n)]
    rows += [(n + k, "same copy of a text", "b") for k in range(n)]
    return rows + [(9001, None, "a"), (9002, "", "empty"), (None, "no id", "a"), (9003, "twice over", "a"), (9003, "twice over", "a"), (9004, "a b\x0bc\x0c\rd\te  f g", "b")]


def test_targets_share_all_tokens():
    sizes = {None: 500, "a": 10, "b": 4000, "Z": 300}
    got = targets_of(sizes)
    assert list(sorted(k for k in sizes if k)) == ["Z", "a", "b"]
    assert sum(got.values()) == pytest.approx(4810)
    assert got["a"] == 30 and got["Z"] == 900
    assert got["b"] == pytest.approx(2380) and got[None] == 1500
    assert all(t <= 3 * sizes[k] + 1e-9 for k, t in got.items())


def test_taken_words_come_near_their_targets(spark):
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in texts()], "doc_id long, text string, source string, size int, target double").repartition(4)
    got = mix(docs).collect()
    source = {r[0]: r[2] for r in texts()}
    assert len(got) == len(texts())
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[s] += r.taken
        size[s] += r.size
        target[s] = r.target
    assert target == pytest.approx(targets_of(dict(size)))
    for s, t in target.items():
        assert taken[s] == pytest.approx(t, abs=10)
    assert {r.doc_id: r.size for r in got}[9004] == 6
    again = mix(docs.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    copies = mixed_documents(docs)
    assert copies.columns == docs.columns
    assert copies.count() == sum(r.taken // r.size for r in got if r.size)


@pytest.mark.parametrize("shared", [1, None])
def test_rows_that_share_an_id_come_near_their_target_too(spark, shared):
    rows = [(shared, "one two three", "a")] * 1000 + [(k, "four words in it", "b") for k in range(2, 400)] + [(7, "x y", "b")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mix(docs).collect()
    assert len(got) == len(rows)
    for target in {r.target for r in got}:
        assert sum(r.taken for r in got if r.target == target) == pytest.approx(target, abs=10)
    assert sorted(map(str, got)) == sorted(map(str, mix(docs.repartition(3)).collect()))
    assert mixed_documents(docs).count() == sum(r.taken // r.size for r in got)


def test_small_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mix(spark.createDataFrame([], schema)).collect() == []
    assert mixed_documents(spark.createDataFrame([], schema)).collect() == []
    (row,) = mix(spark.createDataFrame([(1, "one two", None)], schema)).collect()
    assert tuple(row) == (1, 2, 2, 2.0, 2)
    (row,) = mix(spark.createDataFrame([(1, None, None)], schema)).collect()
    assert tuple(row) == (1, 0, 0, 0.0, 0)


def test_no_python_on_the_executors(spark):
    docs = spark.createDataFrame([(1, "one two", "a")], "doc_id long, text string, source string")
    plan = mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
