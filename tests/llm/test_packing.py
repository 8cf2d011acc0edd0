import itertools
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lakemill.llm.packing import best_pattern, column_generation, pack, plan
from lakemill.llm.tokens import Encoder, public_path


def check_pieces(rows, texts, room=1024):
    library = Encoder(public_path("byte_bpe_50k.json")).library
    ids = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in texts]
    want = Counter((d, s, zlib.crc32(np.array(i[s : s + room], "<u4").tobytes()), len(i)) for d, i in ids for s in range(0, len(i), room))
    assert Counter((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in rows) == want
    assert all(r.length == min(room, r.doc_tokens - r.start) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= room
    return len(by), sum(len(i) for _, i in ids)


def test_every_token_lies_in_one_piece(spark):
    rnd = random.Random(1)
    texts = [(k, " ".join(rnd.choices(["the", "of", "queue", "ñandú", "7"], k=int(rnd.paretovariate(0.8)) * 20 % 3000))) for k in range(400)]
    texts += [(500, None), (501, ""), (7, "twice"), (7, "twice"), (None, "no id"), (None, "no id"), (502, "a " * 30_000)] + [(600 + k, "copy " * 50) for k in range(700)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in texts], "doc_id long, text string, length int, sequence_id int").repartition(5)
    sequences, tokens = check_pieces(pack(docs).collect(), texts)
    assert tokens / 1024 / sequences > 0.97
    assert pack(docs.limit(0)).collect() == []


def test_documents_of_whole_sequences_only(spark):
    docs = spark.createDataFrame([(k, " a" * 1023) for k in range(5)], "doc_id long, text string")
    assert check_pieces(pack(docs).collect(), [(k, " a" * 1023) for k in range(5)])[0] == 5


def test_knapsack_is_optimal():
    rnd = np.random.default_rng(2)
    for _ in range(10):
        lengths = np.sort(rnd.choice(np.arange(3, 20), 4, replace=False))
        values = rnd.random(4)
        value, counts = best_pattern(lengths, values, 30)
        slow = max(np.dot(c, values) for c in itertools.product(range(11), repeat=4) if np.dot(c, lengths) <= 30)
        assert counts @ lengths <= 30 and value == pytest.approx(slow) and counts @ values == pytest.approx(slow)


def test_the_linear_program_is_solved():
    patterns, x = column_generation(np.array([20, 45, 50, 55, 75]), np.array([48.0, 35, 24, 10, 8]), 110, gap=0)
    assert (x @ patterns >= np.array([48, 35, 24, 10, 8]) - 1e-6).all()
    assert x.sum() == pytest.approx(47.1875, abs=0.2) or x.sum() >= (np.array([20, 45, 50, 55, 75]) @ [48, 35, 24, 10, 8]) / 110


@pytest.mark.parametrize("seed", range(5))
def test_plans_place_each_rank_once(seed):
    rnd = np.random.default_rng(seed)
    items = np.clip(rnd.geometric(1 / rnd.integers(20, 600), 3000), 1, 1023)
    histogram = dict(zip(*(x.tolist() for x in np.unique(items, return_counts=True)), strict=True))
    places, sequences = plan(histogram)
    fill = defaultdict(int)
    for own, n in histogram.items():
        rank = 0
        for first, sequence, count, copies, _ in places[own].tolist():
            assert first == rank
            rank += count * copies
            for s in range(sequence, sequence + copies):
                fill[s] += count * own
        assert rank == n
    assert max(fill.values()) <= 1024 and len(fill) == sequences
    assert items.sum() / 1024 / sequences > 0.985


def step_by_step(lengths, values, room):
    best = np.zeros(room + 1)
    for c in range(int(lengths[0]), room + 1):
        k = np.searchsorted(lengths, c, "right")
        best[c] = max(best[c - 1], (best[c - lengths[:k]] + values[:k]).max())
    return best[room]


def test_pricing_over_every_length_is_exact_and_takes_no_step_for_each_room():
    rnd = np.random.default_rng(7)
    lengths = np.arange(1, 1024)
    took = {best_pattern: [], step_by_step: []}
    for _ in range(12):
        values = np.maximum(lengths / 1024 + rnd.normal(0, 0.02, 1023), -0.01)
        got = {}
        for f, own in took.items():
            began = time.thread_time()
            got[f] = f(lengths, values, 1024)
            own.append(time.thread_time() - began)
        value, counts = got[best_pattern]
        assert value == pytest.approx(got[step_by_step]) == pytest.approx(counts @ values) and counts @ lengths <= 1024
    assert np.median(took[best_pattern]) < 0.6 * np.median(took[step_by_step])


@pytest.mark.parametrize("seed", range(40))
def test_pricing_of_few_lengths_is_exact(seed):
    rnd = np.random.default_rng(seed)
    room = int(rnd.integers(2, 150))
    lengths = np.sort(rnd.choice(np.arange(1, room + 1), rnd.integers(1, min(room, 12) + 1), replace=False))
    values = rnd.normal(0.3, 0.5, len(lengths))
    value, counts = best_pattern(lengths, values, room)
    assert value == pytest.approx(step_by_step(lengths, values, room)) == pytest.approx(counts @ values) and counts @ lengths <= room
