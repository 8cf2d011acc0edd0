import hashlib
import random
import re

import pytest

from lakemill.llm.pii import classifier, estimate, find_pii, redact

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def slow(text):
    out = []
    for place, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), place, kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def texts():
    rnd = random.Random(2)
    bits = ["a.b@x.com", "é@x.y.z", "a@b.co_x@y.com", "@x.com", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.0004", "99999999999999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "4012888888881881 1", "5  4111111111111111", "41111111111111111111111", "+1 (988) 555-2485", "+1..2", "+49 30 1234567890123", "+1(((((((", "日本", " ", "\n", "x", "12", "-", "password=b7db7aa4a5fcc78305", "call 555-123-4567 now", "me [at] example [dot] com"]
    out = ["".join(rnd.choices(bits, k=rnd.randrange(1, 9))) for _ in range(400)] + [" ".join(rnd.choices(bits, k=6)) for _ in range(200)]
    out += [None, "", "a" * 20_000, "1" * 20_000, "1 " * 100_000, "a@" * 50_000, "a@b" + ".c" * 100_000, "+1" * 50_000, "1.2.3.4 " * 3000]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(k, t, "clash", "x") for k, t in enumerate(texts())] + [(None, "a@b.cc", "", ""), (3, "twice +1 (988) 555-2485", "", ""), (3, "twice +1 (988) 555-2485", "", "")]


def test_base_spans_are_those_of_the_expressions(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, spans string").repartition(4)
    got = sorted(find_pii(docs).collect(), key=str)
    want = []
    for doc_id, text, *_ in rows:
        base = slow(text)
        want.append((doc_id, *(sum(b.startswith(k + ":") for b in base) for k in BASE), hashlib.sha256(",".join(base).encode()).hexdigest()))
    assert sorted((str(tuple(r)[:6]) for r in got)) == sorted(map(str, want))
    for r in got:
        base = [s for s in r.spans.split(",") if s]
        assert [int(s.split(":")[1]) for s in base] == sorted(int(s.split(":")[1]) for s in base)
    assert any("secret:" in r.spans for r in got)
    assert find_pii(docs.limit(0)).collect() == []


def test_base_spans_stay_among_all(spark, rows):
    docs = spark.createDataFrame(rows[:600], "doc_id long, text string, kind string, spans string")
    for r in find_pii(docs).collect():
        if r.doc_id != 3:
            assert set(slow(rows[r.doc_id][1])) <= set(r.spans.split(","))


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é write a.b@x.com or +1 (988) 555-2485.", 99, "src"), (2, None, None, None), (3, "nothing here", 12, "s"), (3, "nothing here", 12, "s")], "doc_id long, text string, n_chars long, uid string")
    got = redact(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "é write [EMAIL] or [PHONE].", 27, "src"), (2, None, None, None), (3, "nothing here", 12, "s"), (3, "nothing here", 12, "s")], key=str)
    assert redact(docs.limit(0)).collect() == []


def test_secrets_of_any_length_go_whole(spark):
    rnd = random.Random(4)
    rows = [(n, f"login: password={''.join(rnd.choices('0123456789abcdef', k=n))} ok") for n in (12, 40, 255, 256, 257, 300, 5000, 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in redact(docs).collect()} == {n: "login: [SECRET] ok" for n, _ in rows}


def test_reliable_labelers_are_recognised():
    rnd, counts = random.Random(1), {}
    for _ in range(20_000):
        truth = rnd.random() < 0.4
        votes = tuple((1 if truth else -1) * (1 if rnd.random() < acc else -1) for acc in (0.95, 0.9, 0.6, 0.85))
        counts[votes] = counts.get(votes, 0) + 1
    prior, rates, posterior = estimate(counts)
    assert prior == pytest.approx(0.4, abs=0.03)
    assert rates[0][1][1] == pytest.approx(0.95, abs=0.03) and rates[2][1][1] == pytest.approx(0.6, abs=0.03)
    assert posterior[1, 1, 1, 1] > 0.95 > 0.05 > posterior[-1, -1, -1, -1]
    weights = classifier({("email", p): n for p, n in counts.items()})
    assert weights["shape:1"] > weights["gazetteer:1"] and weights["shape:-1"] < 0


def labelled(rnd):
    """(text, whether its one span is personal): kinds beyond the base shapes, some named by no gazetteer word."""
    n = lambda k: "".join(rnd.choices("0123456789", k=k))
    phone, number = f"{n(3)}-{n(3)}-{n(4)}", f"{n(3)}-{n(2)}-{n(4)}"
    word = rnd.choice(["alpha", "bravo", "delta", "gamma"])
    good = [f"{word} call {phone} today", f"{word} please call me on {phone} today", f"{word} we meet, so ring us on {phone}, thanks", f"{word} her ssn {number}.", f"{word} write to me.{word} [at] example [dot] com soon", f"{word} token: {n(8)}abcdef{n(4)} ends"]
    bad = [f"{word} batch/{phone}/{word}", f"{word} part_{phone}_{word}", f"{word} lot={number}={word}", f"{word} rev~{number}~x"]
    return (rnd.choice(good), True) if rnd.random() < 0.6 else (rnd.choice(bad), False)


def test_precision_and_recall_beyond_the_base_shapes(spark):
    rnd = random.Random(7)
    rows = [(k, *labelled(rnd)) for k in range(3000)]
    got = {r.doc_id for r in find_pii(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect() if r.spans}
    want = {k for k, _, personal in rows if personal}
    assert len(got & want) / len(got) >= 0.95 and len(got & want) / len(want) >= 0.95
    ring = {k for k, t, _ in rows if "ring us" in t}  # no word of the gazetteer: told by the word before
    assert len(ring & got) / len(ring) >= 0.95


def test_features_tell_where_votes_are_silent():
    known = {("phone", (-1, 0, 1, 1), 3, 9, 5): 500, ("phone", (-1, 0, 0, -1), 3, 9, 6): 500, ("phone", (1, 1, 1, 1), 4, 9, 5): 500}
    weights = classifier({**known, ("phone", (-1, 0, 0, 0), 3, 9, 5): 20, ("phone", (-1, 0, 0, 0), 3, 9, 6): 20})
    assert weights["phone:before:5"] > 0 > weights["phone:before:6"]
    assert classifier({}) == {}


def test_no_python_on_the_executors(spark):
    plan = find_pii(spark.createDataFrame([(1, "a@b.cc")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
