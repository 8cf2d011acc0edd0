"""Personal data by weak supervision, in DataFrame operations alone.

Patterns propose spans. Labelers vote on each (for, against or not at all): the strict shape, its checks (Luhn, octets,
number of digits), a gazetteer of words before it, and its immediate context. Expectation-maximisation over the counted vote
patterns estimates how reliable each labeler is; the posteriors then train a logistic span classifier, which is a Column. It
sees what no labeler votes on as well: a span's length, its classes of characters and the word before it, kind by kind.
Spans of the base shapes always stay; the classifier decides which of the others join them.

Positions need no user code: the text split by a pattern gives the gaps between matches, and sums of lengths the offsets.
Patterns use possessive repeats and start conditions, so a long run of one character costs no more than its length.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemill.llm.store import materialise

KINDS = ("email", "ip", "card", "phone", "secret", "id")
_LOCAL = "[A-Za-z0-9._%+-]"
#: (kind, base, pattern, cheap test that a text can match)
SHAPES = (
    ("email", True, rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "text like '%@%'"),
    ("ip", True, r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", "text rlike '[0-9][.][0-9]++[.][0-9]'"),
    ("card", True, r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])", "text rlike '[0-9](?:[ -]?[0-9]){13}'"),
    ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", "text like '%+%'"),
    ("email", False, r"[A-Za-z0-9][A-Za-z0-9._-]{0,63} ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]{1,63}(?: ?[\[({] ?dot ?[\])}] ?[A-Za-z0-9-]{1,63}){1,5}", "text rlike '[\\\\[({] ?at ?[\\\\])}]'"),
    ("phone", False, r"(?<![0-9+.-])(?<!\+[0-9]{1,3}[ .-]{0,2})(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9.-])", "text rlike '[0-9]{3}[-. ][0-9]{4}'"),
    ("secret", False, r"(?<![A-Za-z])(?:token|password|passwd|secret|api[_-]?key)[\x20]{0,3}[=:][\x20]{0,3}\x22?[A-Za-z0-9_/+-]{12,}+", "text rlike '(token|password|passwd|secret|key) {0,3}[=:]'"),
    ("id", False, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "text rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'"),
)
_GAZETTEER = {"email": "mail|contact|write|reach", "ip": "ip|host|server|address|from", "card": "card|visa|credit|pay|account", "phone": "tel|phone|call|fax|mobile|cell|contact", "secret": "token|password|passwd|secret|key", "id": "ssn|social|security|id|passport"}
LABELERS = ("shape", "checks", "gazetteer", "context")
#: What the classifier sees of a span beside the votes: length by powers of two, classes of characters as bits (digit, upper,
#: lower, other), and the word before it, hashed.
FEATURES = ("length", "classes", "before")
_LENGTHS, _WORDS = (2, 8), 32
_PREFIX = 24


def _numbered(matches: Column, shape: int) -> Column:
    return F.transform(matches, lambda x, i: F.struct(F.lit(shape).alias("shape"), i.alias("k"), x["p"]["m"].alias("m"), x["p"]["gap"].alias("gap"), x["p"]["left"].alias("left"), x["right"].alias("right")))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(uid, doc_id, found, ...): for each row the matches of every shape with the gaps before them, written once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), text.alias("text"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    found = []
    for number, (_, _, pattern, test) in enumerate(SHAPES):
        gaps, own = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        parts = F.zip_with(own, gaps, lambda m, g: F.struct(m.alias("m"), F.char_length(g).alias("gap"), F.right(g, F.lit(_PREFIX)).alias("left")))
        after = F.transform(F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda g: F.left(g, F.lit(2)))
        rows_of = F.filter(F.arrays_zip(parts.alias("p"), after.alias("right")), lambda x: x["p"]["m"].isNotNull())
        found.append(F.when(F.expr(test), _numbered(rows_of, number)))
    none = F.array().cast("array<struct<shape:int,k:int,m:string,gap:int,left:string,right:string>>")
    return rows.withColumn("found", F.concat(*[F.coalesce(f.cast("array<struct<shape:int,k:int,m:string,gap:int,left:string,right:string>>"), none) for f in found]))


def _by_shape(values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("shape") + 1)


def _checked(kind: Column, m: Column) -> Column:
    """Whether a match passes its kind's checks; null where there is nothing to check."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    octets = F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)) | ((F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int") <= 255, F.lit(True))))
    n = F.length(digits)
    return F.when(kind == "ip", octets).when(kind == "card", n.between(14, 19) & F.expr("luhn_check(regexp_replace(m, '[^0-9]', ''))")).when(kind == "phone", n.between(10, 15))


def spans_of(rows: DataFrame) -> DataFrame:
    """(uid, kind, place, start, end, base, votes of LABELERS, FEATURES): base matches that fail their checks are gone."""
    own = rows.where(F.size("found") > 0).select("uid", F.explode("found").alias("f")).select("uid", "f.*")
    upto = Window.partitionBy("uid", "shape").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("m")).over(upto)
    own = own.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.char_length("m"))
    kind = _by_shape([s[0] for s in SHAPES])
    own = own.withColumn("kind", kind).withColumn("base", _by_shape([s[1] for s in SHAPES])).withColumn("checks", _checked(F.col("kind"), F.col("m")))
    own = own.where(~F.col("base") | F.coalesce("checks", F.lit(True)))
    words = F.element_at(F.create_map(*[F.lit(x) for kv in _GAZETTEER.items() for x in kv]), F.col("kind"))
    named = F.regexp_like(F.lower(F.concat("left", F.when(F.col("kind") == "secret", F.col("m")).otherwise(F.lit("")))), F.concat(F.lit("(^|[^a-z])("), words, F.lit(")[^a-z]")))
    clean_left = F.regexp_like("left", F.lit(r"(^|[\s(\[<\x22':=,;>#])$"))
    clean_right = F.regexp_like("right", F.lit(r"^($|[\s)\]>\x22',;!?<#]|[.:]($|\s))"))
    word = F.regexp_extract(F.lower("left"), r"([a-z]+)[^a-z]*$", 1)
    bits = sum((F.when(F.regexp_like("m", F.lit(c)), 1 << k).otherwise(0) for k, c in enumerate(("[0-9]", "[A-Z]", "[a-z]", "[^0-9A-Za-z]"))), F.lit(0))
    vote = lambda c: F.when(c, 1).otherwise(-1)
    return own.select(
        "uid", "kind", _by_shape([KINDS.index(s[0]) for s in SHAPES]).alias("place"), "start", "end", "base",
        vote(F.col("base")).alias("shape"), F.coalesce(F.when(F.col("checks"), 1).when(~F.col("checks"), -1), F.lit(0)).alias("checks"),
        F.when(named, 1).otherwise(0).alias("gazetteer"), F.when(clean_left & clean_right, 1).when(clean_left | clean_right, 0).otherwise(-1).alias("context"),
        F.greatest(F.lit(_LENGTHS[0]), F.least(F.lit(_LENGTHS[1]), F.floor(F.log2(F.char_length("m"))).cast("int"))).alias("length"), bits.alias("classes"),
        F.when(word != "", F.pmod(F.xxhash64(word), F.lit(_WORDS)).cast("int")).otherwise(-1).alias("before"),
    )


def estimate(patterns: dict[tuple[int, ...], int], turns: int = 100) -> tuple[float, list[dict[int, list[float]]], dict[tuple[int, ...], float]]:
    """EM for one hidden yes or no: (share of yes, for each labeler P(vote | no, yes), posterior of each pattern)."""
    posterior = {p: 1 / (1 + math.exp(-1.5 * sum(p))) for p in patterns}
    prior, rates = 0.5, []
    for _ in range(turns):
        total = sum(patterns.values())
        yes = sum(n * posterior[p] for p, n in patterns.items())
        prior = (yes + 1) / (total + 2)
        rates = []
        for k in range(len(LABELERS)):
            table = {}
            for v in (-1, 0, 1):
                own = [(n, posterior[p]) for p, n in patterns.items() if p[k] == v]
                table[v] = [(sum(n * (1 - q) for n, q in own) + 0.5) / (total - yes + 1.5), (sum(n * q for n, q in own) + 0.5) / (yes + 1.5)]
            rates.append(table)
        for p in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rates[k][v][1] / rates[k][v][0]) for k, v in enumerate(p))
            posterior[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, rates, posterior


def _names(kind: str, votes: tuple[int, ...], features: tuple[int, ...]) -> list[str]:
    return [f"kind:{kind}", *(f"{name}:{v}" for name, v in zip(LABELERS, votes, strict=True)), *(f"{kind}:{name}:{v}" for name, v in zip(FEATURES, features))]  # noqa: B905


def classifier(counts: dict[tuple, int], turns: int = 400) -> dict[str, float]:
    """Weights of a logistic model on kind, votes and features, fitted to the posteriors of each kind's spans.

    ``counts`` says how many spans are of each (kind, votes, features...). Each kind weighs the same, however rare.
    """
    cells, soft, weigh = [], [], []
    for kind in KINDS:
        votes: dict[tuple[int, ...], int] = {}
        for (k, p, *_), n in counts.items():
            if k == kind:
                votes[p] = votes.get(p, 0) + n
        if votes:
            posterior, total = estimate(votes)[2], sum(votes.values())
            own = [(p, tuple(f), n) for (k, p, *f), n in sorted(counts.items()) if k == kind]
            cells += [_names(kind, p, f) for p, f, _ in own]
            soft += [posterior[p] for p, _, _ in own]
            weigh += [n / total for _, _, n in own]
    names = sorted({f for own in cells for f in own})
    number = {f: k for k, f in enumerate(names)}
    cell = np.repeat(np.arange(len(cells)), [len(own) for own in cells])
    at = np.array([number[f] for own in cells for f in own], np.int64)
    target, share, w = np.array(soft), np.array(weigh) / max(sum(weigh), 1e-300), np.zeros(len(names))
    for _ in range(turns):
        y = 1 / (1 + np.exp(-np.clip(np.bincount(cell, w[at], len(cells)), -30, 30)))
        w += np.bincount(at, (share * (target - y))[cell], len(names)) - 1e-4 * w
    return dict(zip(names, w.tolist(), strict=True))


def judged(spans: DataFrame) -> DataFrame:
    """The spans that stay: base ones, and others that the classifier takes.

    Counts of what spans look like reach the driver, never spans: six kinds' votes and features make some 80,000 at most.
    """
    seen = [*LABELERS, *FEATURES]
    rows = spans.groupBy("kind", *seen).agg(F.count(F.lit(1)).alias("n")).collect()
    weights = classifier({(r["kind"], tuple(r[v] for v in LABELERS), *(r[v] for v in FEATURES)): r["n"] for r in rows})
    if not weights:
        return spans
    of = F.create_map(*[F.lit(x) for f in sorted(weights.items()) for x in f])
    terms = [F.concat(F.lit("kind:"), "kind"), *[F.concat_ws(":", F.lit(v), v) for v in LABELERS], *[F.concat_ws(":", "kind", F.lit(v), v) for v in FEATURES]]
    score = sum((F.coalesce(F.try_element_at(of, t), F.lit(0.0)) for t in terms), F.lit(0.0))
    return spans.where(F.col("base") | (score >= 0))


def _listed(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row; null texts are empty.

    Rows with a null or repeated id are rows of their own. Extra columns are not read.
    """
    rows = materialise(candidates(docs, id_col, text_col).select("uid", "doc_id", "found"), "candidates")
    stay = judged(materialise(spans_of(rows), "spans"))
    by = stay.groupBy("uid").agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS[:4]],
        F.array_sort(F.collect_list(F.struct("start", "place", "end", "kind", "base"))).alias("all"),
    )
    out = rows.select("uid", "doc_id").join(by, "uid", "left")
    base = F.coalesce(_listed(F.filter("all", lambda s: s["base"])), F.lit(""))
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return out.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.coalesce(_listed(F.col("all")), F.lit("")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, overlapping spans as one; null texts stay null.

    ``n_chars``, where there is such a column, follows the text.
    """
    kept = materialise(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*docs.columns).alias("row")), "rows")
    rows = materialise(candidates(kept.select(F.col("uid").alias("own"), F.col(f"row.{text_col}").alias("t")), "own", "t").select(F.col("doc_id").alias("uid"), "found").where(F.size("found") > 0), "candidates")
    by = judged(materialise(spans_of(rows), "spans")).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("all"))
    text = F.col(f"row.{text_col}")
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.call_function("substring", text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        tag = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, tag).alias("out"))

    new = F.aggregate("all", first, step, lambda acc: F.concat(acc["out"], F.call_function("substring", text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    new = F.when(F.col("all").isNull(), text).otherwise(new)
    fields = [new.alias(c) if c == text_col else F.when(text.isNull(), F.col(f"row.{c}")).otherwise(F.char_length(new).cast("long")).alias(c) if c == "n_chars" else F.col(f"row.{c}").alias(c) for c in docs.columns]
    return kept.join(by.hint("shuffle_hash"), "uid", "left").select(*fields)
