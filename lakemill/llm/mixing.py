"""Mixing sources to target weights by entropy balancing.

Among all document rates that meet each source's token constraint, the ones closest to 1 in relative entropy are
exponential tilts of the documents' sizes: rate = min(cap, exp(lambda_source * size / largest size)). The convex dual has one
variable for each source, found by Newton steps kept in a bracket; each step is one distributed aggregation over the counts
of equal sizes. Cumulated from the largest size down, rates are rounded into whole copies, and what is still missing of a
source's target is settled by copies of its smallest documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemill.llm.store import materialise

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS, CAP = (5.0, 2.0, 1.0), 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets_of(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> dict[str | None, float]:
    """Shares of all tokens by weight, sources in code point order with null last; none over ``cap`` times its source, the
    excess shared again by weight."""
    order = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    weight = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while len(fixed) < len(order):
        rest, shared = total - sum(fixed.values()), sum(weight[k] for k in order if k not in fixed)
        target = {k: rest * weight[k] / shared for k in order if k not in fixed}
        over = [k for k, t in target.items() if t > cap * sizes[k]]
        if not over:
            return {k: float(x) for k, x in (fixed | target).items()}
        fixed |= {k: float(cap * sizes[k]) for k in over}
    return fixed


def _tilts(classes: DataFrame, targets: dict, largest: dict, cap: int, most: int = 60, close: float = 1e-6) -> dict:
    """The dual variables. Only sums for each source reach the driver: a source is a constraint, so there are few."""
    spark = classes.sparkSession
    low, high, at = {}, {}, {}
    for k in targets:
        if largest[k]:
            low[k], high[k], at[k] = -60.0 * largest[k], (math.log(cap) + 1) * largest[k], 0.0
    open_ = set(at)
    for _ in range(most):
        if not open_:
            break
        now = spark.createDataFrame([(k, at[k], float(largest[k])) for k in open_], "of string, tilt double, largest double")
        z = F.col("size") / F.col("largest")
        raw = F.exp(F.least(F.col("tilt") * z, F.lit(50.0)))
        moments = classes.join(now, classes.source.eqNullSafe(now.of)).groupBy("of").agg(F.sum(F.col("n") * F.col("size") * F.least(raw, F.lit(float(cap)))).alias("f"), F.sum(F.when(raw < cap, F.col("n") * F.col("size") * z * raw).otherwise(0.0)).alias("slope"))
        for row in moments.collect():
            k = row["of"]
            miss = row["f"] - targets[k]
            if abs(miss) <= close * max(1.0, targets[k]):
                open_.discard(k)
                continue
            low[k], high[k] = (at[k], high[k]) if miss < 0 else (low[k], at[k])
            step = at[k] - miss / row["slope"] if row["slope"] > 0 else math.inf
            at[k] = step if low[k] < step < high[k] else (low[k] + high[k]) / 2
    if open_:
        raise RuntimeError(f"the dual of {len(open_)} sources did not converge in {most} steps")
    return at


_PLAN = "of string, at long, source_size long, target double, base long, cuts array<struct<h:long,some:long>>"


def plan_copies(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, deals: int = 8192) -> DataFrame:
    """(of, at, source_size, target, base, cuts): for each source ``of`` and size ``at`` the copies that each row has and, by
    deal, the hash up to which rows have one more; of the rows with the very hash, the first ``some`` (null: all).
    ``sized`` holds uid, doc_id, source and size, written once.

    A third of all rows may share a source and a size: ranks are found within deals of bounded size. They may share an id as
    well: equal hashes are counted before they are ranked.
    """
    spark = sized.sparkSession
    classes = materialise(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "classes")
    sums = {r["source"]: (int(r["s"]), int(r["m"]), r["n"]) for r in classes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("s"), F.max("size").alias("m"), F.sum("n").alias("n")).collect()}
    if not sums:
        return spark.createDataFrame([], _PLAN)
    sizes, largest = {k: v[0] for k, v in sums.items()}, {k: v[1] for k, v in sums.items()}
    targets = targets_of(sizes, weights, cap)
    tilts = _tilts(classes, targets, largest, cap)
    known = spark.createDataFrame([(k, sizes[k], targets[k], tilts.get(k, 0.0), float(largest[k] or 1)) for k in sums], "of string, source_size long, target double, tilt double, largest double")
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("largest"), F.lit(50.0))))
    c = classes.join(known, classes.source.eqNullSafe(known.of)).drop("of").withColumn("rate", rate)
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    so_far = F.sum(F.col("n") * F.col("rate")).over(down.rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("so_far", F.floor(so_far + 0.5)).withColumn("copies", F.least(F.col("so_far") - F.coalesce(F.lag("so_far").over(down), F.lit(0)), F.col("n") * cap))
    whole = Window.partitionBy("source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = c.withColumn("missing", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(whole))
    room = F.when(F.col("size") == 0, 0).when(F.col("missing") > 0, cap * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
    c = c.withColumn("room", room)
    up = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum(F.col("room") * F.col("size")).over(up) - F.col("room") * F.col("size")
    moved = F.when(F.col("size") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.col("room"), F.floor((F.abs("missing") - before) / F.greatest(F.col("size"), F.lit(1)) + 0.5))))
    c = c.withColumn("copies", (F.col("copies") + F.signum("missing").cast("long") * moved.cast("long")).cast("long"))
    total = sum(v[2] for v in sums.values())
    target_rows = max(256, total // deals)
    c = c.withColumn("base", F.floor(F.col("copies") / F.col("n"))).withColumn("extra", F.col("copies") - F.col("base") * F.col("n"))
    c = c.withColumn("parts", F.ceil(F.col("n") / target_rows).cast("int")).select(F.col("source").alias("of"), F.col("size").alias("at"), "source_size", "target", "n", "base", "extra", "parts")
    c = materialise(c, "copies")
    own = sized.select("source", "size", hash_of("doc_id").alias("h"))
    some = c.where("extra > 0").select(F.col("of").alias("of2"), F.col("at").alias("at2"), "n", "extra", "parts")
    dealt = own.join(some, own.source.eqNullSafe(F.col("of2")) & (own["size"] == F.col("at2"))).select("of2", "at2", "n", "extra", "parts", "h", F.pmod("h", "parts").cast("int").alias("deal"))
    dealt = dealt.groupBy("of2", "at2", "n", "extra", "parts", "deal", "h").agg(F.count(F.lit(1)).alias("m"))
    upto = Window.partitionBy("of2", "at2", "deal").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("upto", F.sum("m").over(upto))
    by_deal = dealt.groupBy("of2", "at2", "n", "extra", "parts", "deal").agg(F.sum("m").alias("m"))
    cum = F.sum("m").over(Window.partitionBy("of2", "at2").orderBy("deal").rowsBetween(Window.unboundedPreceding, 0))
    share = by_deal.withColumn("cum", cum).withColumn("take", F.floor(F.col("extra") * F.col("cum") / F.col("n")) - F.floor(F.col("extra") * (F.col("cum") - F.col("m")) / F.col("n")))
    share = share.select(F.col("of2").alias("of3"), F.col("at2").alias("at3"), F.col("deal").alias("deal3"), "take")
    crossed = (F.col("upto") >= F.col("take")) & (F.col("upto") - F.col("m") < F.col("take"))
    cut = dealt.join(share, dealt.of2.eqNullSafe(F.col("of3")) & (dealt.at2 == F.col("at3")) & (dealt.deal == F.col("deal3"))).where(crossed)
    some = F.col("take") - (F.col("upto") - F.col("m"))
    cut = cut.withColumn("cut", F.struct("h", F.when(some < F.col("m"), some).alias("some")))
    cuts = cut.groupBy("of2", "at2").agg(F.map_from_entries(F.collect_list(F.struct("deal", "cut"))).alias("by_deal"))
    out = c.join(cuts, c.of.eqNullSafe(F.col("of2")) & (c["at"] == F.col("at2")), "left")
    listed = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.col("by_deal")[k])
    return out.select("of", "at", "source_size", "target", "base", listed.alias("cuts"))


def first_of_equals(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(lucky): uids of the rows that have one copy more among rows of one id, source and size, which nothing else tells apart.

    Ranks are counted by written part, so that one id may hold any share of the rows.
    """
    cut = plan.select("of", "at", F.explode("cuts").alias("c")).select("of", "at", F.col("c.h").alias("h"), F.col("c.some").alias("some")).where("some is not null")
    own = sized.select("uid", "source", "size", hash_of("doc_id").alias("own_h"), F.shiftright("uid", 33).alias("part"))
    rows = own.join(cut, own.source.eqNullSafe(cut.of) & (own["size"] == cut["at"]) & (F.col("own_h") == F.col("h"))).select("of", "at", "h", "some", "part", "uid")
    key = [F.coalesce("of", F.lit("")), F.col("of").isNull(), F.col("at"), F.col("h")]
    per = rows.groupBy("of", "at", "h", "some", "part").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    per = per.withColumn("take", F.least(F.col("m"), F.col("some") - before)).where("take > 0").select(*[F.col(x).alias(f"{x}_2") for x in ("of", "at", "h", "part")], "take")
    met = rows.join(per, F.col("of").eqNullSafe(F.col("of_2")) & (F.col("at") == F.col("at_2")) & (F.col("h") == F.col("h_2")) & (F.col("part") == F.col("part_2")))
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy(*key, "part").orderBy("uid")))
    return ranked.where("rank <= take").select(F.col("uid").alias("lucky"))


def hash_of(id_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.lit(29))


def with_copies(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` (uid, doc_id, source, size and any other columns) with source_size, target and copies."""
    joined = sized.join(plan, sized.source.eqNullSafe(plan.of) & (sized["size"] == plan["at"]))
    h = hash_of("doc_id")
    cut = F.get("cuts", F.pmod(h, F.size("cuts")).cast("int"))
    more = (h < cut["h"]) | ((h == cut["h"]) & cut["some"].isNull())
    lucky = materialise(first_of_equals(sized.select("uid", "doc_id", "source", "size"), plan), "lucky")
    if lucky.limit(1).count():  # only where rows repeat an id
        joined = joined.join(lucky, F.col("uid") == F.col("lucky"), "left")
        more = more | F.col("lucky").isNotNull()
    return joined.withColumn("copies", F.col("base") + F.coalesce(more, F.lit(False)).cast("long")).drop("of", "at", "base", "cuts", "lucky")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row; taken is whole copies, at most ``cap``, times the size.

    Null texts have size 0; a null source is a source of its own, the last; which equal-sized documents get a copy more is
    settled by a hash of the id, so reruns agree; of rows that share an id too as many as it takes. No rows in, none out;
    other columns are not read.
    """
    sized = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = materialise(sized, "sized")
    out = with_copies(sized, materialise(plan_copies(sized, weights, cap), "plan"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source and any others) as often as the mix takes them.

    Documents without words, null texts among them, are never taken. Rows with a null or repeated id are rows of their own, as
    in :func:`mix`. No rows in, none out.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*docs.columns).alias("row"), "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    rows = materialise(rows, "sized-rows")
    plan = materialise(plan_copies(rows.select("uid", "doc_id", "source", "size"), weights, cap), "plan")
    out = with_copies(rows, plan).where("copies > 0 and size > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
