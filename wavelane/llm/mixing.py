"""Mixing sources to target weights by entropy balancing.

Per source the primal problem is: rates ``r`` of the documents, as close to one copy each as
possible in relative entropy, none above ``CAP``, whose words add up to the source's target. Its
dual has one multiplier ``lam`` a source and the rates ``r = min(CAP, exp(lam * size / scale))``.
Newton steps (kept inside a bracket) solve all sources at once; a step reads only how many
documents a source has of each size. The sums are decimals, so their order doesn't matter and
reruns agree.

Rates become copies by systematic rounding: a source's documents are laid out by size, largest
first, and the running sum of rates is rounded. Neighbours in that order have like sizes, so a
source's words miss its target by half its longest document at most; a few single documents then
close most of the gap. Within one size, the
documents that get the extra copy are the first ones by a hash of the id.

Defined cases: null text has size 0, gets rate 0 and is never taken; a null source is a source of its
own, ranked last; repeated rows count each for itself; no rows or no words give targets of 0;
extra columns are kept by ``repeat`` and ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelane.functions.ordinals import null_safe_join, ordinal
from wavelane.llm.common import cut

CAP = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _decimal_sum(value: Column) -> Column:
    return F.sum(value.cast("decimal(38,6)")).cast("double")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """``source, source_size, target`` from ``source, size``.

    Sources in code point order (null last) share all words by repeating ``weights``; where the
    share is above ``cap`` times the source, the excess goes to the others by weight, until none is.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    start = F.struct(F.col("source").isNull().alias("none"), F.substring("source", 1, 2).alias("start"))
    ranked = ordinal(totals, [], order, start, "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    sources = cut(ranked.select("source", "source_size", weight.alias("weight")))
    whole, left = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level, stopped = (float(whole) / left if left else 0.0), 0
    while True:
        over = F.col("weight") * level > cap * F.col("source_size")
        n, held, weight_left = sources.agg(F.sum(over.cast("bigint")), F.sum(F.when(over, cap * F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).first()
        if not n or n == stopped or not weight_left:
            break
        level, stopped = (float(whole) - float(held)) / float(weight_left), n
    return sources.select("source", "source_size", F.least((cap * F.col("source_size")).cast("double"), F.col("weight") * level).alias("target"))


def tilted_rates(by_size: DataFrame, targets: DataFrame, cap: int = CAP, tolerance: float = 1e-10, most: int = 100) -> DataFrame:
    """``source, size, n, rate``: the dual solved for all sources of ``by_size`` (``source, size, n``).

    ``most`` is a guard against a loop that can't end; reaching it is an error.
    """
    some = by_size.filter("size > 0")
    words = F.col("n") * F.col("size")
    scale = some.groupBy("source").agg((_decimal_sum((words * F.col("size")).cast("double")) / F.sum(words)).alias("scale"))
    grid = cut(null_safe_join(null_safe_join(some, scale, ["source"]), targets.select("source", "source_size", "target"), ["source"]))
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    state = grid.filter(~full).groupBy("source").agg(F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("gap"))
    raw = F.exp(F.least(F.lit(700.0), F.col("lam") * F.col("size") / F.col("scale")))
    rate = F.least(F.lit(float(cap)), raw)
    for _ in range(most):
        state = cut(state)
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= tolerance:
            break
        at = null_safe_join(grid, state.select("source", "lam", "low", "high"), ["source"])
        slope = F.when(raw < cap, words * F.col("size") / F.col("scale") * raw).otherwise(0.0)
        sums = at.groupBy("source", "lam", "low", "high").agg((_decimal_sum(words * rate) - F.first("target")).alias("g"), _decimal_sum(slope).alias("h"), F.first("target").alias("target"))
        low = F.when(F.col("g") <= 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(F.col("g") > 0, F.col("lam")).otherwise(F.col("high"))
        bounded = sums.select("source", "lam", "g", "h", (F.abs("g") / F.col("target")).alias("gap"), low.alias("low"), high.alias("high"))
        newton = F.when(F.col("h") > 0, F.col("lam") - F.col("g") / F.col("h"))
        inside = F.coalesce(newton > F.col("low"), F.lit(True)) & F.coalesce(newton < F.col("high"), F.lit(True)) & newton.isNotNull()
        between = F.when(F.col("low").isNull(), 2 * F.col("high") - 1).when(F.col("high").isNull(), 2 * F.col("low") + 1).otherwise((F.col("low") + F.col("high")) / 2)
        same = (F.col("gap") <= tolerance) | F.coalesce(F.col("high") - F.col("low") <= 1e-15 * F.abs("high"), F.lit(False))
        moved = F.when(same, F.col("lam")).when(inside, newton).otherwise(between)
        state = bounded.select("source", moved.alias("lam"), "low", "high", F.when(same, 0.0).otherwise(F.col("gap")).alias("gap"))
    else:
        raise RuntimeError("entropy balancing did not converge")
    solved = null_safe_join(grid, state.select("source", "lam"), ["source"], "left")
    return solved.select("source", "size", "n", F.when(F.col("lam").isNull(), F.lit(float(cap))).otherwise(F.round(rate, 9)).alias("rate"))


def _settled(plan: DataFrame, cap: int, rounds: int = 3) -> DataFrame:
    """Give or take one document where that brings a source nearer to its target, the longest that fits each time."""
    own = Window.partitionBy("source")
    for _ in range(rounds):
        words = F.sum(F.col("size") * (F.col("n") * F.col("whole") + F.col("extra"))).over(own)
        plan = plan.withColumn("off", F.col("target") - words)
        able = (F.col("size") <= F.abs("off")) & F.when(F.col("off") > 0, (F.col("extra") < F.col("n")) & (F.col("whole") < cap)).otherwise(F.col("extra") > 0)
        plan = plan.withColumn("best", F.max(F.when(able, F.col("size"))).over(own))
        plan = plan.withColumn("extra", F.col("extra") + F.when(F.col("size") == F.col("best"), F.signum("off").cast("bigint")).otherwise(0))
    return cut(plan.drop("off", "best", "n"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """``doc_id, source, size, source_size, target, rate, copies, taken``: one row for each row of ``docs``."""
    rows = cut(docs.select("doc_id", F.col("source").cast("string"), word_count().alias("size")))
    by_size = cut(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    targets = source_targets(by_size.select("source", (F.col("size") * F.col("n")).alias("size")), weights, cap)
    rates = tilted_rates(by_size, targets, cap)
    before = F.sum(F.col("n") * F.col("rate")).over(Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    laid = rates.withColumn("upto", before)
    whole = F.floor("rate")
    taken_here = F.floor(F.round("upto", 6) + 0.5) - F.floor(F.round(F.col("upto") - F.col("n") * F.col("rate"), 6) + 0.5)
    plan = laid.select("source", "size", "n", "rate", whole.alias("whole"), (taken_here - F.col("n") * whole).alias("extra"))
    plan = null_safe_join(by_size.select("source", "size"), plan, ["source", "size"], "left")
    plan = _settled(cut(null_safe_join(plan, targets, ["source"])), cap)
    placed = ordinal(rows.withColumn("h", F.xxhash64("doc_id")), ["source", "size"], ["h", "doc_id"], F.shiftright("h", 54), "place")
    joined = null_safe_join(placed, plan, ["source", "size"])
    copies = F.coalesce(F.least(F.lit(cap), F.col("whole") + (F.col("place") <= F.col("extra")).cast("bigint")), F.lit(0)).cast("bigint")
    return joined.select("doc_id", "source", "size", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Rows with one id and source and as many words are alike to the mix."""
    plan = mix(docs, weights, cap).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies")
    # Rows that repeat an id are numbered on both sides, so each meets its own share.
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", word_count().alias("words"), F.xxhash64("text").alias("h"))
    left = whole.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "source", "words").orderBy("h"))).drop("h")
    right = plan.withColumn("j", F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy(F.desc("copies"))))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("words") == F.col("_size")) & (F.col("k") == F.col("j"))
    return left.join(right, same).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
