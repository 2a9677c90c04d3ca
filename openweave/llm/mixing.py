"""Mixing sources to target weights: hash-threshold histograms with nested budget thresholds, filtered without a sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from ..skew import small

#: Bits of the hash used at each level: 1,024 buckets a level, three levels; what is left is a 2**-30 part of the documents.
LEVEL_BITS = 10
LEVELS = 3
#: Above every hash: the whole source is drawn.
ALL = 1 << 62


def _hash(id_col: str, seed: int):
    """62 hash bits as a non-negative number; the bits are independent of the source, so thresholds of all mixes nest."""
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 2)


def histogram(docs: DataFrame, id_col: str = "doc_id", source: str = "source", size: str = "n_tokens", seed: int = 17) -> DataFrame:
    """(source, b, n): tokens by source and hash bucket, 1,024 buckets a source; all totals and first thresholds come from it.

    Negative and NULL sizes count as 0, documents without a source are left out. Partial sums are combined before they are moved.
    """
    return materialize(_sized(docs, id_col, source, size, seed).groupBy("source", F.shiftright("_h", 62 - LEVEL_BITS).alias("b")).agg(F.sum("_n").cast("long").alias("n")), "histogram")


def _sized(docs: DataFrame, id_col: str, source: str, size: str, seed: int) -> DataFrame:
    return docs.filter(F.col(source).isNotNull()).select(F.col(source).alias("source"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).alias("_n"), _hash(id_col, seed).alias("_h"))


def budgets(hist: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: available and target tokens, whole repeats, the rest to be drawn, whether the target can be reached.

    target = weight's part of the mix's weights x tokens of all documents whose source is in the mix. Sources without
    documents have 0 tokens; documents without a source belong to no mix; negative or NULL weights and sizes count as 0.
    ``targets`` is the statement of the mixes and small by nature; the tokens of a source are the sum of its buckets in ``hist``.
    """
    t = targets.groupBy("mix_id", "source").agg(
        F.sum(F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0))).cast("long").alias("weight"),
        F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).cast("long").alias("max_repeats"),
    )
    sums = hist.groupBy("source").agg(F.sum("n").alias("tokens"))
    have = t.join(sums, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    mix = W.partitionBy("mix_id")
    have = have.withColumn("mix_tokens", F.sum("tokens").over(mix)).withColumn("mix_weight", F.sum("weight").over(mix))
    # weight x mix_tokens is compared in decimals, so that no rounding decides a case
    wide = "decimal(38,0)"
    have = have.withColumn("_part", F.col("weight").cast(wide) * F.col("mix_tokens").cast("decimal(19,0)"))
    have = have.withColumn("reachable", (F.col("tokens").cast("decimal(19,0)") * F.col("max_repeats").cast("decimal(10,0)") * F.col("mix_weight").cast("decimal(9,0)")) >= F.col("_part"))
    have = have.withColumn("target", F.coalesce(F.try_divide(F.col("weight") * F.col("mix_tokens").cast("double"), F.col("mix_weight")), F.lit(0.0)))
    aim = F.least(F.col("target"), F.col("tokens") * F.col("max_repeats").cast("double"))
    have = have.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(aim / F.col("tokens"))).otherwise(F.lit(0)).cast("long"))
    have = have.withColumn("rest", F.greatest(aim - F.col("whole") * F.col("tokens"), F.lit(0.0)))
    return have.select("mix_id", "source", "weight", "max_repeats", "tokens", "target", "whole", "rest", "reachable")


def unreachable(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source) whose documents, repeated as often as allowed, stay below the target: no threshold of the histogram reaches it."""
    return budgets(histogram(docs), targets).filter(~F.col("reachable")).select("mix_id", "source")


def thresholds(docs: DataFrame, budget: DataFrame, hist: DataFrame, id_col: str = "doc_id", source: str = "source", size: str = "n_tokens", seed: int = 17) -> DataFrame:
    """Per mix and source the hash below which documents are drawn once more, so that their tokens come closest below ``rest``.

    Level by level the tokens are summed by source and bucket; only the bucket in which the budget runs out is refined. The documents
    of these buckets, a 1,024th of a source for each of its mixes, are written once; later levels read nothing else.
    """
    state = budget.select("mix_id", "source", "rest", F.lit(0).cast("long").alias("lo"))
    part, near = state.join(hist, "source"), None
    for level in range(LEVELS):
        shift = 62 - LEVEL_BITS * (level + 1)
        if level:
            bound = F.shiftright("_h", shift + LEVEL_BITS) == F.shiftright("lo", shift + LEVEL_BITS)
            if near is None:
                near = materialize(_sized(docs, id_col, source, size, seed).join(small(state.select("mix_id", "source", "lo")), "source").filter(bound).drop("lo"), "boundary")
            inside = near.join(small(state), ["mix_id", "source"]).filter(bound)
            part = inside.groupBy("mix_id", "source", "rest", "lo", F.shiftright("_h", shift).alias("b")).agg(F.sum("_n").alias("n"))
        w = W.partitionBy("mix_id", "source").orderBy("b").rowsBetween(W.unboundedPreceding, 0)
        over = part.withColumn("before", F.sum("n").over(w) - F.col("n")).filter(F.col("before") + F.col("n") > F.col("rest"))
        first = over.groupBy("mix_id", "source").agg(F.min(F.struct("b", "before")).alias("x"))
        state = state.join(first, ["mix_id", "source"], "left").select(
            "mix_id", "source",
            F.when(F.col("x").isNull(), F.col("rest")).otherwise(F.col("rest") - F.col("x.before")).alias("rest"),
            F.when(F.col("x").isNull(), F.lit(ALL if level == 0 else None).cast("long")).otherwise(F.col("x.b") * F.lit(1 << shift)).alias("lo"),
        )
        if level:  # where a level found no boundary, all of the source fits: the mark set at level 0 stays
            state = state.withColumn("lo", F.coalesce("lo", F.lit(ALL)))
        state = materialize(state, f"mix{level}")
    return state.select("mix_id", "source", F.col("lo").alias("below"))


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", source: str = "source", size: str = "n_tokens", seed: int = 17) -> DataFrame:
    """(mix_id, source, id, repeats): each document's number of uses in each mix; documents not used are left out.

    A source whose target exceeds its tokens is used whole as often as fits, then drawn by hash; never above max_repeats.
    """
    hist = histogram(docs, id_col, source, size, seed)
    budget = materialize(budgets(hist, targets), "budget")
    cut = thresholds(docs, budget, hist, id_col, source, size, seed)
    plan = budget.select("mix_id", "source", "whole", "max_repeats").join(cut, ["mix_id", "source"])
    d = docs.filter(F.col(source).isNotNull()).select(F.col(id_col), F.col(source).alias("source"), F.col(size).alias("_n"), _hash(id_col, seed).alias("_h"))
    used = d.join(small(plan), "source").withColumn("repeats", F.least(F.col("whole") + F.when(F.col("_h") < F.col("below"), 1).otherwise(0), F.col("max_repeats")).cast("long"))
    return used.filter("repeats > 0").select("mix_id", "source", F.col(id_col), F.col("_n").alias("n_tokens"), "repeats")


def shares(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: target share, share reached, tokens used, documents used, and whether what was promised holds.

    ``capped``: no document is used more often than max_repeats. ``close``: a reachable source falls short of its target by less than
    its largest document, an unreachable one uses every document max_repeats times; none exceeds the target.
    """
    budget = materialize(budgets(histogram(docs), targets), "sharesbudget")
    used = mix(docs, targets).groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used"), F.count(F.lit(1)).alias("docs"), F.max("repeats").alias("most"))
    largest = docs.filter("source is not null").groupBy("source").agg(F.max("n_tokens").alias("largest"))
    both = budget.join(used, ["mix_id", "source"], "left").join(largest, "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    w = W.partitionBy("mix_id")
    short = F.col("target") - F.col("used")
    return both.select(
        "mix_id", "source", F.col("tokens").alias("available"), "used", F.coalesce("docs", F.lit(0)).alias("docs"), "reachable",
        F.coalesce(F.try_divide(F.col("weight").cast("double"), F.sum("weight").over(w)), F.lit(0.0)).alias("target_share"),
        F.coalesce(F.try_divide(F.col("used").cast("double"), F.sum("used").over(w)), F.lit(0.0)).alias("actual_share"),
        (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("capped"),
        (F.when(F.col("reachable"), short <= F.coalesce("largest", F.lit(0))).otherwise(F.col("used") == F.col("tokens") * F.col("max_repeats")) & (short >= -0.5)).alias("close"),
    )
