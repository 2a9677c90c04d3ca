"""Is an answer worth analysing? Flags, confidence and recommendation by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import wordlists as L
from ..functions.text import letters_tokens

FLAGS = ("too_short_chars", "too_few_words", "non_analytic_pattern", "high_repetition", "low_english_ratio")


def assess_quality(df: DataFrame, text_col: str, min_words: int = 3, min_chars: int = 10, max_repetition: float = 0.7, min_english: float = 0.3) -> DataFrame:
    """df with quality_is_analytic, quality_confidence, quality_reason, quality_recommendation, quality_flags.

    NULL and blank texts are excluded with confidence 1. The steps are separate projections, so that words are found once a text.
    """
    text = F.col(text_col)
    d = df.withColumns({"_q_words": letters_tokens(text), "_q_text": F.regexp_replace(text, r"(?U)^\s+|\s+$", "")})
    d = d.withColumns(
        {
            "_q_low": F.lower("_q_text"), "_q_n": F.size("_q_words"), "_q_unique": F.size(F.array_distinct("_q_words")).cast("double"),
            "_q_english": F.size(F.filter("_q_words", lambda w: w.isin(*sorted(L.COMMON_ENGLISH)))).cast("double"),
        }
    )
    low, n = F.col("_q_low"), F.col("_q_n")
    idle = F.lit(False)
    for p in L.NON_ANALYTIC:
        idle = idle | low.rlike(p)
    checks = (
        (F.length("_q_text") < min_chars, 0.3),
        (n < min_words, 0.3),
        (idle, 0.5),
        ((n > 0) & (1.0 - F.try_divide(F.col("_q_unique"), n) > max_repetition), 0.2),
        ((n > 0) & (F.try_divide(F.col("_q_english"), n) < min_english), 0.2),
    )
    d = d.withColumns({f"_q_{i}": hit for i, (hit, _) in enumerate(checks)})
    confidence = F.lit(1.0)
    for i, (_, weight) in enumerate(checks):  # one after the other: the order of the subtractions decides the last digits
        confidence = confidence - F.when(F.col(f"_q_{i}"), weight).otherwise(0.0)
    flags = F.array_compact(F.array(*[F.when(F.col(f"_q_{i}"), F.lit(name)) for i, name in enumerate(FLAGS)]))
    d = d.withColumns({"_q_flags": flags, "_q_confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)), "_q_blank": text.isNull() | (F.col("_q_text") == "")})
    blank, clean, c = F.col("_q_blank"), F.size("_q_flags") == 0, F.col("_q_confidence")
    listed = F.array_join("_q_flags", ", ")
    reason = F.when(clean, F.lit("Content appears analytic")).when(c >= 0.5, F.concat(F.lit("Flagged for review: "), listed)).otherwise(F.concat(F.lit("Low quality indicators: "), listed))
    d = d.withColumns(
        {
            "quality_is_analytic": ~blank & clean,
            "quality_confidence": F.when(blank, 1.0).otherwise(F.round(c, 3)),
            "quality_reason": F.when(blank, "Empty or null response").otherwise(reason),
            "quality_recommendation": F.when(blank, "exclude").when(clean, "include").when(c >= 0.5, "review").otherwise("exclude"),
            "quality_flags": F.when(blank, F.array(F.lit("empty_response"))).otherwise(F.col("_q_flags")),
        }
    )
    return d.drop(*[c for c in d.columns if c.startswith("_q_")])


def flag_statistics(assessed: DataFrame) -> DataFrame:
    return assessed.select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("count"))


def summary(assessed: DataFrame) -> DataFrame:
    """One row: total, analytic, percent analytic, counts by recommendation, mean confidence."""
    n = F.count(F.lit(1))
    kind = F.col("quality_recommendation")
    return assessed.agg(
        n.alias("total"), F.count_if("quality_is_analytic").alias("analytic"), F.round(F.coalesce(F.try_divide(100.0 * F.count_if("quality_is_analytic"), n), F.lit(0.0)), 6).alias("analytic_percent"),
        *[F.count_if(kind == k).alias(f"n_{k}") for k in ("include", "review", "exclude")], F.round(F.coalesce(F.avg("quality_confidence"), F.lit(0.0)), 3).alias("mean_confidence"),
    )
