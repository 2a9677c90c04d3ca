"""Operators over coded results: assigned codes with confidences, one row per answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..skew import small
from .coding import EMPTY


def first_delivery(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """One row per id where rows were delivered more than once: the smallest by the order columns."""
    rest = [c for c in df.columns if c != id_col]
    key = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    return df.groupBy(id_col).agg(F.min(key).alias("_r")).select(id_col, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def confidences(df: DataFrame, column: str = "confidence_scores") -> DataFrame:
    return df.select(F.explode(column).alias("confidence"))


def uncoded(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce("num_codes", F.lit(0)) == 0)


def low_confidence(df: DataFrame, threshold: float = 0.5, column: str = "confidence_scores") -> DataFrame:
    """Rows with any confidence below the threshold; rows without confidences do not qualify."""
    return df.filter(F.exists(F.coalesce(F.col(column), F.array().cast("array<double>")), lambda c: c < threshold))


def ambiguous(df: DataFrame, min_codes: int = 3) -> DataFrame:
    return df.filter(F.col("num_codes") >= min_codes)


def boundary_cases(df: DataFrame, id_col: str, low: float = 0.3, high: float = 0.5, limit: int = 100) -> DataFrame:
    """The first ``limit`` ids whose best confidence lies between low and high."""
    return df.filter(F.array_max("confidence_scores").between(low, high)).select(id_col).orderBy(id_col).limit(limit)


def binary_matrix(df: DataFrame, id_col: str, members: DataFrame, key: str, column: str = "assigned_codes") -> DataFrame:
    """(id, code, assigned) as 0/1 for every row and code: the matrix in long form; the dimension is bounded where it was read."""
    codes = F.broadcast(members.agg(F.array_sort(F.collect_set(key)).alias("_all")))
    return df.join(codes).select(id_col, F.explode("_all").alias(key), F.coalesce(F.col(column), F.array().cast(EMPTY)).alias("_c")).select(id_col, key, F.array_contains("_c", F.col(key)).cast("int").alias("assigned"))


def metrics_summary(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """One row: answers, codes, active codes, assignments, codes per answer (mean, median, most), coverage, uncoded, confidences."""
    n = F.count(F.lit(1))
    k = F.coalesce("num_codes", F.lit(0))
    base = df.agg(
        n.alias("n_responses"), F.coalesce(F.sum(k), F.lit(0)).cast("long").alias("n_assignments"), F.round(F.coalesce(F.avg(k), F.lit(0.0)), 6).alias("mean_codes"), F.coalesce(F.percentile(k, F.lit(0.5)), F.lit(0.0)).alias("median_codes"),
        F.coalesce(F.max(k), F.lit(0)).cast("long").alias("max_codes"), F.count_if(k == 0).alias("n_uncoded"), F.round(F.coalesce(F.try_divide(100.0 * F.count_if(k > 0), n), F.lit(0.0)), 6).alias("coverage"),
    )
    c = confidences(df).agg(F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"))
    total = members.agg(F.countDistinct(key).alias("n_codes"))
    active = df.select(F.explode("assigned_codes").alias(key)).agg(F.countDistinct(key).alias("n_active"))
    return base.join(F.broadcast(c)).join(F.broadcast(total)).join(F.broadcast(active))


def quality_metrics(df: DataFrame) -> DataFrame:
    """One row: codes per answer with the population deviation, and the confidences."""
    base = df.agg(F.count(F.lit(1)).alias("n_responses"), F.round(F.avg("num_codes"), 6).alias("mean_codes"), F.round(F.stddev_pop("num_codes"), 6).alias("std_codes"), F.round(F.coalesce(F.avg(F.when(F.col("num_codes") > 0, 100.0).otherwise(0.0)), F.lit(0.0)), 6).alias("coverage"))
    c = confidences(df).agg(F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.stddev_pop("confidence"), 6).alias("std_confidence"))
    return base.join(F.broadcast(c))


def descriptive(df: DataFrame) -> DataFrame:
    """One row of statistics of num_codes, with the sample deviation."""
    k = F.coalesce("num_codes", F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(k), 6).alias("mean"), F.percentile(k, F.lit(0.5)).alias("median"), F.round(F.stddev_samp(k), 6).alias("std"), F.min(k).cast("long").alias("min"), F.max(k).cast("long").alias("max"),
        F.count_if(k == 0).alias("n_none"), F.count_if(k >= 1).alias("n_some"), F.round(F.coalesce(F.avg(F.when(k > 0, 100.0).otherwise(0.0)), F.lit(0.0)), 6).alias("coverage"),
    )


def segmentation(df: DataFrame, segment_col: str, members: DataFrame, key: str, column: str = "assigned_codes") -> DataFrame:
    """(segment, code, count, percentage of the segment) of every segment and code, zeros kept; NULL is a segment of its own."""
    sizes = df.groupBy(F.col(segment_col).alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    counts = df.select(F.col(segment_col).alias("segment"), F.explode(F.array_distinct(column)).alias(key)).groupBy("segment", key).agg(F.count(F.lit(1)).alias("c"))
    codes = F.broadcast(members.agg(F.array_sort(F.collect_set(key)).alias("_all")))
    grid = sizes.join(codes).select("segment", "n", F.explode("_all").alias(key))
    right = counts.select(F.col("segment").alias("_s"), F.col(key).alias("_k"), "c")
    return grid.join(right, grid["segment"].eqNullSafe(right["_s"]) & (grid[key] == right["_k"]), "left").select("segment", key, F.coalesce("c", F.lit(0)).alias("count"), F.round(100.0 * F.coalesce("c", F.lit(0)) / F.col("n"), 6).alias("percentage"))


def qa_report(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    low = F.exists(F.coalesce(F.col("confidence_scores"), F.array().cast("array<double>")), lambda c: c < threshold)
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(low).alias("n_low_confidence"), F.count_if(F.coalesce("num_codes", F.lit(0)) == 0).alias("n_uncoded"), F.count_if(F.col("num_codes") > 1).alias("n_multi"), F.count_if(F.col("num_codes") >= 3).alias("n_ambiguous"))


def assignments(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, code, confidence): one row an assignment; a missing confidence is NULL."""
    zipped = F.arrays_zip(F.col("assigned_codes").alias("code"), F.col("confidence_scores").alias("confidence"))
    return df.select(id_col, text_col, F.explode(zipped).alias("z")).select(id_col, text_col, F.col("z.code").alias("code"), F.col("z.confidence").alias("confidence")).filter("code is not null")


def code_statistics(assigned: DataFrame) -> DataFrame:
    """(code, count, avg_confidence): the true mean of the confidences."""
    return assigned.groupBy("code").agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def examples(assigned: DataFrame, id_col: str, text_col: str, first: int = 5, most: int = 10, above: float = 0.5) -> DataFrame:
    """(code, place, id): per code the first answers in order of id, then further ones of confidence above ``above``, ``most`` in all.

    Both lists are cut by partial top lists first (limit pushed below the shuffle by rank), so no code is gathered whole.
    """
    w = W.partitionBy("code").orderBy(id_col)
    early = assigned.select("code", id_col, "confidence", F.row_number().over(w).alias("rn")).filter(F.col("rn") <= first)
    sure = assigned.filter(F.col("confidence") > above).select("code", id_col, "confidence", F.row_number().over(w).alias("rn")).filter(F.col("rn") <= first + most)
    both = early.select("code", id_col, F.lit(0).alias("late")).unionByName(sure.select("code", id_col, F.lit(1).alias("late"))).groupBy("code", id_col).agg(F.min("late").alias("late"))
    place = F.row_number().over(W.partitionBy("code").orderBy("late", id_col))
    return both.withColumn("place", place.cast("long")).filter(F.col("place") <= most).select("code", "place", id_col)


def quotes(assigned: DataFrame, id_col: str, text_col: str, n: int = 3, width: int = 100) -> DataFrame:
    """(code, place, quote): n texts per code, distinct but for case, the most confident first, cut to width."""
    key = F.lower(F.trim(text_col))
    best = assigned.filter(F.col(text_col).rlike(r"\S")).groupBy("code", key.alias("_k")).agg(F.max("confidence").alias("c"), F.min(id_col).alias("i"), F.min(text_col).alias("t"))
    place = F.row_number().over(W.partitionBy("code").orderBy(F.desc_nulls_last("c"), "i"))
    cut = F.when(F.length("t") > width, F.concat(F.substring("t", 1, width - 3), F.lit("..."))).otherwise(F.col("t"))
    return best.withColumn("place", place.cast("long")).filter(F.col("place") <= n).select("code", "place", cut.alias("quote"))


def top_codes(df: DataFrame, n: int = 10, column: str = "assigned_codes", by: str = "count") -> DataFrame:
    counts = df.select(F.explode(column).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "code").limit(n) if by == "count" else counts.orderBy("code").limit(n)


def strong_overlap(pairs: DataFrame, threshold: float = 10.0) -> DataFrame:
    """One row: the largest percentage of a pair and whether it exceeds the threshold."""
    return pairs.agg(F.coalesce(F.max("percentage"), F.lit(0.0)).alias("max_percentage")).withColumn("strong", F.col("max_percentage") > threshold)


def keyword_overlap(topics: DataFrame, top: int = 7) -> DataFrame:
    """(a, b, shared): the keywords two topics have in common among their first ``top``; topics are few by nature (k of a model)."""
    x = topics.select(F.col("topic").alias("a"), F.slice("keywords", 1, top).alias("x"))
    y = topics.select(F.col("topic").alias("b"), F.slice("keywords", 1, top).alias("y"))
    return x.join(small(y), F.col("a") < F.col("b")).select("a", "b", F.array_sort(F.array_intersect("x", "y")).alias("shared"))


def with_sentiment(codebook: DataFrame, assigned: DataFrame, sentiment: DataFrame, id_col: str) -> DataFrame:
    """The codebook with counts of positive, negative and neutral answers per code."""
    s = assigned.join(sentiment, id_col).groupBy("code").agg(*[F.count_if(F.col("label") == k).alias(k) for k in ("positive", "negative", "neutral")])
    return codebook.join(s, "code", "left")


def any_of(column: Column, values: list[str]) -> Column:
    return F.arrays_overlap(F.coalesce(column, F.array().cast(EMPTY)), F.array(*map(F.lit, values)))
