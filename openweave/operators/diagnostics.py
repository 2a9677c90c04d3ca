"""Rigor diagnostics: validity, bias and health of a coding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .results import confidences


def stability(df: DataFrame) -> DataFrame:
    """One row: 1 - std / mean of num_codes within 0..1; NULL below 30 rows."""
    n = F.count(F.lit(1))
    value = 1 - F.stddev_pop("num_codes") / (F.avg("num_codes") + 1e-6)
    return df.agg(F.when(n >= 30, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 6)).alias("stability"))


def saturation(df: DataFrame, codes: DataFrame) -> DataFrame:
    """One row: share of uncoded answers and of unused codes, and the verdict: under, over or adequate. codes: (code_id, count)."""
    a = df.agg(F.coalesce(F.avg(F.when(F.coalesce("num_codes", F.lit(0)) == 0, 1.0).otherwise(0.0)), F.lit(0.0)).alias("uncoded"))
    b = codes.agg(F.coalesce(F.avg(F.when(F.col("count") == 0, 1.0).otherwise(0.0)), F.lit(0.0)).alias("unused"))
    verdict = F.when(F.col("uncoded") > 0.15, "under-saturated").when(F.col("unused") > 0.2, "over-saturated").otherwise("adequate")
    return a.join(F.broadcast(b)).select(F.round("uncoded", 6).alias("uncoded"), F.round("unused", 6).alias("unused"), verdict.alias("saturation"))


def utilisation(codes: DataFrame) -> DataFrame:
    """(code_id, count, use): under for unused codes or those below a fifth of the median, over above five medians."""
    m = codes.agg(F.percentile("count", F.lit(0.5)).alias("median"))
    use = F.when((F.col("count") == 0) | (F.col("count") < 0.2 * F.col("median")), "under").when(F.col("count") > 5 * F.col("median"), "over").otherwise("normal")
    return codes.join(F.broadcast(m)).select("code_id", "count", use.alias("use"))


def confidence_distribution(df: DataFrame) -> DataFrame:
    """One row: number, mean, median, population deviation and linear percentiles of all confidences."""
    p = F.percentile("confidence", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9)]))
    one = confidences(df).filter("confidence is not null").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.round(F.stddev_pop("confidence"), 6).alias("std"), p.alias("_p"))
    return one.select("n", "mean", "std", *[F.round(F.col("_p")[i], 6).alias(k) for i, k in enumerate(("p25", "median", "p75", "p90"))])


def confidence_histogram(df: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, count): equal widths between the least and the greatest confidence, the last bin closed; empty bins kept."""
    c = confidences(df).filter("confidence is not null")
    ends = c.agg(F.min("confidence").alias("lo"), F.max("confidence").alias("hi"))
    at = F.least(F.floor((F.col("confidence") - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))), F.lit(bins - 1))
    counts = c.join(F.broadcast(ends)).select(F.coalesce(at, F.lit(0)).cast("long").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))


def ambiguity(df: DataFrame) -> DataFrame:
    k = F.coalesce("num_codes", F.lit(0))
    return df.agg(F.round(F.avg(F.when(k > 1, 1.0).otherwise(0.0)), 6).alias("multi_share"), F.round(F.avg(F.when(k >= 3, 1.0).otherwise(0.0)), 6).alias("ambiguous_share"))


def imbalance(codes: DataFrame) -> DataFrame:
    """One row: most frequent to least frequent used code, and the Gini coefficient over all codes."""
    w = W.orderBy("count", "code_id")  # one row a code: the frame is bounded where it was read
    g = codes.withColumn("i", F.row_number().over(w))
    n, total = F.count(F.lit(1)), F.sum("count")
    gini = F.try_divide(2.0 * F.sum(F.col("i") * F.col("count")), n * total) - (n + 1.0) / n
    return g.agg(F.round(F.try_divide(F.max("count").cast("double"), F.min(F.when(F.col("count") > 0, F.col("count")))), 6).alias("ratio"), F.round(F.coalesce(gini, F.lit(0.0)), 6).alias("gini"))


def chi_square(df: DataFrame, group_col: str, flag_col: str) -> DataFrame:
    """One row: chi-square statistic of group x flag, degrees of freedom; Yates' correction for 2 x 2. chi_square_p gives the p-value.

    NULL groups are left out. Tables with one group or one flag value give statistic 0.
    """
    t = df.filter(F.col(group_col).isNotNull() & F.col(flag_col).isNotNull()).groupBy(F.col(group_col).alias("g"), F.col(flag_col).alias("f")).agg(F.count(F.lit(1)).cast("double").alias("o"))
    rows, cols = t.groupBy("g").agg(F.sum("o").alias("r")), t.groupBy("f").agg(F.sum("o").alias("c"))
    n_rows = rows.agg(F.count(F.lit(1)).alias("nr"), F.sum(1 / F.col("r")).alias("ir"), F.sum("r").alias("N"))
    n_cols = cols.agg(F.count(F.lit(1)).alias("nc"), F.sum(1 / F.col("c")).alias("ic"))
    # the sum over all cells of (o - e)^2 / e is that of o^2 / e over the cells that occur, less N: empty cells need no grid
    one = t.join(rows, "g").join(cols, "f").join(F.broadcast(n_rows))
    e = F.col("r") * F.col("c") / F.col("N")
    cells = one.agg(F.sum(F.col("o") * F.col("o") / e).alias("s"), F.max(F.abs(F.col("o") - e)).alias("gap"))
    both = n_rows.join(F.broadcast(n_cols)).join(F.broadcast(cells))
    # in a 2 x 2 table all four gaps are equal
    gap = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    yates = gap * gap * F.col("N") * F.col("ir") * F.col("ic")
    statistic = F.when((F.col("nr") == 2) & (F.col("nc") == 2), yates).otherwise(F.greatest(F.col("s") - F.col("N"), F.lit(0.0)))
    return both.select(F.round(F.coalesce(statistic, F.lit(0.0)), 6).alias("statistic"), F.greatest((F.col("nr") - 1) * (F.col("nc") - 1), F.lit(0)).alias("dof"))


def chi_square_p(statistic: float, dof: int) -> float:
    """Upper tail of the chi-square distribution (series and continued fraction of the incomplete gamma function)."""
    import math

    if dof <= 0 or statistic <= 0:
        return 1.0
    a, x = dof / 2, statistic / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for n in range(1, 1000):
        k = -n * (n - a)
        b += 2
        d = 1 / (k * d + b or 1e-300)
        c = b + k / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, front * h)


def group_statistics(df: DataFrame, group_col: str) -> DataFrame:
    """(group, mean, std, n) of num_codes, with the sample deviation; groups are trimmed and lower-cased."""
    g = F.lower(F.trim(group_col))
    return df.filter(F.col(group_col).isNotNull()).groupBy(g.alias("group")).agg(F.round(F.avg("num_codes"), 6).alias("mean"), F.round(F.stddev_samp("num_codes"), 6).alias("std"), F.count(F.lit(1)).alias("n"))


def positional_bias(df: DataFrame, id_col: str) -> DataFrame:
    """One row: mean num_codes of the first half by id and of the rest; significant if they differ by more than a half (n >= 20).

    The first half ends at the n // 2-th smallest id, found by rounds of bucket counts: no task numbers or holds all ids.
    """
    n, lo, hi = df.agg(F.count(F.lit(1)), F.min(id_col), F.max(id_col)).first()
    place = n // 2
    last = lo - 1 if not place and n else _nth(df, id_col, place, lo, hi) if n else 0
    first = F.col(id_col) <= last
    one = df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(first, F.col("num_codes"))).alias("a"), F.avg(F.when(~first, F.col("num_codes"))).alias("b"))
    return one.select("n", F.round("a", 6).alias("first_half"), F.round("b", 6).alias("second_half"), ((F.col("n") >= 20) & (F.abs(F.col("a") - F.col("b")) > 0.5)).alias("significant"))


def _nth(df: DataFrame, column: str, place: int, lo: int, hi: int, buckets: int = 1024) -> int:
    """The place-th smallest value of an integer column within lo..hi: each round keeps one bucket of 1,024."""
    while lo < hi:
        width = -(-(hi - lo + 1) // buckets)
        counts = df.filter(F.col(column).between(lo, hi)).groupBy(F.expr(f"(cast({column} as decimal(38,0)) - {lo}) div {width}").cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()
        for b, n in counts:
            if place <= n:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            place -= n
    return lo


def health(df: DataFrame, codes: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row: the number of issues found by fixed thresholds and the status: excellent, good, fair or poor."""
    k = F.coalesce("num_codes", F.lit(0))
    a = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.when(k == 0, 1.0).otherwise(0.0)), F.lit(0.0)).alias("uncoded"), F.coalesce(F.avg(F.when(k >= 3, 1.0).otherwise(0.0)), F.lit(0.0)).alias("many"))
    c = confidences(df).agg(F.percentile("confidence", F.lit(0.75)).alias("p75"))
    u = codes.agg(F.count_if(F.col("count") == 0).alias("unused"), F.try_divide(F.max("count").cast("double"), F.min(F.when(F.col("count") > 0, F.col("count")))).alias("ratio"))
    one = a.join(F.broadcast(c)).join(F.broadcast(u))
    wordy = F.lit(0)
    if labels is not None:
        one = one.join(F.broadcast(labels.agg(F.count_if(F.size(F.split(F.trim("label"), r"\s+")) > 5).alias("wordy"))))
        wordy = F.col("wordy")
    issues = [wordy > 0, F.coalesce(F.col("ratio") > 10, F.lit(False)), F.col("uncoded") > 0.2, F.coalesce(F.col("p75") < 0.5, F.lit(False)), F.col("n") < 20, F.col("unused") > 0, F.col("many") > 0.3]
    count = sum((F.when(i, 1).otherwise(0) for i in issues[1:]), F.when(issues[0], 1).otherwise(0))
    status = F.when(count == 0, "excellent").when(count <= 2, "good").when(count <= 4, "fair").otherwise("poor")
    return one.select("n", F.round("uncoded", 6).alias("uncoded"), F.round("many", 6).alias("many"), F.round("p75", 6).alias("p75"), "unused", F.round("ratio", 6).alias("ratio"), count.cast("long").alias("issues"), status.alias("status"))


def validity(df: DataFrame, codes: DataFrame) -> DataFrame:
    """One row, the bundle of validity measures: stability, coverage, saturation, use of codes, confidence, ambiguity, boundary cases.

    Boundary cases are answers whose best confidence lies within 0.3..0.5. An empty table has coverage 0 and NULL means.
    """
    best = F.array_max("confidence_scores")
    near = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(best.between(0.3, 0.5)).alias("boundary"))
    use = utilisation(codes).agg(F.count_if(F.col("use") == "under").alias("underused"), F.count_if(F.col("use") == "over").alias("overused"))
    parts = [stability(df), saturation(df, codes), use, confidence_distribution(df).select(F.col("mean").alias("mean_confidence"), F.col("median").alias("median_confidence")), ambiguity(df)]
    one = near
    for p in parts:  # each is one row
        one = one.join(F.broadcast(p))
    return one.select("n", "stability", F.round(1 - F.col("uncoded"), 6).alias("coverage"), "saturation", "unused", "underused", "overused", "mean_confidence", "median_confidence", "multi_share", "ambiguous_share", "boundary")


def bias(df: DataFrame, codes: DataFrame, id_col: str, group_col: str) -> DataFrame:
    """One row, the bundle of bias measures: imbalance of the codes, dependence of being coded on a group, position. Rows without group count for the others only."""
    flagged = df.select(F.lower(F.trim(group_col)).alias("g"), (F.coalesce("num_codes", F.lit(0)) > 0).alias("f"))
    one = imbalance(codes).join(F.broadcast(chi_square(flagged, "g", "f"))).join(F.broadcast(positional_bias(df, id_col).select("first_half", "second_half", F.col("significant").alias("position_bias"))))
    warnings = F.array_compact(F.array(F.when(F.col("ratio") > 10, "codes out of balance"), F.when(F.col("position_bias"), "halves differ")))
    return one.withColumn("warnings", F.array_join(warnings, ","))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Extension: Cohen's kappa of two coders' columns."""
    t = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = t.agg(F.sum("n").alias("N"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0.0)).alias("same"))
    p = t.groupBy(F.col("x").alias("k")).agg(F.sum("n").alias("p")).join(t.groupBy(F.col("y").alias("k")).agg(F.sum("n").alias("q")), "k").agg(F.coalesce(F.sum(F.col("p") * F.col("q")), F.lit(0.0)).alias("pq"))
    po, pe = F.col("same") / F.col("N"), F.col("pq") / (F.col("N") * F.col("N"))
    return total.join(F.broadcast(p)).select(F.round(F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(1.0)), 6).alias("kappa"))


def band(value: float | None, ladder: tuple[tuple[float, str], ...] = ((0.8, "excellent"), (0.6, "good"), (0.4, "moderate"), (0.0, "low"))) -> str:
    """The word for a score, by a descending ladder; none for no score."""
    if value is None:
        return "none"
    return next((w for t, w in ladder if value >= t), ladder[-1][1])
