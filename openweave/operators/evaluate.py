"""Evaluating groupings: contingency measures, centroid indices, coherence, exact silhouette."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import split_labels, unknown_label

#: Rows up to which the exact silhouette compares every row with every cluster member.
SILHOUETTE_ROWS = 5_000


def contingency(df: DataFrame, cluster_col: str, label_col: str) -> DataFrame:
    """(cluster, label, n) of rows that have both; labels that stand for none are left out."""
    d = df.filter(F.col(cluster_col).isNotNull() & ~unknown_label(F.col(label_col).cast("string")))
    return d.groupBy(F.col(cluster_col).alias("cluster"), F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def agreement(table: DataFrame, digits: int = 6) -> DataFrame:
    """One row: adjusted Rand index, normalized mutual information (arithmetic), homogeneity, completeness, V-measure, purity."""
    n = F.col("n").cast("double")
    rows = table.groupBy("cluster").agg(F.sum(n).alias("a"), F.max(n).alias("top"))
    cols = table.groupBy("label").agg(F.sum(n).alias("b"))
    total = table.agg(F.sum(n).alias("total"), F.sum(n * (n - 1) / 2).alias("sij"))
    cell = table.join(rows.select("cluster", "a"), "cluster").join(cols, "label").join(F.broadcast(total))
    t = F.col("total")
    mi = cell.agg(F.sum(n / t * F.log(n * t / (F.col("a") * F.col("b")))).alias("mi"))
    ra = rows.join(F.broadcast(total)).agg(F.sum(F.col("a") * (F.col("a") - 1) / 2).alias("sa"), F.sum(-F.col("a") / t * F.log(F.col("a") / t)).alias("ha"), F.sum("top").alias("pure"))
    cb = cols.join(F.broadcast(total)).agg(F.sum(F.col("b") * (F.col("b") - 1) / 2).alias("sb"), F.sum(-F.col("b") / t * F.log(F.col("b") / t)).alias("hb"))
    one = total.join(F.broadcast(mi)).join(F.broadcast(ra)).join(F.broadcast(cb))
    pairs = t * (t - 1) / 2
    expected = F.try_divide(F.col("sa") * F.col("sb"), pairs)
    ari = F.coalesce(F.try_divide(F.col("sij") - expected, (F.col("sa") + F.col("sb")) / 2 - expected), F.lit(1.0))
    homogeneity = F.coalesce(F.try_divide(F.col("mi"), F.col("hb")), F.lit(1.0))
    completeness = F.coalesce(F.try_divide(F.col("mi"), F.col("ha")), F.lit(1.0))
    one = one.withColumn("h", homogeneity).withColumn("c", completeness)
    v = F.coalesce(F.try_divide(2 * F.col("h") * F.col("c"), F.col("h") + F.col("c")), F.lit(0.0))
    nmi = F.coalesce(F.try_divide(2 * F.col("mi"), F.col("ha") + F.col("hb")), F.lit(1.0))
    return one.select(*[F.round(x, digits).alias(k) for k, x in (("ari", ari), ("nmi", nmi), ("homogeneity", F.col("h")), ("completeness", F.col("c")), ("v_measure", v), ("purity", F.col("pure") / t))], t.cast("long").alias("n"))


def mapping(table: DataFrame, by: str = "cluster") -> DataFrame:
    """The most common counterpart of each cluster or label with its share; ties go to the smallest name."""
    other = "label" if by == "cluster" else "cluster"
    best = table.groupBy(by).agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), F.col(other).alias("o"))).alias("x"))
    return best.select(by, F.col("x.o").alias(other), F.round(-F.col("x.m") / F.col("total"), 6).alias("share"), F.col("total").alias("n"))


def multi_label_purity(df: DataFrame, cluster_col: str, label_col: str, delimiter: str | None = None) -> DataFrame:
    """One row: the unweighted mean over clusters of the share of rows that hold the cluster's most common label."""
    labels = F.array_distinct(F.filter(split_labels(F.col(label_col), delimiter), lambda x: ~unknown_label(x)))
    d = df.select(F.col(cluster_col).alias("cluster"), labels.alias("l")).filter(F.size("l") > 0)
    size = d.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    top = d.select("cluster", F.explode("l").alias("label")).groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max("n").alias("top"))
    return size.join(top, "cluster").agg(F.round(F.coalesce(F.avg(F.col("top") / F.col("size")), F.lit(0.0)), 6).alias("purity"), F.count(F.lit(1)).alias("clusters"))


def overlap_summary(table: DataFrame) -> DataFrame:
    """(cluster, size, purity, coverage of its main label) and their size-weighted means, from (cluster, label, n)."""
    sizes = table.groupBy("cluster").agg(F.sum("n").alias("size"), F.max("n").alias("top"))
    return sizes.select("cluster", "size", F.round(F.col("top") / F.col("size"), 6).alias("purity"))


def label_coverage(table: DataFrame) -> DataFrame:
    """(label, n, coverage): the share of a label that its main cluster holds."""
    return table.groupBy("label").agg(F.sum("n").alias("n"), F.max("n").alias("top")).select("label", "n", F.round(F.col("top") / F.col("n"), 6).alias("coverage"))


def long_vectors(df: DataFrame, id_col: str, vector_col: str, cluster_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(cluster_col).alias("cluster"), F.posexplode(vector_col).alias("d", "x")).withColumn("x", F.col("x").cast("double"))


def centroids(df: DataFrame, vector_col: str, cluster_col: str, dims: int) -> DataFrame:
    """(cluster, n, centroid): means dimension by dimension, in one aggregation without exploding."""
    v = F.col(vector_col)
    means = F.array(*[F.avg(v[i].cast("double")) for i in range(dims)])
    return df.groupBy(F.col(cluster_col).alias("cluster")).agg(F.count(F.lit(1)).alias("n"), means.alias("centroid"))


def _square_distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def indices(df: DataFrame, id_col: str, vector_col: str, cluster_col: str, dims: int) -> DataFrame:
    """One row: Calinski-Harabasz and Davies-Bouldin index of a labelled set of vectors.

    Centroids are one row a cluster (k of a model); they are broadcast only below their counted bound.
    """
    from ..skew import small

    c = centroids(df, vector_col, cluster_col, dims)
    overall = df.agg(F.array(*[F.avg(F.col(vector_col)[i].cast("double")) for i in range(dims)]).alias("mean"), F.count(F.lit(1)).alias("total"))
    d = df.select(F.col(vector_col).alias("v"), F.col(cluster_col).alias("cluster")).join(small(c, 10_000), "cluster")
    w = d.select("cluster", _square_distance(F.col("v"), F.col("centroid")).alias("q")).groupBy("cluster").agg(F.sum("q").alias("within"), F.avg(F.sqrt("q")).alias("s"))
    b = c.join(F.broadcast(overall)).select("cluster", (F.col("n") * _square_distance(F.col("centroid"), F.col("mean"))).alias("between"))
    sums = w.join(b, "cluster").agg(F.sum("within").alias("within"), F.sum("between").alias("between"), F.count(F.lit(1)).alias("k"))
    x = c.join(w, "cluster").select("cluster", "centroid", "s")
    y = x.select(F.col("cluster").alias("other"), F.col("centroid").alias("oc"), F.col("s").alias("os"))
    r = x.join(small(y, 10_000), F.col("cluster") != F.col("other")).select("cluster", F.try_divide(F.col("s") + F.col("os"), F.sqrt(_square_distance(F.col("centroid"), F.col("oc")))).alias("r"))
    db = r.groupBy("cluster").agg(F.max("r").alias("r")).agg(F.round(F.avg("r"), 6).alias("davies_bouldin"))
    ch = sums.join(F.broadcast(overall.select("total"))).select(F.round(F.try_divide(F.col("between") * (F.col("total") - F.col("k")), F.col("within") * (F.col("k") - 1)), 4).alias("calinski_harabasz"), "k", F.col("total").alias("n"))
    return ch.join(F.broadcast(db))


def coherence(df: DataFrame, vector_col: str, cluster_col: str, dims: int) -> DataFrame:
    """(cluster, n, coherence): mean pairwise cosine, exact and without pairs: (|sum of unit vectors|^2 - m) / (m (m - 1))."""
    v = F.col(vector_col)
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    d = df.select(F.col(cluster_col).alias("cluster"), F.transform(v, lambda x: F.try_divide(x.cast("double"), norm)).alias("u"), norm.alias("norm")).filter("norm > 0")
    sums = d.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("u")[i]).alias(f"_{i}") for i in range(dims)])
    total = sum((F.col(f"_{i}") * F.col(f"_{i}") for i in range(1, dims)), F.col("_0") * F.col("_0"))
    return sums.select("cluster", "n", F.round(F.try_divide(total - F.col("n"), F.col("n") * (F.col("n") - 1.0)), 6).alias("coherence"))


def cluster_network(df: DataFrame, vector_col: str, cluster_col: str, dims: int, threshold: float = 0.1) -> DataFrame:
    """(a, b, similarity): cosines of cluster means of at least the threshold, a < b."""
    from ..skew import small

    c = centroids(df, vector_col, cluster_col, dims)
    size = F.sqrt(F.aggregate(F.transform("centroid", lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    x = c.select(F.col("cluster").alias("a"), F.col("centroid").alias("ca"), size.alias("na"))
    y = c.select(F.col("cluster").alias("b"), F.col("centroid").alias("cb"), size.alias("nb"))
    dot = F.aggregate(F.zip_with("ca", "cb", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return x.join(small(y, 10_000), F.col("a") < F.col("b")).select("a", "b", F.round(F.try_divide(dot, F.col("na") * F.col("nb")), 6).alias("similarity")).filter(F.col("similarity") >= threshold)


def representative(df: DataFrame, id_col: str, vector_col: str, cluster_col: str, dims: int, top: int = 3) -> DataFrame:
    """(cluster, place, id, similarity): the rows nearest to their cluster's mean by cosine; ties by id."""
    from ..skew import small

    c = centroids(df, vector_col, cluster_col, dims)
    dot = F.aggregate(F.zip_with("v", "centroid", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)

    def size(col):
        return F.sqrt(F.aggregate(F.transform(col, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))

    d = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(cluster_col).alias("cluster")).join(small(c, 10_000), "cluster")
    d = d.select("cluster", "id", F.round(F.try_divide(dot, size("v") * size("centroid")), 6).alias("similarity"))
    place = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("similarity"), "id"))
    return d.withColumn("place", place.cast("long")).filter(F.col("place") <= top).select("cluster", "place", "id", "similarity")


def silhouette(df: DataFrame, id_col: str, vector_col: str, cluster_col: str, limit: int = SILHOUETTE_ROWS) -> DataFrame:
    """(id, cluster, silhouette): exact, Euclidean; quadratic, so tables beyond ``limit`` rows are refused (see sampled use in plans)."""
    n = df.count()
    if n > limit:
        raise ValueError(f"{n} rows; the exact silhouette takes at most {limit}. Use the centroid indices or a sample.")
    a = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(cluster_col).alias("cluster"))
    b = a.select(F.col("id").alias("oid"), F.col("v").alias("ov"), F.col("cluster").alias("oc"))
    dist = F.sqrt(F.aggregate(F.zip_with("v", "ov", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    m = a.join(F.broadcast(b), F.col("id") != F.col("oid")).groupBy("id", "cluster", "oc").agg(F.avg(dist).alias("m"))
    own = F.min(F.when(F.col("cluster") == F.col("oc"), F.col("m")))
    near = F.min(F.when(F.col("cluster") != F.col("oc"), F.col("m")))
    s = m.groupBy("id", "cluster").agg(own.alias("a"), near.alias("b"))
    return s.select("id", "cluster", F.round(F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))), 6).alias("silhouette"))


def combined_score(silhouette: float, davies_bouldin: float, calinski_harabasz: float) -> float:
    """The tuning objective: half silhouette scaled to 0..1, three tenths 1 / (1 + DB), a fifth CH / 1000 up to 1."""
    return 0.5 * (silhouette + 1) / 2 + 0.3 / (1 + davies_bouldin) + 0.2 * min(calinski_harabasz / 1000, 1.0)
