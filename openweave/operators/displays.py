"""The data behind plots: what a chart of a coding shows, without drawing it. All tables here are k topics by top terms or samples of stated size."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..skew import small
from .features import ascii_words
from .ml import Fitted

# Which displays make sense for which method.
DISPLAYS = {
    "kmeans": ("word_cloud", "scatter", "network", "silhouette", "sunburst"),
    "bisecting": ("word_cloud", "scatter", "network", "silhouette", "sunburst"),
    "spectral": ("word_cloud", "scatter", "network", "silhouette"),
    "lda": ("word_cloud", "topic_terms", "topic_distribution", "sunburst"),
    "nmf": ("word_cloud", "topic_terms", "topic_distribution", "sunburst"),
}


def availability(spark) -> DataFrame:
    """(method, display, available) of every known pair."""
    names = sorted({d for v in DISPLAYS.values() for d in v})
    return spark.createDataFrame([(m, d, d in v) for m, v in sorted(DISPLAYS.items()) for d in names], "method string, display string, available boolean")


def topic_terms(fitted: Fitted, top: int = 10) -> DataFrame:
    """(topic, term, weight) over the union of the topics' first terms, each topic scaled by its largest weight; 0 where a topic lacks a term."""
    z = F.explode(F.arrays_zip(F.slice("terms", 1, top).alias("term"), F.slice("weights", 1, top).alias("w")))
    cells = fitted.topics.select("topic", z.alias("z")).select("topic", "z.term", "z.w")
    best = cells.groupBy("topic").agg(F.max("w").alias("best"))
    grid = fitted.topics.select("topic").join(small(cells.select("term").distinct()))
    scaled = grid.join(cells, ["topic", "term"], "left").join(best, "topic", "left")
    return scaled.select("topic", "term", F.coalesce(F.try_divide("w", "best"), F.lit(0.0)).alias("weight"))


def topic_distribution(fitted: Fitted, documents: int = 50) -> DataFrame:
    """(id, topic, weight) of a fixed number of documents, chosen by the hash of their id."""
    some = fitted.doc_topics.orderBy(F.md5(F.col("id").cast("string")), "id").limit(documents)
    return some.select("id", F.posexplode("weights").alias("topic", "weight"))


def cluster_terms(df: DataFrame, text_col: str, cluster_col: str, top: int = 20, stopwords: frozenset[str] = frozenset()) -> DataFrame:
    """(cluster, term, score): the most frequent terms of each cluster, the first scaled to 100."""
    t = df.select(F.col(cluster_col).alias("cluster"), F.explode(ascii_words(F.col(text_col))).alias("term"))
    if stopwords:
        t = t.filter(~F.col("term").isin(*sorted(stopwords)))
    n = t.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("cluster").orderBy(F.desc("n"), "term")
    ranked = n.select("cluster", "term", "n", F.row_number().over(w).alias("place"), F.max("n").over(W.partitionBy("cluster")).alias("best"))
    return ranked.filter(F.col("place") <= top).select("cluster", "term", F.round(100.0 * F.col("n") / F.col("best"), 6).alias("score"))


def compare_representations(features: dict[str, DataFrame], k: int = 5, seed: int = 42) -> list[dict]:
    """Per named table of (id, features): rows, seconds to cluster it, silhouette (MLlib's); best first."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    out = []
    for name, df in features.items():
        began = time.time()
        model = KMeans(k=k, seed=seed).fit(df)
        fitted = model.transform(df)
        used = fitted.select("prediction").distinct().count()
        score = ClusteringEvaluator(featuresCol="features").evaluate(fitted) if used > 1 else -1.0
        out.append({"name": name, "rows": fitted.count(), "seconds": round(time.time() - began, 3), "silhouette": score})
    return sorted(out, key=lambda x: -x["silhouette"])
