"""Unsupervised coding: clusterings and topic models over sparse features, assignment, codebooks, the choice of k."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_words, clean_multilingual
from .evaluate import combined_score
from .features import VectorConfig, ngrams

#: Starts of k-means, the best of which is kept.
RESTARTS = 10
#: Rows of a partition from which another pays.
ROWS_A_TASK = 10_000
#: Partial sums of a topic in a factorization, before the last.
SPREAD = 64
METHODS = ("kmeans", "lda", "nmf", "spectral", "bisecting")


@dataclass
class Fitted:
    """A fitted model: topics (topic, terms, weights) and doc_topics (id, weights array)."""

    method: str
    k: int
    topics: DataFrame
    doc_topics: DataFrame
    vocabulary: list[str]
    model: Any = None


def vectorize(df: DataFrame, id_col: str, text_col: str, config: VectorConfig = VectorConfig(), counts: bool = False):
    """(features, vocabulary): (id, features) as sparse vectors of counts or unit-length TF-IDF; blank texts are left out."""
    from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    tokens = ascii_words(clean_multilingual(F.col(text_col)))
    if config.stopwords:
        gone = sorted(config.stopwords)
        tokens = F.filter(tokens, lambda t: ~t.isin(*gone))
    d = df.filter(F.col(text_col).isNotNull() & F.col(text_col).rlike(r"\S")).select(F.col(id_col).alias("id"), ngrams(tokens, config.min_ngram, config.max_ngram).alias("tokens"))
    cv = CountVectorizer(inputCol="tokens", outputCol="tf", vocabSize=config.max_features, minDF=config.min_df, maxDF=config.max_df if config.max_df != 1 else float(1 << 62)).fit(d)  # MLlib takes 1.0 for one document
    d = cv.transform(d).select("id", "tf")
    if counts:
        return d.withColumnRenamed("tf", "features"), cv.vocabulary
    # MLlib's idf lacks the + 1, so it is added to the weights by which the counts are multiplied
    weights = Vectors.dense([x + 1.0 for x in IDF(inputCol="tf", outputCol="idf").fit(d).idf])
    raw = ElementwiseProduct(scalingVec=weights, inputCol="tf", outputCol="raw").transform(d)
    return Normalizer(inputCol="raw", outputCol="features", p=2.0).transform(raw).select("id", "features"), cv.vocabulary


def _topics(spark, weights: list[list[float]], vocabulary: list[str], top: int) -> DataFrame:
    rows = []
    for t, row in enumerate(weights):
        best = sorted(range(len(row)), key=lambda i: (-row[i], vocabulary[i]))[:top]
        rows.append((t, [vocabulary[i] for i in best if row[i] > 0], [float(row[i]) for i in best if row[i] > 0]))
    return spark.createDataFrame(rows, "topic int, terms array<string>, weights array<double>")


def fit(features: DataFrame, vocabulary: list[str], method: str = "kmeans", k: int = 10, seed: int = 42, top_terms: int = 15, iterations: int = 20) -> Fitted:
    """Fits a model on (id, features). Hard clusterings give one-hot weights; topic models and factors give a weight a topic."""
    spark = features.sparkSession
    if method in ("kmeans", "bisecting"):
        from pyspark.ml.clustering import BisectingKMeans, KMeans

        if method == "kmeans":
            # as many partitions as the rows are worth: the restarts, not the pieces of one, fill a small cluster
            held = features.coalesce(max(1, -(-features.count() // ROWS_A_TASK))).persist()
            with ThreadPoolExecutor(RESTARTS) as pool:  # the restarts share the cluster and the cached features
                runs = list(pool.map(lambda i: KMeans(k=k, seed=seed + i, maxIter=iterations).fit(held), range(RESTARTS)))
            costs = [m.summary.trainingCost for m in runs]
            model = runs[costs.index(min(costs))]
            held.unpersist()
        else:
            model = BisectingKMeans(k=k, seed=seed, maxIter=iterations).fit(features)
        centres = [c.tolist() for c in model.clusterCenters()]
        one = F.transform(F.sequence(F.lit(0), F.lit(len(centres) - 1)), lambda i: F.when(i == F.col("prediction"), 1.0).otherwise(0.0))
        return Fitted(method, len(centres), _topics(spark, centres, vocabulary, top_terms), model.transform(features).select("id", one.alias("weights")), vocabulary, model)
    if method == "lda":
        from pyspark.ml.clustering import LDA

        model = LDA(k=k, seed=seed, maxIter=iterations, optimizer="online").fit(features)
        weights = model.topicsMatrix().toArray().T.tolist()
        return Fitted(method, k, _topics(spark, weights, vocabulary, top_terms), model.transform(features).select("id", vector_to_array("topicDistribution").alias("weights")), vocabulary, model)
    if method == "nmf":
        return _nmf(features, vocabulary, k, seed, top_terms, iterations)
    if method == "spectral":
        return _spectral(features, vocabulary, k, seed, top_terms)
    raise ValueError(f"unknown method {method}; known: {', '.join(METHODS)}")


def _nmf(features: DataFrame, vocabulary: list[str], k: int, seed: int, top_terms: int, iterations: int) -> Fitted:
    """Non-negative factors by multiplicative updates: W stays with its documents, H (k x vocabulary) is summed over partitions.

    Each round is one pass over the features; k x vocabulary sums come to the driver, bounded by max_features.
    """
    import numpy as np
    import pandas as pd

    spark, v = features.sparkSession, len(vocabulary)
    rng = np.random.default_rng(seed)
    h = rng.random((k, v)) + 0.1
    parts = features.select("id", vector_to_array("features").alias("x"))

    def solve(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        w = np.full((len(x), h.shape[0]), 1.0 / h.shape[0])
        hh, xh = h @ h.T, x @ h.T
        for _ in range(30):
            w *= xh / np.maximum(w @ hh, 1e-12)
        return w

    def sums(batches):
        num, den = np.zeros((k, v)), np.zeros((k, k))
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy())
                w = solve(x, h)
                num += w.T @ x
                den += w.T @ w
        at = TaskContext.get().partitionId() % SPREAD  # which of the partial sums of a topic takes these
        yield pd.DataFrame({"topic": range(k), "at": at, "sums": [np.concatenate([num[t], den[t]]).tobytes() for t in range(k)]})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x) for x in b["sums"]], axis=0)
        return pd.DataFrame({"topic": [b["topic"].iloc[0]], "sums": [total.tobytes()]})

    for _ in range(iterations):  # summed on the executors, topic by topic in two steps: the driver gets k rows
        partial = parts.mapInPandas(sums, "topic int, at int, sums binary").groupBy("topic", "at").applyInPandas(add, "topic int, sums binary")
        rows = partial.groupBy("topic").applyInPandas(add, "topic int, sums binary").orderBy("topic").collect()
        both = np.stack([np.frombuffer(r[1]) for r in rows]) if rows else np.zeros((k, v + k))
        num, den = both[:, :v], both[:, v:]
        h = h * num / np.maximum(den @ h, 1e-12)
    final = h.copy()

    def weights(batches):
        for b in batches:
            w = solve(np.stack(b["x"].to_numpy()), final) if len(b) else np.zeros((0, k))
            total = np.maximum(w.sum(axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"id": b["id"], "weights": list(w / total)})

    kind = dict(features.dtypes)["id"]
    return Fitted("nmf", k, _topics(spark, final.tolist(), vocabulary, top_terms), parts.mapInPandas(weights, f"id {kind}, weights array<double>"), vocabulary)


def _spectral(features: DataFrame, vocabulary: list[str], k: int, seed: int, top_terms: int) -> Fitted:
    """Power-iteration clustering on affinities through shared leading terms: documents link to the terms they weigh most,
    so the graph has few edges a document and no pairs of documents are formed; documents take the cluster of their nodes."""
    from pyspark.ml.clustering import PowerIterationClustering

    x = features.select("id", F.posexplode(vector_to_array("features")).alias("t", "w")).filter("w > 0")
    edges = x.select(F.col("id").cast("long").alias("src"), (-F.col("t") - 1).cast("long").alias("dst"), F.col("w").alias("weight"))
    assigned = PowerIterationClustering(k=k, maxIter=20, initMode="degree", srcCol="src", dstCol="dst", weightCol="weight").assignClusters(edges)
    docs = assigned.filter("id >= 0").select("id", "cluster")
    one = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == F.col("cluster"), 1.0).otherwise(0.0))
    means = x.join(docs, "id").groupBy("cluster", "t").agg(F.sum("w").alias("w")).collect()
    weights = [[0.0] * len(vocabulary) for _ in range(k)]
    for r in means:
        weights[r["cluster"]][r["t"]] = r["w"]
    return Fitted("spectral", k, _topics(features.sparkSession, weights, vocabulary, top_terms), docs.select("id", one.alias("weights")), vocabulary)


def assign(doc_topics: DataFrame, min_confidence: float = 0.3) -> DataFrame:
    """(id, assigned_codes, confidence_scores, num_codes): every topic of at least min_confidence, in topic order."""
    pairs = F.filter(F.transform("weights", lambda w, i: F.struct(F.format_string("CODE_%02d", i + 1).alias("code"), w.alias("confidence"))), lambda p: p["confidence"] >= min_confidence)
    d = doc_topics.select("id", pairs.alias("p"))
    return d.select("id", F.transform("p", lambda p: p["code"]).alias("assigned_codes"), F.transform("p", lambda p: p["confidence"]).alias("confidence_scores"), F.size("p").alias("num_codes"))


def codebook(fitted: Fitted, assigned: DataFrame) -> DataFrame:
    """(code, label, keywords, count, avg_confidence); the label is the first three distinct terms, capitalised."""
    words = F.slice(F.array_distinct("terms"), 1, 3)
    names = fitted.topics.select(F.format_string("CODE_%02d", F.col("topic") + 1).alias("code"), F.initcap(F.array_join(words, " / ")).alias("label"), F.col("terms").alias("keywords"))
    z = assigned.select(F.explode(F.arrays_zip("assigned_codes", "confidence_scores")).alias("z")).groupBy(F.col("z.assigned_codes").alias("code")).agg(F.count(F.lit(1)).alias("count"), F.avg("z.confidence_scores").alias("avg_confidence"))
    return names.join(z, "code", "left").withColumns({"count": F.coalesce("count", F.lit(0)), "avg_confidence": F.coalesce("avg_confidence", F.lit(0.0))})


def rename(book: DataFrame, names: dict[str, str]) -> DataFrame:
    """The codebook with new labels; original_label keeps the old, source tells auto from user_renamed."""
    new = F.coalesce(*[F.when(F.col("code") == c, F.lit(n)) for c, n in names.items()], F.lit(None).cast("string"))
    return book.withColumn("original_label", F.col("label")).withColumn("label", F.coalesce(new, "label")).withColumn("source", F.when(new.isNotNull(), "user_renamed").otherwise("auto"))


def scores(features: DataFrame, fitted: Fitted) -> dict[str, float]:
    """Silhouette (squared Euclidean, MLlib's), Davies-Bouldin and Calinski-Harabasz index, the clusters used and the combined score.

    A document belongs to its strongest topic. With fewer than two clusters in use: silhouette -1, the others 0.
    """
    from pyspark.ml.evaluation import ClusteringEvaluator

    best = F.array_position(F.col("weights"), F.array_max("weights")).cast("int") - 1
    d = features.join(fitted.doc_topics.select("id", best.alias("prediction")), "id")
    used = d.select("prediction").distinct().count()
    if used < 2:
        return {"silhouette": -1.0, "davies_bouldin": 0.0, "calinski_harabasz": 0.0, "clusters": used, "combined": 0.0}
    silhouette = ClusteringEvaluator(featuresCol="features").evaluate(d)
    db, ch = _dispersion(d)
    return {"silhouette": silhouette, "davies_bouldin": db, "calinski_harabasz": ch, "clusters": used, "combined": combined_score(silhouette, db, ch)}


def _dispersion(d: DataFrame) -> tuple[float, float]:
    """(Davies-Bouldin, Calinski-Harabasz) of (features, prediction): the centres, k rows, come to the driver; distances are summed where the rows are."""
    import numpy as np
    import pandas as pd
    from pyspark.ml.stat import Summarizer

    means = d.groupBy("prediction").agg(Summarizer.mean(F.col("features")).alias("c"), F.count(F.lit(1)).alias("n")).orderBy("prediction").collect()
    names = [r["prediction"] for r in means]
    centre, n = np.array([r["c"].toArray() for r in means]), np.array([r["n"] for r in means], dtype=float)

    def run(batches):
        for b in batches:
            if len(b):
                at = np.searchsorted(names, b["prediction"].to_numpy())
                q = ((np.stack(b["x"].to_numpy()) - centre[at]) ** 2).sum(axis=1)
                yield pd.DataFrame({"at": at, "q": q, "s": np.sqrt(q)}).groupby("at", as_index=False).sum()

    sums = d.select("prediction", vector_to_array("features").alias("x")).mapInPandas(run, "at long, q double, s double").groupBy("at").agg(F.sum("q").alias("q"), F.sum("s").alias("s")).orderBy("at").collect()
    within, spread = sum(r["q"] for r in sums), np.array([r["s"] for r in sums]) / n
    apart = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(axis=2))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(apart > 0, (spread[:, None] + spread[None]) / apart, 0.0)
    overall = (centre * n[:, None]).sum(axis=0) / n.sum()
    between, k = float((n * ((centre - overall) ** 2).sum(axis=1)).sum()), len(n)
    ch = between * (n.sum() - k) / (within * (k - 1)) if within > 0 else 0.0
    return float(ratio.max(axis=1).mean()), float(ch)


def find_k(features: DataFrame, vocabulary: list[str], low: int = 3, high: int = 15, method: str = "kmeans", seed: int = 42) -> tuple[int, list[tuple[int, float]]]:
    """(best k, silhouettes): the smallest k of the highest silhouette; k never exceeds documents or terms."""
    high = min(high, features.count(), len(vocabulary))
    tried, best = [], (None, -2.0)
    for k in range(low, high + 1):
        s = scores(features, fit(features, vocabulary, method, k, seed))["silhouette"]
        tried.append((k, s))
        if s > best[1]:
            best = (k, s)
    return best[0] or max(1, high), tried


def tune(df: DataFrame, id_col: str, text_col: str, trials: int = 12, seed: int = 42, methods: tuple[str, ...] = ("kmeans", "nmf", "lda")) -> tuple[dict, list[dict]]:
    """(best, trials): seeded random search over method, k, n-gram length and document-frequency bounds by the combined score.

    The best parameters include all that the final fit needs.
    """
    rng, out = random.Random(seed), []
    for _ in range(trials):
        p = {"method": rng.choice(methods), "k": rng.randint(3, 15), "max_ngram": rng.choice((1, 2, 3)), "min_df": rng.choice((1, 2, 5)), "max_df": rng.choice((0.7, 0.8, 0.9))}
        config = VectorConfig(max_ngram=p["max_ngram"], min_df=p["min_df"], max_df=p["max_df"])
        features, vocabulary = vectorize(df, id_col, text_col, config, counts=p["method"] == "lda")
        if len(vocabulary) < p["k"]:
            continue
        features = features.cache()
        out.append(p | scores(features, fit(features, vocabulary, p["method"], p["k"], seed)))
        features.unpersist()
    if not out:
        raise ValueError("no trial had enough terms")
    return max(out, key=lambda p: p["combined"]), out


def importance(trials: list[dict], by: str = "combined") -> dict[str, float]:
    """How much each tuned parameter tells about the score: the share of its variance that lies between the values of the parameter."""
    names = [k for k in ("method", "k", "max_ngram", "min_df", "max_df") if all(k in t for t in trials)]
    mean = sum(t[by] for t in trials) / max(len(trials), 1)
    total = sum((t[by] - mean) ** 2 for t in trials)
    out = {}
    for name in names:
        groups: dict = {}
        for t in trials:
            groups.setdefault(t[name], []).append(t[by])
        out[name] = sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in groups.values()) / total if total else 0.0
    return out


def pca_scatter(features: DataFrame, k: int = 2) -> DataFrame:
    """(id, x, y): two principal components for display."""
    from pyspark.ml.feature import PCA

    model = PCA(k=k, inputCol="features", outputCol="p").fit(features)
    return model.transform(features).select("id", vector_to_array("p").alias("p")).select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def dense(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """(id, features) from a column of precomputed embeddings."""
    return df.select(F.col(id_col).alias("id"), array_to_vector(F.col(array_col).cast("array<double>")).alias("features"))
