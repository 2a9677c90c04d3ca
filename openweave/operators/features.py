"""Features: relational counts and TF-IDF, n-gram phrases, dataset profiles, stop-word discovery, embeddings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_words, split_labels, unknown_label_pattern, word_count


@dataclass(frozen=True)
class VectorConfig:
    min_ngram: int = 1
    max_ngram: int = 3
    max_features: int = 1000
    min_df: float = 2
    max_df: float = 0.8
    sublinear: bool = False
    stopwords: frozenset[str] = frozenset()


def ngrams(tokens: Column, low: int = 1, high: int = 1) -> Column:
    """All n-grams of low..high tokens, joined by blanks."""

    def of(n: int) -> Column:
        last = F.size(tokens) - n
        grams = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))
        return F.when(last >= 0, grams).otherwise(F.array().cast("array<string>"))

    parts = [tokens if n == 1 else of(n) for n in range(low, high + 1)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def term_frequencies(df: DataFrame, id_col: str, text_col: str, config: VectorConfig = VectorConfig(), tokens=ascii_words) -> DataFrame:
    """(id, term, tf). Stop words go before n-grams are formed."""
    t = tokens(F.col(text_col))
    if config.stopwords:
        gone = sorted(config.stopwords)
        t = F.filter(t, lambda x: ~x.isin(*gone))
    d = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), t.alias("_t"))
    d = d.select("id", F.explode(ngrams(F.col("_t"), config.min_ngram, config.max_ngram)).alias("term"))
    return d.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(tf: DataFrame, n_docs: Column | int, config: VectorConfig = VectorConfig()) -> DataFrame:
    """(term, df, total): terms within the document-frequency bounds, the max_features most frequent of them (ties by term)."""
    v = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    low = F.lit(config.min_df) if config.min_df >= 1 else n * config.min_df
    high = F.lit(config.max_df) if config.max_df > 1 else n * config.max_df
    return v.filter((F.col("df") >= low) & (F.col("df") <= high)).orderBy(F.desc("total"), "term").limit(config.max_features)


def tfidf(df: DataFrame, id_col: str, text_col: str, config: VectorConfig = VectorConfig()) -> tuple[DataFrame, DataFrame]:
    """(weights, vocabulary): (id, term, weight) with idf ln((1 + n) / (1 + df)) + 1 and rows of unit length."""
    n = df.filter(F.col(text_col).isNotNull()).count()
    tf = term_frequencies(df, id_col, text_col, config)
    v = vocabulary(tf, n, config).withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)
    raw = (1.0 + F.log("tf")) if config.sublinear else F.col("tf").cast("double")
    # the vocabulary has at most max_features rows, so it goes to every task and the counts stay where they are
    w = tf.join(F.broadcast(v.select("term", "idf")) if config.max_features <= 100_000 else v, "term").withColumn("raw", raw * F.col("idf"))
    norms = w.groupBy("id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return w.join(norms, "id").select("id", "term", (F.col("raw") / F.col("norm")).alias("weight")), v


def phrase_frequencies(df: DataFrame, id_col: str, text_col: str, config: VectorConfig = VectorConfig(), top: int = 50) -> DataFrame:
    """(term, score): mean TF-IDF weighted by 1 + 0.3 (n - 1), the best scaled to 100, never below 1."""
    n = df.filter(F.col(text_col).isNotNull()).count()
    if n < 5:
        config = VectorConfig(config.min_ngram, config.max_ngram, config.max_features, 1, 1.0, config.sublinear, config.stopwords)
    w, _ = tfidf(df, id_col, text_col, config)
    words = F.size(F.split("term", " "))
    s = w.groupBy("term").agg((F.sum("weight") / n).alias("m")).withColumn("s", F.col("m") * (1 + 0.3 * (words - 1))).orderBy(F.desc(F.round("s", 9)), "term").limit(top)
    best = s.agg(F.max("s").alias("best"))
    return s.join(F.broadcast(best)).select("term", F.greatest(F.lit(1.0), F.round(100 * F.col("s") / F.col("best"), 6)).alias("score"))


def document_profile(df: DataFrame, text_col: str) -> DataFrame:
    """One row: documents, words a document (mean, population deviation, median and linear percentiles), distinct terms."""
    wc = word_count(F.col(text_col))
    p = F.percentile(wc, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9, 0.95)]))
    lengths = df.agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg(wc), 6).alias("mean_words"), F.round(F.stddev_pop(wc), 6).alias("std_words"), p.alias("_p"))
    lengths = lengths.select("n_docs", "mean_words", "std_words", *[F.col("_p")[i].alias(f"p{k}") for i, k in enumerate((25, 50, 75, 90, 95))])
    terms = df.select(F.explode(ascii_words(F.col(text_col), 1)).alias("t")).agg(F.countDistinct("t").alias("vocabulary"))
    return lengths.join(F.broadcast(terms))


def text_profile(df: DataFrame, text_col: str) -> DataFrame:
    """One row: mean words and sentences, type/token ratio, and the bands they fall into."""
    t = F.col(text_col)
    sentences = F.greatest(F.size(F.regexp_extract_all(t, F.lit(r"([.!?]+)"), F.lit(1))), F.lit(1))
    base = df.filter(t.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(word_count(t)), 6).alias("mean_words"), F.round(F.avg(sentences), 6).alias("mean_sentences"))
    words = df.select(F.explode(ascii_words(t, 1)).alias("w")).agg(F.round(F.coalesce(F.try_divide(F.countDistinct("w").cast("double"), F.count("w")), F.lit(0.0)), 6).alias("type_token_ratio"))
    return base.join(F.broadcast(words)).withColumns(
        {
            "size_band": F.when(F.col("n") < 50, "small").when(F.col("n") < 500, "medium").otherwise("large"),
            "length_band": F.when(F.col("mean_words") < 10, "short").when(F.col("mean_words") < 50, "medium").otherwise("long"),
            "diversity_band": F.when(F.col("type_token_ratio") < 0.3, "low").when(F.col("type_token_ratio") < 0.6, "medium").otherwise("high"),
        }
    )


def column_profile(df: DataFrame) -> DataFrame:
    """(column, n, nulls, distinct): one row a column; arrays count as one value each. One pass with partial aggregation."""
    aggs = [a for i, c in enumerate(df.columns) for a in (F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}"), F.countDistinct(F.col(f"`{c}`")).alias(f"d{i}"))]
    one = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n"), F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(df.columns)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def label_profile(df: DataFrame, label_col: str) -> DataFrame:
    """One row: rows, missing labels and their share, distinct labels, and the delimiter that more than a tenth of the labels hold."""
    label = F.col(label_col)
    missing = unknown_label_pattern(label)
    held = {d: F.count_if(~missing & F.contains(label, F.lit(d))) for d in (",", ";", "|")}
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("n_missing"), F.countDistinct(F.when(~missing, label)).alias("n_labels"), *[h.alias(f"_{i}") for i, h in enumerate(held.values())])
    present = F.col("n") - F.col("n_missing")
    best = F.greatest("_0", "_1", "_2")
    mark = F.when(best <= 0.1 * present, None).otherwise(F.coalesce(*[F.when(F.col(f"_{i}") == best, F.lit(d)) for i, d in enumerate(held)]))
    return row.select("n", "n_missing", F.round(F.coalesce(F.try_divide(F.col("n_missing").cast("double"), F.col("n")), F.lit(0.0)), 6).alias("missing_ratio"), "n_labels", mark.alias("delimiter"), mark.isNotNull().alias("multi_label"))


def adaptive_config(median_words: float, vocabulary_size: int, n_docs: int, small: int = 500, medium: int = 5000, long_form: float = 100, short_form: float = 30, **overrides) -> VectorConfig:
    """Vectorizer settings by rule from a dataset's profile: aggressive for long texts, minimal for short ones of few words."""
    from ..functions.wordlists import STOPWORDS

    c = {"min_df": 2, "max_df": 0.8, "sublinear": False, "max_features": 1000, "stopwords": STOPWORDS if median_words >= 10 else frozenset()}
    if median_words >= long_form:
        c |= {"min_df": 10 if n_docs > medium else 5 if n_docs > small else 3, "max_df": 0.85, "sublinear": True}
    elif median_words <= short_form and vocabulary_size < 500:
        c |= {"min_df": 1}
    if vocabulary_size > 10_000:
        c["max_features"] = min(2000, vocabulary_size // 2)
    elif vocabulary_size < 200:
        c["max_features"] = min(500, max(vocabulary_size, 1))
    return VectorConfig(**(c | overrides))


# Scores of the methods at the start, and what a dataset's size, length and diversity add to each.
METHOD_SCORES = {
    "start": {"tfidf_kmeans": 50, "lda": 40, "nmf": 45, "bert_kmeans": 30, "lstm_kmeans": 25, "svm": 20},
    "fewer than 100 texts": {"tfidf_kmeans": 20, "nmf": 18, "svm": 15, "bert_kmeans": 10, "lda": -10, "lstm_kmeans": -15},
    "fewer than 500 texts": {"tfidf_kmeans": 15, "nmf": 12, "lda": 10, "bert_kmeans": 10},
    "500 texts or more": {"lda": 25, "nmf": 15, "tfidf_kmeans": 10, "bert_kmeans": 5, "lstm_kmeans": 10},
    "under 20 words": {"bert_kmeans": 20, "tfidf_kmeans": 15, "nmf": 12, "lda": -5},
    "under 100 words": {"tfidf_kmeans": 10, "nmf": 10, "lda": 10},
    "100 words or more": {"lda": 20, "nmf": 10, "tfidf_kmeans": 5, "lstm_kmeans": 10},
    "varied words": {"lda": 15, "nmf": 12, "bert_kmeans": 10},
    "few words": {"tfidf_kmeans": 15, "nmf": 10, "svm": 10},
    "more than 1000 texts": {"bert_kmeans": -15, "lstm_kmeans": -10},
}


def method_scores(n: int, mean_words: float, diversity: float) -> tuple[dict[str, int], list[str]]:
    """(score of each of six methods, the traits that counted) of a dataset: its texts, mean words and share of different words."""
    size = "fewer than 100 texts" if n < 100 else "fewer than 500 texts" if n < 500 else "500 texts or more"
    length = "under 20 words" if mean_words < 20 else "under 100 words" if mean_words < 100 else "100 words or more"
    traits = [size, length, *(["varied words"] if diversity > 0.6 else ["few words"] if diversity < 0.3 else []), *(["more than 1000 texts"] if n > 1000 else [])]
    start = METHOD_SCORES["start"]
    return {m: s + sum(METHOD_SCORES[t].get(m, 0) for t in traits) for m, s in start.items()}, traits


def choose_method(n: int, mean_words: float, diversity: float) -> str:
    """The method of the highest score; the first of the list wins ties."""
    score, _ = method_scores(n, mean_words, diversity)
    return max(score, key=lambda m: score[m])


def parity(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: terms of two vocabularies, shared and not, and whether they are the same."""
    a, b = first.select("term").distinct().withColumn("x", F.lit(1)), second.select("term").distinct().withColumn("y", F.lit(1))
    j = a.join(b, "term", "full")
    return j.agg(F.count("x").alias("n_first"), F.count("y").alias("n_second"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n_shared")).withColumn("same", (F.col("n_first") == F.col("n_shared")) & (F.col("n_second") == F.col("n_shared")))


def stopword_candidates(df: DataFrame, id_col: str, text_col: str, min_ratio: float = 0.7, limit: int = 100, general: frozenset[str] = frozenset(), keep: frozenset[str] = frozenset(), min_length: int = 2) -> DataFrame:
    """Terms in at least min_ratio of the texts that are no general stop words: df, tf, ratio, mean length of their texts, advice.

    tfidf_variance is the population variance of idf x tf / length over the texts that are not empty, zeros included.
    """
    words = ascii_words(F.col(text_col), min_length)
    d = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), words.alias("w")).withColumn("len", F.size("w"))
    n = d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("len") > 0).alias("m"))
    tf = d.select("id", "len", F.explode("w").alias("term")).groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    x = F.col("tf") / F.col("len")
    t = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"), F.avg("len").alias("mean_length"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"))
    t = t.join(F.broadcast(n)).withColumn("ratio", F.col("df") / F.col("n")).filter((F.col("ratio") >= min_ratio) & ~F.col("term").isin(*sorted(general) or [""]))
    idf = F.log(F.col("n") / (F.col("df") + 1.0)) + 1.0
    variance = idf * idf * (F.col("s2") / F.col("m") - (F.col("s1") / F.col("m")) ** 2)
    kept = F.col("term").isin(*sorted(keep) or [""])
    reason = F.when(kept, "in the keep list").when(F.col("ratio") >= 0.9, "in nearly all texts").when(F.col("ratio") >= 0.8, "in most texts").otherwise("in many texts")
    out = t.select("term", "df", "total", F.round("ratio", 6).alias("ratio"), F.round("mean_length", 6).alias("mean_length"), F.round(variance, 9).alias("tfidf_variance"), (~kept).alias("recommended"), reason.alias("reason"))
    return out.orderBy(F.desc("df"), F.desc("total"), "term").limit(limit)


def cluster_coverage(candidates: DataFrame, terms_by_cluster: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Candidates with the share of clusters that hold them; below the threshold they are not recommended."""
    n = terms_by_cluster.agg(F.countDistinct("cluster").alias("n"))
    c = terms_by_cluster.groupBy("term").agg(F.countDistinct("cluster").alias("k")).join(F.broadcast(n)).select("term", (F.col("k") / F.col("n")).alias("coverage"))
    j = candidates.join(c, "term", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    return j.withColumn("recommended", F.col("recommended") & (F.col("coverage") >= threshold)).orderBy(F.desc(F.col("df") * F.col("coverage")), "term")


def layered_stopwords(general: frozenset[str], domain: frozenset[str] = frozenset(), custom: frozenset[str] = frozenset(), keep: frozenset[str] = frozenset()) -> tuple[frozenset[str], dict[str, int]]:
    """(general + domain + custom) - keep, with the number of words of each layer."""
    words = (general | domain | custom) - keep
    return words, {"general": len(general), "domain": len(domain), "custom": len(custom), "kept": len(keep), "total": len(words)}


def word_cloud(df: DataFrame, text_col: str, stopwords: frozenset[str] = frozenset(), top: int = 100) -> DataFrame:
    """(term, count) of the most frequent words without stop words."""
    t = df.select(F.explode(ascii_words(F.col(text_col))).alias("term"))
    if stopwords:
        t = t.filter(~F.col("term").isin(*sorted(stopwords)))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "term").limit(top)


def single_label(df: DataFrame, label_col: str, delimiter: str = ",") -> DataFrame:
    label = F.col(label_col)
    return df.filter(label.isNotNull() & label.rlike(r"\S") & ~F.contains(label, F.lit(delimiter)))


def label_overlap(df: DataFrame, cluster_col: str, label_col: str, delimiter: str | None = None) -> DataFrame:
    """(cluster, label, n): how often each label of the answers of a cluster occurs."""
    return df.select(F.col(cluster_col).alias("cluster"), F.explode(split_labels(F.col(label_col), delimiter)).alias("label")).groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))


def word2vec(df: DataFrame, tokens_col: str, size: int = 100, min_count: int = 2, seed: int = 42):
    """A fitted Word2Vec model; with too few words in common it is fitted again on all words."""
    from pyspark.ml.feature import Word2Vec

    def fit(least: int):
        return Word2Vec(vectorSize=size, minCount=least, seed=seed, inputCol=tokens_col, outputCol="embedding").fit(df)

    try:
        return fit(min_count)
    except Exception:  # noqa: BLE001 - MLlib raises for an empty vocabulary
        return fit(1)
