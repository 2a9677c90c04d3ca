"""End-to-end plans: keyword coding, and unsupervised open coding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coding, features, interpret, ml, results
from ..operators.coding import Category, CodeFrame, Theme


def keyword_coding(df: DataFrame, frame: CodeFrame, text_col: str, themes: list[Theme] = (), categories: list[Category] = ()) -> DataFrame:
    """Codes, themes and categories in one projection; nothing is executed here."""
    d = coding.apply_codes(df, frame, text_col)
    d = coding.identify_themes(d, list(themes)) if themes else d
    return coding.categorize(d, list(categories)) if categories else d


def open_coding(df: DataFrame, id_col: str, text_col: str, method: str = "auto", k: int | None = None, min_confidence: float = 0.3, seed: int = 42, adaptive: bool = True) -> dict:
    """Unsupervised coding: profile, vectorize, fit, assign, codebook, interpretation, metrics.

    Returns results (id, text, assigned_codes, confidence_scores, num_codes), codebook, metrics and summaries. The size is checked
    after blank texts are left out.
    """
    texts = df.filter(F.col(text_col).isNotNull() & F.col(text_col).rlike(r"\S"))
    profile = features.document_profile(texts, text_col).first()
    n = profile["n_docs"]
    if n == 0 or (k or 1) > n:
        raise ValueError(f"{n} texts are too few for {k} codes")
    shape = features.text_profile(texts, text_col).first()
    if method == "auto":
        # the methods on embeddings need a precomputed column: their clustering runs on TF-IDF here
        method = {"lda": "lda", "nmf": "nmf", "svm": "spectral"}.get(features.choose_method(n, shape["mean_words"], shape["type_token_ratio"]), "kmeans")
    config = features.adaptive_config(profile["p50"], profile["vocabulary"], n) if adaptive else features.VectorConfig()
    matrix, vocabulary = ml.vectorize(texts, id_col, text_col, config, counts=method == "lda")
    matrix = matrix.cache()
    if k is None:
        k, _ = ml.find_k(matrix, vocabulary, method=method, seed=seed)
    fitted = ml.fit(matrix, vocabulary, method, k, seed)
    assigned = ml.assign(fitted.doc_topics, min_confidence)
    out = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(assigned, "id")
    book = ml.codebook(fitted, assigned)
    sizes = {int(r["code"][5:]) - 1: r["count"] for r in book.select("code", "count").collect()}
    # what the reader of a cluster needs besides its terms: its most typical texts, its mood, words that are everywhere
    typical: dict[int, list[str]] = {}
    for r in interpret.representatives(fitted.doc_topics, texts, id_col, text_col).orderBy("topic", "place").collect():
        typical.setdefault(r["topic"], []).append(r["text"])
    strongest = fitted.doc_topics.select("id", (F.array_position("weights", F.array_max("weights")) - 1).cast("int").alias("topic"))
    mood = interpret.analyze_sentiment(out.join(strongest, "id"), "text")
    moods = {r["cluster"]: r.asDict() for r in interpret.cluster_sentiment(mood, "topic").collect()}
    detected = frozenset(r["word"] for r in interpret.label_stopwords(texts, text_col).collect())
    summaries = interpret.interpret(fitted.topics, sizes, detected=detected, documents=typical, moods=moods)
    return {
        "results": out, "codebook": book, "metrics": results.metrics_summary(out, book, "code"), "summaries": summaries,
        "method": method, "k": k, "scores": ml.scores(matrix, fitted), "model": fitted,
    }


def outputs(coded: DataFrame, book: DataFrame, id_col: str = "id", text_col: str = "text") -> dict[str, DataFrame]:
    """The twelve tables of an analysis by name, for writers.export_all or csv_package.

    coded: (id, text, assigned_codes, confidence_scores, num_codes); book: the codebook with a column code.
    """
    members, flat = book.select("code"), results.assignments(coded, id_col, text_col)
    return {
        "code_assignments": coded, "codebook": book, "frequency_table": coding.frequency_table(coded, members, "code", "assigned_codes"), "quality_metrics": results.quality_metrics(coded),
        "binary_matrix": results.binary_matrix(coded, id_col, members, "code"), "representative_quotes": results.quotes(flat, id_col, text_col),
        "cooccurrence_matrix": coding.cooccurrence_matrix(coded, members, "code", "assigned_codes"), "cooccurrence_pairs": coding.cooccurrence(coded, "assigned_codes", 1),
        "descriptive_statistics": results.descriptive(coded), "qa_report": results.qa_report(coded), "uncoded_responses": results.uncoded(coded), "low_confidence_responses": results.low_confidence(coded),
    }
