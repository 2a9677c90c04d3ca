"""The queries over the library's own operators, each over its whole tables, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import wordlists as L
from .functions.text import split_labels, unknown_label_pattern
from .operators import cleaning, coding, diagnostics, displays, evaluate, features, interpret, ml, quality, results
from .operators.coding import Category, CodeFrame, Theme
from .session import materialize, read_table
from .streaming import events as stream

THEMES = [Theme("VALUE", "Value", ("PRICE", "DELIVERY")), Theme("GOODS", "Goods", ("PRODUCT", "MATERIAL", "POWER", "TASTE", "PACK")), Theme("PEOPLE", "People", ("SERVICE", "TONE", "LEAD")), Theme("LIFE", "Life", ("WORKLIFE", "COMMUTE", "FAMILY", "ISOLATION", "HEALTH"))]
CATEGORIES = [Category("BROAD", "Broad", 1, min_codes=3), Category("COSTLY", "Costly goods", 2, codes_all=("PRICE", "PRODUCT")), Category("HUMAN", "Human", 2, themes_any=("PEOPLE", "LIFE"), max_codes=4), Category("NONE", "Nothing", 3, max_codes=0)]
DIMS = 64


def frame(spark: SparkSession, sf: str) -> CodeFrame:
    return CodeFrame.from_table(read_table(spark, sf, "code_frame"))


def market(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "market_research_survey_300")


def remote(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "remote_work_experiences_200")


def coded(spark: SparkSession, sf: str) -> DataFrame:
    return coding.apply_codes(market(spark, sf).select("id", "response", "respondent_id", "demographic_segment"), frame(spark, sf), "response")


def grouped(spark: SparkSession, sf: str) -> DataFrame:
    return coding.categorize(coding.identify_themes(coded(spark, sf), THEMES), CATEGORIES)


def members(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "code_frame").select("code_id")


def theme_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t.theme_id,) for t in THEMES], "theme_id string")


def ml_results(spark: SparkSession, sf: str) -> DataFrame:
    """Each response once: repeated deliveries are equal."""
    return results.first_delivery(read_table(spark, sf, "ml_results"), "response_id", ["num_codes"])


# --- keyword coding -------------------------------------------------------------------------------------------------------


def coding_apply(spark, sf):
    return coded(spark, sf).select("id", F.array_join("codes", ",").alias("codes"))


def coding_frequency(spark, sf):
    return coding.frequency_table(coded(spark, sf), members(spark, sf), "code_id", "codes")


def coding_frame_summary(spark, sf):
    return coding.frame_summary(coded(spark, sf), frame(spark, sf))


def coding_hierarchy(spark, sf):
    return coding.hierarchy(read_table(spark, sf, "code_frame")).select("parent", F.array_join("children", ",").alias("children"))


def coding_ancestors(spark, sf):
    return coding.ancestors(read_table(spark, sf, "code_frame")).select("code_id", "ancestor", F.col("distance").cast("long").alias("distance"))


def coding_themes(spark, sf):
    return grouped(spark, sf).select("id", F.array_join("themes", ",").alias("themes"))


def coding_theme_summary(spark, sf):
    return coding.membership_counts(grouped(spark, sf), theme_table(spark), "theme_id", "themes")


def coding_theme_matrix(spark, sf):
    return coding.cooccurrence_matrix(grouped(spark, sf), theme_table(spark), "theme_id", "themes")


def coding_theme_responses(spark, sf):
    return coding.members_of(grouped(spark, sf), "themes", "PEOPLE").select("id")


def coding_theme_coverage(spark, sf):
    return coding.coverage(grouped(spark, sf), "themes").select(F.round("coverage", 6).alias("coverage"))


def coding_categories(spark, sf):
    return grouped(spark, sf).select("id", F.array_join("categories", ",").alias("categories"))


def coding_category_summary(spark, sf):
    return coding.category_summary(grouped(spark, sf), CATEGORIES).select("category_id", "name", F.col("level").cast("long").alias("level"), "count")


def coding_category_level(spark, sf):
    return coding.category_summary(grouped(spark, sf), Category.at_level(CATEGORIES, 2)).select("category_id", "count")


def coding_cross_tab(spark, sf):
    return coding.cross_tabulation(grouped(spark, sf), "BROAD", "HUMAN")


def coding_cooccurrence(spark, sf):
    return coding.cooccurrence(coded(spark, sf), "codes", 2)


def coding_code_matrix(spark, sf):
    return coding.cooccurrence_matrix(coded(spark, sf), members(spark, sf), "code_id", "codes")


def coding_by_segment(spark, sf):
    d = coded(spark, sf).withColumn("segment", F.lower(F.trim("demographic_segment")))
    return results.segmentation(d, "segment", members(spark, sf), "code_id", "codes")


def coding_network_nodes(spark, sf):
    return coding.network(coded(spark, sf), "codes")[0]


def coding_tree(spark, sf):
    counts = coding.membership_counts(coded(spark, sf), members(spark, sf), "code_id", "codes")
    return coding.tree(read_table(spark, sf, "code_frame"), counts)


def coding_part_names(spark, sf):
    f = CodeFrame().with_code("RED", "Red", ["red"]).with_code("BLUE", "Blue", ["blue", "navy"]).with_code("GREEN", "Green", ["green", "lime"])
    d = coding.apply_codes(read_table(spark, sf, "part"), f, "p_name")
    return d.select("p_partkey", F.array_join("codes", ",").alias("codes"))


# --- coded results --------------------------------------------------------------------------------------------------------


def results_once(spark, sf):
    return ml_results(spark, sf).select("response_id", "num_codes", F.array_join("assigned_codes", ",").alias("codes"))


def results_frequency(spark, sf):
    return coding.frequency_table(ml_results(spark, sf), members(spark, sf), "code_id", "assigned_codes")


def results_cooccurrence(spark, sf):
    return coding.cooccurrence(ml_results(spark, sf), "assigned_codes", 2)


def results_overlap(spark, sf):
    return results.strong_overlap(coding.cooccurrence(ml_results(spark, sf), "assigned_codes", 2))


def results_binary(spark, sf):
    return results.binary_matrix(ml_results(spark, sf), "response_id", members(spark, sf), "code_id")


def results_metrics(spark, sf):
    return results.metrics_summary(ml_results(spark, sf), members(spark, sf), "code_id")


def results_quality(spark, sf):
    return results.quality_metrics(ml_results(spark, sf))


def results_descriptive(spark, sf):
    return results.descriptive(ml_results(spark, sf))


def results_qa(spark, sf):
    return results.qa_report(ml_results(spark, sf))


def results_uncoded(spark, sf):
    return results.uncoded(ml_results(spark, sf)).select("response_id")


def results_low_confidence(spark, sf):
    return results.low_confidence(ml_results(spark, sf)).select("response_id")


def results_ambiguous(spark, sf):
    return results.ambiguous(ml_results(spark, sf)).select("response_id")


def results_boundary(spark, sf):
    return results.boundary_cases(ml_results(spark, sf), "response_id")


def results_top_codes(spark, sf):
    return results.top_codes(ml_results(spark, sf), 10)


def _assigned(spark, sf):
    return results.assignments(ml_results(spark, sf), "response_id", "response_text")


def results_code_statistics(spark, sf):
    return results.code_statistics(_assigned(spark, sf))


def results_examples(spark, sf):
    return results.examples(_assigned(spark, sf), "response_id", "response_text")


def results_quotes(spark, sf):
    return results.quotes(_assigned(spark, sf), "response_id", "response_text")


def results_by_topic(spark, sf):
    d = ml_results(spark, sf).join(remote(spark, sf).select(F.col("id").alias("response_id"), "topic"), "response_id")
    return results.segmentation(d, "topic", members(spark, sf), "code_id")


# --- diagnostics ----------------------------------------------------------------------------------------------------------


def _codes(spark, sf):
    return coding.membership_counts(ml_results(spark, sf), members(spark, sf), "code_id", "assigned_codes")


def diagnostics_stability(spark, sf):
    return diagnostics.stability(ml_results(spark, sf))


def diagnostics_saturation(spark, sf):
    return diagnostics.saturation(ml_results(spark, sf), _codes(spark, sf))


def diagnostics_utilisation(spark, sf):
    return diagnostics.utilisation(_codes(spark, sf))


def diagnostics_confidence(spark, sf):
    return diagnostics.confidence_distribution(ml_results(spark, sf))


def diagnostics_histogram(spark, sf):
    return diagnostics.confidence_histogram(ml_results(spark, sf))


def diagnostics_ambiguity(spark, sf):
    return diagnostics.ambiguity(ml_results(spark, sf))


def diagnostics_imbalance(spark, sf):
    return diagnostics.imbalance(_codes(spark, sf))


def _with_people(spark, sf):
    r = remote(spark, sf).select(F.col("id").alias("response_id"), "respondent_id")
    return ml_results(spark, sf).join(r, "response_id").join(read_table(spark, sf, "respondents"), "respondent_id")


def diagnostics_groups(spark, sf):
    return diagnostics.group_statistics(_with_people(spark, sf), "department")


def diagnostics_chi_square(spark, sf):
    d = _with_people(spark, sf).select(F.lower(F.trim("gender")).alias("g"), (F.col("num_codes") > 0).alias("f"))
    return diagnostics.chi_square(d, "g", "f")


def diagnostics_position(spark, sf):
    return diagnostics.positional_bias(ml_results(spark, sf), "response_id")


def diagnostics_validity(spark, sf):
    return diagnostics.validity(ml_results(spark, sf), _codes(spark, sf))


def diagnostics_bias(spark, sf):
    return diagnostics.bias(_with_people(spark, sf).drop("response_text"), _codes(spark, sf), "response_id", "gender")


def diagnostics_health(spark, sf):
    return diagnostics.health(ml_results(spark, sf), _codes(spark, sf))


# --- text -----------------------------------------------------------------------------------------------------------------


def text_quality(spark, sf):
    d = quality.assess_quality(market(spark, sf).select("id", "response"), "response")
    return d.select("id", "quality_is_analytic", "quality_confidence", "quality_recommendation", F.array_join("quality_flags", ",").alias("quality_flags"))


def text_quality_summary(spark, sf):
    return quality.summary(quality.assess_quality(market(spark, sf).select("id", "response"), "response"))


def text_quality_flags(spark, sf):
    return quality.flag_statistics(quality.assess_quality(market(spark, sf).select("id", "response"), "response"))


def text_sentences(spark, sf):
    return cleaning.segment(read_table(spark, sf, "documents"), "doc_id", "text").select("segment_id", "text", "position", "original_text_length")


def text_paragraphs(spark, sf):
    return cleaning.segment(read_table(spark, sf, "documents"), "doc_id", "text", "paragraph").select("segment_id", "text", "position")


def text_context(spark, sf):
    d = cleaning.segment(remote(spark, sf), "id", "response")
    return cleaning.with_context(d).select("segment_id", "context_before", "context_after")


def text_hierarchy(spark, sf):
    d = cleaning.segment_hierarchical(read_table(spark, sf, "documents"), "doc_id", "text")
    return d.groupBy("segment_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.sum("position").cast("long").alias("positions"))


def text_filtered(spark, sf):
    return cleaning.filter_responses(remote(spark, sf), "response", "id", remove_duplicates=True, min_length=10).select("id")


def text_multilingual(spark, sf):
    from .functions.text import clean_multilingual

    return read_table(spark, sf, "documents").select("doc_id", F.md5(clean_multilingual(F.col("text"))).alias("clean"))


def text_normalized(spark, sf):
    return cleaning.process(market(spark, sf).select("id", "response"), "response", "id").select("id", "norm.*", "reject_reason")


def text_normalizer_report(spark, sf):
    d = cleaning.process(market(spark, sf).select("id", "response"), "response", "id")
    return cleaning.quality_report(d).withColumn("rejects", F.to_json("rejects"))


def text_cleaned(spark, sf):
    return cleaning.clean_table(read_table(spark, sf, "sample_texts").select("id", "input"), "input").select("id", "input_cleaned")


def text_chunks(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", F.posexplode(cleaning.long_document(F.col("text"), "chunk", 512, 50)).alias("chunk", "part"))
    return d.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("part").cast("long").alias("chars"))


def text_twitter(spark, sf):
    from .functions.text import clean_twitter

    return read_table(spark, sf, "sample_texts").select("id", clean_twitter(F.col("input")).alias("clean"))


def text_sentiment(spark, sf):
    return interpret.analyze_sentiment(market(spark, sf).select("id", "response"), "response").groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sentiment_score"), 6).alias("score"))


def text_sample(spark, sf):
    return cleaning.sample(remote(spark, sf).select("id"), "id", 150)


# --- features -------------------------------------------------------------------------------------------------------------


CONFIG = features.VectorConfig(max_ngram=1, max_features=500, min_df=2, max_df=0.8)


def features_vocabulary(spark, sf):
    d = read_table(spark, sf, "sample_texts")
    tf = features.term_frequencies(d, "id", "input", CONFIG)
    return features.vocabulary(tf, d.filter("input is not null").count(), CONFIG)


def features_tfidf(spark, sf):
    w, _ = features.tfidf(read_table(spark, sf, "sample_texts"), "id", "input", CONFIG)
    return w.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.round(F.sum("weight"), 4).alias("weight"))


def features_phrases(spark, sf):
    return features.phrase_frequencies(read_table(spark, sf, "sample_texts"), "id", "input", features.VectorConfig(max_ngram=3)).select("term", F.round("score", 4).alias("score"))


def features_profile(spark, sf):
    return features.document_profile(read_table(spark, sf, "documents"), "text")


def features_text_profile(spark, sf):
    return features.text_profile(remote(spark, sf), "response")


def features_labels(spark, sf):
    return features.label_profile(market(spark, sf), "demographic_segment")


def features_stopwords(spark, sf):
    return features.stopword_candidates(remote(spark, sf), "id", "response", min_ratio=0.2, limit=50, keep=frozenset(("not",)))


def features_word_cloud(spark, sf):
    return features.word_cloud(remote(spark, sf), "response", L.STOPWORDS, 50)


def features_method(spark, sf):
    """The score of every method for the remote survey."""
    p = features.text_profile(remote(spark, sf), "response").first()
    scores, _ = features.method_scores(p["n"], p["mean_words"], p["type_token_ratio"])
    return spark.createDataFrame(sorted(scores.items()), "method string, score long")


def features_label_stopwords(spark, sf):
    return interpret.label_stopwords(remote(spark, sf), "response", 0.1)


def features_columns(spark, sf):
    return features.column_profile(market(spark, sf).select("id", "response", "respondent_id", "submitted_at", "demographic_segment"))


def features_split_labels(spark, sf):
    d = read_table(spark, sf, "sample_texts").select(F.explode(split_labels(F.col("input"), ",")).alias("label"))
    return d.filter(~unknown_label_pattern(F.col("label"))).groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


# --- evaluation -----------------------------------------------------------------------------------------------------------


def _labelled(spark, sf):
    d = ml_results(spark, sf).join(remote(spark, sf).select(F.col("id").alias("response_id"), "topic"), "response_id")
    return d.select(F.get("assigned_codes", F.lit(0)).alias("cluster"), "topic")


def evaluate_agreement(spark, sf):
    return evaluate.agreement(evaluate.contingency(_labelled(spark, sf), "cluster", "topic"))


def evaluate_mapping(spark, sf):
    return evaluate.mapping(evaluate.contingency(_labelled(spark, sf), "cluster", "topic"))


def evaluate_label_coverage(spark, sf):
    return evaluate.label_coverage(evaluate.contingency(_labelled(spark, sf), "cluster", "topic"))


def evaluate_multi_label(spark, sf):
    d = ml_results(spark, sf).select(F.get("assigned_codes", F.lit(0)).alias("cluster"), F.array_join("assigned_codes", ",").alias("labels")).filter("cluster is not null")
    return evaluate.multi_label_purity(d, "cluster", "labels", ",")


def evaluate_indices(spark, sf):
    return evaluate.indices(read_table(spark, sf, "embeddings"), "vec_id", "embedding", "label", DIMS)


def evaluate_coherence(spark, sf):
    return evaluate.coherence(read_table(spark, sf, "embeddings"), "embedding", "label", DIMS)


def evaluate_network(spark, sf):
    return evaluate.cluster_network(read_table(spark, sf, "embeddings"), "embedding", "label", DIMS)


def evaluate_representative(spark, sf):
    return evaluate.representative(read_table(spark, sf, "embeddings"), "vec_id", "embedding", "label", DIMS)


def evaluate_silhouette(spark, sf):
    d = evaluate.silhouette(read_table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    return d.groupBy("cluster").agg(F.round(F.avg("silhouette"), 4).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def display_availability(spark, sf):
    return displays.availability(spark)


def display_cluster_terms(spark, sf):
    return displays.cluster_terms(remote(spark, sf), "response", "topic", 10, L.STOPWORDS)


# --- models (no SQL: tested by invariants) --------------------------------------------------------------------------------


def _model(spark, sf, method):
    m, v = ml.vectorize(read_table(spark, sf, "sample_texts"), "id", "input", features.VectorConfig(max_ngram=1, max_features=300, stopwords=L.STOPWORDS), counts=method == "lda")
    m = materialize(m, "features") if method != "spectral" else m
    fitted = ml.fit(m, v, method, 6)
    return ml.codebook(fitted, ml.assign(fitted.doc_topics)).select("code", "label", F.array_join("keywords", ",").alias("keywords"), "count", "avg_confidence")


def model_kmeans(spark, sf):
    return _model(spark, sf, "kmeans")


def model_lda(spark, sf):
    return _model(spark, sf, "lda")


def model_nmf(spark, sf):
    return _model(spark, sf, "nmf")


# --- streams --------------------------------------------------------------------------------------------------------------


def stream_tumbling(spark, sf):
    s = stream.tumbling(stream.read_stream(spark, sf, "events"), "ts", "event_type", "value", "6 hours")
    return stream.run_available(s, "complete").select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def stream_sliding(spark, sf):
    return stream.run_available(stream.sliding(stream.read_stream(spark, sf, "events"), "ts", "event_type", "12 hours", "6 hours"), "complete")


def stream_coded(spark, sf):
    s = stream.coded(stream.read_stream(spark, sf, "remote_work_experiences_200"), frame(spark, sf), "response")
    return stream.run_available(s.select("id", F.array_join("codes", ",").alias("codes")))


# --- extensions -----------------------------------------------------------------------------------------------------------


def _respondents(spark, sf):
    return market(spark, sf).select("respondent_id"), remote(spark, sf).select("respondent_id")


def extension_intersect(spark, sf):
    a, b = _respondents(spark, sf)
    return a.intersect(b)


def extension_except(spark, sf):
    a, b = _respondents(spark, sf)
    return a.exceptAll(b).groupBy("respondent_id").agg(F.count(F.lit(1)).alias("n"))


def extension_rollup(spark, sf):
    d = read_table(spark, sf, "events")
    return d.rollup("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def extension_cube(spark, sf):
    return read_table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


PREFIXES = ("coding_", "results_", "diagnostics_", "text_", "features_", "evaluate_", "display_", "model_", "stream_", "extension_")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith(PREFIXES) and callable(f)}
