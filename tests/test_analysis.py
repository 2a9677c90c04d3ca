import math

import pytest

from openweave.operators import diagnostics, displays, evaluate, features, interpret, ml, reports, results
from openweave.plans.pipelines import open_coding
from openweave.sources import readers, writers
from openweave.streaming import events as stream
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def coded(spark):
    data = [(1, "a", ["A", "B"], [0.9, 0.4], 2), (1, "a", ["A", "B"], [0.9, 0.4], 2), (2, "b", ["A"], [0.6], 1), (3, None, [], [], 0), (4, "d", ["A", "B", "C"], [0.35, 0.45, 0.2], 3)]
    return results.first_delivery(spark.createDataFrame(data, "id long, text string, assigned_codes array<string>, confidence_scores array<double>, num_codes int"), "id", ["num_codes"]).cache()


def test_results(spark, coded):
    codes = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "code string")
    m = results.metrics_summary(coded, codes, "code").first()
    assert (m.n_responses, m.n_assignments, m.n_uncoded, m.n_codes, m.n_active, m.coverage) == (4, 6, 1, 4, 3, 75.0)
    assert [r.id for r in results.low_confidence(coded).orderBy("id").collect()] == [1, 4] and [r.id for r in results.boundary_cases(coded, "id").collect()] == [4]
    assert {r.code: r.avg_confidence for r in results.code_statistics(results.assignments(coded, "id", "text")).collect()}["A"] == round((0.9 + 0.6 + 0.35) / 3, 6)
    empty = results.metrics_summary(coded.limit(0), codes, "code").first()
    assert (empty.n_responses, empty.coverage, empty.mean_confidence) == (0, 0.0, None)
    seg = results.segmentation(coded.withColumn("s", F.when(F.col("id") < 3, "x")), "s", codes, "code").collect()
    assert len(seg) == 8 and {(r.segment, r.code): r["count"] for r in seg}[(None, "A")] == 1


def test_diagnostics(spark, coded):
    codes = spark.createDataFrame([("A", 3), ("B", 2), ("C", 1), ("D", 0)], "code_id string, count long")
    g = diagnostics.imbalance(codes).first()
    assert g.ratio == 3.0 and g.gini == round(2 * (1 * 0 + 2 * 1 + 3 * 2 + 4 * 3) / (4 * 6) - 5 / 4, 6)
    assert diagnostics.health(coded, codes).first().status in ("good", "fair", "poor")
    assert diagnostics.stability(coded).first().stability is None
    t = spark.createDataFrame([("m", True)] * 10 + [("m", False)] * 20 + [("f", True)] * 30 + [("f", False)] * 40, "g string, f boolean")
    c = diagnostics.chi_square(t, "g", "f").first()
    assert c.dof == 1 and abs(c.statistic - 0.446429) < 1e-5
    assert abs(diagnostics.chi_square_p(3.841459, 1) - 0.05) < 1e-5 and abs(diagnostics.chi_square_p(0.5, 4) - 0.973501) < 1e-5
    k = spark.createDataFrame([("a", "a"), ("b", "b"), ("a", "b"), ("b", "b")], "x string, y string")
    assert diagnostics.kappa(k, "x", "y").first().kappa == 0.5


def test_agreement_of_perfect_and_mixed_clusters(spark):
    perfect = spark.createDataFrame([(i % 3, f"L{i % 3}") for i in range(30)], "cluster int, label string")
    a = evaluate.agreement(evaluate.contingency(perfect, "cluster", "label")).first()
    assert a.ari == a.nmi == a.purity == a.v_measure == 1.0
    mixed = spark.createDataFrame([(i % 3, f"L{i % 2}") for i in range(60)] + [(0, "unknown"), (None, "L1")], "cluster int, label string")
    b = evaluate.agreement(evaluate.contingency(mixed, "cluster", "label")).first()
    assert b.ari < 0.1 and b.n == 60


def test_coherence_equals_mean_of_pairs(spark):
    import random

    rng = random.Random(1)
    v = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(9)]
    d = spark.createDataFrame([(i, x, 0) for i, x in enumerate(v)] + [(99, [0.0] * 5, 0)], "id int, v array<double>, c int")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    pairs = [cos(v[i], v[j]) for i in range(9) for j in range(i)]
    assert abs(evaluate.coherence(d, "v", "c", 5).first().coherence - sum(pairs) / len(pairs)) < 1e-6
    with pytest.raises(ValueError):
        evaluate.silhouette(d, "id", "v", "c", limit=3)


def test_tfidf_rows_have_unit_length(spark):
    d = spark.createDataFrame([(1, "red apple red"), (2, "green apple"), (3, "red car car"), (4, ""), (5, None)], "id int, t string")
    w, v = features.tfidf(d, "id", "t", features.VectorConfig(max_ngram=2, min_df=1, max_df=1.0))
    assert all(abs(r[1] - 1) < 1e-9 for r in w.groupBy("id").agg(F.sum(F.col("weight") ** 2)).collect())
    assert {r.term for r in v.collect()} >= {"red", "red apple", "car car"}


def test_adaptive_rules():
    assert features.adaptive_config(150, 800, 100).min_df == 3 and features.adaptive_config(10, 300, 100).min_df == 1 and features.adaptive_config(50, 20000, 100).max_features == 2000
    assert features.adaptive_config(5, 100, 10).stopwords == frozenset() and features.adaptive_config(50, 500, 10, min_df=7).min_df == 7


@pytest.fixture(scope="module")
def topics(spark):
    base = ["the parcel delivery was late and the courier lost the parcel", "good price and a fair discount on the price", "the battery and the charger failed, battery empty"]
    return spark.createDataFrame([(i, base[i % 3]) for i in range(60)] + [(60, None), (61, " ")], "id long, text string")


@pytest.mark.parametrize("method", ["kmeans", "nmf", "lda", "bisecting", "spectral"])
def test_models_find_three_topics(spark, topics, method):
    m, v = ml.vectorize(topics, "id", "text", features.VectorConfig(max_ngram=1, min_df=2, max_df=1.0, stopwords=frozenset(("the", "and", "was", "on"))), counts=method == "lda")
    f = ml.fit(m, v, method, 3, iterations=15)
    a = ml.assign(f.doc_topics, 0.3)
    assert a.count() == 60 and f.topics.count() == 3
    if method in ("kmeans", "nmf"):
        groups = a.withColumn("g", F.col("id") % 3).groupBy("g").agg(F.countDistinct("assigned_codes").alias("n")).collect()
        assert all(r.n == 1 for r in groups)
    assert all(1 >= c >= 0.3 for r in a.collect() for c in r.confidence_scores)


def test_the_twelve_outputs_make_the_round_trip(spark, tmp_path):
    from openweave.plans.pipelines import outputs
    from openweave.sources import readers, writers

    rows = [(1, "good price", ["A", "B"], [0.9, 0.4], 2), (2, "bad price", ["A"], [0.8], 1), (3, None, [], [], 0)]
    coded = spark.createDataFrame(rows, "id long, text string, assigned_codes array<string>, confidence_scores array<double>, num_codes int")
    book = spark.createDataFrame([("A", "Price"), ("B", "Good"), ("C", "Never")], "code string, label string")
    tables = outputs(coded, book)
    assert len(tables) == 12
    for name, path in writers.export_all(tables, str(tmp_path)).items():
        assert readers.read_csv(spark, path).count() == tables[name].count(), name
    import io
    import zipfile

    assert len(zipfile.ZipFile(io.BytesIO(writers.csv_package(tables))).namelist()) == 12
    with pytest.raises(ValueError):
        writers.csv_package({"x": coded}, rows=2)
    assert '"json' not in writers.download_link(coded, "f", "l", form="json") and "application/json" in writers.download_link(coded, "f", "l", form="json")
    path = writers.write_text(spark, reports.methods({"k": 3, "seed": 4}, {"rows": 3}, {"silhouette": 0.3}, ["read", "code"]), f"file://{tmp_path}/methods.md")
    assert "## Reproduction" in open(path.removeprefix("file://")).read()
    assert reports.parameter_log([("fit", {"k": 3})]) == '{"order": 1, "parameters": {"k": 3}, "step": "fit"}'


def test_scores_of_methods_and_traits():
    assert features.choose_method(80, 15, 0.5) == "tfidf_kmeans" and features.choose_method(80, 15, 0.7) == "nmf" and features.choose_method(2000, 120, 0.7) == "lda"
    scores, traits = features.method_scores(300, 50, 0.5)
    assert scores == {"tfidf_kmeans": 75, "lda": 60, "nmf": 67, "bert_kmeans": 40, "lstm_kmeans": 25, "svm": 20} and len(traits) == 2


def test_scores_of_a_clustering_equal_their_definition(spark):
    points = {0: [(0.0, 0.0), (0.0, 1.0)], 1: [(4.0, 0.0), (4.0, 1.0), (4.0, 2.0)]}
    rows = [(i, p, c) for i, (c, p) in enumerate((c, p) for c, ps in points.items() for p in ps)]
    d = spark.createDataFrame([(i, list(p), [float(c == 0), float(c == 1)]) for i, p, c in rows], "id long, v array<double>, weights array<double>")
    got = ml.scores(ml.dense(d, "id", "v"), ml.Fitted("kmeans", 2, None, d.select("id", "weights"), []))
    s0, s1, apart = 0.5, 2 / 3, math.hypot(4, 0.5)
    within = 0.5 + 2.0
    between = 2 * (2.4**2 + 0.3**2) + 3 * (1.6**2 + 0.2**2)
    assert abs(got["davies_bouldin"] - (s0 + s1) / apart) < 1e-9 and abs(got["calinski_harabasz"] - between * 3 / within) < 1e-9 and 0 < got["combined"] <= 1
    assert ml.importance([{"k": 1, "combined": 0.1}, {"k": 2, "combined": 0.9}]) == {"k": 1.0}


def test_chi_square_of_wide_tables(spark):
    wide = spark.createDataFrame([(str(i % 3), str(i)) for i in range(3600)], "g string, f string")
    r = diagnostics.chi_square(wide, "g", "f").first()
    assert r.dof == 2 * 3599 and abs(r.statistic - 7200) < 1e-6


def test_open_coding_end_to_end(spark, topics):
    out = open_coding(topics, "id", "text", method="kmeans", k=3)
    assert out["results"].count() == 60 and out["codebook"].count() == 3 and len(out["summaries"]) == 3
    assert out["metrics"].first().coverage == 100.0
    with pytest.raises(ValueError):
        open_coding(topics.limit(0), "id", "text", method="kmeans", k=3)


def test_interpretation():
    terms = [("late parcel", 0.5), ("parcel", 0.4), ("courier", 0.3)]
    assert interpret.without_subsets(terms) == [("late parcel", 0.5), ("courier", 0.3)]
    assert interpret.phrase_label(terms) == "Late Parcel Courier" and interpret.phrase_label([]) == "" and interpret.word_label([]) == "Unlabeled"
    assert interpret.parse_answer('```json\n{"label": "X", "description": "d"}\n```')["label"] == "X" and interpret.parse_answer("Label: Y\nDescription: z") == {"label": "Y", "description": "z", "alternatives": []}
    assert interpret.is_vague("General topic") and not interpret.is_vague("Late parcels")
    assert reports.audit("This proves it")[0][0] == "proves"


def test_sentiment(spark):
    d = spark.createDataFrame([(1, "I love it, great"), (2, "not good"), (3, None), (4, "table")], "id int, t string")
    assert {r.id: r.sentiment_label for r in interpret.analyze_sentiment(d, "t").collect()} == {1: "positive", 2: "negative", 3: "neutral", 4: "neutral"}


def test_sources_and_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a "q", b\nc', ["x", "y"]), (2, None, [])], "id long, text string, l array<string>")
    writers.write_csv(d, str(tmp_path / "c"))
    back = readers.read_csv(spark, str(tmp_path / "c"), "id long, text string, l string")
    assert sorted((r.id, r.text, r.l) for r in back.collect())[0] == (1, 'a "q", b\nc', "x, y")
    writers.write_json(d, str(tmp_path / "j"))
    assert readers.read_json(spark, str(tmp_path / "j"), lines=True).count() == 2
    (tmp_path / "w.txt").write_text("# c\n\n The \nand\nthe\n")
    assert {r.word for r in readers.read_word_list(spark, str(tmp_path / "w.txt")).collect()} == {"the", "and"}
    assert writers.write_words(spark.createDataFrame([("b",), ("a",)], "word string"), str(tmp_path / "o"), "words") == 2
    assert readers.validate(d, ["id", "nope"])[0] is False and readers.validate(d, ["id"], 5)[0] is False and readers.validate(d, ["id"]) == (True, "Valid")
    with pytest.raises(ValueError):
        readers.require_columns(d, ["nope"])
    with pytest.raises(ValueError):
        writers.download_link(d, "f", "l", rows=1)
    assert set(writers.export_all({"a": d, "b": d}, str(tmp_path / "all"), "parquet")) == {"a", "b"}


def test_reports(spark, coded):
    codes = spark.createDataFrame([("A",), ("B",)], "code string")
    f = spark.createDataFrame([("A", 3, 75.0, 1), ("B", 2, 50.0, 2)], "code_id string, count long, percentage double, rank long")
    s = results.metrics_summary(coded, codes, "code")
    assert "Dominant theme: A" in reports.executive_summary(s, f) and reports.insights(s, f) and "| A |" in reports.table(f)
    assert reports.recommendations(diagnostics.health(coded, f.select("code_id", "count"))) and "# Methods" in reports.methods({"k": 3}, {"rows": 4})


def test_streams(spark, tmp_path):
    d = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 2.0), (3, "2024-01-01 01:10:00", "b", 3.0), (4, None, "b", 4.0)], "id long, ts string, k string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    d.write.parquet(str(tmp_path / "events.parquet"))
    s = stream.run_available(stream.tumbling(stream.read_stream(spark, str(tmp_path), "events"), "ts", "k", "v"), "complete")
    assert sorted((str(r.window_start), r.k, r.n, r.total) for r in s.collect()) == [("2024-01-01 00:00:00", "a", 2, 3.0), ("2024-01-01 01:00:00", "b", 1, 3.0)]


def test_skewed_lookup_keeps_every_row(spark):
    from openweave.skew import lookup_skewed, small

    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert lookup_skewed(rows, table, ["k"], "n", 4000).count() == 4000
    assert small(rows, 10) is rows


def test_displays_and_codebook_forms(spark, topics):
    m, v = ml.vectorize(topics, "id", "text", features.VectorConfig(max_ngram=1, min_df=2, max_df=1.0, stopwords=frozenset(("the", "and"))))
    f = ml.fit(m, v, "kmeans", 3)
    grid = displays.topic_terms(f, 3).collect()
    assert max(r.weight for r in grid) == 1.0 and len(grid) % 3 == 0
    assert displays.topic_distribution(f, 5).count() == 15 and displays.availability(spark).filter("available").count() > 5
    book = reports.codebook_dict(ml.codebook(f, ml.assign(f.doc_topics)))
    assert len(book) == 3 and "## CODE_01" in reports.codebook_markdown(book) and reports.codebook_csv(book).count("\n") == 4
    c = features.stopword_candidates(topics, "id", "text", 0.3, keep=frozenset(("the",)))
    assert "the" in reports.stopword_report(c) and '"recommended"' in reports.stopword_report(c, "json")
    assert displays.compare_representations({"tfidf": m}, 3)[0]["rows"] == 60
