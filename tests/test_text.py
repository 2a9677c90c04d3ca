import pytest

from openweave.functions.text import STEPS, clean_twitter, list_text, normalize_text, split_labels, truncate
from openweave.operators import cleaning, quality
from pyspark.sql import functions as F

DEFAULT = frozenset(STEPS) - {"slang"}


@pytest.mark.parametrize(
    "raw, out",
    [
        ("I loooove this!!!", "I loove this!"), ("It's  AMAZING", "It is AMAZING"), ("see https://a.b/c now", "see <URL> now"), ("hi @bob #fun", "hi <USER> fun"), ("ﬁne &amp; good", "fine & good"),
        ("can't stop", "cannot stop"), ("Can't stop", "Cannot stop"), ("?!?!", "?!?!"), ("end.Next", "<URL>"),
    ],
)
def test_normalizer_steps(raw, out):
    assert normalize_text(raw, DEFAULT)[0] == out


def test_slang_only_on_request():
    assert normalize_text("lol ok", DEFAULT)[0] == "lol ok"
    assert normalize_text("lol ok", frozenset(STEPS))[0] == "laughing out loud ok"


def test_reject_reasons_in_order(spark):
    d = spark.createDataFrame([(1, None), (2, "   "), (3, "one two"), (4, "buy now this thing"), (5, "a fine text here"), (6, "a  fine text here"), (7, "😀😀😀 😀😀😀 😀😀😀"), (8, "w " * 600)], "id long, text string")
    got = {r.id: r.reject_reason for r in cleaning.process(d, "text", "id").collect()}
    assert got == {1: "empty_or_invalid", 2: "empty_after_strip", 3: "below_min_tokens", 4: "spam_detected", 5: None, 6: "duplicate", 7: "emoji_spam", 8: "above_max_tokens"}
    report = cleaning.quality_report(cleaning.process(d, "text", "id")).first()
    assert report.total == 8 and report.valid == 1 and report.rejects["duplicate"] == 1
    assert cleaning.cleaned(d, "text", "id").count() == 1
    assert cleaning.cleaned(d.limit(0), "text", "id").count() == 0


@pytest.mark.parametrize("raw, out", [("I can't do the cats", "can not the cat"), ("The open-ended boxes are not no fun", "the openended box not fun"), ("CANNOT wait", "can not wait"), ("", "")])
def test_preprocess(spark, raw, out):
    norm = normalize_text(raw, DEFAULT)[0]
    d = spark.createDataFrame([(norm,)], "t string").select(cleaning.preprocess(F.col("t"), stopwords=frozenset(("i", "do", "are"))).alias("x"))
    assert d.first().x == out


def test_sentences_paragraphs_and_context(spark):
    d = spark.createDataFrame([("R", "One. Two!  Three?\n\nFour| five"), ("E", ""), ("N", None)], "id string, text string")
    s = cleaning.segment(d, "id", "text")
    assert [(r.segment_id, r.text) for r in s.orderBy("position").collect()] == [("R-S0", "One."), ("R-S1", "Two!"), ("R-S2", "Three?"), ("R-S3", "Four|"), ("R-S4", "five")]
    c = {r.segment_id: (r.context_before, r.context_after) for r in cleaning.with_context(s).collect()}
    assert c["R-S0"] == (None, "Two!") and c["R-S4"] == ("Four|", None)
    h = cleaning.segment_hierarchical(d, "id", "text").collect()
    assert {r.segment_id for r in h} >= {"R", "R-P0", "R-P1", "R-P0-S0", "R-P1-S0"}
    assert [r.position for r in sorted((r for r in h if r.segment_type == "sentence"), key=lambda r: r.position)] == [0, 1, 2, 3, 4]


def test_long_documents(spark):
    d = spark.createDataFrame([("a b c d e",), ("",)], "t string")
    parts = [r[0] for r in d.select(cleaning.long_document(F.col("t"), "chunk", 3, 1)).collect()]
    assert parts == [["a b c", "c d e", "e"], [""]]
    assert d.select(cleaning.long_document(F.col("t"), "truncate", 2)).first()[0] == ["a b"]
    with pytest.raises(ValueError):
        cleaning.long_document(F.col("t"), "chunk", 3, 3)


def test_domain_terms_survive(spark):
    d = spark.createDataFrame([("C++ is 3x Better, re-use it!",)], "t string").select(cleaning.clean_domain(F.col("t"), ["c++"]))
    assert d.first()[0] == "c++ is x better reuse it"


def test_quality(spark):
    texts = [None, "  ", "n/a", "good", "aaaa", "This is a thoughtful answer about the work we do.", "ok ok ok ok ok ok ok ok ok ok", "zzz qqq xxx vvv bbb"]
    d = quality.assess_quality(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t")
    got = {r.id: (r.quality_recommendation, r.quality_flags, r.quality_confidence) for r in d.collect()}
    assert got[0] == got[1] == ("exclude", ["empty_response"], 1.0)
    assert got[2][0] == "exclude" and "non_analytic_pattern" in got[2][1] and "non_analytic_pattern" in got[4][1]
    assert got[5] == ("include", [], 1.0) and "high_repetition" in got[6][1] and got[7] == ("review", ["low_english_ratio"], 0.8)
    s = quality.summary(d).first()
    assert s.total == 8 and s.n_include == 1


def test_small_functions(spark):
    d = spark.createDataFrame([("@Bob see https://x.y/z soooooo", ["a", "b", "c"], "x, y,,n/a")], "t string, l array<string>, s string")
    r = d.select(clean_twitter(F.col("t")), truncate(F.col("t"), 10), list_text(F.col("l"), 2), split_labels(F.col("s"))).first()
    assert r[0] == "@user see http sooo" and r[1] == "@Bob se..." and r[2] == "a, b +1 more" and r[3] == ["x", "y", "n/a"]


def test_sample_is_exact_and_stable(spark, rows):
    d = spark.range(1000)
    assert rows(cleaning.sample(d.repartition(7), "id", 50)) == rows(cleaning.sample(d.coalesce(1), "id", 50))
    assert cleaning.sample(d, "id", 50).count() == 50


def test_keep_first(spark):
    d = spark.createDataFrame([(2, "same text"), (1, "same text"), (3, "abc"), (4, None)], "id long, t string")
    assert [r.id for r in cleaning.filter_responses(d, "t", "id", remove_duplicates=True).collect()] == [1]
