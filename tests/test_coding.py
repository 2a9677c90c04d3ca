import pytest

from openweave.operators import coding
from openweave.operators.coding import Category, CodeFrame, Theme

FRAME = CodeFrame().with_code("POS", "Positive", ["good", "great"]).with_code("NEG", "Negative", ["bad"]).with_code("ART", "Art", ["art"], parent="POS")


@pytest.fixture(scope="module")
def coded(spark):
    d = spark.createDataFrame([(1, "Good start", "x"), (2, "bad", "y"), (3, None, "z"), (4, "", "w"), (5, "great BAD", "v")], "id long, text string, codes_ string")
    return coding.apply_codes(d, FRAME, "text").cache()


def test_codes_by_substring_in_frame_order(coded):
    got = {r.id: r.codes for r in coded.collect()}
    assert got == {1: ["POS", "ART"], 2: ["NEG"], 3: [], 4: [], 5: ["POS", "NEG"]}


def test_frame_updates_keep_place():
    f = FRAME.with_code("POS", "Changed", ["fine"])
    assert [c.code_id for c in f.codes] == ["POS", "NEG", "ART"] and f.codes[0].label == "Changed"
    assert [c.code_id for c in f.without("NEG").codes] == ["POS", "ART"]


@pytest.mark.parametrize("case", [False, True])
def test_a_large_frame_gives_the_same_codes(spark, coded, monkeypatch, case):
    odd = spark.createDataFrame([(1, "Good ART", "x"), (1, None, "y"), (2, "", "z"), (2, "goodbad goodness", "k")], "id long, text string, k string").unionByName(coded.select("id", "text"), allowMissingColumns=True)
    wide = FRAME.with_code("ALL", "All", [""]).with_code("ODD", "Odd", ["good", "goodness", "dness"])
    want = coding.apply_codes(odd, wide, "text", case_sensitive=case).select("id", "text", "k", "codes")
    monkeypatch.setattr(coding, "COMPILED_KEYWORDS", 0)
    got = coding.apply_codes(odd, wide, "text", case_sensitive=case).select("id", "text", "k", "codes")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_ancestors_of_a_deep_frame(spark):
    chain = spark.createDataFrame([(f"C{i:02d}", f"C{i + 1:02d}") for i in range(20)], "code_id string, parent string")
    got = coding.ancestors(chain)
    assert got.count() == 210 and got.agg({"distance": "max"}).first()[0] == 20


def test_frequency_keeps_zeros_and_ties(spark, coded):
    t = FRAME.with_code("NONE", "None", ["zzz"]).table(spark)
    got = {r.code_id: (r["count"], r.percentage, r["rank"]) for r in coding.frequency_table(coded, t, "code_id", "codes").collect()}
    assert got["NONE"] == (0, 0.0, 4) and got["POS"] == (2, 40.0, 1) and got["NEG"] == (2, 40.0, 1)


def test_counts_sum_to_assignments_and_diagonal_is_frequency(spark, coded):
    t = FRAME.table(spark)
    m = {(r.a, r.b): r["count"] for r in coding.cooccurrence_matrix(coded, t, "code_id", "codes").collect()}
    f = {r.code_id: r["count"] for r in coding.membership_counts(coded, t, "code_id", "codes").collect()}
    assert all(m[k, k] == v for k, v in f.items()) and all(m[a, b] == m[b, a] for a, b in m)
    assert sum(f.values()) == sum(len(r.codes) for r in coded.collect())


def test_themes_categories_and_cross_table(spark, coded):
    d = coding.identify_themes(coded, [Theme("T", "T", ("POS",)), Theme("U", "U", ("NEG",))])
    assert {r.id: r.themes for r in d.collect()}[5] == ["T", "U"]
    cats = [Category("ALL", "all", codes_all=()), Category("ANY", "any", codes_any=()), Category("TWO", "two", min_codes=2), Category("FREE", "free"), Category("BOTH", "both", themes_all=("T", "U"))]
    c = coding.categorize(d, cats)
    got = {r.id: r.categories for r in c.collect()}
    assert got[3] == ["ALL", "FREE"] and got[5] == ["ALL", "TWO", "FREE", "BOTH"]
    assert {(r.has_first, r.has_second): r["count"] for r in coding.cross_tabulation(c, "TWO", "BOTH").collect()} == {(True, True): 1, (True, False): 1, (False, False): 3}
    assert coding.categorize(coded, [Category("X", "x", themes_any=("T",))]).filter("size(categories) > 0").isEmpty()


def test_empty_tables(spark, coded):
    none = coded.limit(0)
    assert coding.coverage(none, "codes").first()[0] == 0.0 and coding.coverage(none, "missing").first()[0] == 0.0
    assert {r["count"] for r in coding.membership_counts(none, FRAME.table(spark), "code_id", "codes").collect()} == {0}
    assert coding.cooccurrence(none, "codes").count() == 0


def test_hierarchy_and_ancestors_stop_at_cycles(spark):
    f = FRAME.with_code("SUB", "Sub", ["q"], parent="ART").table(spark)
    assert {(r.code_id, r.ancestor, r.distance) for r in coding.ancestors(f).collect()} == {("ART", "POS", 1), ("SUB", "ART", 1), ("SUB", "POS", 2)}
    loop = spark.createDataFrame([("A", "B"), ("B", "A")], "code_id string, parent string")
    assert coding.ancestors(loop).count() > 0


def test_same_under_any_partitioning(spark, coded, rows):
    t = FRAME.table(spark)
    assert rows(coding.frequency_table(coded.repartition(7), t, "code_id", "codes")) == rows(coding.frequency_table(coded.coalesce(1), t, "code_id", "codes"))
