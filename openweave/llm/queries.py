"""The queries p1_ .. p9_ over whole tables, and the SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import binpack, clusters, dedup, lookalike, mixing, mojibake, pii, quality, terms

SURVEYS = {"market": "market_research_survey_300", "remote": "remote_work_experiences_200"}


def surveys(spark: SparkSession, sf: str) -> DataFrame:
    """Both surveys as (survey, id, response)."""
    parts = [read_table(spark, sf, t).select(F.lit(k).alias("survey"), "id", "response") for k, t in SURVEYS.items()]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.copies(surveys(spark, sf), "id", "response", ["survey"])


def p1_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.distinct_records(surveys(spark, sf), "id", "response", ["survey"])


def p1_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that a 128-bit hash alone would have merged: none, if the hash holds."""
    found = dedup.hash_collisions(dedup.keyed(surveys(spark, sf), "id", "response", ["survey"]), ["survey"])
    return found.groupBy("survey").agg(F.count(F.lit(1)).alias("collisions"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return terms.marked_terms(surveys(spark, sf), "response", "survey").filter("mark is not null").select("survey", "term", "mark")


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    return terms.marked_terms(surveys(spark, sf), "response", "survey")


def p3_masked(spark: SparkSession, sf: str) -> DataFrame:
    return pii.annotate(surveys(spark, sf), ["survey", "id"], "response", read_table(spark, sf, "given_names"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_masked(spark, sf).select("survey", "id", F.explode("kinds").alias("kind"))


def fields(spark: SparkSession, sf: str) -> DataFrame:
    """The two fields of problems 4 and 6 as (tbl, rec_id, text)."""
    market = read_table(spark, sf, "market_research_survey_300").select(F.lit("market_research_survey_300").alias("tbl"), F.col("id").cast("string").alias("rec_id"), F.col("response").alias("text"))
    samples = read_table(spark, sf, "sample_texts").select(F.lit("sample_texts").alias("tbl"), F.col("id").alias("rec_id"), F.col("input").alias("text"))
    return market.unionByName(samples)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.disguised(fields(spark, sf), "tbl", "rec_id", "text")


def p4_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.normalized(fields(spark, sf), "tbl", "rec_id", "text")


def p5_members(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.similarity_clusters(surveys(spark, sf), "id", "response", "survey").withColumnRenamed("grp", "survey")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_members(spark, sf).select("survey", "id", "cluster_id")


def p5_clusters(spark: SparkSession, sf: str) -> DataFrame:
    members = clusters.similarity_clusters(surveys(spark, sf), "id", "response", "survey")
    return clusters.describe(members).withColumnRenamed("grp", "survey")


def p6_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.statistics(fields(spark, sf), ["tbl", "rec_id"], "text", read_table(spark, sf, "common_words"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return quality.not_prose(p6_statistics(spark, sf)).select("tbl", "rec_id")


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    return binpack.pack(read_table(spark, sf, "documents"), read_table(spark, sf, "bin_sizes"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return binpack.divided(p7_packed(spark, sf))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    docs, bins = read_table(spark, sf, "documents"), read_table(spark, sf, "bin_sizes")
    return binpack.report(p7_packed(spark, sf), binpack.bounds(docs, bins))


def p7_certificates(spark: SparkSession, sf: str) -> DataFrame:
    return binpack.certificates(p7_packed(spark, sf))


def p7_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return binpack.bounds(read_table(spark, sf, "documents"), read_table(spark, sf, "bin_sizes"))


def p7_audit(spark: SparkSession, sf: str) -> DataFrame:
    return binpack.audit(read_table(spark, sf, "documents"), p7_packed(spark, sf))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.unreachable(read_table(spark, sf, "documents"), read_table(spark, sf, "mix_targets"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf, "documents"), read_table(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(read_table(spark, sf, "documents"), read_table(spark, sf, "mix_targets"))


def p8_promises(spark: SparkSession, sf: str) -> DataFrame:
    return p8_shares(spark, sf).select("mix_id", "source", "available", "reachable", F.round("target_share", 9).alias("target_share"), "capped", "close")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.restore(read_table(spark, sf, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"))


def p9_restored(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.restore(read_table(spark, sf, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    answers = " UNION ALL ".join(f"SELECT '{k}' AS survey, id, response FROM {t} WHERE response IS NOT NULL" for k, t in SURVEYS.items())
    counts = f"""
            WITH r AS ({answers}), n AS (SELECT survey, count(*) AS total FROM r GROUP BY survey),
            t AS (SELECT survey, id, unnest(regexp_extract_all(lower(response), '[a-z][a-z]+')) AS term FROM r),
            c AS (SELECT survey, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM t GROUP BY survey, term),
            m AS (SELECT c.*, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.1 * total THEN 'common' END AS mark FROM c JOIN n USING (survey))"""
    cut = """
            SELECT bin_id, capacity_tokens AS capacity, unnest(range(0, greatest(1, ceil(n_tokens / capacity_tokens))::BIGINT)) AS piece, least(capacity_tokens, n_tokens - piece * capacity_tokens) AS tokens
            FROM documents, bin_sizes"""
    functions = ["ceil(sum(tokens) / capacity)"]
    functions += [f"ceil(sum(CASE WHEN tokens * {k + 1} % capacity = 0 THEN tokens * {k} ELSE tokens * {k + 1} // capacity * capacity END) / (capacity * {k}))" for k in range(1, binpack.STEPS + 1)]
    functions += [f"ceil(sum(CASE WHEN tokens * {binpack.GRID} > capacity * {binpack.GRID - j} THEN capacity WHEN tokens * {binpack.GRID} < capacity * {j} THEN 0 ELSE tokens END) / capacity)" for j in range(1, binpack.GRID // 2 + 1)]
    mixes = """
            WITH s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM documents WHERE source IS NOT NULL GROUP BY source),
            t AS (SELECT m.mix_id, m.source, m.weight, m.max_repeats, coalesce(s.tokens, 0)::BIGINT AS tokens FROM mix_targets m LEFT JOIN s ON s.source = m.source),
            w AS (SELECT *, sum(weight) OVER (PARTITION BY mix_id) AS ws, sum(tokens) OVER (PARTITION BY mix_id) AS ts FROM t)"""
    return {
        "p1_collisions": "SELECT 'x' AS survey, 0::BIGINT AS collisions WHERE false",
        "p2_found": counts + " SELECT survey, term, mark FROM m WHERE mark IS NOT NULL",
        "p2_counts": counts + " SELECT survey, term, occurrences, records, mark FROM m",
        "p7_found": "SELECT bin_id, doc_id FROM documents JOIN bin_sizes ON n_tokens > capacity_tokens",
        "p7_bounds": f"WITH x AS ({cut}) SELECT bin_id, capacity, count(*) AS pieces, sum(tokens)::BIGINT AS tokens, greatest({', '.join(functions)})::BIGINT AS bound FROM x WHERE tokens > 0 GROUP BY bin_id, capacity",
        "p7_audit": f"WITH x AS ({cut}) SELECT bin_id, count(*) AS pieces, sum(tokens)::BIGINT AS tokens, count(*) FILTER (piece = 1) AS divided, 0::BIGINT AS torn, 0::BIGINT AS overfull FROM x GROUP BY bin_id",
        "p8_promises": f"{mixes} SELECT mix_id, source, tokens AS available, tokens * max_repeats * ws >= weight * ts AS reachable, round(weight / ws, 9) AS target_share, true AS capped, true AS close FROM w",
        "p8_found": f"{mixes} SELECT mix_id, source FROM w WHERE tokens * max_repeats * ws < weight * ts",
    }
