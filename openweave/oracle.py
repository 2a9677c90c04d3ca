"""The same questions in SQL, for an independent engine over the same tables. Operators SQL cannot state are tested instead."""

from __future__ import annotations

from .functions import wordlists as L
from .operators.displays import DISPLAYS
from .operators.features import METHOD_SCORES
from .operators.interpret import NEGATIVE, POSITIVE

CODED = """k AS (SELECT code_id, unnest(keywords) AS kw FROM code_frame),
    hit AS (SELECT DISTINCT m.id, k.code_id FROM market_research_survey_300 m JOIN k ON contains(lower(m.response), lower(k.kw))),
    c AS (SELECT m.id, m.demographic_segment, coalesce(list_sort(list(h.code_id) FILTER (h.code_id IS NOT NULL)), []) AS codes FROM market_research_survey_300 m LEFT JOIN hit h ON h.id = m.id GROUP BY m.id, m.demographic_segment)"""
THEMED = (
    CODED
    + """,
    t AS (SELECT *, list_filter([CASE WHEN list_has_any(codes, ['PRICE', 'DELIVERY']) THEN 'VALUE' END, CASE WHEN list_has_any(codes, ['PRODUCT', 'MATERIAL', 'POWER', 'TASTE', 'PACK']) THEN 'GOODS' END,
        CASE WHEN list_has_any(codes, ['SERVICE', 'TONE', 'LEAD']) THEN 'PEOPLE' END, CASE WHEN list_has_any(codes, ['WORKLIFE', 'COMMUTE', 'FAMILY', 'ISOLATION', 'HEALTH']) THEN 'LIFE' END], lambda x: x IS NOT NULL) AS themes FROM c),
    g AS (SELECT *, list_filter([CASE WHEN len(codes) >= 3 THEN 'BROAD' END, CASE WHEN list_has_all(codes, ['PRICE', 'PRODUCT']) THEN 'COSTLY' END,
        CASE WHEN list_has_any(themes, ['PEOPLE', 'LIFE']) AND len(codes) <= 4 THEN 'HUMAN' END, CASE WHEN len(codes) = 0 THEN 'NONE' END], lambda x: x IS NOT NULL) AS categories FROM t),
    th AS (SELECT unnest(['VALUE', 'GOODS', 'PEOPLE', 'LIFE']) AS theme_id)"""
)
ONCE = """r AS (SELECT response_id, any_value(response_text) AS response_text, any_value(assigned_codes) AS assigned_codes, any_value(confidence_scores) AS confidence_scores, any_value(num_codes) AS num_codes FROM ml_results GROUP BY response_id),
    e AS (SELECT response_id, unnest(assigned_codes) AS code, unnest(confidence_scores) AS confidence FROM r),
    n AS (SELECT count(*) AS n FROM r),
    cc AS (SELECT f.code_id, coalesce(x.c, 0) AS count FROM (SELECT DISTINCT code_id FROM code_frame) f LEFT JOIN (SELECT code, count(*) AS c FROM e WHERE code IS NOT NULL GROUP BY code) x ON x.code = f.code_id)"""
SEG = r"""s AS (SELECT doc_id, length(text) AS chars, regexp_extract_all(text, '(?m)([^.|!|?]+[.|!|?]+(?:\s+|$)|[^.|!|?]+$)') AS p FROM documents WHERE text <> '')"""


def _in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words))


def oracle_sql() -> dict[str, str]:
    one = "WITH " + ONCE
    themed = "WITH " + THEMED
    coded = "WITH " + CODED
    trimmed = r"regexp_replace(regexp_replace(response, '^[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', ''), '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+$', '')"
    patterns = " OR ".join(f"regexp_matches(low, '{p.replace(chr(39), chr(39) * 2)}')" for p in L.NON_ANALYTIC if "\\1" not in p)
    labelled = (
        one
        + ", j AS (SELECT r.assigned_codes[1] AS cluster, w.topic AS label FROM r JOIN remote_work_experiences_200 w ON w.id = r.response_id), t AS (SELECT cluster, label, count(*)::DOUBLE AS n FROM j WHERE cluster IS NOT NULL AND label IS NOT NULL"
        " AND lower(trim(label)) NOT IN ('unknown', 'unlabeled', 'n/a', 'none', '') GROUP BY 1, 2)"
    )
    vec = "WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS d FROM embeddings), c AS (SELECT label, d, avg(v) AS m FROM x GROUP BY 1, 2), sz AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)"
    tokens = "WITH d AS (SELECT id, input FROM sample_texts WHERE input IS NOT NULL), t AS (SELECT id, unnest(regexp_extract_all(lower(input), '[a-z]{2,}')) AS term FROM d), f AS (SELECT id, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM d), v AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM f GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= (SELECT n * 0.8 FROM n) ORDER BY total DESC, term LIMIT 500)"
    out = {
        "coding_apply": coded + " SELECT id, array_to_string(codes, ',') AS codes FROM c",
        "coding_frequency": coded + ", u AS (SELECT unnest(codes) AS code_id FROM c), q AS (SELECT f.code_id, count(u.code_id) AS count FROM code_frame f LEFT JOIN u USING (code_id) GROUP BY 1) SELECT code_id, count, round(100.0 * count / (SELECT count(*) FROM c), 6) AS percentage, rank() OVER (ORDER BY count DESC) AS rank FROM q",
        "coding_frame_summary": coded + ", u AS (SELECT unnest(codes) AS code_id FROM c) SELECT f.code_id, f.label, count(u.code_id) AS count, f.parent, len(f.keywords) AS n_keywords FROM code_frame f LEFT JOIN u USING (code_id) GROUP BY f.code_id, f.label, f.parent, f.keywords",
        "coding_hierarchy": "SELECT coalesce(parent, 'root') AS parent, string_agg(code_id, ',' ORDER BY code_id) AS children FROM code_frame GROUP BY 1",
        "coding_ancestors": "WITH RECURSIVE a AS (SELECT code_id, parent AS ancestor, 1::BIGINT AS distance FROM code_frame WHERE parent IS NOT NULL UNION ALL SELECT a.code_id, f.parent, a.distance + 1 FROM a JOIN code_frame f ON f.code_id = a.ancestor WHERE f.parent IS NOT NULL AND a.distance < 16) SELECT * FROM a",
        "coding_themes": themed + " SELECT id, array_to_string(themes, ',') AS themes FROM t",
        "coding_theme_summary": themed + ", u AS (SELECT unnest(themes) AS theme_id FROM t) SELECT theme_id, count(u.theme_id) AS count FROM th LEFT JOIN u USING (theme_id) GROUP BY 1",
        "coding_theme_matrix": themed + ", u AS (SELECT id, unnest(themes) AS x FROM t), p AS (SELECT a.x AS a, b.x AS b, count(*) AS c FROM u a JOIN u b ON a.id = b.id GROUP BY 1, 2) SELECT a.theme_id AS a, b.theme_id AS b, coalesce(p.c, 0) AS count FROM th a CROSS JOIN th b LEFT JOIN p ON p.a = a.theme_id AND p.b = b.theme_id",
        "coding_theme_responses": themed + " SELECT id FROM t WHERE list_contains(themes, 'PEOPLE')",
        "coding_theme_coverage": themed + " SELECT round(avg(CASE WHEN len(themes) > 0 THEN 100.0 ELSE 0.0 END), 6) AS coverage FROM t",
        "coding_categories": themed + " SELECT id, array_to_string(categories, ',') AS categories FROM g",
        "coding_category_summary": themed + ", u AS (SELECT unnest(categories) AS category_id FROM g), k2 AS (SELECT * FROM (VALUES ('BROAD', 'Broad', 1::BIGINT), ('COSTLY', 'Costly goods', 2), ('HUMAN', 'Human', 2), ('NONE', 'Nothing', 3)) v(category_id, name, level)) SELECT category_id, name, level, count(u.category_id) AS count FROM k2 LEFT JOIN u USING (category_id) GROUP BY ALL",
        "coding_cross_tab": themed + " SELECT list_contains(categories, 'BROAD') AS has_first, list_contains(categories, 'HUMAN') AS has_second, count(*) AS count FROM g GROUP BY 1, 2",
        "coding_cooccurrence": coded + ", u AS (SELECT id, unnest(codes) AS x FROM c) SELECT a.x AS a, b.x AS b, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM c), 6) AS percentage FROM u a JOIN u b ON a.id = b.id AND a.x < b.x GROUP BY 1, 2 HAVING count(*) >= 2",
        "coding_code_matrix": coded + ", u AS (SELECT id, unnest(codes) AS x FROM c), p AS (SELECT a.x AS a, b.x AS b, count(*) AS c FROM u a JOIN u b ON a.id = b.id GROUP BY 1, 2) SELECT a.code_id AS a, b.code_id AS b, coalesce(p.c, 0) AS count FROM code_frame a CROSS JOIN code_frame b LEFT JOIN p ON p.a = a.code_id AND p.b = b.code_id",
        "coding_by_segment": coded + ", s AS (SELECT *, lower(trim(demographic_segment)) AS segment FROM c), z AS (SELECT segment, count(*) AS n FROM s GROUP BY 1), u AS (SELECT segment, unnest(codes) AS code_id FROM s), q AS (SELECT segment, code_id, count(*) AS c FROM u GROUP BY 1, 2) SELECT z.segment, f.code_id, coalesce(q.c, 0) AS count, round(100.0 * coalesce(q.c, 0) / z.n, 6) AS percentage FROM z CROSS JOIN code_frame f LEFT JOIN q ON q.segment IS NOT DISTINCT FROM z.segment AND q.code_id = f.code_id",
        "coding_network_nodes": coded + ", u AS (SELECT unnest(codes) AS id FROM c) SELECT id, count(*) AS count FROM u GROUP BY 1",
        "coding_tree": coded + ", u AS (SELECT unnest(codes) AS code_id FROM c), q AS (SELECT f.code_id AS id, coalesce(f.parent, 'All') AS parent, greatest(count(u.code_id), 1)::BIGINT AS value FROM code_frame f LEFT JOIN u USING (code_id) GROUP BY 1, 2) SELECT * FROM q UNION ALL SELECT 'All', '', sum(value)::BIGINT FROM q",
        "coding_part_names": "SELECT p_partkey, concat_ws(',', CASE WHEN contains(lower(p_name), 'red') THEN 'RED' END, CASE WHEN contains(lower(p_name), 'blue') OR contains(lower(p_name), 'navy') THEN 'BLUE' END, CASE WHEN contains(lower(p_name), 'green') OR contains(lower(p_name), 'lime') THEN 'GREEN' END) AS codes FROM part",
        "results_once": one + " SELECT response_id, num_codes, array_to_string(assigned_codes, ',') AS codes FROM r",
        "results_frequency": one + " SELECT code_id, count, round(100.0 * count / (SELECT n FROM n), 6) AS percentage, rank() OVER (ORDER BY count DESC) AS rank FROM cc",
        "results_cooccurrence": one + " SELECT a.code AS a, b.code AS b, count(*) AS count, round(100.0 * count(*) / (SELECT n FROM n), 6) AS percentage FROM e a JOIN e b ON a.response_id = b.response_id AND a.code < b.code GROUP BY 1, 2 HAVING count(*) >= 2",
        "results_overlap": one + ", p AS (SELECT round(100.0 * count(*) / (SELECT n FROM n), 6) AS p FROM e a JOIN e b ON a.response_id = b.response_id AND a.code < b.code GROUP BY a.code, b.code HAVING count(*) >= 2) SELECT coalesce(max(p), 0.0) AS max_percentage, coalesce(max(p), 0.0) > 10.0 AS strong FROM p",
        "results_binary": one + " SELECT r.response_id, f.code_id, list_contains(r.assigned_codes, f.code_id)::INT AS assigned FROM r CROSS JOIN code_frame f",
        "results_metrics": one + " SELECT (SELECT n FROM n) AS n_responses, sum(num_codes)::BIGINT AS n_assignments, round(avg(num_codes), 6) AS mean_codes, quantile_cont(num_codes, 0.5)::DOUBLE AS median_codes, max(num_codes)::BIGINT AS max_codes, count(*) FILTER (num_codes = 0) AS n_uncoded, round(100.0 * count(*) FILTER (num_codes > 0) / count(*), 6) AS coverage, (SELECT round(avg(confidence), 6) FROM e) AS mean_confidence, (SELECT min(confidence) FROM e) AS min_confidence, (SELECT max(confidence) FROM e) AS max_confidence, (SELECT count(DISTINCT code_id) FROM code_frame) AS n_codes, (SELECT count(DISTINCT code) FROM e) AS n_active FROM r",
        "results_quality": one + " SELECT count(*) AS n_responses, round(avg(num_codes), 6) AS mean_codes, round(stddev_pop(num_codes), 6) AS std_codes, round(avg(CASE WHEN num_codes > 0 THEN 100.0 ELSE 0.0 END), 6) AS coverage, (SELECT round(avg(confidence), 6) FROM e) AS mean_confidence, (SELECT round(stddev_pop(confidence), 6) FROM e) AS std_confidence FROM r",
        "results_descriptive": one + " SELECT count(*) AS n, round(avg(num_codes), 6) AS mean, quantile_cont(num_codes, 0.5)::DOUBLE AS median, round(stddev_samp(num_codes), 6) AS std, min(num_codes)::BIGINT AS min, max(num_codes)::BIGINT AS max, count(*) FILTER (num_codes = 0) AS n_none, count(*) FILTER (num_codes >= 1) AS n_some, round(avg(CASE WHEN num_codes > 0 THEN 100.0 ELSE 0.0 END), 6) AS coverage FROM r",
        "results_qa": one + " SELECT count(*) AS total, count(*) FILTER (len(list_filter(confidence_scores, lambda x: x < 0.5)) > 0) AS n_low_confidence, count(*) FILTER (num_codes = 0) AS n_uncoded, count(*) FILTER (num_codes > 1) AS n_multi, count(*) FILTER (num_codes >= 3) AS n_ambiguous FROM r",
        "results_uncoded": one + " SELECT response_id FROM r WHERE num_codes = 0",
        "results_low_confidence": one + " SELECT response_id FROM r WHERE list_min(confidence_scores) < 0.5",
        "results_ambiguous": one + " SELECT response_id FROM r WHERE num_codes >= 3",
        "results_boundary": one + " SELECT response_id FROM r WHERE list_max(confidence_scores) BETWEEN 0.3 AND 0.5 ORDER BY response_id LIMIT 100",
        "results_top_codes": one + " SELECT code, count(*) AS count FROM e GROUP BY 1 ORDER BY count DESC, code LIMIT 10",
        "results_code_statistics": one + " SELECT code, count(*) AS count, round(avg(confidence), 6) AS avg_confidence FROM e GROUP BY 1",
        "results_examples": one + ", q AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY response_id) AS rn FROM e), p AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY rn) AS place FROM q WHERE rn <= 5 OR confidence > 0.5) SELECT code, place, response_id FROM p WHERE place <= 10",
        "results_quotes": one + r", q AS (SELECT e.code, max(e.confidence) AS c, min(r.response_id) AS i, min(r.response_text) AS t FROM e JOIN r USING (response_id) WHERE regexp_matches(r.response_text, '\S') GROUP BY e.code, lower(trim(r.response_text))), p AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY c DESC NULLS LAST, i) AS place FROM q) SELECT code, place, CASE WHEN length(t) > 100 THEN substr(t, 1, 97) || '...' ELSE t END AS quote FROM p WHERE place <= 3",
        "results_by_topic": one + ", j AS (SELECT r.*, w.topic AS segment FROM r JOIN remote_work_experiences_200 w ON w.id = r.response_id), z AS (SELECT segment, count(*) AS n FROM j GROUP BY 1), u AS (SELECT DISTINCT response_id, segment, unnest(assigned_codes) AS code_id FROM j), q AS (SELECT segment, code_id, count(*) AS c FROM u GROUP BY 1, 2) SELECT z.segment, f.code_id, coalesce(q.c, 0) AS count, round(100.0 * coalesce(q.c, 0) / z.n, 6) AS percentage FROM z CROSS JOIN code_frame f LEFT JOIN q ON q.segment IS NOT DISTINCT FROM z.segment AND q.code_id = f.code_id",
        "diagnostics_stability": one + " SELECT CASE WHEN count(*) >= 30 THEN round(greatest(0.0, least(1.0, 1 - stddev_pop(num_codes) / (avg(num_codes) + 1e-6))), 6) END AS stability FROM r",
        "diagnostics_saturation": one + ", a AS (SELECT avg(CASE WHEN num_codes = 0 THEN 1.0 ELSE 0.0 END) AS u FROM r), b AS (SELECT avg(CASE WHEN count = 0 THEN 1.0 ELSE 0.0 END) AS v FROM cc) SELECT round(u, 6) AS uncoded, round(v, 6) AS unused, CASE WHEN u > 0.15 THEN 'under-saturated' WHEN v > 0.2 THEN 'over-saturated' ELSE 'adequate' END AS saturation FROM a, b",
        "diagnostics_utilisation": one + ", m AS (SELECT quantile_cont(count, 0.5) AS m FROM cc) SELECT code_id, count, CASE WHEN count = 0 OR count < 0.2 * m THEN 'under' WHEN count > 5 * m THEN 'over' ELSE 'normal' END AS use FROM cc, m",
        "diagnostics_confidence": one + " SELECT count(confidence) AS n, round(avg(confidence), 6) AS mean, round(stddev_pop(confidence), 6) AS std, round(quantile_cont(confidence, 0.25), 6) AS p25, round(quantile_cont(confidence, 0.5), 6) AS median, round(quantile_cont(confidence, 0.75), 6) AS p75, round(quantile_cont(confidence, 0.9), 6) AS p90 FROM e",
        "diagnostics_histogram": one + ", m AS (SELECT min(confidence) AS lo, max(confidence) AS hi FROM e), b AS (SELECT least(floor((confidence - lo) / ((hi - lo) / 10)), 9)::BIGINT AS bin FROM e, m WHERE confidence IS NOT NULL) SELECT g.bin, count(b.bin) AS count FROM (SELECT unnest(range(10)) AS bin) g LEFT JOIN b ON b.bin = g.bin GROUP BY 1",
        "diagnostics_ambiguity": one + " SELECT round(avg(CASE WHEN num_codes > 1 THEN 1.0 ELSE 0.0 END), 6) AS multi_share, round(avg(CASE WHEN num_codes >= 3 THEN 1.0 ELSE 0.0 END), 6) AS ambiguous_share FROM r",
        "diagnostics_imbalance": one + ", i AS (SELECT *, row_number() OVER (ORDER BY count, code_id) AS i FROM cc) SELECT round(max(count)::DOUBLE / min(count) FILTER (count > 0), 6) AS ratio, round(2.0 * sum(i * count) / (count(*) * sum(count)) - (count(*) + 1.0) / count(*), 6) AS gini FROM i",
        "diagnostics_groups": one + " SELECT lower(trim(p.department)) AS \"group\", round(avg(num_codes), 6) AS mean, round(stddev_samp(num_codes), 6) AS std, count(*) AS n FROM r JOIN remote_work_experiences_200 w ON w.id = r.response_id JOIN respondents p USING (respondent_id) WHERE p.department IS NOT NULL GROUP BY 1",
        "diagnostics_chi_square": one + ", d AS (SELECT lower(trim(p.gender)) AS g, num_codes > 0 AS f FROM r JOIN remote_work_experiences_200 w ON w.id = r.response_id JOIN respondents p USING (respondent_id) WHERE p.gender IS NOT NULL), a AS (SELECT g, count(*)::DOUBLE AS x FROM d GROUP BY 1), b AS (SELECT f, count(*)::DOUBLE AS y FROM d GROUP BY 1), k AS (SELECT a.g, b.f, x * y / (SELECT count(*) FROM d) AS ex, (SELECT count(*) FROM d WHERE d.g = a.g AND d.f = b.f)::DOUBLE AS o FROM a CROSS JOIN b), z AS (SELECT (SELECT count(*) FROM a) AS nr, (SELECT count(*) FROM b) AS nc) SELECT round(sum(CASE WHEN nr = 2 AND nc = 2 THEN power(abs(o - ex) - least(0.5, abs(o - ex)), 2) ELSE power(o - ex, 2) END / ex), 6) AS statistic, max((nr - 1) * (nc - 1)) AS dof FROM k, z",
        "diagnostics_position": one + ", o AS (SELECT num_codes, row_number() OVER (ORDER BY response_id) AS i, count(*) OVER () AS n FROM r) SELECT max(n) AS n, round(avg(num_codes) FILTER (i <= n // 2), 6) AS first_half, round(avg(num_codes) FILTER (i > n // 2), 6) AS second_half, max(n) >= 20 AND abs(avg(num_codes) FILTER (i <= n // 2) - avg(num_codes) FILTER (i > n // 2)) > 0.5 AS significant FROM o",
        "diagnostics_health": one + ", a AS (SELECT count(*) AS n, avg(CASE WHEN num_codes = 0 THEN 1.0 ELSE 0.0 END) AS uncoded, avg(CASE WHEN num_codes >= 3 THEN 1.0 ELSE 0.0 END) AS many FROM r), b AS (SELECT quantile_cont(confidence, 0.75) AS p75 FROM e), u AS (SELECT count(*) FILTER (count = 0) AS unused, max(count)::DOUBLE / min(count) FILTER (count > 0) AS ratio FROM cc), i AS (SELECT *, (CASE WHEN ratio > 10 THEN 1 ELSE 0 END + CASE WHEN uncoded > 0.2 THEN 1 ELSE 0 END + CASE WHEN p75 < 0.5 THEN 1 ELSE 0 END + CASE WHEN a.n < 20 THEN 1 ELSE 0 END + CASE WHEN unused > 0 THEN 1 ELSE 0 END + CASE WHEN many > 0.3 THEN 1 ELSE 0 END)::BIGINT AS issues FROM a, b, u) SELECT n, round(uncoded, 6) AS uncoded, round(many, 6) AS many, round(p75, 6) AS p75, unused, round(ratio, 6) AS ratio, issues, CASE WHEN issues = 0 THEN 'excellent' WHEN issues <= 2 THEN 'good' WHEN issues <= 4 THEN 'fair' ELSE 'poor' END AS status FROM i",
        "text_sentences": "WITH " + SEG + r", t AS (SELECT doc_id, chars, list_filter(list_transform(p, lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: length(x) >= 1) AS q FROM s), u AS (SELECT doc_id, chars, unnest(q) AS text, unnest(range(len(q))) AS i FROM t) SELECT doc_id || '-S' || i AS segment_id, text, i::INT AS position, chars::INT AS original_text_length FROM u",
        "text_paragraphs": r"WITH t AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r\n\r\n|\n\n'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: length(x) >= 1) AS q FROM documents WHERE text <> ''), u AS (SELECT doc_id, unnest(q) AS text, unnest(range(len(q))) AS i FROM t) SELECT doc_id || '-P' || i AS segment_id, text, i::INT AS position FROM u",
        "text_context": r"WITH s AS (SELECT id, regexp_extract_all(response, '(?m)([^.|!|?]+[.|!|?]+(?:\s+|$)|[^.|!|?]+$)') AS p FROM remote_work_experiences_200 WHERE response <> ''), t AS (SELECT id, list_filter(list_transform(p, lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: length(x) >= 1) AS q FROM s), u AS (SELECT id, unnest(q) AS text, unnest(range(len(q))) AS i FROM t) SELECT id || '-S' || i AS segment_id, lag(text) OVER (PARTITION BY id ORDER BY i) AS context_before, lead(text) OVER (PARTITION BY id ORDER BY i) AS context_after FROM u",
        "text_filtered": "SELECT min(id) AS id FROM remote_work_experiences_200 WHERE length(response) >= 10 GROUP BY response",
        "text_multilingual": r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-zß-öø-ÿ\s]', ' ', 'g'), '\s+', ' ', 'g'), ' ')) AS clean FROM documents",
        "text_chunks": r"WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents), s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) > 0 THEN range(0, len(w), 462) ELSE [0] END) AS i FROM w) SELECT doc_id, i // 462 AS chunk, length(array_to_string(w[i + 1:i + 512], ' ')) AS chars FROM s",
        "text_sample": "SELECT id, row_number() OVER (ORDER BY md5(id || '|42'), id) AS sample_no FROM remote_work_experiences_200 ORDER BY md5(id || '|42'), id LIMIT 150",
        "features_vocabulary": tokens + " SELECT * FROM v",
        "features_tfidf": tokens + ", w AS (SELECT f.id, f.term, f.tf * (ln((1.0 + n) / (1.0 + v.df)) + 1.0) AS raw FROM f JOIN v USING (term), n), m AS (SELECT id, sqrt(sum(raw * raw)) AS norm FROM w GROUP BY 1) SELECT term, count(*) AS docs, round(sum(raw / norm), 4) AS weight FROM w JOIN m USING (id) GROUP BY 1",
        "features_profile": r"WITH w AS (SELECT coalesce(len(regexp_extract_all(text, '\S+')), 0) AS n FROM documents) SELECT count(*) AS n_docs, round(avg(n), 6) AS mean_words, round(stddev_pop(n), 6) AS std_words, quantile_cont(n, 0.25)::DOUBLE AS p25, quantile_cont(n, 0.5)::DOUBLE AS p50, quantile_cont(n, 0.75)::DOUBLE AS p75, quantile_cont(n, 0.9)::DOUBLE AS p90, quantile_cont(n, 0.95)::DOUBLE AS p95, (SELECT count(DISTINCT t) FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents)) AS vocabulary FROM w",
        "features_text_profile": r"WITH d AS (SELECT response FROM remote_work_experiences_200 WHERE response IS NOT NULL), a AS (SELECT count(*) AS n, round(avg(len(regexp_extract_all(response, '\S+'))), 6) AS mean_words, round(avg(greatest(len(regexp_extract_all(response, '[.!?]+')), 1)), 6) AS mean_sentences FROM d), b AS (SELECT round(count(DISTINCT w)::DOUBLE / count(w), 6) AS type_token_ratio FROM (SELECT unnest(regexp_extract_all(lower(response), '[a-z]+')) AS w FROM d)) SELECT *, CASE WHEN n < 50 THEN 'small' WHEN n < 500 THEN 'medium' ELSE 'large' END AS size_band, CASE WHEN mean_words < 10 THEN 'short' WHEN mean_words < 50 THEN 'medium' ELSE 'long' END AS length_band, CASE WHEN type_token_ratio < 0.3 THEN 'low' WHEN type_token_ratio < 0.6 THEN 'medium' ELSE 'high' END AS diversity_band FROM a, b",
        "features_labels": "WITH d AS (SELECT demographic_segment AS x, x IS NULL OR regexp_matches(lower(trim(x)), '^(unknown|none|n/?a|\\s*|unlabeled|unassigned|no\\s*label|\\?)$') AS miss FROM (SELECT demographic_segment, demographic_segment AS x FROM market_research_survey_300)) SELECT count(*) AS n, count(*) FILTER (miss) AS n_missing, round(count(*) FILTER (miss)::DOUBLE / count(*), 6) AS missing_ratio, count(DISTINCT x) FILTER (NOT miss) AS n_labels, NULL::VARCHAR AS delimiter, false AS multi_label FROM d",
        "features_stopwords": "WITH d AS (SELECT id, regexp_extract_all(lower(response), '[a-z]{2,}') AS w FROM remote_work_experiences_200 WHERE response IS NOT NULL), n AS (SELECT count(*) AS n, count(*) FILTER (len(w) > 0) AS m FROM d), t AS (SELECT id, len(w) AS len, unnest(w) AS term FROM d), f AS (SELECT id, len, term, count(*) AS tf FROM t GROUP BY ALL), g AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total, avg(len) AS ml, sum(tf / len) AS s1, sum((tf / len) * (tf / len)) AS s2 FROM f GROUP BY 1) SELECT term, df, total, round(df / n, 6) AS ratio, round(ml, 6) AS mean_length, round(power(ln(n / (df + 1.0)) + 1.0, 2) * (s2 / m - power(s1 / m, 2)), 9) AS tfidf_variance, term <> 'not' AS recommended, CASE WHEN term = 'not' THEN 'in the keep list' WHEN df / n >= 0.9 THEN 'in nearly all texts' WHEN df / n >= 0.8 THEN 'in most texts' ELSE 'in many texts' END AS reason FROM g, n WHERE df / n >= 0.2 ORDER BY df DESC, total DESC, term LIMIT 50",
        "features_word_cloud": f"SELECT term, count(*) AS count FROM (SELECT unnest(regexp_extract_all(lower(response), '[a-z]{{2,}}')) AS term FROM remote_work_experiences_200) WHERE term NOT IN ({_in(L.STOPWORDS)}) GROUP BY 1 ORDER BY count DESC, term LIMIT 50",
        "evaluate_agreement": labelled + ", s AS (SELECT sum(n) AS total, sum(n * (n - 1) / 2) AS sij FROM t), a AS (SELECT cluster, sum(n) AS a, max(n) AS top FROM t GROUP BY 1), b AS (SELECT label, sum(n) AS b FROM t GROUP BY 1), q AS (SELECT (SELECT sum(a * (a - 1) / 2) FROM a) AS sa, (SELECT sum(b * (b - 1) / 2) FROM b) AS sb, (SELECT sum(-a.a / total * ln(a.a / total)) FROM a, s) AS ha, (SELECT sum(-b.b / total * ln(b.b / total)) FROM b, s) AS hb, (SELECT sum(t.n / s.total * ln(t.n * s.total / (a.a * b.b))) FROM t JOIN a USING (cluster) JOIN b USING (label), s) AS mi, (SELECT sum(top) FROM a) AS pure), h AS (SELECT *, mi / hb AS h, mi / ha AS c, sa * sb / (total * (total - 1) / 2) AS ex FROM q, s) SELECT round((sij - ex) / ((sa + sb) / 2 - ex), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi, round(h, 6) AS homogeneity, round(c, 6) AS completeness, round(2 * h * c / (h + c), 6) AS v_measure, round(pure / total, 6) AS purity, total::BIGINT AS n FROM h",
        "evaluate_mapping": labelled + ", p AS (SELECT *, sum(n) OVER (PARTITION BY cluster) AS total, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) AS i FROM t) SELECT cluster, label, round(n / total, 6) AS share, total::BIGINT AS n FROM p WHERE i = 1",
        "evaluate_label_coverage": labelled + " SELECT label, sum(n)::BIGINT AS n, round(max(n) / sum(n), 6) AS coverage FROM t GROUP BY 1",
        "evaluate_multi_label": one + ", d AS (SELECT response_id, assigned_codes[1] AS cluster, unnest(assigned_codes) AS label FROM r WHERE len(assigned_codes) > 0), z AS (SELECT cluster, count(DISTINCT response_id) AS n FROM d GROUP BY 1), k AS (SELECT cluster, label, count(DISTINCT response_id) AS c FROM d GROUP BY 1, 2), m AS (SELECT cluster, max(c) AS c FROM k GROUP BY 1) SELECT round(avg(m.c / z.n), 6) AS purity, count(*) AS clusters FROM m JOIN z USING (cluster)",
        "evaluate_indices": vec + ", g AS (SELECT d, avg(v) AS gm FROM x GROUP BY 1), q AS (SELECT x.vec_id, x.label, sum(power(v - m, 2)) AS q FROM x JOIN c USING (label, d) GROUP BY 1, 2), w AS (SELECT label, sum(q) AS w, avg(sqrt(q)) AS s FROM q GROUP BY 1), b AS (SELECT sum(sz.n * power(c.m - g.gm, 2)) AS b FROM c JOIN g USING (d) JOIN sz USING (label)), p AS (SELECT a.label AS i, o.label AS j, sqrt(sum(power(a.m - o.m, 2))) AS dist FROM c a JOIN c o ON a.d = o.d AND a.label <> o.label GROUP BY 1, 2), r AS (SELECT i, max((x.s + y.s) / dist) AS r FROM p JOIN w x ON x.label = i JOIN w y ON y.label = j GROUP BY 1), k AS (SELECT count(*) AS k, sum(w) AS sw FROM w), nn AS (SELECT count(*) AS n FROM embeddings) SELECT round(b * (n - k) / (sw * (k - 1)), 4) AS calinski_harabasz, k, n, (SELECT round(avg(r), 6) FROM r) AS davies_bouldin FROM b, k, nn",
        "evaluate_coherence": vec + ", nn AS (SELECT vec_id, sqrt(sum(v * v)) AS norm FROM x GROUP BY 1), u AS (SELECT x.label, d, sum(v / norm) AS s FROM x JOIN nn USING (vec_id) GROUP BY 1, 2), t AS (SELECT label, sum(s * s) AS t FROM u GROUP BY 1) SELECT label AS cluster, n, round((t - n) / (n * (n - 1.0)), 6) AS coherence FROM t JOIN sz USING (label)",
        "evaluate_network": vec + " SELECT * FROM (SELECT a.label AS a, b.label AS b, round(sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))), 6) AS similarity FROM c a JOIN c b ON a.d = b.d AND a.label < b.label GROUP BY 1, 2) WHERE similarity >= 0.1",
        "evaluate_representative": vec + ", q AS (SELECT x.label AS cluster, x.vec_id AS id, round(sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))), 6) AS similarity FROM x JOIN c USING (label, d) GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY similarity DESC, id) AS place FROM q) SELECT cluster, place, id, similarity FROM p WHERE place <= 3",
        "evaluate_silhouette": "WITH m AS (SELECT a.vec_id, a.label, b.label AS o, avg(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS m FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3), s AS (SELECT vec_id, label, min(m) FILTER (label = o) AS a, min(m) FILTER (label <> o) AS b FROM m GROUP BY 1, 2) SELECT label AS cluster, round(avg(round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6)), 4) AS silhouette, count(*) AS n FROM s GROUP BY 1",
        "display_cluster_terms": f"WITH t AS (SELECT topic AS cluster, unnest(regexp_extract_all(lower(response), '[a-z]{{2,}}')) AS term FROM remote_work_experiences_200), n AS (SELECT cluster, term, count(*) AS n FROM t WHERE term NOT IN ({_in(L.STOPWORDS)}) GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, term) AS i, max(n) OVER (PARTITION BY cluster) AS best FROM n) SELECT cluster, term, round(100.0 * n / best, 6) AS score FROM p WHERE i <= 10",
        "stream_tumbling": "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
        "stream_sliding": "SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL '6 hours']) AS w FROM events WHERE ts IS NOT NULL) GROUP BY 1, 2",
        "stream_coded": "WITH k AS (SELECT code_id, unnest(keywords) AS kw FROM code_frame), hit AS (SELECT DISTINCT m.id, k.code_id FROM remote_work_experiences_200 m JOIN k ON contains(lower(m.response), lower(k.kw))) SELECT m.id, coalesce(string_agg(h.code_id, ',' ORDER BY h.code_id), '') AS codes FROM remote_work_experiences_200 m LEFT JOIN hit h USING (id) GROUP BY 1",
        "extension_rollup": "SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type, date_trunc('day', ts))",
        "extension_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    }
    shown = sorted({d for v in DISPLAYS.values() for d in v})
    pairs = ", ".join(f"('{m}', '{d}', {str(d in v).lower()})" for m, v in sorted(DISPLAYS.items()) for d in shown)
    out["display_availability"] = f"SELECT * FROM (VALUES {pairs}) AS v(method, display, available)"
    out["features_split_labels"] = r"SELECT label, count(*) AS n FROM (SELECT trim(unnest(string_split(input, ',')), ' ') AS label FROM sample_texts) WHERE label <> '' AND NOT regexp_matches(lower(trim(label)), '^(unknown|none|n/?a|\s*|unlabeled|unassigned|no\s*label|\?)$') GROUP BY label HAVING count(*) > 1"
    cut = r"list_filter(list_transform({}, lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: length(x) >= 1)"
    out["text_hierarchy"] = f"""WITH p AS (SELECT doc_id, text, {cut.format(r"string_split_regex(text, '\r\n\r\n|\n\n')")} AS ps FROM documents WHERE text <> ''),
        q AS (SELECT doc_id, unnest(ps) AS pt, unnest(range(len(ps))) AS i FROM p),
        s AS (SELECT doc_id, i, {cut.format(r"regexp_extract_all(pt, '(?m)([^.|!|?]+[.|!|?]+(?:\s+|$)|[^.|!|?]+$)')")} AS ss FROM q),
        u AS (SELECT doc_id, i, unnest(ss) AS st, unnest(range(len(ss))) AS j FROM s),
        z AS (SELECT 'response' AS segment_type, text AS t, 0 AS position FROM p UNION ALL SELECT 'paragraph', pt, i FROM q UNION ALL SELECT 'sentence', st, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 FROM u)
        SELECT segment_type, count(*) AS n, sum(length(t))::BIGINT AS chars, sum(position)::BIGINT AS positions FROM z GROUP BY 1"""
    grams = "list_concat(w, CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END)"
    out["features_phrases"] = f"""WITH d AS (SELECT id, regexp_extract_all(lower(input), '[a-z]{{2,}}') AS w FROM sample_texts WHERE input IS NOT NULL), n AS (SELECT count(*) AS n FROM d), t AS (SELECT id, unnest({grams}) AS term FROM d),
        f AS (SELECT id, term, count(*) AS tf FROM t GROUP BY 1, 2), v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM f GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= (SELECT n * 0.8 FROM n) ORDER BY total DESC, term LIMIT 1000),
        w AS (SELECT id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS raw FROM f JOIN v USING (term), n), m AS (SELECT id, sqrt(sum(raw * raw)) AS norm FROM w GROUP BY 1),
        s AS (SELECT term, sum(raw / norm) / any_value(n) * (1 + 0.3 * (len(string_split(term, ' ')) - 1)) AS s FROM w JOIN m USING (id), n GROUP BY 1 ORDER BY round(s, 9) DESC, term LIMIT 50) SELECT term, round(greatest(1.0, 100 * s / max(s) OVER ()), 4) AS score FROM s"""
    add = lambda trait, m: METHOD_SCORES[trait].get(m, 0)
    out["features_method"] = r"WITH d AS (SELECT response FROM remote_work_experiences_200 WHERE response IS NOT NULL), a AS (SELECT count(*) AS n, avg(len(regexp_extract_all(response, '\S+'))) AS w FROM d), b AS (SELECT count(DISTINCT w)::DOUBLE / count(w) AS u FROM (SELECT unnest(regexp_extract_all(lower(response), '[a-z]+')) AS w FROM d))" + " UNION ALL ".join(
        f""" SELECT '{m}' AS method, ({s} + CASE WHEN n < 100 THEN {add('fewer than 100 texts', m)} WHEN n < 500 THEN {add('fewer than 500 texts', m)} ELSE {add('500 texts or more', m)} END
        + CASE WHEN w < 20 THEN {add('under 20 words', m)} WHEN w < 100 THEN {add('under 100 words', m)} ELSE {add('100 words or more', m)} END
        + CASE WHEN u > 0.6 THEN {add('varied words', m)} WHEN u < 0.3 THEN {add('few words', m)} ELSE 0 END + CASE WHEN n > 1000 THEN {add('more than 1000 texts', m)} ELSE 0 END)::BIGINT AS score FROM a, b"""
        for m, s in METHOD_SCORES["start"].items()
    )
    out["features_label_stopwords"] = rf"SELECT word, count(*) AS documents FROM (SELECT DISTINCT id, unnest(string_split_regex(lower(response), '\s+')) AS word FROM remote_work_experiences_200) WHERE length(word) > 2 AND word NOT IN ({_in(L.STOPWORDS)}) GROUP BY 1 HAVING count(*) >= 0.1 * (SELECT count(*) FROM remote_work_experiences_200) ORDER BY documents DESC, word LIMIT 20"
    out["features_columns"] = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS \"distinct\" FROM market_research_survey_300" for c in ("id", "response", "respondent_id", "submitted_at", "demographic_segment"))
    out["coding_category_level"] = themed + ", u AS (SELECT unnest(categories) AS category_id FROM g) SELECT v.category_id, count(u.category_id) AS count FROM (VALUES ('COSTLY'), ('HUMAN')) AS v(category_id) LEFT JOIN u USING (category_id) GROUP BY 1"
    turned = lambda words: [f"{n} {w}" for n in ("not", "no", "never") for w in words]
    out["text_sentiment"] = rf"""WITH t AS (SELECT response, regexp_extract_all(replace(lower(response), 'n''t', ' not'), '((?:(?:not|no|never) )?[a-z]{{2,}})') AS w FROM market_research_survey_300),
        c AS (SELECT response, len(list_filter(w, lambda x: x IN ({_in([*POSITIVE, *turned(NEGATIVE)])})))::DOUBLE - len(list_filter(w, lambda x: x IN ({_in([*NEGATIVE, *turned(POSITIVE)])})))::DOUBLE AS d FROM t),
        s AS (SELECT CASE WHEN response IS NULL THEN 0 ELSE d / sqrt(d * d + 15.0::DOUBLE) END AS x, response IS NULL AS none FROM c)
        SELECT CASE WHEN x >= 0.05 THEN 'positive' WHEN x <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment_label, count(*) AS n, round(avg(CASE WHEN none THEN 1.0 ELSE round(abs(x), 6) END), 6) AS score FROM s GROUP BY 1"""
    out["extension_intersect"] = "SELECT respondent_id FROM market_research_survey_300 INTERSECT SELECT respondent_id FROM remote_work_experiences_200"
    out["extension_except"] = "SELECT respondent_id, count(*) AS n FROM (SELECT respondent_id FROM market_research_survey_300 EXCEPT ALL SELECT respondent_id FROM remote_work_experiences_200) GROUP BY 1"
    of = {k: out[f"diagnostics_{k}"].removeprefix(one).strip() for k in ("stability", "saturation", "utilisation", "confidence", "ambiguity", "imbalance", "chi_square", "position")}
    inner = lambda k: "(WITH " + of[k].removeprefix(", ") + ")" if of[k].startswith(",") else "(" + of[k] + ")"
    out["diagnostics_validity"] = one + f""" SELECT (SELECT count(*) FROM r) AS n, s.stability, round(1 - t.uncoded, 6) AS coverage, t.saturation, t.unused, u.underused, u.overused, c.mean AS mean_confidence, c.median AS median_confidence, m.multi_share, m.ambiguous_share,
        (SELECT count(*) FROM r WHERE list_max(confidence_scores) BETWEEN 0.3 AND 0.5) AS boundary
        FROM {inner('stability')} s, {inner('saturation')} t, (SELECT count(*) FILTER (use = 'under') AS underused, count(*) FILTER (use = 'over') AS overused FROM {inner('utilisation')}) u, {inner('confidence')} c, {inner('ambiguity')} m"""
    # the bundle covers the answers whose respondent is known
    known = ONCE.replace("FROM ml_results GROUP BY response_id)", "FROM ml_results WHERE response_id IN (SELECT w.id FROM remote_work_experiences_200 w JOIN respondents p USING (respondent_id)) GROUP BY response_id)", 1)
    everything = "(" + one + " " + of["imbalance"] + ")"
    out["diagnostics_bias"] = f"""WITH {known} SELECT i.*, c.*, p.first_half, p.second_half, p.significant AS position_bias, concat_ws(',', CASE WHEN i.ratio > 10 THEN 'codes out of balance' END, CASE WHEN p.significant THEN 'halves differ' END) AS warnings
        FROM {everything} i, {inner('chi_square')} c, {inner('position')} p"""
    flags = f"""WITH a AS (SELECT id, response, {trimmed} AS x FROM market_research_survey_300), b AS (SELECT *, lower(x) AS low, list_filter(regexp_extract_all(lower(response), '[\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-z]+')) AS w FROM a),
        d AS (SELECT id, response IS NULL OR x = '' AS blank, length(x) < 10 AS f1, len(w) < 3 AS f2, ({patterns}) OR (length(low) >= 3 AND replace(low, substr(low, 1, 1), '') = '' AND substr(low, 1, 1) <> chr(10)) AS f3,
            len(w) > 0 AND 1.0 - len(list_distinct(w)) / len(w) > 0.7 AS f4, len(w) > 0 AND len(list_filter(w, lambda t: t IN ({_in(L.COMMON_ENGLISH)}))) / len(w) < 0.3 AS f5 FROM b),
        q AS (SELECT id, blank, CASE WHEN blank THEN 'empty_response' ELSE concat_ws(',', CASE WHEN f1 THEN 'too_short_chars' END, CASE WHEN f2 THEN 'too_few_words' END, CASE WHEN f3 THEN 'non_analytic_pattern' END, CASE WHEN f4 THEN 'high_repetition' END, CASE WHEN f5 THEN 'low_english_ratio' END) END AS quality_flags,
            CASE WHEN blank THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - CASE WHEN f1 THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN f2 THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN f3 THEN 0.5::DOUBLE ELSE 0 END - CASE WHEN f4 THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN f5 THEN 0.2::DOUBLE ELSE 0 END) END AS c FROM d),
        z AS (SELECT id, NOT blank AND quality_flags = '' AS quality_is_analytic, round(c, 3) AS quality_confidence, CASE WHEN blank THEN 'exclude' WHEN quality_flags = '' THEN 'include' WHEN c >= 0.5 THEN 'review' ELSE 'exclude' END AS quality_recommendation, quality_flags FROM q)"""
    out["text_quality"] = flags + " SELECT * FROM z"
    out["text_quality_summary"] = flags + " SELECT count(*) AS total, count(*) FILTER (quality_is_analytic) AS analytic, round(100.0 * count(*) FILTER (quality_is_analytic) / count(*), 6) AS analytic_percent, count(*) FILTER (quality_recommendation = 'include') AS n_include, count(*) FILTER (quality_recommendation = 'review') AS n_review, count(*) FILTER (quality_recommendation = 'exclude') AS n_exclude, round(avg(quality_confidence), 3) AS mean_confidence FROM z"
    out["text_quality_flags"] = flags + " SELECT flag, count(*) AS count FROM (SELECT unnest(string_split(quality_flags, ',')) AS flag FROM z WHERE quality_flags <> '') GROUP BY 1"
    return out
