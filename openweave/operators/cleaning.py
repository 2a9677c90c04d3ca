"""The cleaning pipelines: normalization with reject reasons, word-level preprocessing, long documents, segments."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import wordlists as L
from ..functions.text import STEPS, matches, normalizer
from ..session import materialize


@dataclass(frozen=True)
class CleaningConfig:
    steps: frozenset[str] = frozenset(STEPS) - {"slang"}
    max_repeat: int = 2
    min_tokens: int = 3
    max_tokens: int = 512
    max_emoji_ratio: float = 0.7
    detect_spam: bool = True
    detect_duplicates: bool = True
    languages: tuple[str, ...] | None = None


PRESETS = {
    "general": CleaningConfig(),
    "survey": CleaningConfig(),
    "social_media": CleaningConfig(steps=frozenset(STEPS), max_emoji_ratio=0.5, min_tokens=2),
    "reviews": CleaningConfig(min_tokens=5, max_tokens=1000),
    "news": CleaningConfig(steps=frozenset(STEPS) - {"slang", "contractions", "elongations"}, detect_spam=False, min_tokens=10, max_tokens=2000),
}


def preset(name: str, **changes) -> CleaningConfig:
    """A preset by name (general for unknown names), with changes."""
    return replace(PRESETS.get(name, PRESETS["general"]), **changes)


def process(df: DataFrame, text_col: str, id_col: str, config: CleaningConfig = CleaningConfig(), lang_col: str | None = None) -> DataFrame:
    """df with norm (normalized text and counters) and reject_reason (NULL for survivors).

    Reasons in their order: empty_or_invalid, empty_after_strip, below_min_tokens, above_max_tokens, emoji_spam, spam_detected,
    duplicate (of the survivor with the smallest id), wrong_language. Languages are taken from lang_col.
    """
    text = F.col(text_col)
    d = df.withColumn("norm", normalizer(config.steps, config.max_repeat)(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")))
    x = F.col("norm.text")
    spam = F.lit(False)
    if config.detect_spam:
        for p in L.SPAM:
            spam = spam | x.rlike("(?i)" + p)
    reason = (
        F.when(text.isNull() | (text == ""), "empty_or_invalid")
        .when(~text.rlike(r"(?U)\S"), "empty_after_strip")
        .when(F.col("norm.tokens") < config.min_tokens, "below_min_tokens")
        .when(F.col("norm.tokens") > config.max_tokens, "above_max_tokens")
        .when(F.col("norm.emojis") > config.max_emoji_ratio * F.length(x), "emoji_spam")
        .when(spam, "spam_detected")
    )
    d = d.withColumn("reject_reason", reason)
    if config.detect_duplicates:
        # the first survivor of a text is found by aggregation: a text that fills a third of the table is one row a task
        d = materialize(d, "normalized")  # the normalizer runs once
        key = F.md5(x)
        first = d.filter(F.col("reject_reason").isNull()).groupBy(key.alias("_md5")).agg(F.min(id_col).alias("_first"))
        d = d.withColumn("_md5", F.when(F.col("reject_reason").isNull(), key)).join(first, "_md5", "left")
        d = d.withColumn("reject_reason", F.when(F.col("reject_reason").isNull() & (F.col(id_col) > F.col("_first")), "duplicate").otherwise(F.col("reject_reason"))).drop("_md5", "_first")
    if config.languages is not None and lang_col is not None:
        wrong = ~F.coalesce(F.col(lang_col).isin(*config.languages), F.lit(True))
        d = d.withColumn("reject_reason", F.when(F.col("reject_reason").isNull() & wrong, "wrong_language").otherwise(F.col("reject_reason")))
    return d


def cleaned(df: DataFrame, text_col: str, id_col: str, config: CleaningConfig = CleaningConfig(), drop_rejected: bool = True) -> DataFrame:
    """df with <text>_processed; rejected rows dropped, or kept with NULL."""
    d = process(df, text_col, id_col, config)
    d = d.withColumn(f"{text_col}_processed", F.when(F.col("reject_reason").isNull(), F.col("norm.text")))
    return (d.filter("reject_reason is null") if drop_rejected else d).drop("norm", "reject_reason")


def quality_report(processed: DataFrame) -> DataFrame:
    """One row: records, survivors, rejects by reason as a map, sums of the counters, mean length and tokens, distinct texts."""
    ok = F.col("reject_reason").isNull()
    counters = ("unicode", "html", "urls", "mentions", "hashtags", "contractions", "elongations", "punctuation", "slang", "emojis")
    sums = processed.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("valid"), F.round(F.coalesce(F.try_divide(100.0 * F.count_if(ok), F.count(F.lit(1))), F.lit(0.0)), 6).alias("valid_percent"),
        *[F.coalesce(F.sum(f"norm.{c}"), F.lit(0)).alias(c) for c in counters], F.round(F.avg(F.when(ok, F.length("norm.text"))), 6).alias("mean_chars"), F.round(F.avg(F.when(ok, F.col("norm.tokens"))), 6).alias("mean_tokens"),
        F.countDistinct(F.when(ok, F.md5("norm.text"))).alias("distinct_texts"),
    )
    reasons = processed.filter(~ok).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reject_reason", "n")))).alias("rejects"))
    return sums.join(F.broadcast(reasons))


def plural_base(word: Column) -> Column:
    """The singular by rule: an approximation of a dictionary's noun lemmas."""
    w = word
    return (
        F.when(F.length(w) <= 3, w)
        .when(w.rlike("(ss|us|is)$"), w)
        .when(w.rlike("[^aeiou]ies$"), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("(xes|ches|shes|sses|zes)$"), F.regexp_replace(w, "es$", ""))
        .when(w.rlike("[^s]s$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def preprocess(text: Column, stopwords: frozenset[str] | None = L.STOPWORDS, lemmatize: bool = True, min_token_length: int = 2, keep_negations: bool = True) -> Column:
    """Lower-cased letters-only tokens of a normalized text, longer than min_token_length, joined by blanks; NULL stays NULL.

    Characters that are no letters are deleted, not replaced, so open-ended becomes openended; cannot becomes can not.
    """
    letters = F.regexp_replace(F.lower(text), r"[^a-z\s]", "")
    split = F.regexp_replace(letters, r"\b(can)(not)\b|\b(gon|wan)(na)\b|\b(got)(ta)\b|\b(gim|lem)(me)\b", "$1$3$5$7 $2$4$6$8")
    tokens = matches(split, r"(\S+)", 1)
    if stopwords:
        gone = sorted(stopwords - L.NEGATIONS if keep_negations else stopwords)
        tokens = F.filter(tokens, lambda t: ~t.isin(*gone))
    if lemmatize:
        tokens = F.transform(tokens, plural_base)
    return F.array_join(F.filter(tokens, lambda t: F.length(t) > min_token_length), " ")


def clean_table(df: DataFrame, text_col: str, dataset: str = "survey", stopwords: frozenset[str] | None = L.STOPWORDS, lemmatize: bool = True) -> DataFrame:
    """df with <text>_cleaned: normalized without rejecting, then preprocessed; blank texts give the empty text."""
    config = preset(dataset)
    norm = normalizer(config.steps, config.max_repeat)(F.col(text_col))
    d = df.withColumn("_norm", norm)
    return d.withColumn(f"{text_col}_cleaned", F.coalesce(preprocess(F.col("_norm.text"), stopwords, lemmatize), F.lit(""))).drop("_norm")


def long_document(text: Column, strategy: str = "truncate", size: int = 512, overlap: int = 50) -> Column:
    """The parts of a long text: its first ``size`` words, or windows that step by size - overlap until they start past the end."""
    words = matches(text, r"(\S+)", 1)
    if strategy in ("truncate", "summarize"):
        return F.array(F.array_join(F.slice(words, 1, size), " "))
    if strategy != "chunk":
        raise ValueError(f"unknown strategy {strategy}")
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(size - overlap))
    return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " "))).otherwise(F.array(F.lit("")))


def clean_domain(text: Column, preserve: list[str] | None = None) -> Column:
    """Lower case, everything but letters deleted, blanks collapsed; preserved terms come through untouched."""
    low = F.lower(text)
    terms = sorted({t.lower() for t in preserve or [] if t}, key=lambda t: (-len(t), t))
    if not terms:
        return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-z\s]", ""), r"\s+", " "))
    kept = "|".join("\\Q" + t + "\\E" for t in terms)
    pieces = F.regexp_extract_all(low, F.lit(rf"({kept})|[a-z\s]"), F.lit(0))
    return F.trim(F.regexp_replace(F.array_join(pieces, ""), r"\s+", " "))


def _sentences(text: Column, endings: str = ".!?", min_length: int = 1) -> Column:
    e = "|".join(endings)
    found = F.regexp_extract_all(text, F.lit(rf"(?md)([^{e}]+[{e}]+(?:\s+|$)|[^{e}]+$)"), F.lit(1))
    return F.filter(F.transform(found, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) >= min_length)


def _paragraphs(text: Column, min_length: int = 1) -> Column:
    return F.filter(F.transform(F.split(text, "\r\n\r\n|\n\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) >= min_length)


def segment(df: DataFrame, id_col: str, text_col: str, granularity: str = "sentence", min_length: int = 1) -> DataFrame:
    """(segment_id, text, parent_response_id, segment_type, position, original_text_length), one row a sentence or paragraph.

    Ids are R-S0, R-S1, ... or R-P0, ...; numbering follows the length filter. Terminators are . ! ? and |.
    """
    parts = {"sentence": _sentences, "paragraph": _paragraphs}[granularity](F.col(text_col), min_length=min_length)
    rid = F.col(id_col).cast("string")
    d = df.filter(F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(rid.alias("parent_response_id"), F.length(text_col).alias("original_text_length"), F.posexplode(parts).alias("position", "text"))
    mark = "-S" if granularity == "sentence" else "-P"
    return d.select(F.concat("parent_response_id", F.lit(mark), F.col("position").cast("string")).alias("segment_id"), "text", "parent_response_id", F.lit(granularity).alias("segment_type"), "position", "original_text_length")


def with_context(segments: DataFrame, window: int = 1) -> DataFrame:
    """segments with context_before and context_after: the neighbouring texts, NULL at the edges."""
    w = W.partitionBy("parent_response_id").orderBy("position")

    def side(frame) -> Column:
        return F.nullif(F.array_join(F.collect_list("text").over(frame), " "), F.lit(""))

    return segments.withColumn("context_before", side(w.rowsBetween(-window, -1))).withColumn("context_after", side(w.rowsBetween(1, window)))


def segment_hierarchical(df: DataFrame, id_col: str, text_col: str, min_length: int = 1) -> DataFrame:
    """Answer, paragraph and sentence rows; a sentence is R-P0-S0 and its position continues over the paragraphs of the answer."""
    base = df.filter(F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(F.col(id_col).cast("string").alias("r"), F.col(text_col).alias("t"))
    paragraphs = base.select("r", F.posexplode(_paragraphs(F.col("t"), min_length)).alias("p", "pt"))
    sentences = paragraphs.select("r", "p", F.posexplode(_sentences(F.col("pt"), min_length=min_length)).alias("s", "st"))
    pid = F.concat("r", F.lit("-P"), F.col("p").cast("string"))
    none = F.lit(None).cast("string")
    order = F.row_number().over(W.partitionBy("r").orderBy("p", "s")) - 1
    return (
        base.select(F.col("r").alias("segment_id"), F.col("t").alias("text"), F.col("r").alias("parent_response_id"), none.alias("parent_paragraph_id"), F.lit("response").alias("segment_type"), F.lit(0).alias("position"))
        .unionByName(paragraphs.select(pid.alias("segment_id"), F.col("pt").alias("text"), F.col("r").alias("parent_response_id"), none.alias("parent_paragraph_id"), F.lit("paragraph").alias("segment_type"), F.col("p").alias("position")))
        .unionByName(sentences.select(F.concat(pid, F.lit("-S"), F.col("s").cast("string")).alias("segment_id"), F.col("st").alias("text"), F.col("r").alias("parent_response_id"), pid.alias("parent_paragraph_id"), F.lit("sentence").alias("segment_type"), order.alias("position")))
    )


def filter_responses(df: DataFrame, text_col: str, id_col: str, remove_nulls: bool = True, remove_duplicates: bool = False, min_length: int = 5) -> DataFrame:
    """Texts that are not NULL, long enough and, on request, the first of their kind by id."""
    d = df.filter(F.col(text_col).isNotNull()) if remove_nulls else df
    if min_length > 0:
        d = d.filter(F.length(text_col) >= min_length)
    if remove_duplicates:
        first = d.groupBy(text_col).agg(F.min(id_col).alias(id_col))
        d = d.join(first.select(id_col), id_col, "left_semi")
    return d


def sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), the same under any partitioning: the smallest hashes of id and seed, renumbered from 1."""
    key = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    top = df.withColumn("_k", key).orderBy("_k", id_col).limit(n)
    return top.withColumn("sample_no", F.row_number().over(W.orderBy("_k", id_col)).cast("long")).drop("_k")
