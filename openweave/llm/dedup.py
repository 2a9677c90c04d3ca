"""Duplicates hidden by formatting: canonical form, 128-bit hash, counts with map-side combining, collision check."""

from __future__ import annotations

import unicodedata

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..skew import lookup_skewed

#: Characters that are mere formatting: Unicode punctuation, ASCII symbols, all white space (Java regex classes).
FORMATTING = r"[\p{P}\p{Z}\s\x{85}$+<=>^`|~]+"
#: Where a labelled field starts: the beginning or a separating mark, then one word and a colon, an equals sign or a spaced dash.
FIELD_START = r"(?:^|[\n\r\t;|,./•*]+|\s[-–—]\s)[\s*•\-]*(?=\p{L}+(?:\s*[:=](?!//)|\s+[-–—]\s))"
LABEL = r"^(\p{L}+)\s*[:=\-–—]"


def words(text: Column) -> Column:
    """Longest runs of letters or digits of any script, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def canonical(text: Column) -> Column:
    """The text without case, spacing and punctuation; the fields of a labelled answer are sorted. NULL stays NULL."""
    low = F.lower(text)
    fields = F.filter(F.transform(F.split(low, FIELD_START), lambda x: F.trim(x)), lambda x: F.regexp_replace(x, FORMATTING, "") != "")
    labels = F.transform(fields, lambda x: F.regexp_extract(x, LABEL, 1))
    labelled = (F.size(fields) >= 2) & ~F.array_contains(labels, "") & (F.size(F.array_distinct(labels)) == F.size(labels))
    bare = F.array_join(F.array_sort(F.transform(fields, lambda x: F.regexp_replace(x, FORMATTING, ""))), "\u0001")
    may_have_fields = low.rlike(r"^[\s*•\-\p{P}]*\p{L}+(?:\s*[:=]|\s+[-–—]\s)")
    return F.when(may_have_fields & labelled, bare).otherwise(F.regexp_replace(low, FORMATTING, ""))


#: The characters of FORMATTING, by their Unicode categories, for deletion in one pass.
_FORMATTING = {c: None for c in range(0x20000) if unicodedata.category(chr(c))[0] in "PZ" or chr(c) in " \t\n\x0b\x0c\r\x85$+<=>^`|~"}
_BARE = bytes(c for c in range(128) if c in _FORMATTING)
_FIELD_START = regex.compile(FIELD_START)
_LABEL = regex.compile(LABEL)
_MAY = regex.compile(r"[\s*•\-\p{P}]*\p{L}+(?:\s*[:=]|\s+[-–—]\s)")


def canonical_text(low: str) -> str:
    """canonical() of one lower-cased text, for operators that have the text in Python anyway."""
    if _MAY.match(low):
        fields = [f for x in _FIELD_START.split(low) if (f := x.strip(" ")) and f.translate(_FORMATTING)]
        labels = [m[1] if (m := _LABEL.match(f)) else "" for f in fields]
        if len(fields) >= 2 and "" not in labels and len(set(labels)) == len(labels):
            return "\u0001".join(sorted(f.translate(_FORMATTING) for f in fields))
    return low.encode().translate(None, _BARE).decode() if low.isascii() else low.translate(_FORMATTING)


def keyed(df: DataFrame, id_col: str, text_col: str, groups: list[str], min_words: int = 0, keep_text: bool = False) -> DataFrame:
    """(groups, id, h, c): the 128-bit hash of the canonical form and an independent 64-bit check; rows without text are left out."""
    rows = df.filter(F.col(text_col).isNotNull())
    if min_words > 1:
        rows = rows.filter(F.size(F.array_distinct(words(F.col(text_col)))) >= min_words)
    rows = rows.select(*groups, F.col(id_col).alias("id"), canonical(F.col(text_col)).alias("_k"), *([F.col(text_col).alias("text")] if keep_text else []))
    return rows.select(*groups, "id", F.unhex(F.md5("_k")).alias("h"), F.xxhash64("_k").alias("c"), *(["text"] if keep_text else []))


def collapse(keys: DataFrame, groups: list[str], *also) -> DataFrame:
    """One row per distinct answer: (groups, h, c, first_id, copies) and further aggregates.

    Grouped by hash and check together, so two texts of equal 128-bit hash never merge unseen. Partial aggregation merges copies
    before they are moved, so a group of copies that holds a third of all rows arrives as one row per task.
    """
    return keys.groupBy(*groups, "h", "c").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), *also)


def distinct_records(df: DataFrame, id_col: str, text_col: str, groups: list[str] | None = None, min_words: int = 0) -> DataFrame:
    """One record per distinct answer with its smallest id, its text as stored there and its number of copies.

    NULL texts are no records. If an id repeats, its rows count as copies and the smallest of its texts is given. An empty table
    gives an empty result; columns other than those named are ignored, whatever their names. Each distinct text is moved once.
    """
    groups = groups or []
    keys = keyed(df, id_col, text_col, groups, min_words, keep_text=True)
    return collapse(keys, groups, F.min(F.struct("id", "text")).alias("_first")).select(*groups, "first_id", F.col("_first.text").alias("text"), "copies")


def hash_collisions(keys: DataFrame, groups: list[str]) -> DataFrame:
    """Hashes under which more than one check value was seen: texts that a 128-bit hash alone would have merged."""
    per = keys.groupBy(*groups, "h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    return per.filter(F.col("lo") != F.col("hi"))


def copies(df: DataFrame, id_col: str, text_col: str, groups: list[str], min_words: int = 4) -> DataFrame:
    """(groups, first_id, copy_id) for every record that repeats an earlier one."""
    keys = materialize(keyed(df, id_col, text_col, groups, min_words), "canon")
    table = materialize(collapse(keys, groups).filter("copies > 1"), "copies")
    joined = lookup_skewed(keys, table, [*groups, "h", "c"], "copies", keys.count())
    return joined.filter("id <> first_id").select(*groups, "first_id", F.col("id").alias("copy_id"))
