"""Scalar text functions: Column expressions where Spark has them, one Arrow function where it has not."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordlists as L

BLANK = r"^[\s\x{a0}]*$"


def is_text(text: Column) -> Column:
    """True for texts that are neither NULL nor blank."""
    return text.isNotNull() & text.rlike(r"\S")


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def letters_tokens(text: Column, min_length: int = 1) -> Column:
    """Runs of a-z in the lower-cased text that touch no other letter, digit or underscore, of at least min_length letters."""
    tokens = matches(F.lower(text), r"(?<![\p{L}\p{N}_])([a-z]+)(?![\p{L}\p{N}_])", 1)
    return tokens if min_length <= 1 else F.filter(tokens, lambda t: F.length(t) >= min_length)


def word_tokens(text: Column) -> Column:
    """Unicode words of two or more characters, lower-cased."""
    return matches(F.lower(text), r"(?U)\b(\w\w+)\b", 1)


def ascii_words(text: Column, min_length: int = 2) -> Column:
    """Runs of a-z, the same in every engine."""
    return matches(F.lower(text), "([a-z]{%d,})" % min_length, 1)


def word_count(text: Column) -> Column:
    """Blank-separated words; NULL counts as none."""
    return F.coalesce(F.size(matches(text, r"(\S+)", 1)), F.lit(0))


def clean_multilingual(text: Column) -> Column:
    """Lower case, everything but Western letters to blanks, blanks collapsed: what the models are fed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-zß-öø-ÿ\s]", " "), r"\s+", " "))


def clean_ascii(text: Column, keep_digits: bool = True) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]" if keep_digits else r"[^a-z\s]", " "), r"\s+", " "))


def clean_twitter(text: Column, mentions: bool = True, urls: bool = True, repeats: bool = True, lower: bool = False, max_repeated: int = 3) -> Column:
    """Mentions to @user, links to http, stretched letters to at most max_repeated, blanks collapsed; NULL to the empty text."""
    x = F.coalesce(text, F.lit(""))
    if mentions:
        x = F.regexp_replace(x, r"(?U)@\w+", "@user")
    if urls:
        x = F.regexp_replace(x, r"https?://(?:[a-zA-Z0-9]|[$-_@.&+]|[!*\\(),]|%[0-9a-fA-F]{2})+|www\.(?:[a-zA-Z0-9]|[$-_@.&+]|[!*\\(),]|%[0-9a-fA-F]{2})+", "http")
    if repeats:
        x = F.regexp_replace(x, r"(.)\1{%d,}" % (max_repeated - 1), "$1" * max_repeated)
    x = F.lower(x) if lower else x
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def truncate(text: Column, width: int = 100, suffix: str = "...") -> Column:
    """At most width characters, the suffix among them."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - len(suffix)), F.lit(suffix))).otherwise(text)


def list_text(values: Column, limit: int | None = None) -> Column:
    """a, b, c; with a limit: a, b +n more."""
    values = F.coalesce(values, F.array().cast("array<string>"))
    if limit is None:
        return F.array_join(values, ", ")
    more = F.concat(F.lit(" +"), (F.size(values) - limit).cast("string"), F.lit(" more"))
    return F.concat(F.array_join(F.slice(values, 1, limit), ", "), F.when(F.size(values) > limit, more).otherwise(""))


def percentage(value: Column, decimals: int = 1) -> Column:
    """Shares up to 1 are taken as parts of one, larger values as percent."""
    return F.concat(F.format_number(F.when(value <= 1, value * 100).otherwise(value).cast("double"), decimals), F.lit("%"))


def confidence_band(value: Column) -> Column:
    return F.when(value >= 0.8, "high").when(value >= 0.5, "medium").when(value.isNotNull(), "low")


def duration(seconds: Column) -> Column:
    s = seconds.cast("double")
    return F.when(s < 60, F.concat(F.format_number(s, 1), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), F.floor(F.pmod(s, F.lit(60.0))).cast("string"), F.lit("s"))).otherwise(
        F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor(F.pmod(s, F.lit(3600.0)) / 60).cast("string"), F.lit("m"))
    )


def best_label(llm_label: Column, label: Column) -> Column:
    return F.coalesce(llm_label, label, F.lit("Unknown"))


def unknown_label(label: Column) -> Column:
    """Labels that stand for none: NULL, blank, unknown, n/a and their like."""
    return label.isNull() | F.lower(F.trim(label)).isin("unknown", "unlabeled", "n/a", "none", "")


def unknown_label_pattern(label: Column) -> Column:
    low = F.lower(F.trim(label))
    out = label.isNull()
    for p in L.UNKNOWN_LABELS:
        out = out | low.rlike(p)
    return out


def split_labels(label: Column, delimiter: str | None = None) -> Column:
    """The labels of one cell: by the delimiter, else by the first of , ; | that occurs; trimmed, empty ones dropped."""
    if delimiter is not None:
        parts = F.split(label, "\\Q" + delimiter + "\\E")
    else:
        parts = F.array(label)
        for d in reversed(L.LABEL_DELIMITERS):
            parts = F.when(F.contains(label, F.lit(d)), F.split(label, "\\Q" + d + "\\E")).otherwise(parts)
    return F.when(label.isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


NORMALIZED = T.StructType(
    [T.StructField("text", T.StringType())]
    + [T.StructField(k, T.IntegerType()) for k in ("unicode", "html", "urls", "mentions", "hashtags", "contractions", "elongations", "punctuation", "slang", "tokens", "emojis")]
)
_URL, _MENTION, _HASHTAG = re.compile(L.URL), re.compile(L.MENTION), re.compile(L.HASHTAG)
_STRETCHED, _MARKS = re.compile(L.STRETCHED), re.compile(L.MARKS)
_EMOJI = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in L.EMOJI) + "]")


def _table(words: dict[str, str]) -> tuple[re.Pattern, dict[str, str]]:
    longest_first = sorted(words, key=lambda w: (-len(w), w))
    return re.compile(r"\b(?:" + "|".join(map(re.escape, longest_first)) + r")\b", re.IGNORECASE), words


_CONTRACTED, _SLANGY = _table(L.CONTRACTIONS), _table(L.SLANG)

STEPS = ("unicode", "html", "whitespace", "urls", "mentions", "hashtags", "contractions", "elongations", "punctuation", "slang")


def normalize_text(text: str, steps: frozenset[str], max_repeat: int = 2) -> tuple:
    """One text through the enabled steps in their fixed order, with a counter for each."""
    n = dict.fromkeys(("unicode", "html", "urls", "mentions", "hashtags", "contractions", "elongations", "punctuation", "slang"), 0)
    if "unicode" in steps:
        x = unicodedata.normalize("NFKC", text)
        n["unicode"], text = int(x != text), x
    if "html" in steps:
        x = html.unescape(text)
        n["html"], text = int(x != text), x
    if "whitespace" in steps:
        text = " ".join(text.split())
    if "urls" in steps:
        text, n["urls"] = _URL.subn("<URL>", text)
    if "mentions" in steps:
        text, n["mentions"] = _MENTION.subn("<USER>", text)
    if "hashtags" in steps:
        text, n["hashtags"] = _HASHTAG.subn(r"\1", text)
    if "contractions" in steps:

        def long_form(m: re.Match) -> str:
            x = L.CONTRACTIONS[m.group().lower()]
            return x.capitalize() if m.group()[0].isupper() else x

        text, n["contractions"] = _CONTRACTED[0].subn(long_form, text)
    if "elongations" in steps:
        text, n["elongations"] = _STRETCHED.subn(lambda m: m.group(1) * max_repeat, text)
    if "punctuation" in steps:
        text, n["punctuation"] = _MARKS.subn(r"\1", text)
    if "slang" in steps:
        text, n["slang"] = _SLANGY[0].subn(lambda m: L.SLANG[m.group().lower()], text)
    return (text, *n.values(), len(text.split()), len(_EMOJI.findall(text)))


def normalizer(steps: frozenset[str] = frozenset(STEPS) - {"slang"}, max_repeat: int = 2):
    """Arrow function text -> struct of the normalized text and the counters; NULL stays NULL."""

    @F.pandas_udf(NORMALIZED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in NORMALIZED]
        for s in batches:
            rows = [normalize_text(x, steps, max_repeat) if isinstance(x, str) else (None,) * len(names) for x in s]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({k: "Int32" for k in names[1:]})

    return run
