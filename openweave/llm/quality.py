"""Per-document text statistics with repetition measures, and combined rules that tell prose from lists, tables and junk."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalike import INVISIBLE, TABLE

WORD = re.compile(r"[^\W_]+")
DIGITS = re.compile(r"\d+")
TAG = re.compile(r"</?[a-zA-Z][^>]*>")
BULLET = re.compile(r"^\s*(?:[-*•>+–]|\(?\d{1,3}[.):]|\d{1,3} -|[a-z][.)])\s+\S")
LABEL = re.compile(r"(?:^|[\n\r\t;|,./•*]\s*)[\s*•-]*([^\W\d_]+)\s*(?:[:=](?!//)|\s[-–—]\s)")
SEPARATORS = re.compile(r"\s*(?:[\n\r;|,]|\s/\s|\t)\s*")
COLUMNS = (("|", re.compile(r"\s*\|\s*")), ("\t", re.compile(r"\t")), ("  ", re.compile(r"\s{2,}")), (",", re.compile(r",")))
MACHINE = re.compile(r"0x[0-9a-fA-F]{4,}|\b\w+=\d+\b|\b[A-Z]\d{3,}\b|\[\d\d:\d\d:\d\d\]|https?\b|\w+\.(?:\w+/)+\S*|/\w+\?\w+=")
CLUMP = re.compile(r"[bcdfghjklmnpqrstvwxz]{5,}|q[^u\W]|^[^aeiouy]{3,}$|[jqxz][bcdfgkpqvxz]|[vw][bcdfgjkqxz]|[aeiou]{4,}")

#: The thresholds of the rules; each is a share unless it says otherwise.
MIN_CHARS = 20
PROSE_COMMON = 0.3
LIST_COMMON = 0.2
LETTERS = 0.55
VARIETY = 0.34
#: Share of the characters in lines or paragraphs said before, from which a text is boilerplate.
REPEATED = 0.3
COVERAGE = 0.5

STATS = (
    "n_chars long, n_words long, mean_word_length double, symbol_ratio double, digit_ratio double, common_share double, n_lines long,"
    " punctuated_lines double, bullet_lines double, duplicate_lines double, duplicate_paragraphs double, unique_words double, top2_coverage double,"
    " top3_coverage double, top4_coverage double, labels long, kind string"
)


def fold(text: str) -> str:
    """The text as it looks, for counting words only: compatibility forms, look-alike letters and invisible characters resolved."""
    text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
    return text if text.isascii() else "".join(TABLE.get(c, c) for c in text)


def _repeated(parts: list[str]) -> float:
    """Share of the characters in lines or paragraphs that are copies of an earlier one."""
    total = sum(map(len, parts))
    if len(parts) < 2 or not total:
        return 0.0
    seen: set[str] = set()
    again = 0
    for p in parts:
        if p in seen:
            again += len(p)
        seen.add(p)
    return again / total


def _coverage(words: list[str], n: int, letters: int) -> float:
    """Share of the letters that lie in occurrences of the most frequent repeated n-gram (0 if none repeats)."""
    if len(words) < n + 1 or not letters:
        return 0.0
    gram, count = Counter(zip(*(words[k:] for k in range(n)), strict=False)).most_common(1)[0]
    return min(1.0, count * sum(map(len, gram)) / letters) if count > 1 else 0.0


def _is_table(lines: list[str]) -> bool:
    """At least two lines of the same three or more cells, most of them short."""
    if len(lines) < 2:
        return False
    for mark, how in COLUMNS:
        if mark in lines[0]:
            cells = [how.split(x.strip()) for x in lines]
            width = Counter(map(len, cells)).most_common(1)[0]
            if width[0] >= 3 and width[1] >= max(2, 0.7 * len(lines)):
                flat = [c for row in cells for c in row]
                if sum(len(c.split()) <= 2 for c in flat) >= 0.8 * len(flat):
                    return True
    return False


def assess(text: str, common: frozenset[str]) -> tuple:
    """The statistics of one text and its verdict: prose, list, table, junk, boilerplate (prose lines or paragraphs repeated), or short (under MIN_CHARS without outer blanks)."""
    plain = text if text.isascii() else fold(text)
    body = plain.strip()
    words = WORD.findall(plain.lower())
    n = len(words)
    letters = sum(map(len, words))
    visible = len("".join(plain.split()))
    lines = [x.strip() for x in body.split("\n") if x.strip()]
    unique = len(set(words))
    share = sum(map(common.__contains__, words)) / n if n else 0.0
    digits = sum(map(len, DIGITS.findall(plain)))
    symbols = (visible - letters) / visible if visible else 0.0
    ends = sum(x[-1] in ".!?…\"”’)" for x in lines) / len(lines) if lines else 0.0
    bullets = sum(BULLET.match(x) is not None for x in lines) / len(lines) if lines else 0.0
    top = [_coverage(words, k, letters) if unique < n else 0.0 for k in (2, 3, 4)]
    twice = _repeated(lines), _repeated([p.strip() for p in re.split(r"\n\s*\n", body)] if "\n" in body else [])
    labels, kind = 0, "prose"
    if len(text.strip()) < MIN_CHARS:
        kind = "short"
    else:
        if ":" in body or "=" in body or " - " in body or "–" in body or "—" in body:
            labels = len({m.lower() for m in LABEL.findall(body)})
        kind = _verdict(body, words, n, unique, share, digits, letters, visible, lines, bullets, max(top), twice, labels)
    return (len(text), n, letters / n if n else 0.0, symbols, digits / visible if visible else 0.0, share, len(lines), ends, bullets, *twice, unique / n if n else 0.0, *top, labels, kind)


def _verdict(body, words, n, unique, share, digits, letters, visible, lines, bullets, top, twice, labels) -> str:
    alphabetic = (letters - digits) / visible if visible else 0.0
    if n == 0 or alphabetic < 0.3:
        return "table" if _is_table(lines) else "junk"
    if max(twice) > REPEATED and share >= LIST_COMMON and len(lines) >= 3:
        return "boilerplate"  # sentences, but the same ones again
    if n >= 5 and unique / n <= VARIETY and (top > COVERAGE or unique <= 3):
        return "junk"
    tags = TAG.findall(body) if "<" in body else []
    if len(tags) >= 2 and sum(map(len, tags)) > 0.3 * len(body):
        return "junk"
    if share < PROSE_COMMON:
        if _is_table(lines):
            return "table"
        machine = MACHINE.findall(body)
        if len(machine) >= 2 and (len(machine) >= 0.2 * n or len(machine) >= len(lines)) and share < 0.25:
            return "junk"
    if share >= LIST_COMMON:
        return "prose"
    starts = re.match(r"[\W_]*[^\W\d_]+\s*(?:[:=]|\s[-–—]\s)", body) is not None
    if labels >= 2 and starts and n / labels <= 9:
        return "list"
    if len(lines) >= 3 and bullets >= 0.6 and share < LIST_COMMON:
        return "list"
    items = [x for x in SEPARATORS.split(body) if WORD.search(x)]
    if len(items) >= 3 and n / len(items) <= 3.5 and share < 0.13:
        return "list"
    if alphabetic < LETTERS:
        return "junk"
    if max(twice) > COVERAGE:
        return "junk"
    if share == 0:
        mixed = sum(any(c.isdigit() for c in w) and not w.isdigit() for w in words)
        odd = sum(CLUMP.search(w) is not None for w in words)
        if mixed + odd >= 0.2 * n or letters / n > 13:
            return "junk"
    return "prose"


def statistics(df: DataFrame, keys: list[str], text_col: str, common_words: DataFrame, word_col: str = "word", limit: int = 100_000) -> DataFrame:
    """(keys, statistics, kind) of every text that is not NULL.

    The list of common words is an argument of the operator, not data: it is read with a bound of ``limit`` words and refused beyond.
    Empty texts have zeros and the verdict short. Repeated rows are judged each for itself; ratios of nothing are 0.
    """
    words = [r[0].lower() for r in common_words.filter(F.col(word_col).isNotNull()).select(word_col).limit(limit + 1).collect()]
    if len(words) > limit:
        raise ValueError(f"more than {limit} common words")
    common = frozenset(words)
    names = [c.split()[0] for c in STATS.split(",")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([assess(t, common) for t in b["_text"]], columns=names)
            for k in reversed(range(len(keys))):
                out.insert(0, keys[k], b[f"_{k}"].to_numpy())
            yield out

    texts = df.filter(F.col(text_col).isNotNull()).select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col(text_col).alias("_text"))
    kinds = dict(texts.dtypes)
    return texts.mapInPandas(run, ", ".join(f"`{k}` {kinds[f'_{i}']}" for i, k in enumerate(keys)) + ", " + STATS)


def not_prose(stats: DataFrame) -> DataFrame:
    return stats.filter(F.col("kind").isin("list", "table", "junk", "boilerplate"))
