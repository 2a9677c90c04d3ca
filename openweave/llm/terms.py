"""Frequency of every term: burst tries count on each worker, adaptive prefixes route the subtrees, matching subtrees merge."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

TERM = re.compile(r"[a-z]{2,}")
#: Entries a container holds before it bursts into one container a next letter.
BURST = 512
#: Letters of the first-level routing prefix: at most 26**2 + 26**3 routes a group, whatever the vocabulary.
ROUTE_LETTERS = 3
#: Entries (over all workers) that one merge task takes; heavier prefixes are routed by further letters.
ROUTE_ENTRIES = 200_000


class BurstTrie:
    """Terms with an occurrence and a record counter. Inner nodes are prefixes; leaves are small hash containers of suffixes."""

    def __init__(self, burst: int = BURST) -> None:
        self.burst = burst
        self.inner: set[str] = set()
        self.boxes: dict[str, dict[str, list[int]]] = {"": {}}

    def _box(self, term: str) -> str:
        d, inner = 0, self.inner
        while term[:d] in inner and d < len(term):
            d += 1
        return term[:d] if term[:d] not in inner else term[:d] + "$"  # "$": the term that ends at an inner node

    def add(self, term: str, occurrences: int, records: int) -> None:
        at = self._box(term)
        box = self.boxes.get(at)
        if box is None:
            box = self.boxes[at] = {}
        suffix = term[len(at) :]
        x = box.get(suffix)
        if x is not None:
            x[0] += occurrences
            x[1] += records
            return
        box[suffix] = [occurrences, records]
        if len(box) > self.burst:
            self._split(at)

    def _split(self, at: str) -> None:
        box = self.boxes.pop(at)
        self.inner.add(at)
        for suffix, x in box.items():
            to = at + (suffix[0] if suffix else "$")
            child = self.boxes.setdefault(to, {})
            child[suffix[1:]] = x
        for c in {s[0] for s in box if s}:
            if len(self.boxes[at + c]) > self.burst:
                self._split(at + c)

    def items(self) -> Iterator[tuple[str, int, int]]:
        for at, box in self.boxes.items():
            head = at.removesuffix("$")
            for suffix, (o, r) in box.items():
                yield head + suffix, o, r

    def subtrees(self, letters: int) -> dict[str, list[tuple[str, int, int]]]:
        """The entries by their first letters, each list sorted: what a worker hands on."""
        out: dict[str, list[tuple[str, int, int]]] = {}
        for term, o, r in self.items():
            out.setdefault(term[:letters], []).append((term, o, r))
        for x in out.values():
            x.sort()
        return out


def pack(entries: list[tuple[str, int, int]]) -> tuple[bytes, bytes]:
    """Sorted terms as lengths shared with the one before and the rest; counters as 64-bit pairs."""
    parts, last = [], ""
    for term, _, _ in entries:
        n, m = 0, min(len(last), len(term), 255)
        while n < m and term[n] == last[n]:
            n += 1
        parts.append(chr(n + 256) + term[n:])
        last = term
    return "".join(parts).encode("utf-8"), np.array([x[1:] for x in entries], dtype="<i8").tobytes()


def unpack(terms: bytes, counts: bytes) -> Iterator[tuple[str, int, int]]:
    numbers = np.frombuffer(counts, dtype="<i8").reshape(-1, 2).tolist()
    last = ""
    for piece, (o, r) in zip(re.findall(r"[Ā-ǿ][a-z]*", terms.decode("utf-8")), numbers, strict=True):
        last = last[: ord(piece[0]) - 256] + piece[1:]
        yield last, o, r


def _count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tries: dict[str, BurstTrie] = {}
    totals: Counter = Counter()
    for b in batches:
        groups = b["grp"].tolist()
        occ: dict[str, Counter] = {}
        rec: dict[str, Counter] = {}
        for g, text in zip(groups, b["text"].tolist(), strict=True):
            found = TERM.findall(text.lower())
            totals[g] += 1
            if found:
                if g not in occ:
                    occ[g], rec[g] = Counter(), Counter()
                occ[g].update(found)
                rec[g].update(set(found))
        for g, counter in occ.items():
            trie = tries.setdefault(g, BurstTrie())
            r = rec[g]
            for term, n in counter.items():
                trie.add(term, n, r[term])
    rows = [(g, "", n, b"", b"") for g, n in totals.items()]
    for g, trie in tries.items():
        rows += [(g, key, len(x), *pack(x)) for key, x in trie.subtrees(ROUTE_LETTERS).items()]
    yield pd.DataFrame(rows, columns=["grp", "key", "n", "terms", "counts"])


def _router(light: dict[tuple[str, str], int], deep: dict[tuple[str, str], int]):
    """Gives each subtree its merge task: light prefixes share one, heavy ones are cut by further letters."""

    def route(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for g, key, n, terms, counts in b.itertuples(index=False):
                extra = deep.get((g, key))
                if extra is None:
                    rows.append((g, f"#{light[g, key]}", n, terms, counts))
                    continue
                parts: dict[str, list[tuple[str, int, int]]] = {}
                for e in unpack(terms, counts):
                    parts.setdefault(e[0][: ROUTE_LETTERS + extra], []).append(e)
                rows += [(g, k, len(x), *pack(x)) for k, x in parts.items()]
            yield pd.DataFrame(rows, columns=["grp", "route", "n", "terms", "counts"])

    return route


def _merge(b: pd.DataFrame) -> pd.DataFrame:
    trie = BurstTrie()
    for terms, counts in zip(b["terms"], b["counts"], strict=True):
        for e in unpack(terms, counts):
            trie.add(*e)
    out = pd.DataFrame(trie.items(), columns=["term", "occurrences", "records"])
    out.insert(0, "grp", b["grp"].iloc[0])
    return out


def term_counts(df: DataFrame, text_col: str, group_col: str) -> tuple[DataFrame, DataFrame]:
    """(grp, term, occurrences, records) of every term, and (grp, total) with the records that have a text.

    A term is a longest run of a-z in the lower-cased text, at least two letters long. NULL texts are no records; empty ones are
    records without terms. Terms as frequent as one wishes cost one entry a worker, so no key is hot. The routing histogram
    that comes to the driver has at most 26**2 + 26**3 rows a group.
    """
    texts = df.filter(F.col(text_col).isNotNull()).select(F.col(group_col).cast("string").alias("grp"), F.col(text_col).alias("text"))
    tries = materialize(texts.mapInPandas(_count, "grp string, key string, n long, terms binary, counts binary"), "tries")
    total = tries.filter("key = ''").groupBy("grp").agg(F.sum("n").alias("total"))
    weights = tries.filter("key <> ''").groupBy("grp", "key").agg(F.sum("n").alias("n")).orderBy("grp", "key").collect()
    light: dict[tuple[str, str], int] = {}
    deep: dict[tuple[str, str], int] = {}
    filled = task = 0
    for g, key, n in weights:
        if n > ROUTE_ENTRIES and len(key) == ROUTE_LETTERS:
            extra = 1
            while n > ROUTE_ENTRIES * 8**extra:  # a letter divides a prefix into about eight even parts
                extra += 1
            deep[g, key] = extra
            continue
        if filled + n > ROUTE_ENTRIES:
            task, filled = task + 1, 0
        light[g, key] = task
        filled += n
    routed = tries.filter("key <> ''").mapInPandas(_router(light, deep), "grp string, route string, n long, terms binary, counts binary")
    merged = routed.groupBy("grp", "route").applyInPandas(_merge, "grp string, term string, occurrences long, records long")
    return merged, total


def marked_terms(df: DataFrame, text_col: str, group_col: str, rare_below: int = 3, common_above: float = 0.1) -> DataFrame:
    """Every term with its counts and its mark: rare (in fewer records than rare_below), common (in more than that part), or NULL."""
    merged, total = term_counts(df, text_col, group_col)
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * F.col("total"), "common")
    # a row a group; each group has at least one merge task of its own, so this join never outgrows the terms
    return merged.join(total, "grp").select(F.col("grp").alias(group_col), "term", "occurrences", "records", mark.alias("mark"))
