"""Keyword coding: code frames, themes, categories, their counts and cross-tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from ..skew import small

EMPTY = "array<string>"
#: Keywords up to which a frame is compiled into one expression; beyond, one automaton a worker finds them. The result is the same.
COMPILED_KEYWORDS = 400


@dataclass(frozen=True)
class Code:
    code_id: str
    label: str
    keywords: tuple[str, ...] = ()
    description: str = ""
    parent: str | None = None


@dataclass(frozen=True)
class CodeFrame:
    """An ordered set of codes. Immutable: with_code and without return new frames; an updated code keeps its place."""

    codes: tuple[Code, ...] = ()

    def with_code(self, code_id: str, label: str, keywords: list[str] | tuple[str, ...] = (), description: str = "", parent: str | None = None) -> CodeFrame:
        new = Code(code_id, label, tuple(keywords), description, parent)
        if any(c.code_id == code_id for c in self.codes):
            return CodeFrame(tuple(new if c.code_id == code_id else c for c in self.codes))
        return CodeFrame((*self.codes, new))

    def without(self, code_id: str) -> CodeFrame:
        return CodeFrame(tuple(c for c in self.codes if c.code_id != code_id))

    @staticmethod
    def from_table(df: DataFrame, limit: int = 10_000) -> CodeFrame:
        """A frame from (code_id, label, description, keywords, parent), ordered by code_id; larger than ``limit`` is refused."""
        rows = df.select("code_id", "label", "description", "keywords", "parent").orderBy("code_id").limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"more than {limit} codes")
        return CodeFrame(tuple(Code(r[0], r[1] or "", tuple(k for k in r[3] or [] if k is not None), r[2] or "", r[4]) for r in rows))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, c.code_id, c.label, c.description, list(c.keywords), c.parent) for i, c in enumerate(self.codes)]
        return spark.createDataFrame(rows, "ord int, code_id string, label string, description string, keywords array<string>, parent string")

    def expression(self, text: Column, case_sensitive: bool = False, lowered: bool = False) -> Column:
        """The codes of a text: those of which any keyword occurs in it, as a substring, in frame order. NULL gives none.

        lowered: the text is in lower case already, so that it is lowered once and not once a keyword.
        """
        t = text if case_sensitive or lowered else F.lower(text)
        hits = []
        for c in self.codes:
            hit = F.lit(False)
            for k in c.keywords:
                hit = hit | F.contains(t, F.lit(k if case_sensitive else k.lower()))
            hits.append(F.when(hit, F.lit(c.code_id)))
        found = F.array_compact(F.array(*hits)) if hits else F.array().cast(EMPTY)
        return F.when(text.isNull(), F.array().cast(EMPTY)).otherwise(found)


def apply_codes(df: DataFrame, frame: CodeFrame, text_col: str, out: str = "codes", case_sensitive: bool = False) -> DataFrame:
    """df with the codes of its text, in frame order; a code applies if one of its keywords occurs in the text as a substring.

    Row by row, whatever the size of the frame: no id is needed, repeated rows and ids are coded each for itself.
    """
    if sum(len(c.keywords) for c in frame.codes) <= COMPILED_KEYWORDS:
        if case_sensitive:
            return df.withColumn(out, frame.expression(F.col(text_col), True))
        return df.withColumn("_low", F.lower(text_col)).withColumn(out, frame.expression(F.col("_low"), lowered=True)).drop("_low")
    return df.withColumn(out, _automaton(frame, case_sensitive)(F.col(text_col)))


def _automaton(frame: CodeFrame, case_sensitive: bool):
    """A function from text to codes that finds all keywords in one pass; an empty keyword occurs in every text."""
    ids = [c.code_id for c in frame.codes]
    of: dict[str, list[int]] = {}
    for i, c in enumerate(frame.codes):
        for k in c.keywords:
            of.setdefault(k if case_sensitive else k.lower(), []).append(i)
    always = of.pop("", [])

    @F.pandas_udf(EMPTY)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for k, codes in of.items():
            machine.add_word(k, codes)
        machine.make_automaton()
        for batch in texts:
            found = []
            for text in batch:
                if text is None:
                    found.append([])
                    continue
                hits = {i for _, codes in machine.iter(text if case_sensitive else text.lower()) for i in codes} | set(always)
                found.append([ids[i] for i in sorted(hits)])
            yield pd.Series(found)

    return find


def membership_counts(df: DataFrame, members: DataFrame, key: str, column: str) -> DataFrame:
    """(key, count) for every member of the dimension, zeros kept."""
    # the outer form keeps the optimizer from inferring a filter that would compute the list once more
    n = df.select(F.explode_outer(column).alias(key)).filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    return members.select(key).distinct().join(n, key, "left").select(key, F.coalesce("count", F.lit(0)).alias("count"))


def frame_summary(df: DataFrame, frame: CodeFrame, column: str = "codes") -> DataFrame:
    """Code, label, count, parent and number of keywords, zeros kept."""
    table = frame.table(df.sparkSession)
    return table.join(membership_counts(df, table, "code_id", column), "code_id").select("code_id", "label", "count", "parent", F.size("keywords").cast("long").alias("n_keywords"))


def hierarchy(frame: DataFrame) -> DataFrame:
    """(parent, children): one level, root for codes without a parent; children sorted."""
    return frame.groupBy(F.coalesce("parent", F.lit("root")).alias("parent")).agg(F.array_sort(F.collect_list("code_id")).alias("children"))


def ancestors(frame: DataFrame) -> DataFrame:
    """Extension: (code_id, ancestor, distance) of the forest, by one join a level until no code has a further ancestor.

    On a cycle a code's line ends before the code itself comes again. A frame is bounded where it is read, and so are its levels.
    """
    step = frame.select("code_id", F.col("parent").alias("ancestor")).filter("ancestor is not null")
    level, out = step.withColumn("distance", F.lit(1)), None
    up = step.select(F.col("code_id").alias("ancestor"), F.col("ancestor").alias("next"))
    levels = frame.count()
    for d in range(2, levels + 2):
        out = level if out is None else out.unionByName(level)
        level = level.join(up, "ancestor").select("code_id", F.col("next").alias("ancestor")).withColumn("distance", F.lit(d)).filter("code_id <> ancestor")
        if level.isEmpty():
            break
        level = materialize(level, "ancestors") if d % 8 == 0 else level
    return out


@dataclass(frozen=True)
class Theme:
    theme_id: str
    name: str
    codes: tuple[str, ...]
    description: str = ""


def identify_themes(df: DataFrame, themes: list[Theme], code_col: str = "codes", out: str = "themes") -> DataFrame:
    """df with the themes of each row: those that share a code with it, in definition order; no codes, no themes."""
    codes = F.coalesce(F.col(code_col), F.array().cast(EMPTY))
    hits = [F.when(F.arrays_overlap(codes, F.array(*map(F.lit, t.codes))), F.lit(t.theme_id)) for t in themes if t.codes]
    return df.withColumn(out, F.array_compact(F.array(*hits)) if hits else F.array().cast(EMPTY))


def coverage(df: DataFrame, column: str) -> DataFrame:
    """One row: percent of the rows whose list is not empty; 0 for an empty table or a missing column."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame([(0.0,)], "coverage double")
    return df.agg(F.coalesce(F.avg(F.when(F.size(F.coalesce(F.col(column), F.array())) > 0, 100.0).otherwise(0.0)), F.lit(0.0)).alias("coverage"))


def members_of(df: DataFrame, column: str, member: str) -> DataFrame:
    return df.filter(F.array_contains(F.coalesce(F.col(column), F.array().cast(EMPTY)), member))


@dataclass(frozen=True)
class Category:
    """Criteria, all of which must hold: any / all of codes and themes, least and most number of codes."""

    category_id: str
    name: str
    level: int = 1
    codes_any: tuple[str, ...] | None = None
    codes_all: tuple[str, ...] | None = None
    themes_any: tuple[str, ...] | None = None
    themes_all: tuple[str, ...] | None = None
    min_codes: int | None = None
    max_codes: int | None = None

    @staticmethod
    def at_level(categories: list[Category], level: int) -> list[Category]:
        """The categories of one level, in their order."""
        return [c for c in categories if c.level == level]

    def predicate(self, columns: list[str]) -> Column:
        """A criterion on a missing column fails; without criteria every row qualifies; any of nothing fails, all of nothing holds."""

        def values(name: str) -> Column:
            return F.coalesce(F.col(name), F.array().cast(EMPTY))

        out = F.lit(True)
        for name, any_of, all_of in (("codes", self.codes_any, self.codes_all), ("themes", self.themes_any, self.themes_all)):
            if any_of is not None:
                out = out & (F.arrays_overlap(values(name), F.array(*map(F.lit, any_of))) if any_of and name in columns else F.lit(False))
            if all_of is not None:
                out = out & ((F.size(F.array_except(F.array(*map(F.lit, all_of)).cast(EMPTY), values(name))) == 0) if name in columns else F.lit(False))
        if self.min_codes is not None:
            out = out & ((F.size(values("codes")) >= self.min_codes) if "codes" in columns else F.lit(False))
        if self.max_codes is not None:
            out = out & ((F.size(values("codes")) <= self.max_codes) if "codes" in columns else F.lit(False))
        return out


def categorize(df: DataFrame, categories: list[Category], out: str = "categories") -> DataFrame:
    hits = [F.when(c.predicate(df.columns), F.lit(c.category_id)) for c in categories]
    return df.withColumn(out, F.array_compact(F.array(*hits)) if hits else F.array().cast(EMPTY))


def category_summary(df: DataFrame, categories: list[Category], column: str = "categories") -> DataFrame:
    """Category, name, level and count, zeros kept (shown by level, then count)."""
    table = df.sparkSession.createDataFrame([(c.category_id, c.name, c.level) for c in categories], "category_id string, name string, level int")
    return table.join(membership_counts(df, table, "category_id", column), "category_id")


def cross_tabulation(df: DataFrame, first: str, second: str, column: str = "categories") -> DataFrame:
    """(has_first, has_second, count) of the combinations that occur."""
    values = F.coalesce(F.col(column), F.array().cast(EMPTY))
    return df.groupBy(F.array_contains(values, first).alias("has_first"), F.array_contains(values, second).alias("has_second")).agg(F.count(F.lit(1)).alias("count"))


def pairs(df: DataFrame, column: str, ordered: bool = False) -> DataFrame:
    """(a, b) of the members of each row's list, a < b; with ordered also b, a and the diagonal. Lists are made distinct first."""
    x = df.select(F.array_distinct(F.coalesce(F.col(column), F.array().cast(EMPTY))).alias("x"))
    both = x.select(F.explode_outer("x").alias("a"), "x").select("a", F.explode_outer("x").alias("b")).filter("a is not null and b is not null")
    return both if ordered else both.filter("a < b")


def cooccurrence(df: DataFrame, column: str, min_count: int = 2, total: DataFrame | None = None) -> DataFrame:
    """(a, b, count, percentage of all rows) of unordered pairs that occur together at least min_count times."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    counts = pairs(df, column).groupBy("a", "b").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= min_count)
    return counts.join(F.broadcast(n)).select("a", "b", "count", F.round(100.0 * F.col("count") / F.col("_n"), 6).alias("percentage"))


def cooccurrence_matrix(df: DataFrame, members: DataFrame, key: str, column: str) -> DataFrame:
    """(a, b, count) for all ordered pairs of members, zeros and the diagonal kept: the matrix in long form.

    The dimension is a frame or theme set, bounded where it was read; its square is what the result is.
    """
    m = members.select(F.col(key).alias("a")).distinct()
    square = m.join(small(m.withColumnRenamed("a", "b"), 10_000), F.lit(True))
    counts = pairs(df, column, ordered=True).groupBy("a", "b").agg(F.count(F.lit(1)).alias("count"))
    return square.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("count", F.lit(0)).alias("count"))


def frequency_table(df: DataFrame, members: DataFrame, key: str, column: str) -> DataFrame:
    """Count, percent of all rows and rank (1 for the most frequent; ties share the better rank) of every member."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    counts = membership_counts(df, members, key, column).join(F.broadcast(n))
    share = F.coalesce(F.try_divide(100.0 * F.col("count"), F.col("_n")), F.lit(0.0))
    return counts.select(key, "count", F.round(share, 6).alias("percentage"), F.rank().over(W.orderBy(F.desc("count"))).cast("long").alias("rank"))


def network(df: DataFrame, column: str, min_count: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, count) and edges (a, b, count) of the code graph."""
    nodes = df.select(F.explode(F.array_distinct(column)).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("count"))
    return nodes, cooccurrence(df, column, min_count).drop("percentage")


def tree(frame: DataFrame, counts: DataFrame, root: str = "All") -> DataFrame:
    """(id, parent, value) of a sunburst or treemap: a root row, then every code below its parent or the root."""
    body = frame.join(counts, "code_id", "left").select(F.col("code_id").alias("id"), F.coalesce("parent", F.lit(root)).alias("parent"), F.greatest(F.coalesce("count", F.lit(0)), F.lit(1)).alias("value"))
    top = body.agg(F.lit(root).alias("id"), F.lit("").alias("parent"), F.coalesce(F.sum("value"), F.lit(0)).alias("value"))
    return top.unionByName(body)
