"""Text that looks alike brought to one form: vocabulary tries searched with a weighted edit automaton, tables for the rest."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..skew import lookup_skewed

# Letters that look like Latin ones, alphabet by alphabet; the second line has the Latin letters meant.
ALIKE = (
    ("аеорсухіјѕԁһԛԝѵкӏьѡ", "aeopcyxijsdhqwvklbw"),
    ("АВЕКМНОРСТУХІЈЅԌԚԜѴӀҮҒ", "ABEKMHOPCTYXIJSGQWVIYF"),
    ("оαονρυιγκητχωϲϳεσμβ", "oaovpuiykntxwcjeoub"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),
    ("օոսհցզյքՕՏԼՍ", "onuhgqjpOSLU"),
    ("ɑɡıɩʏɪɴʀʙɢʜʟᴀᴄᴅᴇꜰᴊᴋᴍᴏᴘᴛᴜᴠᴡᴢ", "agiiyinrbghlacdefjkmoptuvwz"),
    ("ᎪᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃᏴᏟᎠᏀ", "AEHJKLMPRSTVWZBCDG"),
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
)
# Less exact readings, at a small cost each.
ALSO = {"ι": "l", "і": "l", "І": "l", "Ι": "l", "ı": "l", "η": "h", "υ": "v", "ν": "n", "γ": "v", "ѕ": "z", "ӏ": "i", "ь": "h", "μ": "m", "ω": "v", "σ": "a"}
ALSO_COST = 0.25
#: The automaton gives up above this cost; only look-alikes and ignorable characters are free, no letter is ever changed into another.
MAX_COST = 0.5
#: Vocabulary words of one trie at most: routes take further letters until none holds more.
TRIE_WORDS = 50_000
MAX_DEPTH = 24

TABLE = {a: b for x, y in ALIKE for a, b in zip(x, y, strict=True)}
#: Characters that show nothing: zero-width and format characters, fillers, variation selectors, tags.
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e01ef]")
#: White space that is neither the ordinary blank nor a tab or line end.
SPACES = re.compile("[   -     　]")
SPLIT = re.compile(r"""([\s!-/:-@\[-`{-~“”‘’„‚«»‹›–—―…•·¡¿]+)""")
STYLED = ("<font>", "<wide>", "<narrow>", "<circle>", "<square>")


def styled(c: str) -> str | None:
    """The plain form of a wide, narrow or styled form or a ligature of Latin letters; None for every other character."""
    how = unicodedata.decomposition(c)
    if how.startswith(STYLED) or how.startswith("<compat>") and ("ﬀ" <= c <= "ﬆ" or "Ⅰ" <= c <= "ⅿ"):
        plain = unicodedata.normalize("NFKC", c)
        return plain if plain.isascii() else None
    return None


def latin(c: str) -> bool:
    return c.isalpha() and (c.isascii() or unicodedata.name(c, "").startswith("LATIN") and c not in TABLE and styled(c) is None)


def _pictorial(text: str, i: int) -> bool:
    """Whether an invisible character belongs to an emoji: it follows one, directly or after other selectors and joiners."""
    j = i - 1
    while j >= 0 and (INVISIBLE.match(text[j]) or unicodedata.category(text[j]) == "Sk"):
        j -= 1
    return j >= 0 and (unicodedata.category(text[j]) == "So" or text[j] in "#*0123456789" and text[i] == "️")


def _needed(text: str, i: int) -> bool:
    """Joiners that other scripts need between their own letters (Arabic, Indic)."""
    return text[i] in "‌‍" and 0 < i < len(text) - 1 and all(text[k].isalpha() and 0x0590 <= ord(text[k]) < 0x1100 for k in (i - 1, i + 1))


def examine(token: str) -> tuple[bool, list[tuple[str, ...]], str] | None:
    """(certain, alternatives, form by table) of a token with a doubtful character; None for tokens that are as they look.

    certain: a character stands in for another whatever the vocabulary says. alternatives: per visible character the readings,
    the first of them free. Tokens wholly in another alphabet are uncertain: only a vocabulary word they look like makes them a case.
    """
    certain, foreign, own = False, False, False
    parts: list[tuple[str, ...]] = []
    kept: list[str] = []
    for i, c in enumerate(token):
        if c.isascii():
            own |= c.isalpha()
        elif INVISIBLE.match(c):
            if not _pictorial(token, i) and not _needed(token, i):
                certain = True
                continue
        elif "̀" <= c <= "ͯ":
            if kept:
                certain = True
                kept[-1] = unicodedata.normalize("NFC", kept[-1] + c)
                parts[-1] = (unicodedata.normalize("NFC", parts[-1][0] + c).lower(),)
                continue
        elif (plain := styled(c)) is not None:
            certain, own = True, own or plain.isalpha()
            kept.append(plain)
            parts += [(x,) for x in plain.lower()]
            continue
        elif c in TABLE:
            foreign |= not unicodedata.name(c, "").startswith("LATIN")
            certain |= unicodedata.name(c, "").startswith("LATIN")
            kept.append(TABLE[c])
            parts.append((TABLE[c].lower(), ALSO[c]) if c in ALSO else (TABLE[c].lower(),))
            continue
        elif latin(c):
            own = True
        kept.append(c)
        parts.append((c.lower(),))
    if not certain and not foreign:
        return None
    if foreign and own:
        certain = True
    form = unicodedata.normalize("NFC", "".join(kept))
    if foreign and not own:  # letters of a real foreign word stay as they are
        form = "".join(c for i, c in enumerate(token) if not INVISIBLE.match(c) or _pictorial(token, i) or _needed(token, i)) if certain else token
    return certain, parts, form


class Automaton:
    """A trie of vocabulary words, searched for all words that a token may be meant to be."""

    def __init__(self, words: Iterable[tuple[str, int]]) -> None:
        self.root: dict = {}
        for word, n in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = n

    def best(self, parts: list[tuple[str, ...]]) -> tuple[str, float] | None:
        """The cheapest, then most frequent word; the path is weighted by the readings taken."""
        states: list[tuple[dict, str, float]] = [(self.root, "", 0.0)]
        for readings in parts:
            after = []
            for node, word, cost in states:
                for k, c in enumerate(readings):
                    total = cost + ALSO_COST * (k > 0)
                    if total > MAX_COST:
                        continue
                    at = node
                    for x in c:
                        at = at.get(x) if at is not None else None
                    if at is not None:
                        after.append((at, word + c, total))
            states = after
            if not states:
                return None
        ends = [(cost, -node[""], word) for node, word, cost in states if "" in node]
        return (min(ends)[2], min(ends)[0]) if ends else None


def _like(form: str, word: str) -> str:
    """word in the letter case of form, letter by letter where the lengths agree."""
    if len(form) == len(word):
        return "".join(w.upper() if f.isupper() else w for f, w in zip(form, word, strict=True))
    return word.upper() if form.isupper() else word.capitalize() if form[:1].isupper() else word


def _routes(parts: list[tuple[str, ...]], depth: int) -> set[str]:
    """First letters, as far as ``depth``, of the readings the automaton can afford; words are routed by theirs."""
    heads = {("", 0.0)}
    for readings in parts[:depth]:
        heads = {(h + r, c + ALSO_COST * (k > 0)) if len(h) < depth else (h, c) for h, c in heads for k, r in enumerate(readings) if c + ALSO_COST * (k > 0) <= MAX_COST}
    return {h[:depth] for h, _ in heads}


def _finder(depth: int):
    def tokens(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for tbl, rec, text in b.itertuples(index=False):
                if SPACES.search(text):
                    rows.append((tbl, rec, " ", True, " ", []))
                for token in set(SPLIT.split(text)[::2]):
                    if token and not token.isascii() and (x := examine(token)) is not None:
                        rows.append((tbl, rec, token, x[0], x[2], sorted(_routes(x[1], depth))))
            yield pd.DataFrame(rows, columns=["tbl", "rec_id", "token", "certain", "form", "routes"])

    return tokens


def _depth(vocabulary: DataFrame) -> int:
    """Letters of a route: as few as keep every trie within TRIE_WORDS words; at least two."""
    for depth in range(2, MAX_DEPTH):
        most = vocabulary.groupBy(F.substring("word", 1, depth)).count().agg(F.max("count")).first()[0]
        if (most or 0) <= TRIE_WORDS:
            return depth
    return MAX_DEPTH


def _search(tokens: pd.DataFrame, vocabulary: pd.DataFrame) -> pd.DataFrame:
    rows = []
    if len(tokens):
        automaton = Automaton(zip(vocabulary["word"], vocabulary["n"], strict=True))
        for token, form in zip(tokens["token"], tokens["form"], strict=True):
            _, parts, _ = examine(token)
            hit = automaton.best(parts)
            if hit:
                plain = "".join(p[0] for p in parts)
                shape = form if len(form) == len(plain) else plain
                rows.append((token, _like(shape, hit[0]), hit[1]))
    return pd.DataFrame(rows, columns=["token", "word", "cost"])


def spellings(df: DataFrame, tbl: str, rec: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(uses, table): which record uses which doubtful token, and per distinct token its canonical form and whether it is a case.

    The vocabulary is every word of Latin letters in the texts themselves, however rare. Tokens and words meet by their first letters as
    they look, by so many that no trie holds more than TRIE_WORDS words; only distinct tokens are moved.
    """
    texts = df.filter(F.col(text).isNotNull()).select(F.col(tbl).alias("tbl"), F.col(rec).cast("string").alias("rec_id"), F.col(text).alias("text"))
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}\p{M}\p{Cf}])([a-zß-öø-ÿ]+)(?![\p{L}\p{M}\p{Cf}])"), F.lit(1))).alias("word"))
    vocabulary = materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "vocabulary")
    depth = _depth(vocabulary)
    vocabulary = vocabulary.withColumn("route", F.substring("word", 1, depth))
    doubtful = texts.filter(F.col("text").rlike("[^\\x00-\\x7F]"))
    uses = materialize(doubtful.mapInPandas(_finder(depth), "tbl string, rec_id string, token string, certain boolean, form string, routes array<string>"), "tokens")
    distinct = materialize(uses.groupBy("token").agg(F.first("certain").alias("certain"), F.first("form").alias("form"), F.first("routes").alias("routes"), F.count(F.lit(1)).alias("uses")), "distinct")
    routed = distinct.select("token", "form", F.explode("routes").alias("route"))
    found = routed.groupBy("route").cogroup(vocabulary.groupBy("route")).applyInPandas(_search, "token string, word string, cost double")
    best = found.groupBy("token").agg(F.min(F.struct("cost", "word")).alias("x"))
    table = distinct.join(best, "token", "left").select("token", F.coalesce("x.word", "form").alias("canonical"), (F.col("certain") | F.col("x").isNotNull()).alias("is_case"), "uses")
    return uses.select("tbl", "rec_id", "token"), materialize(table, "spellings")


def disguised(df: DataFrame, tbl: str, rec: str, text: str) -> DataFrame:
    """(tbl, rec_id) of texts in which a character stands in for another. NULL and plain ASCII texts are never cases."""
    uses, table = spellings(df, tbl, rec, text)
    cases = table.filter("is_case")
    return lookup_skewed(uses, cases, ["token"], "uses", uses.count()).select("tbl", "rec_id").distinct()


def _rewrite(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for text, pairs in zip(b["text"], b["pairs"], strict=True):
            forms = {p["token"]: p["canonical"] for p in pairs}
            parts = SPLIT.split(SPACES.sub(" ", text))
            out.append("".join(forms.get(x, x) for x in parts))
        yield pd.DataFrame({"tbl": b["tbl"], "rec_id": b["rec_id"], "text": b["text"], "normalized": out})


def normalized(df: DataFrame, tbl: str, rec: str, text: str) -> DataFrame:
    """(tbl, rec_id, text, normalized) of every text that is not NULL, in one form: texts that look alike are then equal."""
    uses, table = spellings(df, tbl, rec, text)
    texts = df.filter(F.col(text).isNotNull()).select(F.col(tbl).alias("tbl"), F.col(rec).cast("string").alias("rec_id"), F.col(text).alias("text"))
    cases = lookup_skewed(uses, table.filter("is_case").select("token", "canonical", "uses"), ["token"], "uses", uses.count())
    forms = cases.groupBy("tbl", "rec_id").agg(F.collect_list(F.struct("token", "canonical")).alias("pairs"))  # the tokens of one text
    changed = texts.join(forms, ["tbl", "rec_id"]).mapInPandas(_rewrite, "tbl string, rec_id string, text string, normalized string")
    same = texts.join(forms, ["tbl", "rec_id"], "left_anti").withColumn("normalized", F.col("text"))
    return changed.unionByName(same)
