"""Garbled text from wrong character encodings: precomputed sequences of all encoding pairs in one multi-pattern automaton, and lead and
continuation bytes by pattern, reading by reading, for all characters that are not in its table."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings in which UTF-8 bytes may have been read, in order of preference where two give the same sequence.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8_r", "cp866", "iso8859_15")
#: (written, read) pairs of one-byte encodings.
ONE_BYTE = (("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "mac_roman"), ("cp1252", "koi8_r"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"))
#: What the table holds: Latin, Greek, Cyrillic, punctuation, currency, kana; the Han block for HAN_READ_AS only.
WRITTEN = ((0x80, 0x250), (0x2C6, 0x2DE), (0x370, 0x460), (0x2010, 0x2045), (0x20A0, 0x20C0), (0x2100, 0x2124), (0x3000, 0x3100), (0xFEFF, 0xFF00), (0xFFFD, 0xFFFE))
HAN = (0x4E00, 0xA000)
HAN_READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251")
#: Letters of Cyrillic alphabets that stand at 0x80-0xBF of cp1251: alone between Latin words they are wrongly read punctuation.
ODD_CYRILLIC = "ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЁЄЇІіґёєјЅѕї"
#: Marks that are meant wherever they stand outside a word.
MEANT = "’‘“”„–…€£«»¡¿"
#: What is likely enough to be written in a one-byte encoding (fixed values).
WESTERN = "áéíóúàèìòùâêîôûäëïöüãõñçßåæøœÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜÃÕÑÇÅÆØŒ¡¿«»’‘“”„–…€£"
LOST = "�"
#: No sequence is shorter, or holds plain ASCII.
BESIDE = re.compile(r"[^\x00-\x7F]{2,}")
#: How often a text may have been garbled again.
ROUNDS = 4


def _read(data: bytes, encoding: str) -> str | None:
    """Bytes as a lenient reader shows them: what cp125x leaves open stays a control character."""
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            if not encoding.startswith("cp125"):
                return None
            out.append(chr(b))
    return "".join(out)


def sequences() -> dict[str, list[tuple[str, str]]]:
    """Garbled sequence -> [(pair, original)], for characters of several UTF-8 bytes."""
    table: dict[str, list[tuple[str, str]]] = {}
    for encoding in READ_AS:
        spans = [*WRITTEN, HAN] if encoding in HAN_READ_AS else WRITTEN
        shown = [_read(bytes([b]), encoding) if b >= 0x80 else None for b in range(256)]
        for lo, hi in spans:
            for code in range(lo, hi):
                c = chr(code)
                if unicodedata.category(c) in ("Cn", "Co"):
                    continue
                parts = [shown[b] for b in c.encode("utf-8")]
                if None in parts:
                    continue
                seen = table.setdefault("".join(parts), [])
                if all(o != c for _, o in seen):
                    seen.append((f"utf-8>{encoding}", "" if code == 0xFEFF else c))
    return table


def patterns() -> list[tuple[str, re.Pattern, dict[str, int]]]:
    """Per reading: its name, what a lead byte with its continuation bytes looks like in it, and the byte of each character shown."""
    out = []
    for encoding in READ_AS:
        byte = {c: b for b in range(0x80, 0x100) if (c := _read(bytes([b]), encoding)) is not None}
        some = lambda lo, hi: "[" + re.escape("".join(c for c, b in byte.items() if lo <= b < hi)) + "]"  # noqa: B023, E731
        rest = some(0x80, 0xC0)
        out.append((f"utf-8>{encoding}", re.compile(f"{some(0xF0, 0xF5)}{rest}{{3}}|{some(0xE0, 0xF0)}{rest}{{2}}|{some(0xC2, 0xE0)}{rest}"), byte))
    return out


def single_tables() -> dict[str, dict[str, str]]:
    """Per one-byte pair: shown character -> written character, where they differ."""
    out = {}
    for written, read in ONE_BYTE:
        t = {}
        for c in WESTERN:
            try:
                g = _read(c.encode(written), read)
            except UnicodeEncodeError:
                continue
            if g and g != c and ord(g) > 0x7F:
                t[g] = c
        out[f"{written}>{read}"] = t
    return out


def _latin(c: str) -> bool:
    return c.isalpha() and (c < "ɐ" or "Ḁ" <= c < "ἀ")


def _foreign_letter(c: str) -> bool:
    return c.isalpha() and not _latin(c)


class Repairer:
    """Built once in a worker; fix() restores one text and touches nothing but matched spans."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for g, origins in sequences().items():
            self.automaton.add_word(g, (len(g), g, origins))
        self.automaton.make_automaton()
        self.patterns = patterns()
        self.singles = single_tables()
        self.any_single = re.compile("[" + re.escape("".join({g for t in self.singles.values() for g in t})) + "]")

    def _natural(self, text: str, a: int, b: int, near: set[int]) -> bool:
        """Whether intact text explains a match: capitals before a closing mark, words of another script."""
        g = text[a:b]
        before, after = text[a - 1 : a], text[b : b + 1]
        if g[0] in "ÃÂ" and len(g) == 2 and before.isupper() and not g[1].isalpha() and not after.isalpha() and g[1] in "…“”’‘»–—™•":
            return True
        if all(_foreign_letter(c) for c in g):  # needs a Latin letter or another match beside it
            if before and _latin(before) or after and _latin(after) or a in near or b in near:
                return False
            return before.isalpha() or after.isalpha() or not any(c in ODD_CYRILLIC for c in g)
        if all(_latin(c) and c.islower() for c in g):
            return True
        return False

    def _sequences(self, text: str) -> tuple[str, Counter]:
        found = [(end - n + 1, end + 1, g, origins) for end, (n, g, origins) in self.automaton.iter_long(text)]
        more = self._unlisted(text)
        if not found and not more:
            return text, Counter()
        emoji = {i for a, b, _, _, how in more if how == 2 for i in range(a, b)}
        found = [x for x in found if emoji.isdisjoint(range(x[0], x[1]))]
        starts, ends = {x[0] for x in found}, {x[1] for x in found}
        kept = [x for x in found if not self._natural(text, x[0], x[1], (starts - {x[0]}) | (ends - {x[1]}))]
        if more:
            kept = self._with_unlisted(kept, [x for x in more if x[4] == 2 or not any(x[0] < y[1] and y[0] < x[1] for y in kept)])
        votes = Counter(pair for *_, origins in kept for pair, _ in origins)
        out, last, used = [], 0, Counter()
        for a, b, _, origins in kept:
            pair, original = max(origins, key=lambda o: votes[o[0]])
            out += (text[last:a], original)
            last = b
            used[pair] += 1
        return "".join((*out, text[last:])), used

    def _unlisted(self, text: str) -> list[tuple[int, int, str, list[tuple[str, str]], int]]:
        """(start, end, sequence, origins, how sure) of matches by pattern that are not in the table, without overlap: 2 for emoji
        and their kind and for whole words, 1 for what intact text does not hold, 0 for what it may: letters of one case, letters before closing marks."""
        spans: dict[tuple[int, int], tuple[list[tuple[str, str]], int]] = {}
        places = [m.span() for m in BESIDE.finditer(text)]
        for pair, pattern, byte in self.patterns if places else ():
            for m in chain.from_iterable(pattern.finditer(text, a, b) for a, b in places):
                g = m.group()
                data = bytes(byte[c] for c in g)
                try:
                    c = data.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if unicodedata.category(c) in ("Cn", "Co", "Cc") or g in self.automaton:
                    continue
                if data[:2] == b"\xf0\x9f":
                    how = 2
                elif g.isalpha():
                    how = int(any(x.islower() and y.isupper() for x, y in zip(g, g[1:])))
                else:
                    marks = all(x in MEANT or x in "•™—" or x.isspace() for x in g[1:])
                    inside = text[m.start() - 1 : m.start()].isalpha() and text[m.end() : m.end() + 1].islower()
                    how = int(len(g) > 2 and g[0] not in "„‚·‡‰" and (inside or not marks))
                origins, known = spans.setdefault(m.span(), ([], how))
                if all(o != c for _, o in origins):
                    origins.append((pair, c))
                spans[m.span()] = origins, max(known, how)
        out: list = []
        taken: set[int] = set()
        for (a, b), (origins, how) in sorted(spans.items(), key=lambda x: (-x[1][1], x[0][0] - x[0][1], x[0])):
            if taken.isdisjoint(range(a, b)):
                taken.update(range(a, b))
                out.append((a, b, text[a:b], origins, how))
        out.sort()
        runs: list[list] = []
        for x in out:
            if runs and runs[-1][-1][1] == x[0]:
                runs[-1].append(x)
            else:
                runs.append([x])
        # three side by side are a word: no listed sequence across two of them is meant
        return [(*x[:4], 2 if len(run) > 2 and not "".join(y[2] for y in run).isalpha() else x[4]) for run in runs for x in run]

    @staticmethod
    def _with_unlisted(kept: list, more: list) -> list:
        """Both together, in order. A run of matches side by side counts if one of them is sure, or if several are not letters only."""
        out, run = [], []
        for x in [*sorted([*((*k, 1) for k in kept), *more], key=lambda x: x[:2]), None]:
            if run and (x is None or x[0] != run[-1][1]):
                if any(y[4] for y in run) or len(run) > 1 and not "".join(y[2] for y in run).isalpha():
                    out += (y[:4] for y in run)
                run = []
            run.append(x)
        return out

    def _single(self, text: str) -> tuple[str, Counter]:
        """One-byte pairs: a character proves a pair where it cannot be meant (another script or a symbol within a Latin word);
        the pair that explains most such places is then applied to all its characters beside Latin letters."""
        proofs, spots = [], []
        for m in self.any_single.finditer(text):
            i, c = m.start(), m.group()
            x, y = text[max(i - 1, 0) : i], text[i + 1 : i + 2]
            left, right = bool(x) and _latin(x), bool(y) and _latin(y)
            if _foreign_letter(c):
                if left or right:
                    proofs.append((i, c))
                elif x.isalpha() or y.isalpha():
                    continue  # within a word of its own script
                elif c in ODD_CYRILLIC:
                    proofs.append((i, c))
            elif c in MEANT:
                if not (left and right) or c == "’":
                    continue
            elif not c.isalpha() and c not in "·°ªº®©™§¶†‡•¨´¸¯¹²³¼½¾":
                if left and right:
                    proofs.append((i, c))
            elif c in "ŽŸŠŒÆ" and x.islower() and y.islower():
                proofs.append((i, c))
            elif c.isalpha() and c not in "ßÆæ":
                continue  # an intact letter
            spots.append((i, c))
        if not proofs:
            return text, Counter()
        votes = Counter()
        for pair, table in self.singles.items():
            hits = [(i, table[c]) for i, c in proofs if c in table]
            if hits:
                letters = sum(o.isalpha() for _, o in hits)
                alike = sum(o.islower() == (text[max(i - 1, 0) : i] + text[i + 1 : i + 2]).strip().islower() for i, o in hits)
                votes[pair] = len(hits) * 10_000 + letters * 100 + alike * 10 + sum(c in table for _, c in spots) / len(spots)
        if not votes:
            return text, Counter()
        pair = max(votes, key=lambda p: votes[p])
        table, out, n = self.singles[pair], list(text), 0
        unsure = "ßÆæøåÅØ" if len(proofs) < 2 else ""
        for i, c in spots:
            if c in table and c not in unsure:
                out[i] = table[c]
                n += 1
        return "".join(out), Counter({pair: n})

    def fix(self, text: str) -> tuple[str, int, bool, str]:
        """(restored text, spans replaced, whether something is lost for good, pairs applied)."""
        if text.isascii():
            return text, 0, False, ""
        used: Counter = Counter()
        for _ in range(ROUNDS):
            text, hits = self._sequences(text)
            if not hits:
                break
            used += hits
        text, hits = self._single(text)
        used += hits
        return text, sum(used.values()), LOST in text, ",".join(sorted(used))


@functools.cache
def _repairer() -> Repairer:
    """One automaton a worker process, whatever the number of its tasks."""
    return Repairer()


def restore(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, spans, lost, pairs) of each record that was decoded wrongly, wholly or in places.

    Texts of plain ASCII cannot be garbled and are passed over before Python sees them, as are NULLs; empty tables give empty
    results. A record counts as found when a span was replaced or a replacement character shows that its original is lost.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repair = _repairer()
        for b in batches:
            rows = [(i, *repair.fix(t)) for i, t in zip(b["id"], b["text"], strict=True)]
            yield pd.DataFrame([r for r in rows if r[2] or r[3]], columns=["id", "text", "spans", "lost", "pairs"])

    texts = df.filter(F.col(text_col).rlike("[^\\x00-\\x7F]")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(texts.dtypes)["id"]
    return texts.mapInPandas(run, f"id {kind}, text string, spans long, lost boolean, pairs string")
