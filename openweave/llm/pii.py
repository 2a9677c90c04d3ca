"""Personal data in free text: a semi-Markov conditional random field over whole spans, decoded by bounded-entity dynamic programming.

Candidate spans of bounded length are proposed for five types; every other span can only be outside, which scores 0. Names: every run of
up to three capitalised words, whatever stands beside it, and in any letter case the spans beside a cue or about a known given name.
A span's score is the sum of the weights of its features (shape of the whole span, words around it, letter case, known given names, endings). Decoding
chooses the best set of spans that do not overlap, so boundaries and types are settled together. The weights are learned here, from
sentences made by rule (TRAIN_SENTENCES of them, seeded), by gradient ascent on the likelihood with forward-backward sums.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalike import INVISIBLE, TABLE
from .pii_sentences import ORDINARY

TYPES = ("email", "phone", "id_number", "address", "name")
#: Training size, passes and step; with the seed they fix the model.
TRAIN_SENTENCES = 6000
#: Sentences with long rows of numbers, besides.
TRAIN_RUNS = 150
EPOCHS = 5
STEP = 0.35
DECAY = 1e-4
SEED = 20240131
#: A numeric span has at most so many digits and characters; its chunks are bounded by these alone.
MAX_DIGITS = 15
MAX_LENGTH = 26

# Words that say what stands beside them.
DIGIT_WORDS = "zero oh one two three four five six seven eight nine double"
STREET = "road rd street st lane ln avenue ave boulevard blvd drive dr court ct terrace close crescent square way row gardens grove hill mews park place parkway pkwy walk highway hwy quay rise view parade"
STREET_FIRST = "rue avenue boulevard chemin impasse quai place calle avenida via rua plaza piazza"
STREET_END = "straße strasse str gasse weg allee platz ring ufer damm"
UNIT = "flat apt apartment unit suite"
NAME_ROLES = "manager supervisor colleague boss technician agent neighbour neighbor doctor nurse teacher driver waiter waitress landlord receptionist dentist trainer assistant consultant engineer cashier clerk friend cousin brother sister husband wife partner son daughter mother father uncle aunt tutor coach chef guide host nanny director lawyer therapist plumber courier"
NAME_BEFORE = "ms mr mrs miss dr prof signed regards cc sincerely cheers attn dear wishes named yours best hi hello"
NAME_PAIRS = "spoke_with spoke_to spoken_with talked_to talked_with speak_with thanks_to name_is helped_by served_by ask_for asked_for called_by told_by met_with dealt_with"
NAME_AFTER = "handled helped served"
NAME_FROM = "accounting sales support hr finance marketing reception billing logistics management payroll it"

WORD = r"[^\W\d_]+(?:['’][^\W\d_]+)?"
NAME_WORD = rf"{WORD}(?:-{WORD})?"
EMAIL = re.compile(
    r"[\w+-]+(?:(?:\.|\s+dot\s+|\s?[(\[]dot[)\]]\s?)[\w+-]+)*"
    r"(?:\s?@\s?|\s?[(\[]\s?at\s?[)\]]\s?|\s+at\s+(?=[\w-]+\s+dot\s|[\w-]+\s?[(\[]dot))"
    r"(?P<domain>[\w-]+(?:(?:\.|\s+dot\s+|\s?[(\[]dot[)\]]\s?)[\w-]+)+)",
    re.IGNORECASE,
)
NUMBERISH = re.compile(r"\S*\d\S*|(?<!\S)[A-Za-z]{1,2}(?=[\s.,!?;:)]|$)")
SPELT = re.compile(rf"\b(?:{'|'.join(DIGIT_WORDS.split())})(?:[\s-]+(?:{'|'.join(DIGIT_WORDS.split())})){{5,14}}\b", re.IGNORECASE)
_S, _SF, _SE, _U = ("|".join(x.split()) for x in (STREET, STREET_FIRST, STREET_END, UNIT))
_TAIL = rf"(?:,?\s+(?:{_U})\.?\s*\d+\w?)?(?:,\s+{WORD}\b(?:\s+{WORD}\b)?(?:\s+\d{{4,5}}\b|\s+[a-z]{{1,2}}\d{{1,2}}[a-z]?\s+\d[a-z]{{2}}\b)?)?"
ADDRESS = tuple(
    (k, re.compile(p, re.IGNORECASE))
    for k, p in (
        ("street", rf"(?:\b(?:{_U})\.?\s*\d+\w?,\s*)?\b\d{{1,4}}[a-z]?\s+(?:{WORD}\s+){{1,3}}?(?:{_S})\b\.?(?!-){_TAIL}"),
        ("long", rf"(?:\b(?:{_U})\.?\s*\d+\w?,\s*)?\b\d{{1,4}}[a-z]?\s+(?:{WORD}\s+){{2,3}}(?:{_S})\b\.?(?!-){_TAIL}"),
        ("longbare", rf"\b\d{{1,4}}[a-z]?\s+(?:{WORD}\s+){{2,3}}(?:{_S})\b(?!-)"),
        ("dot", rf"\b\d{{1,4}}[a-z]?\s+(?:{WORD}\s+){{1,3}}?(?:{_S})\."),
        ("bare", rf"\b\d{{1,4}}[a-z]?\s+(?:{WORD}\s+){{0,3}}?(?:{_S})\b(?!-)"),
        ("unit", rf"\b\d{{1,4}}[a-z]?\s+(?:{WORD}\s+){{1,3}}?(?:{_S})\b\.?,?\s+(?:{_U})\.?\s*\d+\w?"),
        ("first", rf"\b\d{{1,4}}[a-z]?(?:\s?(?:bis|ter))?,?\s+(?:{_SF})\s+(?:de\s+la\s+|de\s+l['’]|des\s+|du\s+|de\s+|di\s+|da\s+)?{WORD}(?:-{WORD})*"),
        ("first2", rf"\b\d{{1,4}}[a-z]?(?:\s?(?:bis|ter))?,?\s+(?:{_SF})\s+{WORD}\s+{WORD}"),
        ("after", rf"\b(?:{_SF})\s+(?:de\s+la\s+|de\s+|del\s+|di\s+|da\s+)?{WORD}(?:\s+{WORD})?,?\s+\d{{1,4}}[a-z]?\b"),
        ("aftertown", rf"\b(?:{_SF})\s+(?:de\s+la\s+|de\s+|del\s+|di\s+|da\s+)?{WORD}(?:\s+{WORD})?,?\s+\d{{1,4}}[a-z]?,\s+{WORD}(?:\s+{WORD})?"),
        ("aftertown1", rf"\b(?:{_SF})\s+(?:de\s+la\s+|de\s+|del\s+|di\s+|da\s+)?{WORD}(?:\s+{WORD})?,?\s+\d{{1,4}}[a-z]?,\s+{WORD}"),
        ("joined", rf"\b{WORD}(?:{_SE})\.?\s+\d{{1,4}}(?:\s?[a-z])?\b"),
        ("joined", rf"\b{WORD}(?:{_SE})\.?\s+\d{{1,4}}\b"),  # "Bergplatz 28 I ...": the letter may be the next word
        ("box", r"\b(?<!o\. )(?<!o )box\s+\d{2,6}\b"),
        ("street1", rf"\b\d{{1,4}}[a-z]?\s+(?:{WORD}\s+){{1,3}}?(?:{_S})\b\.?,\s+{WORD}"),
        ("pobox", r"\bp\.?\s*o\.?\s*box\s+\d{1,6}\b"),
        ("pobox1", rf"\bp\.?\s*o\.?\s*box\s+\d{{1,6}}\b,\s+{WORD}"),
        ("pobox2", rf"\bp\.?\s*o\.?\s*box\s+\d{{1,6}}\b,\s+{WORD}\s+{WORD}"),
    )
)
#: Cheap necessary conditions: a text that meets none of them has no candidate that could score above 0.
WORDS = re.compile(r"[^\W\d_]+")
DIGIT = re.compile(r"\d")
_LETTERS = bytes(c if 97 <= c <= 122 else 32 for c in range(256))
NUMBER_GATE = re.compile(r"\d[\d\s().,/-]{4,}\d|\d{5}|[A-Za-z]\d\d[A-Za-z]?\d{2}|[A-Za-z]\d{3}-\d|[A-Za-z]{2}\s\d\d\s\d\d")
SPELT_GATE = re.compile(rf"\b(?:{'|'.join(DIGIT_WORDS.split())})[\s-]+(?:{'|'.join(DIGIT_WORDS.split())})[\s-]+(?:{'|'.join(DIGIT_WORDS.split())})\b")
JOINED_GATE = re.compile(rf"(?:{_SE})\.?\s+\d")
STREET_WORDS = frozenset(f"{STREET} {STREET_FIRST} box".split())
NUMBER_WORDS = frozenset(DIGIT_WORDS.split())
NAME_WORDS = frozenset(f"{NAME_BEFORE} handled {' '.join(x.split('_')[0] for x in NAME_PAIRS.split())} {NAME_FROM}".split())
ROLES = frozenset(NAME_ROLES.split())
#: Who is spoken of, and the word that follows.
ROLE_NEXT = re.compile(rf"\b(?:{'|'.join(NAME_ROLES.split())}),? \(?([^\W\d_]+)")
#: Two capitalised words in a row, or one after a word that people often follow.
PERSON_AFTER = frozenset("with by to from ask asked contact call met saw told thank named called am is and".split())
CAPITALS = re.compile(rf"\b[A-ZÀ-Þ](?:\.|[^\W\d_]*,?) [A-ZÀ-Þ]|\b(?:{'|'.join(sorted(PERSON_AFTER))}) \(?[A-ZÀ-Þ][^\W\d_A-Z]")
INNER = re.compile(r"(?<![.!?]) \(?[A-ZÀ-Þ](?!(?:['’]\w+)? )")
ODD_CASE = re.compile(r"[a-zß-ÿ][A-ZÀ-Þ]")
UPPER, LOWER = re.compile(r"\b[A-ZÀ-Þ]"), re.compile(r"\b[a-zß-ÿ]")
#: What a number of a person may be called, and what other numbers are called.
ID_WORDS = frozenset("ssn social security insurance ni nino passport identity id card tax licence license driving driver national".split())
CALL_WORDS = frozenset("call phone tel telephone mobile cell fax ring text whatsapp number contact reach dial".split())
OTHER_WORDS = frozenset("order ticket invoice serial sku part tracking code model batch version voucher barcode page room catalogue iso row box err points cost price".split())
TOKEN = re.compile(rf"{WORD}|\d+|[^\w\s]")
NAME_TOKEN = re.compile(rf"{NAME_WORD}|\d+|[^\w\s]")
FUNCTION = frozenset(
    "a an the and or but if of to in on at by for with from as is was are were be been it its this that these those he she they we you i my our your his her their me us them not no so too very "
    "said has had have who which what when where why how than then there here all any some every each another other more most one two such"
    " within between across before after during since despite against under over near past upon without through throughout until while yet once per via off out up down into onto about around among behind beyond beside besides because although though whereas whether unless instead outside inside again thanks anyway whenever wherever".split()
)
SAID = frozenset("said told called replied wrote answered explained promised sent gave took refused came".split())
#: Endings of adverbs, adjectives, verbs and nouns that are no names.
DERIVED = re.compile(r"(?:ly|ed|ing|ous|ful|able|ible|less|ness|ment|tion|sion|ity|ive|ish|ical|ance|ence)$")


#: Look-alike letters and odd spaces, one for one.
PLAIN = {ord(a): b for a, b in TABLE.items()} | dict.fromkeys((0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000), " ")
MARKS = re.compile("[\u0300-\u036f\ufb00-\ufb06]|" + INVISIBLE.pattern)


def fold(text: str) -> tuple[str, list[int] | None]:
    """The text as it looks, and for each of its characters the place in the original; None if nothing changed."""
    if text.isascii():
        return text, None
    swapped = text.translate(PLAIN)
    if len(swapped) == len(text) and not MARKS.search(swapped):
        folded = unicodedata.normalize("NFKC", swapped)
        if len(folded) == len(text):  # one character for one: places stay
            return folded, None
    out, at = [], []
    for i, c in enumerate(text):
        if INVISIBLE.match(c):
            continue
        for x in unicodedata.normalize("NFKC", TABLE.get(c, c)):
            out.append(" " if x.isspace() and x not in "\n\t\r" else x)
            at.append(i)
    at.append(len(text))
    return "".join(out), at


def shape(span: str) -> str:
    """Digits as 9, letters as A, blanks as one blank: the form of a number."""
    return re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "9", re.sub(r"\s+", " ", span)))


def _case(word: str) -> str:
    return "A" if word.isupper() and len(word) > 1 else "I" if word.isupper() else "a" if word.islower() else "Aa" if word[:1].isupper() and word[1:].islower() else "x"


def _around(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    """Up to three tokens before and after, in lower case."""
    before = [t.lower() for t in TOKEN.findall(text[max(0, a - 48) : a])][-3:]
    after = [t.lower() for t in TOKEN.findall(text[b : b + 40])][:3]
    return ["^"] * (3 - len(before)) + before, after + ["$"] * (3 - len(after))


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while b > a and text[b - 1] in ".,;:!?\"'>":
        b -= 1
    while a < b and text[a] in "\"'<,;:#":
        a += 1
    if b - a > 6 and text[a] == "(" and text[b - 1] == ")" and "(" not in text[a + 1 : b]:
        return a + 1, b - 1
    if text[a:b].count("(") > text[a:b].count(")") and text[a] == "(":
        a += 1
    if text[a:b].count(")") > text[a:b].count("(") and text[b - 1] == ")":
        b -= 1
    return a, b


def candidates(text: str, given: frozenset[str]) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """(start, end, type, features of the whole span) of every span worth scoring; bounded by the text's chunks."""
    out: dict[tuple[int, int, str], tuple[str, ...]] = {}

    def add(a: int, b: int, kind: str, features: list[str]) -> None:
        before, after = _around(text, a, b)
        p = before[1] if before[2] in ":,." else before[2]
        context = [f"p1={before[2]}", f"p2={before[1]} {before[2]}", f"n1={after[0]}", f"n2={after[0]} {after[1]}", f"p3={before[1]}"]
        if kind == "name":
            case = _case(re.sub(r"[^A-Za-z]", "", text[a:b]))
            start = before[2] in "^.!?" or a > 0 and text[a - 1] == "\n"
            context += [f"pc={p}|{case}", f"pcn={p}|{case}|{after[0]}", f"start={start}|{case}", f"role={before[2] in ROLES or before[1] in ROLES and before[2] in ',(' }|{case}|{before[1] in FUNCTION}", f"next={after[0] in AFTER}|{after[0] in SAID}|{after[0].isdigit()}|{after[0] in FUNCTION}", f"the={p in ARTICLES}|{case}", f"copula={after[0] in COPULA}|{start}"]
        elif kind in ("phone", "id_number"):
            near = {t.lower() for t in WORDS.findall(text[max(0, a - 60) : a])[-6:]}
            later = {t.lower() for t in WORDS.findall(text[b : b + 40])[:5]}
            context += [f"id={not near.isdisjoint(ID_WORDS)}|{not later.isdisjoint(ID_WORDS)}", f"call={not near.isdisjoint(CALL_WORDS)}", f"other={not near.isdisjoint(OTHER_WORDS)}"]
            context.append(f"called={context[-3][3:]}{context[-2][5:]}{context[-1][6:]}")
        out[a, b, kind] = tuple(f"{kind}|{f}" for f in ["", *features, *context])

    low = text.lower()
    words = frozenset(low.encode().translate(_LETTERS).decode().split() if low.isascii() else WORDS.findall(low))
    digits = DIGIT.search(text) is not None
    if "@" in text or "at" in words and "dot" in words or "[at]" in low or "(at)" in low:
        at = 0
        while m := EMAIL.search(text, at):
            at = m.start("domain")  # "reach me at ada dot halv at mailhut dot test": what follows an at may be the address
            span = m.group()
            last = re.split(r"[.\s)\]]", span)[-1]
            plain = "@" in span and " " not in span
            add(m.start(), m.end(), "email", [f"plain={plain}", f"tld={last.isalpha() and 2 <= len(last) <= 12}", f"digits={span[0].isdigit()}", "at" if "@" in span else "spelt"])
    if len(words & NUMBER_WORDS) > 1 and SPELT_GATE.search(low):
        for m in SPELT.finditer(text):
            add(m.start(), m.end(), "phone", ["spelt", f"words={min(len(m.group().split()), 12)}"])
    if digits and NUMBER_GATE.search(text):
        _numbers(text, add)
    if digits and (not words.isdisjoint(STREET_WORDS) or JOINED_GATE.search(low)):
        for how, pattern in ADDRESS:
            for m in pattern.finditer(text):
                a, b = m.start(), m.end()
                add(a, b, "address", [f"form={how}", *(f"way={w}" for w in WORDS.findall(m.group().lower()) if w in STREET_WORDS), f"tail={text[b : b + 1] == '-'}", f"zip={bool(re.search(r'[0-9]{4,}$', m.group()))}", f"function={any(w in FUNCTION for w in WORDS.findall(m.group().lower().partition(',')[2]))}"])
    capitals = INNER.search(text) is not None and CAPITALS.search(text) is not None
    if capitals:  # in a text written in capitals, with a capital on every word or in mixed case, capitals tell nothing
        upper = len(UPPER.findall(text))
        capitals = (upper < 4 or upper < len(LOWER.findall(text))) and len(ODD_CASE.findall(text)) < 3
    if capitals or not words.isdisjoint(NAME_WORDS) or not words.isdisjoint(given) or not words.isdisjoint(ROLES) and any(_personal(w, given) for w in ROLE_NEXT.findall(low)):
        _names(text, given, add, capitals)
    return [(a, b, kind, f) for (a, b, kind), f in out.items()]


def _numbers(text: str, add) -> None:
    chunks = [_trim(text, m.start(), m.end()) for m in NUMBERISH.finditer(text)]
    chunks = [c for c in chunks if c[0] < c[1]]
    numeric = [text[a:b].strip("()+").isdigit() for a, b in chunks]
    for i, (a, _) in enumerate(chunks):
        for j in range(i, len(chunks)):
            b = chunks[j][1]
            if j > i and (text[chunks[j - 1][1] : chunks[j][0]].strip(" \t") not in ("", "(")):
                break
            span = text[a:b]
            digits = sum(c.isdigit() for c in span)
            if digits > MAX_DIGITS or len(span) > MAX_LENGTH:
                break
            if digits < 5 or "@" in span or "<" in span or "=" in span or span[:1] == "[":
                continue
            near = i > 0 and numeric[i - 1] and not text[chunks[i - 1][1] : a].strip() or j + 1 < len(chunks) and numeric[j + 1] and not text[b : chunks[j + 1][0]].strip()
            s = shape(span)
            letters = sum(c.isalpha() for c in span)
            head = ("" if span[0].isalnum() else span[0]) + ("0" if span.lstrip("+(").startswith("0") else "")
            features = [f"shape={s}", f"digits={digits}", f"letters={min(letters, 8)}", f"near={near}", f"groups={s.count(' ') + s.count('-')}", f"head={head}", f"odd={ODD.search(span) is not None}", f"hex={span[:2] in ('0x', '0X')}", f"gap={GAP.search(span) is not None}"]
            if letters <= 2:
                add(a, b, "phone", features)
            add(a, b, "id_number", features)


BEFORE, PAIRS, AFTER, FROM = (frozenset(x.split()) for x in (NAME_BEFORE, NAME_PAIRS, NAME_AFTER, NAME_FROM))
ARTICLES = frozenset("the a an this that every each no another our my your his her their its".split())
COPULA = frozenset("is was were are be has had did will would never and who".split())
MIXED = re.compile(r"(?:[^\W\d_]['’]|Ma?c|De|Di|Van|Le|La)?[A-Z][a-zß-ÿ'’]*")
#: Capitalised words that never belong to a name by themselves.
NEVER = frozenset("i monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december".split())
ODD = re.compile(r"[^0-9A-Za-z ()+./-]")
GAP = re.compile(r"\s{2,}|\n")


def _personal(word: str, given: frozenset[str]) -> bool:
    """Whether a word in lower case may begin a name."""
    return word in given or word[0].isalpha() and not (word in FUNCTION or word in COPULA or word in AFTER or word in ORDINARY or DERIVED.search(word))


def _names(text: str, given: frozenset[str], add, tells: bool) -> None:
    tokens = [(*m.span(), m[0]) for m in NAME_TOKEN.finditer(text)]
    low = [t[2].lower() for t in tokens]
    n = len(tokens)
    starts: dict[int, bool] = {}  # where a name may begin: after a cue (True), before one, about a known given name or capitalised
    caps: set[int] = set()
    roles: set[int] = set()
    for i, w in enumerate(low):
        if w in ROLES:  # a name follows at once, after a comma or in brackets; an everyday word does not begin one
            k = i + 1
            while k < n and low[k] in ",(":
                k += 1
            if k < n and _personal(low[k], given) and "\n" not in text[tokens[i][1] : tokens[k][0]]:
                starts[k] = True
                roles.add(k)
        elif i and f"{low[i - 1]}_{w}" in PAIRS:
            if i + 1 < n and (_personal(low[i + 1], given) or tells and tokens[i + 1][2][0].isupper()):
                starts[i + 1] = True
        elif w in BEFORE:
            if i + 1 < n and low[i + 1] in ":,.":
                starts[i + 2] = True
            else:
                starts[i + 1] = True
        if w in AFTER or w == "from" and i + 1 < n and low[i + 1] in FROM:
            for k in range(max(0, i - 4), i):
                starts.setdefault(k, False)
        if w in given:
            for k in range(max(0, i - 3), i + 1):
                starts.setdefault(k, False)
    if tells:  # every run of capitalised words, and single ones where a person is likely to follow
        capital = [t[2][0].isupper() and w not in NEVER and (t[2][1:].islower() or t[2].isupper() or MIXED.fullmatch(t[2]) is not None) for t, w in zip(tokens, low, strict=True)]
        for i in range(n):
            if capital[i] and (low[i] not in FUNCTION or len(low[i]) == 1 and i + 1 < n and low[i + 1] == "."):
                if i + 1 < n and (capital[i + 1] or (low[i + 1] == "," or low[i + 1] == "." and len(low[i]) == 1) and i + 2 < n and capital[i + 2]) or i and low[i - 1] in PERSON_AFTER:
                    caps.add(i)
                    starts.setdefault(i, False)
    for i, cue in sorted(starts.items()):
        if i >= n:
            continue
        word = tokens[i][2]
        if not word[0].isalpha() or "@" in text[tokens[i][0] - 1 : tokens[i][0]]:
            continue
        ends = [i + 1]  # W
        if i + 1 < n and tokens[i + 1][2][0].isalpha():
            ends.append(i + 2)  # W W
        if i + 2 < n and low[i + 1] == "." and len(word) == 1 and tokens[i + 2][2][0].isalpha():
            ends.append(i + 3)  # X. W
        elif len(word) == 1 and i + 1 < n and low[i + 1] == ".":
            ends.append(i + 2)  # X.
        if i + 2 < n and low[i + 1] == "," and tokens[i + 2][2][0].isalpha() and text[tokens[i + 1][1]].isspace():
            ends.append(i + 3)  # W, W
        if i + 3 < n and len(low[i + 1]) == 1 and tokens[i + 1][2].isalpha() and low[i + 2] == "." and tokens[i + 3][2][0].isalpha():
            ends.append(i + 4)  # W X. W
        for e in ends:
            a, b = tokens[i][0], tokens[e - 1][1]
            if b - a > 48 or "\n" in text[a:b]:
                continue
            parts = [t for t in tokens[i:e] if t[2][0].isalpha()]
            words = [t[2].lower() for t in parts]
            if not words:
                continue
            known = sum(w in given for w in words)
            if e - i == 3 and low[i + 1] == "," and words[-1] not in given and not (tells and parts[0][2][0].isupper() and parts[-1][2][0].isupper()):
                continue  # a name turned round ends in a given name, or shows by its capitals
            after = e < n and (low[e] in AFTER or low[e] == "from" and e + 1 < n and low[e + 1] in FROM)
            if not (cue or after or known):
                if i not in caps or not all(t[2][0].isupper() for t in parts):
                    continue
            if i in roles and len(words) == 1 and not known and not (parts[0][2][0].isupper() and (tells or tokens[i - 1][2].islower() and parts[0][2][1:].islower())):
                continue  # "the driver left": one word in lower case after a role tells too little
            form = "".join("," if t[2] == "," else "." if t[2] == "." else "1" if len(t[2]) == 1 else "w" for t in tokens[i:e])
            last = max(words, key=len)
            features = [
                f"form={form}", f"case={' '.join(_case(t[2]) for t in parts)}", f"known={min(known, 2)}", f"function={sum(w in FUNCTION for w in words)}", f"ordinary={sum(w in ORDINARY for w in words)}|{min(known, 1)}|{_case(parts[-1][2])}", f"cue={cue}|{after}",
                *(f"end={w[-3:]}" for w in words if len(w) > 3 and w not in given), f"long={min(len(last), 9)}", f"derived={sum(DERIVED.search(w) is not None for w in words)}|{min(known, 1)}", f"both={cue}{after}{known > 0}", f"formcase={form}{cue}{_case(parts[0][2]) if parts else ''}",
            ]
            if len(words) == 1 and words[0] in given:
                features.append(f"word={words[0]}")
            add(a, b, "name", features)


def decode(spans: list[tuple[int, int, str, tuple[str, ...]]], weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """The set of spans without overlap of the highest total score; outside scores 0. Ties go to the earlier, shorter choice."""
    scored = sorted((b, a, kind, s) for a, b, kind, f in spans if (s := sum(weights.get(x, 0.0) for x in f)) > 0)
    if not scored:
        return []
    from bisect import bisect_right

    ends = [x[0] for x in scored]
    best = [0.0] * (len(scored) + 1)
    take: list[int | None] = [None] * (len(scored) + 1)
    for k, (_, a, _, s) in enumerate(scored, 1):
        prior = bisect_right(ends, a, 0, k - 1)
        best[k] = best[k - 1]
        if best[prior] + s > best[k] + 1e-12:
            best[k], take[k] = best[prior] + s, prior
    out, k = [], len(scored)
    while k:
        if take[k] is None:
            k -= 1
        else:
            b, a, kind, _ = scored[k - 1]
            out.append((a, b, kind))
            k = take[k]
    return out[::-1]


def _marginals(spans: list, weights: dict[str, float]) -> list[float]:
    """Probability of each span, by forward and backward sums over the points where spans begin and end."""
    points = sorted({p for a, b, *_ in spans for p in (a, b)})
    index = {p: i for i, p in enumerate(points)}
    scores = [sum(weights.get(x, 0.0) for x in f) for *_, f in spans]
    m = len(points)
    ending: list[list[int]] = [[] for _ in range(m)]
    starting: list[list[int]] = [[] for _ in range(m)]
    for k, (a, b, *_) in enumerate(spans):
        ending[index[b]].append(k)
        starting[index[a]].append(k)

    def total(xs: list[float]) -> float:
        top = max(xs)
        return top + math.log(sum(math.exp(x - top) for x in xs))

    fore, back = [0.0] * m, [0.0] * m
    for p in range(1, m):
        fore[p] = total([fore[p - 1], *(fore[index[spans[k][0]]] + scores[k] for k in ending[p])])
    for p in range(m - 2, -1, -1):
        back[p] = total([back[p + 1], *(back[index[spans[k][1]]] + scores[k] for k in starting[p])])
    z = fore[-1]
    return [math.exp(min(0.0, fore[index[a]] + s + back[index[b]] - z)) for (a, b, *_), s in zip(spans, scores, strict=True)]


def train(given: Iterable[str], sentences: int = TRAIN_SENTENCES) -> dict[str, float]:
    """Weights that maximise the likelihood of made sentences (adaptive gradient steps, seeded order)."""
    from .pii_sentences import runs
    from .pii_sentences import sentences as made

    names = frozenset(x.lower() for x in given)
    rng = random.Random(SEED)
    examples = []
    plain = sorted(n for n in names if n.isalpha() and len(n) <= 24)  # others are no single word of a candidate
    for text, gold in chain(made(rng, plain, sentences), runs(random.Random(SEED), TRAIN_RUNS)):
        spans = candidates(text, names)
        wanted = {(a, b, k) for a, b, k in gold}
        # out of reach by design: a name in one letter case, or of one word that opens a sentence, without a cue or a given name;
        # such a span is no candidate and teaches nothing
        if spans:
            examples.append((spans, [float((a, b, k) in wanted) for a, b, k, _ in spans]))
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    for _ in range(EPOCHS):
        rng.shuffle(examples)
        for spans, gold in examples:
            for (*_, features), want, have in zip(spans, gold, _marginals(spans, weights), strict=True):
                g = want - have
                if abs(g) < 1e-4:
                    continue
                for f in features:
                    step = g - DECAY * weights.get(f, 0.0)
                    squares[f] = squares.get(f, 0.0) + step * step
                    weights[f] = weights.get(f, 0.0) + STEP * step / math.sqrt(squares[f] + 1e-6)
    return {f: round(w, 4) for f, w in weights.items() if abs(w) > 1e-3}


_models: dict[tuple, dict[str, float]] = {}


def model(given: Iterable[str]) -> dict[str, float]:
    key = tuple(sorted({x.lower() for x in given}))
    if key not in _models:
        _models[key] = train(key)
    return _models[key]


def find(text: str, given: frozenset[str], weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """(start, end, type) in the original text, in order."""
    plain, at = fold(text)
    found = decode(candidates(plain, given), weights)
    return found if at is None else [(at[a], at[b - 1] + 1, k) for a, b, k in found]


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder in place of each span."""
    out, last = [], 0
    for a, b, kind in spans:
        out += (text[last:a], f"<{kind.upper()}>")
        last = b
    return "".join((*out, text[last:]))


def annotate(df: DataFrame, keys: list[str], text_col: str, given_names: DataFrame, name_col: str = "given_name", limit: int = 100_000) -> DataFrame:
    """(keys, masked, kinds) of the records in which personal data was found; kinds are distinct and sorted.

    Records without text have none. Texts are read whole. The list of given names is an argument, read with a bound of ``limit``
    and refused beyond; it may be empty. Repeated rows are judged each for itself.
    """
    names = [r[0] for r in given_names.filter(F.col(name_col).isNotNull()).select(name_col).limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} given names")
    given, weights = frozenset(x.lower() for x in names), model(names)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep, masked, kinds = [], [], []
            for i, text in enumerate(b["_text"]):
                spans = find(text, given, weights)
                if spans:
                    keep.append(i)
                    masked.append(mask(text, spans))
                    kinds.append(sorted({k for *_, k in spans}))
            out = b.iloc[keep].drop(columns="_text").rename(columns={f"_{i}": k for i, k in enumerate(keys)})
            # typed, since a batch may hold nothing
            yield out.assign(masked=pd.Series(masked, dtype=object, index=out.index), kinds=pd.Series(kinds, dtype=object, index=out.index))

    texts = df.filter(F.col(text_col).isNotNull()).select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col(text_col).alias("_text"))
    types = dict(texts.dtypes)
    return texts.mapInPandas(run, ", ".join(f"`{k}` {types[f'_{i}']}" for i, k in enumerate(keys)) + ", masked string, kinds array<string>")
