"""Every operator against a brute-force version, an exact round trip or planted cases, on small tables with the awkward rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from openweave.llm import binpack, clusters, dedup, lookalike, mixing, mojibake, pii, quality, terms
from pyspark.sql import functions as F

SCHEMA = "survey string, id long, response string, text string, h string, c string"


def answers(spark, texts):
    """Texts as rows of one survey, with columns whose names clash with the operators' own."""
    return spark.createDataFrame([("s", i, t, "x", "y", "z") for i, t in enumerate(texts, 1)], SCHEMA)


# --- p1 -------------------------------------------------------------------------------------------------------------------

COPIES = ["One two three four.", "one TWO  three, four", "one two three four five", None, "", "  ", "a b", "A: x y; B: z w", "b=z w\ta=x y", "* B: z w\n* A: x y", "can't we go now", "cant we go now", "one two three four.", "ﬁne one two three", "fine one two three", "x" * 50_000]


def test_copies_and_distinct_records(spark):
    d = answers(spark, COPIES)
    got = sorted(tuple(r) for r in dedup.copies(d, "id", "response", ["survey"]).select("first_id", "copy_id").collect())
    assert got == [(1, 2), (1, 13), (8, 9), (8, 10), (11, 12)]
    per = {r.first_id: r.copies for r in dedup.distinct_records(d, "id", "response", ["survey"]).collect()}
    assert per[1] == 3 and sum(per.values()) == sum(t is not None for t in COPIES)
    assert dedup.copies(d.limit(0), "id", "response", ["survey"]).count() == 0
    assert dedup.hash_collisions(dedup.keyed(d, "id", "response", ["survey"]), ["survey"]).count() == 0


def test_canonical_form_is_the_same_in_both_engines(spark):
    d = spark.createDataFrame([(t,) for t in COPIES if t is not None], "t string").withColumn("c", dedup.canonical(F.col("t")))
    assert all(r.c == dedup.canonical_text(r.t.lower()) for r in d.collect())


def test_a_hot_group_of_copies_is_kept_whole(spark):
    texts = ["the very same answer again"] * 700 + [f"answer number {i} is different" for i in range(1400)]
    got = dedup.copies(answers(spark, texts).repartition(8), "id", "response", ["survey"])
    assert got.count() == 699 and got.select("first_id").distinct().count() == 1


# --- p2 -------------------------------------------------------------------------------------------------------------------


def brute_terms(texts):
    occ, rec = Counter(), Counter()
    for t in texts:
        if t is not None:
            found = re.findall("[a-z]{2,}", t.lower())
            occ.update(found)
            rec.update(set(found))
    return {k: (v, rec[k]) for k, v in occ.items()}


@pytest.mark.parametrize("route_entries", [200_000, 3])
def test_terms_equal_brute_force(spark, monkeypatch, route_entries):
    monkeypatch.setattr(terms, "ROUTE_ENTRIES", route_entries)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(20)) for _ in range(200)] + [None, "", "É1x", "THE the"]
    got = {r.term: (r.occurrences, r.records) for r in terms.marked_terms(answers(spark, texts).repartition(5), "response", "survey").collect()}
    assert got == brute_terms(texts)
    assert terms.marked_terms(answers(spark, []), "response", "survey").count() == 0


def test_burst_trie_round_trip():
    rng = random.Random(2)
    words = Counter("".join(rng.choice("abcd") for _ in range(rng.randint(2, 9))) for _ in range(5000))
    trie = terms.BurstTrie(burst=16)
    for w, n in words.items():
        trie.add(w, n, 1)
        trie.add(w, n, 1)
    assert {t: (o, r) for t, o, r in trie.items()} == {w: (2 * n, 2) for w, n in words.items()} and len(trie.inner) > 10
    entries = sorted((w, n, 1) for w, n in words.items())
    assert list(terms.unpack(*terms.pack(entries))) == entries


# --- p3 -------------------------------------------------------------------------------------------------------------------

NAMES = ["Amara", "Mark", "Grace", "Will", "Rose", "Hope", "Florian"]
PRIVATE = [
    ("Write to amara.halv@mail.example if needed.", {"email"}), ("contact = kofi dot thorn at mailhut dot example", {"email"}), ("Call me on 07700 900123.", {"phone"}), ("tel five five five oh one nine six", {"phone"}),
    ("My SSN is 914-91-7108.", {"id_number"}), ("They still have QQ 10 92 44 D on file for me.", {"id_number"}), ("I live at 27 rue des Tisserands.", {"address"}), ("Pick it up from P.O. Box 2291, Port Sallow.", {"address"}),
    ("My manager Farid Rusketti said it was fine.", {"name"}), ("hope lorrova handled the case.", {"name"}), ("Ms Thora Pellwick from the store was rude. phone: +1 555 555 0155", {"name", "phone"}), ("Ｃａｌｌ ｍｅ ｏｎ ０７７００ ９００１２３．", {"phone"}),
    ("Grace period ended after 30 days.", set()), ("Rose Garden is my favourite scent.", set()), ("Order 81665-4 came on 12-02-2024.", set()), ("See you @ noon.", set()), ("Row 12 Lane swimming is included.", set()),
    ("Our plan covers 1 000 000 points per year.", set()), ("The driving licence holder fell apart.", set()), ("Mark my words, the line will be gone.", set()), ("", set()), (None, set()), ("word " * 20_000, set()),
]


def test_private_data(spark):
    d = answers(spark, [t for t, _ in PRIVATE])
    given = spark.createDataFrame([(n,) for n in NAMES], "given_name string")
    got = {r.id: r for r in pii.annotate(d, ["survey", "id"], "response", given).collect()}
    for i, (text, kinds) in enumerate(PRIVATE, 1):
        assert set(got[i].kinds if i in got else []) == kinds, text
    assert got[1].masked == "Write to <EMAIL> if needed." and "<NAME>" in got[9].masked and "manager" in got[9].masked
    assert pii.annotate(d.limit(0), ["survey", "id"], "response", given.limit(0)).count() == 0


def test_held_out_sentences():
    from openweave.llm.pii_sentences import sentences

    given = frozenset(n.lower() for n in NAMES)
    weights, hit, wrong, total = pii.model(NAMES), 0, 0, 0
    for text, gold in sentences(random.Random(99), sorted(given), 400):
        want, have = {(a, b, k) for a, b, k in gold}, set(pii.find(text, given, weights))
        hit, wrong, total = hit + len(want & have), wrong + len(have - want), total + len(want)
    assert hit / total > 0.85 and wrong / total < 0.1


#: Written by hand, apart from the training frames: what is marked is personal.
UNSEEN = """
The gardener, [name:Leopold Fenwick], trimmed the hedge too short.
I would like to thank [name:Amara Nwosu] for staying late.
Our bank adviser [name:Duncan Mackie] explained the fees.
[name:Pilar Ortega] refunded me the same day.
Could you let [name:Stig Hallberg] know?
My flatmate [name:Bogdan] broke the kettle.
Yours faithfully, [name:Eleanor Prentiss]
In the end [name:Mira Kovacs] drove me home.
The cleaner is called [name:Ottoline Grey].
I went with [name:Ravi Menon] to the counter.
Write me: [email:otto.grey@lumen-office.eu]
It is [email:jan_dekker at kpnpost dot nl] by the way.
Ping [email:HELP@ACORN.ORG] or visit the desk.
Mobile [phone:07700 900123], evenings.
Dial [phone:+39 06 555 0182] to reach us.
my phone [phone:555-0199] is off
The hotline 0800 is useless and we waited for 45 minutes.
[phone:0049 151 5550123] is my new number.
SSN [id_number:604 22 1187] was visible on the form.
Passport no. [id_number:X7719203] got lost.
They copied my identity card [id_number:48291044-K] at check-in.
National insurance [id_number:PW 40 31 22 B] on file.
My driving licence [id_number:FENWI510236L99AB] expired.
tax number [id_number:77/310/55821]
Leave it at [address:3 Hawthorn Close], behind the bins.
My mother lives at [address:118 Jubilee Road, Derby].
Rechnung an [address:Gartenweg 9] bitte.
We met at [address:14 rue Saint-Denis].
Deliver to [address:Calle de Alcalá 210].
Send post to [address:P.O. Box 3391].
[address:Flat 2, 61 Canal Street, Millbrook 4471] is the right one.
The Sony headphones and the Lenovo dock died.
We stayed in San Diego near Central Station.
Black Friday was chaos and Boxing Day worse.
Invoice 2201 4410 is not mine.
Chapter 12 of the guide has 300 pages.
I like Earl Grey tea and French toast.
The manager was away and nobody called.
Row 14 seat 22 was wet.
Part number 5521-88 fits the old pump.
It took 3 to 5 working days.
A nurse listened, the doctor did not.
The colour is Forest Green, not blue.
Gate B12 closed at 18:45.
The bill was wrong and I may leave.
Rose petals all over the place, pure joy.
"""
#: As above, but looked at while the features were chosen.
SEEN = """
The landlady, [name:Rosalind Achebe], never fixed the boiler.
Yesterday [name:Tomasz Zielinski] came round to measure the windows.
I wanted to compliment [name:Dev Chaudhuri] on the quick fix.
Both [name:Ingrid Sandvik] and the intern were lovely.
Please forward this to [email:r.achebe@northbank.co.uk] today.
Reach me via [email:pia (at) studio (dot) net] if unclear.
My husband [name:Gareth Pugh] picked it up on Tuesday.
We live at [address:27 Birchfield Avenue, Nottingham NG5 2DR] since 2019.
Drop it off at [address:Via Garibaldi 12, Torino], second door.
Her new place is [address:1408 Sycamore Drive, Unit 7].
Post goes to [address:PO Box 771, Alice Springs].
You may ring [phone:+61 412 555 019] during office hours.
My landline, [phone:01632 960 441], is dead again.
Call the shop at [phone:(212) 555-0148] and ask for [name:Leila].
Passport [id_number:P8812043] was scanned twice at the gate.
I typed my SSN [id_number:512-44-9981] and it failed.
NI number [id_number:AB 12 34 56 C] appears on every payslip.
Driving licence [id_number:MORGA753116SM9IJ] was rejected by the kiosk.
My tax ID is [id_number:12 345 678 901], why do you need it?
The waiter [name:Enzo] spilled soup over me.
[name:Priya Raman] from billing sorted everything within minutes.
Kind regards, [name:Wendeline Okoro]
The new Samsung fridge hums all night.
We flew via Hong Kong and the Lufthansa desk was empty.
Order 558-221 arrived on 12.03.2024 with a dent.
The Oak Street branch closes at five.
My manager never answers, and the neighbour complains.
Great Value detergent smells awful.
I paid 1,249.00 for the Pro Max and regret it.
Serial number 88213094 is printed on the base.
Ask at reception for the Blue Room.
Version 4.2.11 crashes when I press Save.
It rained all through June and August.
The driver was polite but late, as always.
They told us the Golden Ticket had expired.
My sister, [name:Beatriz Falcão], uses the same account.
It was [name:Oluwaseun Bankole] who refunded me.
Hello [name:Marguerite], thanks for the fast reply.
Send the invoice to [address:5 rue Lamartine] please.
Unsere Adresse ist [address:Lindenstraße 44].
text me on [phone:07911 123456] after work
my number is [phone:five five five oh one two three] call anytime
contact: [email:accounts.payable@harbor-lights.org]
[name:J. Whitcombe] signed for the parcel.
The plumber ([name:Aurelio Conti]) left a mess.
The doctor, [name:Hyun-woo Park], listened carefully.
I emailed [name:Saoirse Byrne] three times.
On Monday we met [name:Kofi Asante] at the depot.
Our teacher [name:Mr. Lindqvist] is patient.
Customer since 2011, ticket #88-2031 still open.
Room 214 and room 215 share a balcony.
The box of 24 pens was missing two.
100 g of sugar, 250 ml of milk, 2 eggs
See page 112 to 119 of the manual.
The Star Wars mug broke in the dishwasher.
"""


@pytest.mark.parametrize("lines", [UNSEEN, SEEN])
def test_sentences_of_another_hand(lines):
    given = frozenset(n.lower() for n in NAMES)
    weights, both, missed, wrong = pii.model(NAMES), 0, 0, 0
    for line in lines.strip().split("\n"):
        want = set(re.findall(r"\[(\w+):", line))
        text = re.sub(r"\[\w+:([^\]]*)\]", r"\1", line)
        have = {k for *_, k in pii.find(text, given, weights)}
        both, missed, wrong = both + len(want & have), missed + len(want - have), wrong + len(have - want)
    assert both / (both + missed) >= 0.88 and both / (both + wrong) >= 0.9, (both, missed, wrong)


LONG = [
    ("Call me on +33 6 12 34 56 78.", "Call me on <PHONE>."), ("tel +33 5 30 23 45 55", "tel <PHONE>"), ("My social security number is 1 85 12 75 108 123 45.", "My social security number is <ID_NUMBER>."),
    ("values 1 2 3 4 5 6 7 8 9 10", None), ("ratings: 5 4 3 5 4 2 1 5", None), ("Row 12 13 14 15 16 17 18 19", None),
]


def test_numbers_of_many_chunks_are_masked_whole():
    given = frozenset(n.lower() for n in NAMES)
    for text, masked in LONG:
        assert pii.mask(text, pii.find(text, given, pii.model(NAMES))) == (masked or text)


def test_every_gold_span_is_a_candidate():
    from openweave.llm.pii_sentences import runs, sentences

    given = frozenset(n.lower() for n in NAMES)
    made = [*sentences(random.Random(5), sorted(given), 1500), *runs(random.Random(5), 100)]
    made += [("Mail me at farid dot vardwick at postbox dot example", [(11, 52, "email")]), ("address: Bergplatz 28\nI moved.", [(9, 21, "address")])]
    total, lost = Counter(), Counter()
    for text, gold in made:
        found = {(a, b, k) for a, b, k, _ in pii.candidates(text, given)}
        total.update(k for *_, k in gold)
        lost.update(k for a, b, k in gold if (a, b, k) not in found)
    assert all(lost[k] <= 0.01 * total[k] for k in ("email", "phone", "id_number", "address"))
    # names in one letter case, or alone at the start of a sentence, need a cue or a given name beside them
    assert lost["name"] <= 0.25 * total["name"]
    # a list with names that are no single word trains as well
    assert pii.train(["Jean-Pierre", "Mary Ann", "O'Neil", "x" * 40, ""], 60)


def test_decoding_equals_all_sets_of_spans():
    rng = random.Random(3)
    for _ in range(200):
        spans = [(a, a + rng.randint(1, 4), "name", (f"f{i}",)) for i, a in enumerate(rng.sample(range(10), 6))]
        weights = {f"f{i}": rng.uniform(-1, 2) for i in range(6)}
        best = 0.0
        for m in range(64):
            chosen = sorted(s for i, s in enumerate(spans) if m >> i & 1)
            if all(x[1] <= y[0] for x, y in zip(chosen, chosen[1:])):
                best = max(best, sum(weights[s[3][0]] for s in chosen))
        score = {s[:3]: weights[s[3][0]] for s in spans}
        assert abs(sum(score[s] for s in pii.decode(spans, weights)) - best) < 1e-9


# --- p4 -------------------------------------------------------------------------------------------------------------------

LOOKS = [
    ("The оpenly halved desk", True, "The openly halved desk"), ("Ｗｉｄｅ desk", True, "Wide desk"), ("a ﬂimsy desk", True, "a flimsy desk"), ("souffle\u0301 desk", True, "soufflé desk"), ("de​sk and so­ap", True, "desk and soap"),
    ("a\u00a0desk", True, "a desk"), ("𝐛𝐨𝐥𝐝 desk", True, "bold desk"), ("І like it", True, "I like it"), ("soufflé “desk” – it’s", False, None), ("👩‍💻 ❤️ ok", False, None), ("As she says: хорошо. γρήγορα! 快递", False, None), ("tab\tand\nline", False, None),
    ("", False, None), (None, False, None), ("plain", False, None),
]


def test_lookalikes(spark):
    texts = [t for t, *_ in LOOKS] + ["openly desk soap I like it flimsy wide bold"] * 3
    d = spark.createDataFrame([("t", str(i), t, 1) for i, t in enumerate(texts)], "tbl string, rec_id string, text string, token int")
    found = {r.rec_id for r in lookalike.disguised(d, "tbl", "rec_id", "text").collect()}
    assert found == {str(i) for i, (_, hit, _) in enumerate(LOOKS) if hit}
    norm = {r.rec_id: r.normalized for r in lookalike.normalized(d, "tbl", "rec_id", "text").collect()}
    assert all(norm[str(i)] == out for i, (_, hit, out) in enumerate(LOOKS) if hit)
    assert all(norm[str(i)] == t for i, (t, hit, _) in enumerate(LOOKS) if not hit and t is not None)
    assert lookalike.disguised(d.limit(0), "tbl", "rec_id", "text").count() == 0


@pytest.mark.parametrize("trie", [50_000, 1])
def test_a_rare_word_in_other_letters_is_found(spark, monkeypatch, trie):
    monkeypatch.setattr(lookalike, "TRIE_WORDS", trie)
    d = answers(spark, ["the cope is here", "the сореѕ", "the соре", "the copes copy coat", "слово и дело", "coaх"]).withColumn("tbl", F.lit("t"))
    got = {r.id: r.normalized for r in lookalike.normalized(d, "tbl", "id", "response").selectExpr("cast(rec_id as long) id", "normalized").collect()}
    assert got[2] == "the copes" and got[3] == "the cope" and got[5] == "слово и дело" and got[6] == "coax"


# --- p5 -------------------------------------------------------------------------------------------------------------------


def brute_clusters(texts, least=16):
    sets = {i: frozenset(re.findall(r"[^\W_]+", t.lower())) for i, t in enumerate(texts, 1) if t}
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and (5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) or dedup.canonical_text(texts[i - 1].lower()) == dedup.canonical_text(texts[j - 1].lower())):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    groups = defaultdict(list)
    for i in sets:
        groups[find(i)].append(i)
    return sorted((i, min(g)) for g in groups.values() if len(g) > 1 for i in g)


@pytest.mark.parametrize("block, chunk, unite, hot, part", [(4_000, 10_000, 2_000_000, 262_144, 60_000), (2, 3, 1, 1, 100)])
def test_clusters_equal_brute_force(spark, rows, monkeypatch, block, chunk, unite, hot, part):
    for name, value in (("BLOCK_SETS", block), ("CHUNK_SETS", chunk), ("UNITE_LINKS", unite), ("HOT", hot), ("PART_SETS", part)):
        monkeypatch.setattr(clusters, name, value)
    rng, texts = random.Random(4), []
    for _ in range(60):
        base = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(16, 40))]
        for _ in range(rng.randint(1, 5)):
            x = list(base)
            for _ in range(rng.randint(0, 5)):
                x[rng.randrange(len(x))] = f"w{rng.randint(0, 300)}"
            texts.append(" ".join(x))
    texts += [texts[0], texts[0].upper() + "!", None, "", "short one", texts[5].replace(" ", "-", 1), "it can't be that " + texts[9], "it cant be that " + texts[9]]
    got = clusters.similarity_clusters(answers(spark, texts), "id", "response", "survey")
    assert rows(got.select("id", "cluster_id")) == sorted(brute_clusters(texts), key=repr)
    sizes = Counter(r.cluster_id for r in got.collect())
    assert all(sizes[r.cluster_id] == r.size for r in got.collect())
    top = {r.cluster_id: r.typical_ids for r in clusters.describe(got).collect()}
    assert set(top) == set(sizes) and all(1 <= len(v) <= 3 for v in top.values())


def near_texts(seed, bases, most):
    """Texts in families of up to ``most``, a few of whose words differ."""
    rng, texts = random.Random(seed), []
    for _ in range(bases):
        base = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(20, 60))]
        for _ in range(rng.randint(2, most)):
            x = list(base)
            for _ in range(rng.randint(0, 4)):
                x[rng.randrange(len(x))] = f"w{rng.randint(0, 300)}"
            texts.append(" ".join(x))
    return texts


def test_results_do_not_depend_on_size_switches(spark, rows, monkeypatch):
    d, got = answers(spark, near_texts(11, 12, 14)), []
    for block, chunk, unite in ((4_000, 10_000, 2_000_000), (2, 5, 2_000_000), (2, 5, 4)):
        for name, value in (("BLOCK_SETS", block), ("CHUNK_SETS", chunk), ("UNITE_LINKS", unite)):
            monkeypatch.setattr(clusters, name, value)
        members = clusters.similarity_clusters(d, "id", "response", "survey").cache()
        got.append((rows(members), rows(clusters.describe(members))))
    assert len(got[0][0]) > 60 and got[0] == got[1] == got[2]


@pytest.mark.parametrize("chunk, held", [(7, 1_000_000), (25, 10), (1_000, 1)])
def test_a_block_is_iterated_on_the_same_affinities_at_any_size(monkeypatch, chunk, held):
    texts = near_texts(3, 5, 30)
    rank = {w: i for i, w in enumerate(sorted({w for t in texts for w in t.split()}))}
    codes = ["".join(chr(32 + c) for c in sorted({rank[w] for w in t.split()}, reverse=True)) for t in texts]
    sets = pd.DataFrame({"block": 1, "node": np.arange(len(texts)) * 3 + 1, "salt": 5, "codes": codes, "rare": [b""] * len(texts)})
    seen, spectral = [], clusters.spectral
    monkeypatch.setattr(clusters, "spectral", lambda *a: seen.append(a) or spectral(*a))
    whole = clusters._cluster(sets)
    monkeypatch.setattr(clusters, "HELD_LINKS", held)
    of, found = np.arange(len(texts)) * 7 // 3 % -(-len(texts) // chunk), []
    for x in range(of.max() + 1):
        for y in range(x, of.max() + 1):
            found.append(clusters._chunks(sets.assign(chunk=of, x=x, y=y)[(of == x) | (of == y)]))
    found = pd.concat(found)
    own = found["a"] == found["b"]
    parts = clusters._cluster_forests(found[~own])
    assert len(seen) == 2 and all((a == b).all() for k, (a, b) in enumerate(zip(*seen, strict=True)) if k != 1)
    assert (seen[0][4] < clusters.UNIT).any()
    assert whole.set_index("node")["label"].reindex(parts["node"]).tolist() == parts["label"].tolist()
    assert found[own].groupby("a")["w"].sum().tolist() == whole["affinity"].tolist()


@pytest.mark.parametrize("piece", [1, 20, 300])
def test_links_united_in_pieces_lose_nothing(piece):
    rng = np.random.default_rng(8)
    for _ in range(20):
        i, j = rng.integers(0, 400, (2, 600))
        label = np.arange(400)
        for k in range(0, len(i), piece):
            label = clusters._spread(label, i[k : k + piece], j[k : k + piece])
        assert (label == clusters._spread(np.arange(400), i, j)).all()
        assert len(clusters._forest(400, np.minimum(i, j), np.maximum(i, j), np.ones(600, dtype=np.int64))[0]) == 400 - len(np.unique(label))


def test_the_forest_keeps_the_heaviest_links_and_every_connection():
    rng = np.random.default_rng(5)
    i, j = np.nonzero(np.triu(rng.random((60, 60)) < 0.08, 1))
    w = rng.integers(1, 6, len(i))
    up, best = list(range(60)), []

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for _, a, b in sorted(zip((-w).tolist(), i.tolist(), j.tolist(), strict=True)):
        if find(a) != find(b):
            up[find(a)] = find(b)
            best.append((a, b))
    a, b, _ = clusters._forest(60, i, j, w)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == sorted(best)


def test_groups_do_not_mix_and_empty_tables(spark):
    text = " ".join(f"word{i}" for i in range(20))
    d = spark.createDataFrame([("a", 1, text), ("b", 1, text), ("b", 2, text)], "survey string, id long, response string")
    assert [(r.grp, r.id) for r in clusters.similarity_clusters(d, "id", "response", "survey").orderBy("id").collect()] == [("b", 1), ("b", 2)]
    assert clusters.similarity_clusters(d.limit(0), "id", "response", "survey").count() == 0


def test_links_between_very_long_texts():
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 63, 20_000, dtype=np.uint64).tolist()
    other = [rng.integers(1, 1 << 63, 20, dtype=np.uint64).tolist() for _ in range(clusters.FEW)]
    found = list(clusters._links([base, base[:19_000], *other]))
    assert [(i.tolist(), j.tolist(), w.tolist()) for i, j, w in found if len(i)] == [([0], [1], [0.95])]


def test_a_set_sends_the_same_at_any_number_of_parts():
    rng = np.random.default_rng(1)
    sets = pd.DataFrame({"node": np.arange(2000), "salt": 7, "codes": ["".join(chr(32 + int(c)) for c in sorted(rng.choice(3000, 30, replace=False), reverse=True)) for _ in range(2000)], "rare": [b""] * 2000})
    sent = {parts: sum(len(e) for out in clusters._signer(parts, 2)([sets]) for e in out["entries"]) for parts in (1, 4, 3300)}
    assert len(set(sent.values())) == 1 and sent[1] < 2000 * 20 * clusters.ENTRY.itemsize


def test_signatures_grow_with_the_length_of_a_set_only():
    sizes = (100, 1_000, 10_000)
    sets = pd.DataFrame({"node": range(3), "salt": 1, "codes": ["".join(chr(32 + c) for c in range(n - 1, -1, -1)) for n in sizes], "rare": [b""] * 3})
    sent = [sum(len(e) for out in clusters._signer(1, 2)([sets.iloc[[i]]]) for e in out["entries"]) // clusters.ENTRY.itemsize for i in range(3)]
    assert all(n <= 3 * size for n, size in zip(sent, sizes, strict=True))


@pytest.mark.parametrize("array, sift, band", [(24, 1024, 128), (2, 4, 128), (24, 1024, 20)])
def test_signatures_lose_no_link(monkeypatch, array, sift, band):
    monkeypatch.setattr(clusters, "BAND", band)
    monkeypatch.setattr(clusters, "ARRAY", array)
    monkeypatch.setattr(clusters, "SIFT", sift)
    rng, sets = np.random.default_rng(2), []
    for _ in range(60):
        base = rng.choice(400, rng.integers(16, 60), replace=False).tolist()
        for _ in range(4):
            x = set(base)
            for _ in range(rng.integers(0, 8)):
                x.discard(int(rng.choice(base)))
                x.add(int(rng.integers(400)))
            sets.append(x)
    frame = pd.DataFrame({"node": range(len(sets)), "salt": 3, "codes": ["".join(chr(32 + c) for c in sorted(x, reverse=True)) for x in sets], "rare": [b""] * len(sets)})
    found = pd.concat(list(clusters._meet(True)(pd.DataFrame({"entries": b["entries"]}) for b in clusters._signer(1, 2)([frame]))))
    label = clusters._spread(np.arange(len(sets)), found["a"].to_numpy(np.int64), found["b"].to_numpy(np.int64))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
                assert label[i] == label[j]


def test_short_sets_are_linked_too(spark, rows):
    texts = ["a b", "b a", "a c", "q", "q q", "one two three four five", "one two three four", "x y z u v w", "x y z u v"]
    got = clusters.similarity_clusters(answers(spark, texts), "id", "response", "survey", min_words=1)
    assert rows(got.select("id", "cluster_id")) == [(1, 1), (2, 1), (4, 4), (5, 4), (6, 6), (7, 6), (8, 8), (9, 8)]


def test_very_long_texts_are_one_cluster(spark):
    words = [f"w{i}" for i in range(17_000)]
    texts = [" ".join(words), " ".join([*words[10:], *(f"x{i}" for i in range(10))]), " ".join(f"y{i}" for i in range(17_000)), *(" ".join(words[k * 50 : k * 50 + 30]) for k in range(12))]
    got = clusters.similarity_clusters(answers(spark, texts), "id", "response", "survey")
    assert sorted((r.id, r.cluster_id) for r in got.collect()) == [(1, 1), (2, 1)]


def test_the_embedding_separates_long_chains():
    n = 3000
    i, j = np.arange(n - 1), np.arange(1, n)
    keep = i != 1499
    x = clusters.embed(n, i[keep], j[keep], np.full(keep.sum(), 0.8), np.arange(n))
    label = clusters.k_means(x, np.zeros(n, dtype=np.int64))
    assert len(np.unique(label)) == 2 and len(np.unique(label[:1500])) == 1 and len(np.unique(label[1500:])) == 1


def test_the_exact_check_rarely_steps_in():
    rng = np.random.default_rng(9)
    ids, block, links, at = np.arange(40_000), np.zeros(40_000, dtype=np.int64), [], 0
    blocks = 0
    while at < 39_000:
        n = int(rng.integers(2, 250))
        block[at : at + n] = blocks
        a = rng.integers(0, n, n)
        links.append(np.stack([np.minimum(a, rng.permutation(n)), np.maximum(a, rng.permutation(n))]) + at)
        at, blocks = at + n, blocks + 1
    block[at:] = np.arange(blocks, blocks + len(ids) - at)
    i, j = np.concatenate(links, axis=1)
    apart = i != j
    label, mended = clusters.spectral(ids, block, i[apart], j[apart], np.ones(apart.sum()))
    assert len(np.unique(block[mended])) <= 0.01 * blocks
    assert (label == clusters._spread(ids, i[apart], j[apart])).all()


# --- p6 -------------------------------------------------------------------------------------------------------------------

KINDS = [
    ("The handle was sturdy and we liked it a lot, but the lid broke.", "prose"), ("too gritty compared to Weskovelan 951, lid included!", "prose"), ("i realy dont like it its bad and i want my money", "prose"),
    ("Quality: friendly refund; Support: fresh syrup; Taste: shaky blanket", "list"), ("- plate\n- thick towel\n- rug\n- kettle", "list"), ("receipt / careless mug / orderly mattress / basket / quick tray", "list"),
    ("item,qty,cost\nKan,6,23.78\nTor,4,62.60", "table"), ("a\t2\t74.37\tx\nb\t9\t53.07\ty", "table"), ("ok ok ok ok ok ok ok ok ok ok ok", "junk"), ("2305543 30048467 86301 353288 6228", "junk"),
    ("<div class='c'><td>182</td><td>456</td></div><br/>", "junk"), ("!!🔥🔥😀🔥🎉!!!!!!!!👍👍🔥🎉👍🔥", "junk"), ("qwsvbr piuletuh srkyjdpzaduypx jkmywleuxinzwt qdexlxe", "junk"), ("good", "short"), ("", "short"),
    ("It was a gift to my sister.\n" + "We want it to be the best and i want it too.\nIt was the aim but we dont want it.\n" * 4, "boilerplate"), ("We liked it a lot and it was the best to my taste.\n\n" * 3, "boilerplate"),
]
COMMON = "the was and we it a but too to i dont its my want".split()


def test_quality_kinds_and_statistics(spark):
    d = spark.createDataFrame([("t", i, t, 1.0) for i, (t, _) in enumerate(KINDS)] + [("t", 99, None, 1.0)], "tbl string, rec_id int, text string, n_words double")
    common = spark.createDataFrame([(w,) for w in COMMON], "word string")
    got = {r.rec_id: r for r in quality.statistics(d, ["tbl", "rec_id"], "text", common).collect()}
    assert {i: got[i].kind for i in got} == {i: k for i, (_, k) in enumerate(KINDS)}
    assert got[0].n_words == 14 and got[0].punctuated_lines == 1.0 and got[8].unique_words < 0.2 and got[8].top2_coverage > 0.5
    assert quality.statistics(d.limit(0), ["tbl", "rec_id"], "text", common).count() == 0
    with pytest.raises(ValueError):
        quality.statistics(d, ["tbl"], "text", common, limit=2)


def test_repetition_measures():
    s = dict(zip([c.split()[0] for c in quality.STATS.split(",")], quality.assess("same line here\nsame line here\nother", frozenset()), strict=True))
    assert s["duplicate_lines"] == 14 / 33 and s["n_lines"] == 3


# --- p7 -------------------------------------------------------------------------------------------------------------------


def test_packing_is_whole_and_within_bounds(spark):
    rng = random.Random(5)
    sizes = [rng.choice((0, 1, 30, 33, 34, 50, 51, 70, 99, 100, 101, 250)) for _ in range(400)] + [None, -3]
    docs = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long")
    bins = spark.createDataFrame([(1, 100), (2, 64), (3, 0), (1, 100)], "bin_id long, capacity_tokens long")
    packed = binpack.pack(docs, bins, part_pieces=60).toPandas()
    for b, cap in ((1, 100), (2, 64)):
        p = packed[packed.bin_id == b]
        assert p.groupby("container").tokens.sum().max() <= cap
        assert p.groupby("doc_id").tokens.sum().to_dict() == {i: max(s or 0, 0) for i, s in enumerate(sizes)}
        cut = {i for i, n in p.groupby("doc_id").size().items() if n > 1}
        assert cut == {i for i, s in enumerate(sizes) if (s or 0) > cap}
        assert p.container.nunique() <= 1.1 * binpack.lower_bound(p.tokens.to_numpy(), cap) + 1
        assert binpack.lower_bound(p.tokens.to_numpy(), cap) >= p[p.certified].groupby("part").bound.max().max()
    assert set(packed.bin_id) == {1, 2} and packed.part.str.startswith("1-").any()  # pieces were exchanged
    audit = binpack.audit(docs, binpack.pack(docs, bins, part_pieces=60)).collect()
    assert [(r.torn, r.overfull, r.pieces) for r in sorted(audit)] == [(0, 0, (packed.bin_id == b).sum()) for b in (1, 2)]
    bound = {r.bin_id: r.bound for r in binpack.bounds(docs, bins).collect()}
    assert all(0 <= r.above == r.containers - bound[r.bin_id] for r in binpack.report(binpack.pack(docs, bins), binpack.bounds(docs, bins)).collect())
    assert binpack.pack(docs.limit(0), bins).count() == 0 and binpack.pack(docs, bins.limit(0)).count() == 0


def test_lower_bound_never_exceeds_the_optimum():
    rng = random.Random(6)
    for _ in range(60):
        cap = 12
        x = sorted((rng.randint(1, cap) for _ in range(7)), reverse=True)

        def best(rest, loads):
            if not rest:
                return len(loads)
            out = 99
            for i in range(len(loads)):
                if loads[i] + rest[0] <= cap and loads[i] not in loads[:i]:
                    out = min(out, best(rest[1:], [*loads[:i], loads[i] + rest[0], *loads[i + 1 :]]))
            return min(out, best(rest[1:], [*loads, rest[0]]))

        assert binpack.lower_bound(np.array(x), cap) <= best(x, []) <= binpack.best_fit_decreasing(np.array(x), cap).max() + 1


# --- p8 -------------------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, "a" if i % 3 else "b", rng.randint(0, 50)) for i in range(3000)] + [(5000, None, 10), (5001, "c", None), (5002, "tiny", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([(1, "a", 1, 2), (1, "b", 1, 3), (2, "tiny", 1, 3), (2, "a", 1, 1), (3, "none", 5, 2), (3, "b", 1, 1)], "mix_id long, source string, weight int, max_repeats int")
    got = {(r.mix_id, r.source): r for r in mixing.shares(docs, targets).collect()}
    assert abs(got[1, "a"].actual_share - 0.5) < 0.01 and abs(got[1, "b"].actual_share - 0.5) < 0.01
    assert all(r.capped and r.close for r in got.values())
    assert got[2, "tiny"].used == 15 and not got[2, "tiny"].reachable and got[3, "none"].used == 0
    limit = {(r[0], r[1]): r[3] for r in targets.collect()}
    assert all(0 < r.repeats <= limit[r.mix_id, r.source] for r in mixing.mix(docs, targets).collect())
    assert sorted(tuple(r) for r in mixing.unreachable(docs, targets).collect()) == [(2, "tiny"), (3, "none")]
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0


# --- p9 -------------------------------------------------------------------------------------------------------------------

INTACT = ["Où que j’aille, le café paraît précis… « Oui »", "NÃO É A MAÇÃ, É O AVIÃO!", "Спасибо. Γρήγορα, 快递 ポイント", "Größe – schön“, ‘ok’ ½ ±5 °C", "plain", ""]


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1251"])
def test_garbled_utf8_round_trip(read):
    repair = mojibake.Repairer()
    for text in ("El té fue pequeño y la reunión parecía rápida, ¿no?", "Ich fände eine Tür schön, die Größe auch", "It’s “fine” – 25 €"):
        garbled = mojibake._read(text.encode(), read)
        fixed, spans, lost, _ = repair.fix(garbled)
        assert fixed == text and spans and not lost
        twice = mojibake._read(mojibake._read(text.encode(), "cp1252").encode(), "cp1252")
        assert repair.fix(twice)[0] == text


WIDE = ["Great 😀 service 👍🎉!", "Rất tốt, cảm ơn", "ok → fine", "정말 좋은 서비스", "خدمة ممتازة جدا", "שירות מצוין", "服务 很好 的"]


@pytest.mark.parametrize("read", mojibake.READ_AS)
def test_garbled_emoji_in_every_reading(read):
    repair = mojibake.Repairer()
    garbled = mojibake._read("Great 😀 service 👍🎉!".encode(), read)
    assert garbled is None or repair.fix(garbled)[0] == "Great 😀 service 👍🎉!"


def test_garbled_characters_outside_the_table():
    repair = mojibake.Repairer()
    for read in ("cp1252", "latin-1"):
        assert [repair.fix(mojibake._read(t.encode(), read))[0] for t in WIDE] == WIDE
    intact = ["Війна і вії, її мрії. Там сам раб, тамтам, ТАМ.", "Тётя, чёрт и ёлкам", "Spaß”, ß… você»… NÃO”", "3×“x”, BLØ”, Ø…", "„Öäse“", "😀 👍", "정말 خدمة שירות → Rất"]
    assert all(repair.fix(t)[:2] == (t, 0) for t in intact)


def test_one_byte_pairs_losses_and_intact_text(spark):
    repair = mojibake.Repairer()
    for read in ("cp437", "cp1251"):
        text = "Según mi opinión será más pequeña la mañana, también después"
        assert repair.fix(text.encode("cp1252").decode(read))[0] == text
    assert all(repair.fix(t)[:3] == (t, 0, False) for t in INTACT)
    mixed = "intact café, garbled cafÃ©, intact señal"
    assert repair.fix(mixed)[0] == "intact café, garbled café, intact señal"
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*INTACT, "press�o", "cafÃ©", None, "dÃ©jÃ\xa0 vu " * 5000])], "doc_id long, text string, spans int")
    got = {r.id: (r.spans, r.lost) for r in mojibake.restore(d, "doc_id", "text").collect()}
    assert got == {6: (0, True), 7: (1, False), 9: (10_000, False)}
    assert mojibake.restore(d.limit(0), "doc_id", "text").count() == 0


def test_queries_are_named_and_sql_belongs_to_them():
    from openweave.llm import queries

    q = queries.queries()
    assert {f"p{n}_found" for n in range(1, 10)} <= set(q) and set(queries.oracle_sql()) <= set(q)
