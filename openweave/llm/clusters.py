"""Grouping answers into similarity clusters: exact sparse affinities, then power-iteration spectral clustering, block by block.

1. Each answer becomes the set of its words, coded by frequency rank; equal sets are one node that keeps its number of answers.
2. Candidate links: of two sets of Jaccard similarity >= 0.8 the n / 5 + k rarest words share at least k. With the words hashed into
   GROUPS groups and k = GROUPS x (size - 1) + 1, at least `size` of the shared ones lie in one group, so both sets emit the same
   combination of `size` words. Sets that meet in a combination are compared by 128-bit parity sketches, whose distance never exceeds
   that of the sets: no link is lost, nearly all others are dropped unseen. Combinations start at two words; the sets of one that more
   than HOT sets share are signed again with one word more, however many sets there are in all.
3. Connected candidates form blocks. The affinity matrix is block-diagonal, so the vectors of the power iteration are partitioned by
   block and iterate without a shuffle, until every link certifies that its ends agree; a block that does not get there has its
   heaviest links contracted and goes on. k-means on the embedding gives the clusters. Members are ranked by internal affinity.
   In blocks of every size the walk goes along the heaviest links that connect what all links do: its leading eigenvectors, the
   constants of the connected sets, are the same, and the forest of forests of parts is that of the whole. So a block compared chunk
   by chunk gives the same embedding as one compared at once, and affinities, summed as whole numbers, are the same to the last bit.
"""

from __future__ import annotations

import re
import struct
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..skew import lookup_skewed
from .dedup import canonical_text

WORD = re.compile(r"[^\W_]+")
#: Words that get a rank; the list goes to every worker, so it is bounded. Further words are ordered before them, by hash.
RANKED_WORDS = 40_000
#: Groups the words are hashed into: signatures per set and the rareness of their words balance here.
GROUPS = 4
#: Words of a set from which its groups double, and again with every doubling.
BAND = 128
#: Sets whose signatures one task takes in; the number of parts follows the data, what a set sends does not.
PART_SETS = 60_000
#: Signatures a worker holds back to send them in large arrays, and takes in before it looks for hot ones.
HELD = 2_000_000
LOAD = 6_000_000
#: Sets that share a signature beyond which they are signed again with one word more; the last size is always decided.
HOT = 262_144
SIZES = (2, 3, 4, 5)
#: Members of a signature from which they are compared array by array, and from which sketches are sifted by equal pieces first.
ARRAY = 24
SIFT = 1_024
#: Links one task unites or iterates on; beyond, they are united, or their heaviest contracted first, by rounds of joins.
UNITE_LINKS = 2_000_000
#: Sets of a block whose pairs one task compares; the pairs of a larger block are compared chunk by chunk, with the same results.
BLOCK_SETS = 4_000
CHUNK_SETS = 10_000
#: Parts of one that affinities are counted in: no order of adding whole numbers changes a sum. Links held before they are thinned to a forest.
UNIT = 1_000_000_000
HELD_LINKS = 1_000_000
#: Sets of a block up to which plain set operations are quicker than arrays.
FEW = 10
#: Sets of blocks that share a task.
TASK_SETS = 8_000
VECTORS = 4
#: Steps of the walk before a block that is not certified is contracted, steps between two looks, and the difference across a link that certifies it.
STEPS = 48
LOOK = 12
CERTIFIED = 1e-9
#: Embeddings nearer than this belong to one centre.
CENTRE = 1e-5
MASK = (1 << 64) - 1
#: One signature as it is sent: 32 bits of it (its part holds the others), the node, the sketch, number of words and prefix mark.
ENTRY = np.dtype([("sig", "<u4"), ("node", "<i8"), ("low", "<u8"), ("high", "<u8"), ("n", "<u2")])
SHORT = 0x8000
_SEPARATED = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def _hash(x: int) -> int:
    """64 well-mixed bits of a number."""
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def _mixed(ids: np.ndarray, vector: int) -> np.ndarray:
    """A start between 0 and 1 for each node of one vector of the iteration: well-mixed bits of its number."""
    x = ids.astype(np.uint64) * np.uint64(VECTORS) + np.uint64(vector) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) / float(1 << 64)


def _words(low: str) -> set[str]:
    """Distinct runs of letters or digits of a lower-cased text."""
    if low.isascii():
        return set(low.encode().translate(_SEPARATED).decode().split())
    return set(WORD.findall(low))


def _counter(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words with the number of texts that hold them, combined before they are moved."""
    count: Counter[str] = Counter()
    for b in batches:
        for text in b["text"]:
            count.update(_words(text.lower()))
        if len(count) > 200_000:
            yield pd.DataFrame({"w": list(count), "n": list(count.values())})
            count.clear()
    yield pd.DataFrame({"w": pd.Series(list(count), dtype=object), "n": pd.Series(list(count.values()), dtype="int64")})


def _encoder(rank: dict[str, int], min_words: int):
    def encode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = rank.get
        for b in batches:
            rows = []
            for g, i, text in b.itertuples(index=False):
                low = text.lower()
                words = _words(low)
                if len(words) < min_words:
                    continue
                canon = xxhash.xxh3_128_digest(canonical_text(low).encode())
                try:
                    known, rare = sorted(map(get, words), reverse=True), b""
                except TypeError:  # a word without a rank
                    known = sorted((r for w in words if (r := get(w)) is not None), reverse=True)
                    rare = b"".join(sorted(xxhash.xxh3_64_digest(w.encode()) for w in words if w not in rank))
                codes = "".join([chr(k + 32) for k in known])
                rows.append((g, i, canon, xxhash.xxh3_128_digest(codes.encode() + b"\xff" + rare), codes, rare))
            yield pd.DataFrame(rows, columns=["grp", "id", "canon", "words", "codes", "rare"])

    return encode


def _tokens(codes: str, rare: bytes, salt: int) -> list[int]:
    """The words as numbers, in one order for all sets; words of different groups never agree."""
    salt &= MASK
    out = [h ^ salt for h in struct.unpack(f"<{len(rare) // 8}Q", rare)] if rare else []
    for c in codes:
        h = _seen.get(c)
        if h is None:
            h = _seen[c] = _hash(ord(c))
        out.append(h ^ salt)
    return out


_seen: dict[str, int] = {}


def _families(min_words: int) -> list[tuple[int, int]]:
    """(size, groups) of the signatures, level by level: similar sets of at least min_words words share enough words for each."""
    shared = -(-min_words * 4 // 5)
    levels = [(size, min(GROUPS, (shared - 1) // (size - 1))) for size in SIZES if shared >= size]
    return levels or [(1, GROUPS)]


def _bands(n: np.ndarray) -> np.ndarray:
    """0 for sets of fewer than BAND words, one more for each doubling: longer sets have more groups, so their signatures grow no faster than they."""
    return np.maximum(np.frexp(n // BAND)[1], 0).astype(np.int64)


def _signer(parts: int, size: int, groups: int = GROUPS):
    """The signatures of sets as (part, entries): an array of ENTRY, byte by byte, for each part; a set sends the same at any number of parts."""
    ranked = np.array([_hash(r) for r in range(RANKED_WORDS + 64)], dtype=np.uint64)
    mix, spread = np.uint64(0x9E3779B1), np.uint64(0xBF58476D1CE4E5B9)

    def signatures(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        words_of = b["codes"].str.len().to_numpy() + b["rare"].str.len().to_numpy() // 8
        band, next_band = _bands(words_of), _bands(words_of * 5 // 4)
        # similar sets meet in the band of the larger: the smaller is signed for that as well
        b, band = pd.concat([b, b[next_band > band]]), np.concatenate([band, next_band[next_band > band]])
        wide = groups << band  # groups of each set
        node = b["node"].to_numpy()
        rare = b["rare"].tolist()
        many = np.fromiter((len(r) // 8 for r in rare), dtype=np.int64, count=len(b))
        known = np.fromiter(map(len, b["codes"]), dtype=np.int64, count=len(b))
        code = np.frombuffer("".join(b["codes"]).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        n = many + known
        # one run of words a set, the unranked ones first
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        doc = np.repeat(np.arange(len(b)), n)
        pos = np.arange(len(doc)) - start[doc]
        hashes = np.empty(len(doc), dtype=np.uint64)
        hashes[pos >= many[doc]] = ranked[code]
        hashes[pos < many[doc]] = np.frombuffer(b"".join(rare), dtype="<u8")
        hashes ^= b["salt"].to_numpy().astype(np.uint64)[doc]
        low, high = _sketches(hashes, start)
        need = wide * (size - 1) + 1
        first = pos < (n // 5 + need)[doc]
        h, d = hashes[first], doc[first]
        short = (pos < (n // 9 + need)[doc])[first]  # the smaller of two similar sets lacks no more than a ninth
        most = int(wide.max())
        key = d * most + ((h >> np.uint64(40)) % wide[d].astype(np.uint64)).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, h, short = key[order], h[order] >> np.uint64(8), short[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        length = np.diff(np.concatenate([at, [len(key)]]))
        sigs, owner, marks = [], [], []
        for g in np.unique(length[length >= size]).tolist():
            rows = at[length == g]
            words, near = h[rows[:, None] + np.arange(g)], short[rows[:, None] + np.arange(g)]
            for c in combinations(range(g), size):
                s = np.zeros(len(rows), dtype=np.uint64)
                for k in c:
                    s = s * mix + words[:, k]
                sigs.append((s ^ (s >> np.uint64(29))) * spread)
                owner.append(key[rows] // most)
                marks.append(near[:, c[-1]])  # the last word is the least rare
        if not sigs:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=ENTRY)
        s, who = np.concatenate(sigs), np.concatenate(owner)
        s ^= band[who].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        entry = np.empty(len(s), dtype=ENTRY)
        entry["sig"], entry["node"], entry["low"], entry["high"] = s & np.uint64(0xFFFFFFFF), node[who], low[who], high[who]
        entry["n"] = np.minimum(n, SHORT - 1)[who] + np.where(np.concatenate(marks), SHORT, 0)
        return ((s >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), entry

    def send(held: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        to, entry = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(to, kind="stable")
        to, entry = to[order], entry[order]
        at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        ends = np.concatenate([at[1:], [len(to)]])
        raw = entry.view(np.uint8).reshape(len(entry), ENTRY.itemsize)
        # bytes of one place stand together: equal upper bytes are compressed away
        return pd.DataFrame({"part": to[at].astype("int32"), "entries": [raw[x:y].T.tobytes() for x, y in zip(at.tolist(), ends.tolist(), strict=True)]})

    def sign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for b in batches:
            if len(b):
                held.append(signatures(b))
                count += len(held[-1][0])
            if count >= HELD:
                yield send(held)
                held, count = [], 0
        if count:
            yield send(held)

    return sign


def _sketches(hashes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per run of words the parity of the words that fall on each of 128 bits."""
    bit = np.left_shift(np.uint64(1), hashes & np.uint64(63))
    upper = (hashes & np.uint64(64)) != 0
    return np.bitwise_xor.reduceat(np.where(upper, np.uint64(0), bit), start), np.bitwise_xor.reduceat(np.where(upper, bit, np.uint64(0)), start)


def _near(low, high, n, a, b) -> np.ndarray:
    """Whether the sketches of a and b allow similarity: sets of n and m words differ in at most (n + m) / 9."""
    apart = np.bitwise_count(low[a] ^ low[b]).astype(np.int64) + np.bitwise_count(high[a] ^ high[b])
    return (apart * 9 <= n[a] + n[b]) & (a != b)


def _rows_by_all(rows: np.ndarray, every: np.ndarray, low, high, n) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one of ``rows`` and one of ``every`` that the sketches allow; half a sketch sifts them."""
    most = min(int(n[every].max()) * 2 // 9, 64)
    step = max(1, 1_000_000 // len(every))
    columns = low[every]
    for k in range(0, len(rows), step):
        some = rows[k : k + step]
        i, j = np.nonzero(np.bitwise_count(low[some][:, None] ^ columns[None]) <= most)
        a, b = some[i], every[j]
        ok = _near(low, high, n, a, b)
        yield a[ok], b[ok]


def _sift(members: np.ndarray, low, high, n) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As _rows_by_all for many members: by size classes, whose similar pairs agree in one of so many pieces of the sketch as may differ and one."""
    least = int(n[members].min())
    while least <= n[members].max():
        most = least * 5 // 4
        of = members[(n[members] * 5 >= least * 4) & (n[members] <= most)]  # the larger of a pair lies in the class
        pieces = most * 2 // 9 + 1
        least = most + 1
        if len(of) < 2:
            continue
        if pieces > 32:  # pieces of under four bits tell nothing apart
            yield from _rows_by_all(of, of, low, high, n)
            continue
        width = 128 // pieces
        for k in range(pieces):
            shift = k * width
            if shift + width <= 64:
                value = low[of] >> np.uint64(shift)
            elif shift >= 64:
                value = high[of] >> np.uint64(shift - 64)
            else:
                value = low[of] >> np.uint64(shift) | high[of] << np.uint64(64 - shift)
            value &= np.uint64((1 << width) - 1)
            order = np.argsort(value, kind="stable")
            value, who = value[order], of[order]
            at = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            for x, y in zip(at.tolist(), [*at[1:].tolist(), len(who)], strict=True):
                if y - x > 1:
                    yield from _rows_by_all(who[x:y], who[x:y], low, high, n)


def _meet(last: bool):
    """Candidate links of a part as (a, b), each connected set of them as a star; (node, NULL) for the sets of hot signatures."""

    def sort(entries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = np.concatenate(entries)
        e = e[np.argsort(e["sig"], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], e["sig"][1:] != e["sig"][:-1]]))
        return e, first, np.diff(np.concatenate([first, [len(e)]]))

    def meet(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        count, hot = 0, np.zeros(0, dtype=np.uint32)

        def cool() -> pd.DataFrame:
            """Signatures found hot are taken out, so that a worker never holds many more than LOAD."""
            nonlocal held, count, hot
            e, _, run = sort(held)
            burning = np.repeat(run > HOT, run) | np.isin(e["sig"], hot)
            hot = np.union1d(hot, e["sig"][burning])
            held, count = [e[~burning]], int((~burning).sum())
            return pd.DataFrame({"a": np.unique(e["node"][burning]), "b": pd.array([None] * len(np.unique(e["node"][burning])), dtype="Int64")})

        for b in batches:
            for raw in b["entries"]:
                held.append(np.frombuffer(raw, dtype=np.uint8).reshape(ENTRY.itemsize, -1).T.copy().view(ENTRY).ravel())
                count += len(held[-1])
            if count > LOAD and not last:
                yield cool()
        if count:
            if not last:
                yield cool()
            e, first, run = sort(held)
            yield _stars(e, first, run)

    return meet


def _stars(e: np.ndarray, first: np.ndarray, run: np.ndarray) -> pd.DataFrame:
    low, high, n, short = e["low"].copy(), e["high"].copy(), (e["n"] & (SHORT - 1)).astype(np.int64), e["n"] >= SHORT
    # numbers of words are cut at SHORT - 1, far beyond where a sketch of 128 bits can tell sets apart
    node, place = np.unique(e["node"], return_inverse=True)
    label, pairs, count = np.arange(len(node)), [], 0

    def add(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal label, pairs, count
        if len(a):
            pairs.append((place[a], place[b]))
            count += len(a)
        if count > 1_000_000:
            unite()

    def unite() -> None:
        nonlocal label, pairs, count
        if pairs:
            i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
            label = _spread(label, i, j)
            pairs, count = [], 0

    at = np.flatnonzero(np.repeat((run > 1) & (run < ARRAY), run))
    left = (np.repeat(first + run, run) - np.arange(len(e)))[at]  # members from here to the end of the run
    for step in range(1, ARRAY):
        at, left = at[left > step], left[left > step]
        if not len(at):
            break
        near = np.bitwise_count(low[at] ^ low[at + step]).astype(np.int64) * 9 <= n[at] + n[at + step]
        a = at[near]
        ok = _near(low, high, n, a, a + step)
        add(a[ok], a[ok] + step)
    for k in np.flatnonzero(run >= ARRAY).tolist():
        members = np.arange(first[k], first[k] + run[k])
        found = _sift(members, low, high, n) if run[k] >= SIFT else _rows_by_all(members[short[members]], members, low, high, n)
        for a, b in found:
            add(a, b)
    unite()
    # labels are the smallest places, places follow the nodes
    joined = label != np.arange(len(node))
    return pd.DataFrame({"a": node[label[joined]], "b": pd.array(node[joined], dtype="Int64")})


def _spread(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest labels of the connected sets of links (i, j) and of what ``label`` unites already."""
    while True:
        low = np.minimum(label[i], label[j])
        fresh = label.copy()
        for k in (i, j):  # the first of a set moves with all of it; a node moved alone would leave what earlier links united
            np.minimum.at(fresh, label[k], low)
        while not (fresh[fresh] == fresh).all():
            fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def _unite(rows: pd.DataFrame) -> pd.DataFrame:
    nodes, codes = np.unique(np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()]), return_inverse=True)
    label = _spread(np.arange(len(nodes)), codes[: len(rows)], codes[len(rows) :])
    return pd.DataFrame({"node": nodes, "block": nodes[label]})


def components(links: DataFrame, bound: int | None = None) -> DataFrame:
    """(node, block): connected components of links (a, b); the block is the smallest node. ``links`` must be materialized.

    Up to ``bound`` links (UNITE_LINKS), counted first, are united in one task; more are contracted by rounds in which every node passes its
    smallest neighbour on (large and small stars in turn), each round cut by a table in the shared folder.
    """
    if links.count() <= (UNITE_LINKS if bound is None else bound):
        return links.groupBy(F.lit(0).alias("one")).applyInPandas(_unite, "node long, block long")
    edges, before = links.select("a", "b").filter("a <> b"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        edges = materialize(small.distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("block"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("block")).distinct())


def _links(sets: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, Jaccard similarity) of all pairs i < j of at least four fifths, in pieces; sketches sift the pairs, bit sets decide exactly."""
    n = len(sets)
    if n <= FEW:  # most blocks are a handful of sets
        found = []
        members = [frozenset(s) for s in sets]
        for i in range(n):
            for j in range(i + 1, n):
                both = len(members[i] & members[j])
                either = len(members[i]) + len(members[j]) - both
                if both * 5 >= either * 4:
                    found.append((i, j, both / either))
        if found:
            i, j, w = zip(*found, strict=True)
            yield np.array(i), np.array(j), np.array(w)
        return
    size = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.array([t for s in sets for t in s], dtype=np.uint64)
    doc = np.repeat(np.arange(n), size)
    low, high = _sketches(flat, np.concatenate([[0], np.cumsum(size)[:-1]]))
    code = np.unique(flat, return_inverse=True)[1]
    bits = np.zeros((n, int(code.max()) // 64 + 1), dtype=np.uint64)
    np.bitwise_or.at(bits, (doc, code // 64), np.left_shift(np.uint64(1), (code % 64).astype(np.uint64)))
    step, piece = max(1, 2_000_000 // n), max(1000, 2_000_000 // bits.shape[1])
    for a in range(0, n - 1, step):
        rows = slice(a, min(a + step, n))
        apart = np.bitwise_count(low[rows, None] ^ low[None, a:]) + np.bitwise_count(high[rows, None] ^ high[None, a:])
        # a distance is at most 128, so larger sums may be cut before they are kept in 16 bits
        i, j = np.nonzero(apart * np.int16(9) <= np.minimum(size[rows, None] + size[None, a:], 9 * 128).astype(np.int16))
        i, j = i[i < j] + a, j[i < j] + a
        for k in range(0, len(i), piece):
            x, y = i[k : k + piece], j[k : k + piece]
            both = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
            either = size[x] + size[y] - both
            near = both * 5 >= either * 4
            yield x[near], y[near], both[near] / either[near]


def _forest(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The heaviest links (i, j, w) that connect what all of them connect, the smallest nodes first among equals, ordered by (i, j)."""
    order = np.lexsort((j, i, -w))
    i, j, w = i[order], j[order], w[order]
    label, kept, live = np.arange(n), np.zeros(len(i), dtype=bool), np.arange(len(i))
    while True:
        a, b = label[i[live]], label[j[live]]
        live, a, b = live[a != b], a[a != b], b[a != b]
        if not len(live):
            break
        best = np.full(n, len(i))
        np.minimum.at(best, a, live)
        np.minimum.at(best, b, live)
        chosen = np.unique(best[best < len(i)])
        kept[chosen] = True
        label = _spread(label, i[chosen], j[chosen])
    i, j, w = i[kept], j[kept], w[kept]
    order = np.lexsort((j, i))
    return i[order], j[order], w[order]


def _thinned(n: int, pieces: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The forest of links that come in pieces, and the sum of all links of each node, in parts of UNIT; a dense cluster takes no more room than its nodes."""
    none = np.zeros(0, dtype=np.int64)
    forest, sums, held, count = (none, none, none), np.zeros(n, dtype=np.int64), [], 0

    def thin() -> None:
        nonlocal forest, held, count
        i, j, w = (np.concatenate(x) for x in zip(*held, strict=True))
        w = np.rint(w * UNIT).astype(np.int64)
        for k in (i, j):  # at most HELD_LINKS and a piece: whole numbers that a float holds
            sums[:] += np.bincount(k, weights=w, minlength=n).astype(np.int64)
        forest, held, count = _forest(n, *(np.concatenate(x) for x in zip(forest, (i, j, w), strict=True))), [], 0

    for piece in pieces:
        held.append(piece)
        count += len(piece[0])
        if count > HELD_LINKS:
            thin()
    if held:
        thin()
    return forest, sums


def embed(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The embedding of n nodes from their affinities (i, j, w): VECTORS values a node, all but equal within a cluster.

    The lazy random walk (I + D^-1 W) / 2 is applied to several vectors that start at values mixed from ``ids``. On a set of mutually
    reachable nodes they tend to a constant of that set, its leading eigenvectors. The iteration ends where the ends of every link
    agree to CERTIFIED. Where STEPS steps do not get that far (long chains), each node of such a set is contracted with the neighbour
    of its highest affinity, the affinities are summed, and the coarser graph is iterated: at most log2 n times.
    """
    x = np.stack([_mixed(ids, v) for v in range(VECTORS)], axis=1)
    of = np.arange(n)
    src, dst, both = np.concatenate([i, j]).astype(np.int64), np.concatenate([j, i]).astype(np.int64), np.concatenate([w, w]).astype(float)
    while len(src):
        for _ in range(0, STEPS, LOOK):
            at, s = np.unique(src, return_inverse=True)
            d = np.searchsorted(at, dst)
            p = both / np.bincount(s, weights=both)[s]
            y = x[at]
            for _ in range(LOOK):
                y = (y + np.stack([np.bincount(s, weights=p * y[d, v], minlength=len(at)) for v in range(VECTORS)], axis=1)) / 2
            x[at] = y
            # sets that hold a link not certified go on, in full
            label = _spread(np.arange(len(at)), s, d)
            bad = np.zeros(len(at), dtype=bool)
            bad[label[s[np.abs(y[s] - y[d]).max(axis=1) > CERTIFIED]]] = True
            live = bad[label[s]]
            src, dst, both = src[live], dst[live], both[live]
            if not len(src):
                return x[of]
        order = np.lexsort((dst, -both, src))
        best = order[np.concatenate([[True], src[order][1:] != src[order][:-1]])]
        kept, to = np.unique(_spread(np.arange(len(x)), src[best], dst[best]), return_inverse=True)
        of, x = to[of], x[kept]
        src, dst = to[src], to[dst]
        apart = src != dst
        code, place = np.unique(src[apart] * len(kept) + dst[apart], return_inverse=True)
        src, dst, both = code // len(kept), code % len(kept), np.bincount(place, weights=both[apart])
    return x[of]


def k_means(x: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Cluster numbers of embeddings, block by block: the first centres are the values that differ by more than CENTRE; then they move until stable."""
    label = np.unique(block, return_inverse=True)[1]
    for v in range(x.shape[1]):  # cut where neighbours along one vector lie apart
        order = np.lexsort((x[:, v], label))
        cut = np.concatenate([[False], (label[order][1:] != label[order][:-1]) | (np.diff(x[order, v]) > CENTRE)])
        fresh = np.empty(len(label), dtype=np.int64)
        fresh[order] = np.cumsum(cut)
        label = fresh
    order = np.argsort(block, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1]])) if len(order) else np.zeros(0, dtype=np.int64)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
        rows = order[a:b]
        names, near = np.unique(label[rows], return_inverse=True)
        if len(names) == 1 or len(names) == len(rows):
            continue
        for _ in range(10):
            count = np.bincount(near, minlength=len(names))
            centre = np.stack([np.bincount(near, weights=x[rows, v], minlength=len(names)) / np.maximum(count, 1) for v in range(x.shape[1])], axis=1)
            step = max(1, 1_000_000 // len(names))
            fresh = np.concatenate([((x[rows[k : k + step], None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1) for k in range(0, len(rows), step)])
            if (fresh == near).all():
                break
            near = fresh
        label[rows] = names[near]
    return label


def spectral(ids: np.ndarray, block: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(clusters, mended): cluster numbers of all nodes of a task, whose links (i, j) lie within blocks, and where the check stepped in.

    The clusters are those of k-means on the embedding. An exact check follows: clusters are to be the sets connected by links; nodes
    of a block in which they are not (equal embeddings by chance) get those sets instead and are marked.
    """
    label = k_means(embed(len(ids), i, j, w, ids), block)
    exact = _spread(np.arange(len(ids)), i, j)
    first = np.full(len(ids), len(ids))
    np.minimum.at(first, label, np.arange(len(ids)))
    wrong = np.isin(block, block[first[label] != exact])
    return np.where(wrong, exact, first[label]), wrong


def _labels(ids: np.ndarray, block: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As spectral; nodes without a link stay alone and outside of the iteration."""
    label, mended = np.arange(len(ids)), np.zeros(len(ids), dtype=bool)
    if len(i):
        linked, code = np.unique(np.concatenate([i, j]), return_inverse=True)
        of, mended[linked] = spectral(ids[linked], block[linked], code[: len(i)], code[len(i) :], w)
        label[linked] = linked[of]
    return label, mended


def _cluster(rows: pd.DataFrame) -> pd.DataFrame:
    """All blocks of one task: (node, label, affinity, mended), label being the smallest node of the cluster."""
    rows = rows.sort_values(["block", "node"])
    block, ids, salts = rows["block"].to_numpy(), rows["node"].to_numpy(), rows["salt"].tolist()
    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    codes, rare = rows["codes"].tolist(), rows["rare"].tolist()
    ends = zip(edges.tolist(), [*edges[1:].tolist(), len(rows)], strict=True)
    forest, sums = _thinned(len(ids), ((i + a, j + a, w) for a, b in ends for i, j, w in _links([_tokens(codes[x], rare[x], salts[x]) for x in range(a, b)])))
    label, mended = _labels(ids, block, *forest)
    return pd.DataFrame({"node": ids, "label": ids[label], "affinity": sums, "mended": mended})


def _chunks(rows: pd.DataFrame) -> pd.DataFrame:
    """Of two chunks of a large block: the forest of their links (block, a, b, w), and as (block, node, node, w) what each node adds to its affinity here.

    Pairs within a chunk count where the chunk meets itself, pairs between chunks where those two meet.
    """
    rows = rows.drop_duplicates("node").sort_values("node")
    ids, chunk = rows["node"].to_numpy(), rows["chunk"].to_numpy()
    pieces = _links([_tokens(c, r, s) for c, r, s in zip(rows["codes"], rows["rare"], rows["salt"], strict=True)])
    if rows["x"].iloc[0] != rows["y"].iloc[0]:
        pieces = ((i[k], j[k], w[k]) for i, j, w in pieces for k in [chunk[i] != chunk[j]])
    (i, j, w), sums = _thinned(len(ids), pieces)
    found = pd.DataFrame({"a": np.concatenate([ids[i], ids]), "b": np.concatenate([ids[j], ids]), "w": np.concatenate([w, sums])})
    return found.assign(block=rows["block"].iloc[0])[["block", "a", "b", "w"]]


def _cluster_forests(rows: pd.DataFrame) -> pd.DataFrame:
    """As _cluster for one large block whose links come as forests of its parts."""
    ids, code = np.unique(np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()]), return_inverse=True)
    label, mended = _labels(ids, np.zeros(len(ids), dtype=np.int64), *_forest(len(ids), code[: len(rows)], code[len(rows) :], rows["w"].to_numpy()))
    return pd.DataFrame({"node": ids, "label": ids[label], "mended": mended})


def _contract(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(links, nodes): blocks of more than UNITE_LINKS links (block, a, b, w) with each node contracted with its heaviest neighbour, as embed does,
    until one task can take them; (node, into) are the nodes contracted, None if there are none."""
    into = None
    while True:
        large = links.groupBy("block").agg(F.count(F.lit(1)).alias("links")).filter(F.col("links") > UNITE_LINKS).select("block")
        if not large.limit(1).count():
            return links, into
        giant = links.join(large, "block", "left_semi")
        both = giant.select("a", "b", "w").unionByName(giant.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        heaviest = both.groupBy("a").agg(F.max(F.struct("w", (-F.col("b")).alias("b"))).alias("m")).select("a", (-F.col("m.b")).alias("b"))
        to = materialize(components(materialize(heaviest, "heaviest")).select("node", F.col("block").alias("into")), "contracted")
        moved = links.join(to.select(F.col("node").alias("a"), F.col("into").alias("x")), "a", "left").join(to.select(F.col("node").alias("b"), F.col("into").alias("y")), "b", "left")
        ends = moved.select("block", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"), "w").filter("x <> y")
        links = materialize(ends.groupBy("block", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("w").alias("w")), "coarse")
        if into is not None:
            to = into.join(to.select(F.col("node").alias("into"), F.col("into").alias("next")), "into", "left").select("node", F.coalesce("next", "into").alias("into"))
        into = materialize(to, "into")


def _large(sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Blocks beyond BLOCK_SETS: every pair of chunks meets in one task; the forests of links found there are the sparse affinities of the block.

    A block of more than UNITE_LINKS links has its heaviest ones contracted before it is iterated in one task.
    """
    many = F.ceil(F.col("sets") / F.lit(CHUNK_SETS)).cast("int")
    rows = sets.join(sizes.filter(F.col("sets") > BLOCK_SETS), "block").withColumn("many", many).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("many")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("other")
    paired = rows.select("block", "node", "salt", "codes", "rare", "chunk", other).withColumn("x", F.least("chunk", "other")).withColumn("y", F.greatest("chunk", "other"))
    found = materialize(paired.groupBy("block", "x", "y").applyInPandas(_chunks, "block long, a long, b long, w long"), "large")
    links, into = _contract(found.filter("a <> b"))
    labels = links.groupBy("block").applyInPandas(_cluster_forests, "node long, label long, mended boolean")
    affinity = found.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("affinity"))
    if into is None:
        affinity = affinity.withColumn("into", F.col("node"))
    else:
        affinity = affinity.join(into, "node", "left").withColumn("into", F.coalesce("into", "node"))
    return affinity.join(labels.withColumnRenamed("node", "into"), "into", "left").select("node", F.coalesce("label", "into").alias("label"), "affinity", F.coalesce("mended", F.lit(False)).alias("mended"))


def word_sets(df: DataFrame, id_col: str, text_col: str, group_col: str, min_words: int) -> DataFrame:
    """(grp, id, canon, words, codes, rare): each answer with its coded set, the hash of that set and of the canonical form."""
    texts = df.filter(F.col(text_col).isNotNull()).select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counts = texts.select("text").mapInPandas(_counter, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    # cut on the executors: a collected limit would send the first words of every partition to the driver
    top = materialize(counts.orderBy(F.desc("n"), "w").limit(RANKED_WORDS), "ranks").collect()
    top.sort(key=lambda r: (-r[1], r[0]))
    rank = {w: i for i, (w, _) in enumerate(top)}
    return materialize(texts.mapInPandas(_encoder(rank, min_words), "grp string, id long, canon binary, words binary, codes string, rare binary"), "answers")


def candidate_links(nodes: DataFrame, total: int, min_words: int) -> DataFrame:
    """(a, b): every two similar sets are connected by these links, most others are not."""
    links = None
    levels = _families(min_words)
    for size, groups in levels:
        last = (size, groups) == levels[-1]
        parts = max(1, -(-total // PART_SETS))
        signed = nodes.select("node", "salt", "codes", "rare").mapInPandas(_signer(parts, size, groups), "part int, entries binary")
        found = materialize(signed.repartitionById(parts, F.col("part")).mapInPandas(_meet(last), "a long, b long"), "links")
        here = found.filter("b is not null")
        links = here if links is None else links.unionByName(here)
        again = materialize(found.filter("b is null").select(F.col("a").alias("node")).distinct(), "again") if not last else None
        total = again.count() if again is not None else 0
        if not total:
            return links
        nodes = nodes.join(again, "node", "left_semi")
    return links


def similarity_clusters(df: DataFrame, id_col: str, text_col: str, group_col: str, min_words: int = 16) -> DataFrame:
    """(grp, id, cluster_id, size, affinity): members of clusters of two or more answers of one group.

    cluster_id is the smallest id. NULL texts and those with fewer than min_words distinct words belong to no cluster; equal texts,
    and copies up to case, spacing and punctuation, share one.
    """
    answers = word_sets(df, id_col, text_col, group_col, min_words)
    found = answers.groupBy("grp", "words").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("answers"), F.first("codes").alias("codes"), F.first("rare").alias("rare"))
    # the group is part of the hashes of a node's words: sets of two groups never meet
    nodes = materialize(found.select(F.monotonically_increasing_id().alias("node"), F.xxhash64("grp").alias("salt"), "*"), "nodes")
    total = nodes.count()
    links = materialize(candidate_links(nodes, total, min_words).distinct(), "candidates")
    blocks = materialize(components(links), "blocks")
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("sets"))
    sets = nodes.select("node", "salt", "codes", "rare").join(blocks, "node")
    small = sets.join(sizes.filter(F.col("sets") <= BLOCK_SETS), "block") if sizes.filter(F.col("sets") > BLOCK_SETS).limit(1).count() else sets
    tasks = max(1, -(-blocks.count() // TASK_SETS))
    clustered = small.select("node", "block", "salt", "codes", "rare", F.pmod(F.xxhash64("block"), F.lit(tasks)).alias("task")).groupBy("task").applyInPandas(_cluster, "node long, label long, affinity long, mended boolean")
    if small is not sets:
        clustered = clustered.unionByName(_large(sets, sizes))
    labels = materialize(clustered, "labels")
    same = materialize(_copies(answers, nodes), "same")
    if same.limit(1).count():
        labels = materialize(_merge_copies(labels, same), "merged")
    named = nodes.select("node", "grp", "words", "first", "answers").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sums = named.groupBy("label").agg(F.sum("answers").alias("size"), F.min("first").alias("cluster_id")).filter("size > 1")
    table = materialize(named.join(sums, "label").select("grp", "words", "answers", "cluster_id", "size", F.coalesce("affinity", F.lit(0)).alias("affinity")), "clusters")
    joined = lookup_skewed(answers.withColumn("grp", F.coalesce("grp", F.lit("\0"))).select("grp", "words", "id"), table.withColumn("grp", F.coalesce("grp", F.lit("\0"))), ["grp", "words"], "answers", answers.count())
    # copies of one text are as similar as can be: each adds 1 to the affinity of the others
    return joined.select(F.nullif("grp", F.lit("\0")).alias("grp"), "id", "cluster_id", "size", ((F.col("affinity") + (F.col("answers") - 1) * UNIT) / UNIT).alias("affinity"))


def _copies(answers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): nodes of copies whose words were joined or cut by punctuation have other sets; their canonical forms link them."""
    keyed = answers.select(F.xxhash64("grp").alias("salt"), "canon", "words", F.xxhash64("words").alias("h"))
    several = keyed.groupBy("salt", "canon").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("salt", "canon")
    rows = keyed.join(materialize(several, "several"), ["salt", "canon"]).select("salt", "canon", "words").distinct()
    ends = rows.join(nodes.select("salt", "words", "node"), ["salt", "words"])
    firsts = ends.groupBy("salt", "canon").agg(F.min("node").alias("a"))
    return ends.join(firsts, ["salt", "canon"]).filter("node <> a").select("a", F.col("node").alias("b")).distinct()


def _merge_copies(labels: DataFrame, same: DataFrame) -> DataFrame:
    """Clusters joined by copies become one."""
    of = labels.select("node", "label")
    ends = same.join(of.select(F.col("node").alias("a"), F.col("label").alias("x")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("label").alias("y")), "b", "left")
    pairs = ends.select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    links = materialize(pairs.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "copylinks")
    merged = materialize(components(links), "copyblocks")
    alone = merged.join(labels.select("node"), "node", "left_anti").select("node", F.col("block").alias("label"), F.lit(0).cast("long").alias("affinity"))
    moved = labels.join(merged.select(F.col("node").alias("label"), "block"), "label", "left").select("node", F.coalesce("block", "label").alias("label"), "affinity")
    return moved.unionByName(alone)


def describe(members: DataFrame, top: int = 3) -> DataFrame:
    """Per cluster its size and its most typical members: those of the highest internal affinity, the smallest ids first among equals.

    The best are found by min-aggregation, one place after the other, so a cluster of any size never comes to one task as a list.
    """
    key = F.struct((-F.col("affinity")).alias("a"), F.col("id").alias("id"))
    found, rest = None, members.select("grp", "cluster_id", "size", key.alias("k"))
    for place in range(top):
        best = rest.groupBy("grp", "cluster_id", "size").agg(F.min("k").alias(f"k{place}"))
        found = best if found is None else found.join(best, ["grp", "cluster_id", "size"], "left")
        if place + 1 < top:
            found = materialize(found, f"typical{place}")
            last = found.select("grp", "cluster_id", F.col(f"k{place}").alias("last"))
            rest = members.select("grp", "cluster_id", "size", key.alias("k")).join(last, ["grp", "cluster_id"]).filter(F.col("k") > F.col("last")).drop("last")
    ids = F.array_compact(F.array(*[F.col(f"k{i}.id") for i in range(top)]))
    return found.select("grp", "cluster_id", "size", ids.alias("typical_ids"))
