"""Filling containers of fixed capacity: best-fit decreasing a partition, certified by dual-feasible bounds, gaps exchanged and repacked."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Partitions at least, and pieces that one of them holds at most on average; their number follows the data.
MIN_PARTS = 8
PART_PIECES = 50_000
#: A partition above its bound opens its emptiest containers: this share of them at most, and only such as have room.
OPEN_SHARE = 0.25
#: Exchange rounds at most. A pool takes about as many pieces as a partition, whatever the number of partitions.
ROUNDS = 4
#: Kinds of containers at most; more are refused.
MAX_KINDS = 1000
#: Dual-feasible functions of the bound over all pieces: u_k for k up to STEPS, f_a for a = capacity x j / GRID, j up to GRID / 2.
STEPS, GRID = 20, 64
OUT = "bin_id long, capacity long, part string, container string, doc_id long, piece long, tokens long, open boolean, bound long, used long"


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing needs: the best of the volume bound and two families of dual-feasible functions.

    f_a counts pieces over capacity - a as whole, drops those under a and keeps the rest; u_k rounds (k + 1) x / capacity down to
    k-ths and leaves exact multiples as they are. A dual-feasible function keeps any set that fits at a sum of at most one.
    """
    x = np.sort(sizes[sizes > 0].astype(np.int64))
    if not len(x):
        return 0
    best = -(-int(x.sum()) // capacity)
    total = np.concatenate([[0], np.cumsum(x)])
    for a in np.unique(x[x * 2 <= capacity]):
        lo, hi = np.searchsorted(x, a), np.searchsorted(x, capacity - a, side="right")
        best = max(best, len(x) - hi + -(-int(total[hi] - total[lo]) // capacity))
    half = np.searchsorted(x, capacity // 2, side="right")
    best = max(best, len(x) - int(half))
    for k in range(1, 21):
        scaled = x * (k + 1)
        exact = scaled % capacity == 0
        # in units of 1 / (k x capacity), so that all sums are of integers
        value = np.where(exact, x * k, (scaled // capacity) * capacity)
        best = max(best, -(-int(value.sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each piece; pieces must come in falling order. Of the containers with room the fullest is taken."""
    where = np.empty(len(sizes), dtype=np.int64)
    gaps: list[int] = []  # the different gaps there are, rising
    holders: dict[int, list[int]] = {}
    count = 0
    for i, s in enumerate(sizes.tolist()):
        k = bisect_left(gaps, s)
        if k < len(gaps):
            gap = gaps[k]
            held = holders[gap]
            c = held.pop()
            if not held:
                del holders[gap]
                gaps.pop(k)
        else:
            c, gap = count, capacity
            count += 1
        where[i] = c
        left = gap - s
        if left in holders:
            holders[left].append(c)
        else:
            holders[left] = [c]
            insort(gaps, left)
    return where


def _packer(turn: int, last: bool):
    def pack(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        capacity, part = int(b["capacity"].iloc[0]), f"{turn}-{b['pool'].iloc[0]}"
        sizes = b["tokens"].to_numpy(dtype=np.int64)
        where = best_fit_decreasing(sizes, capacity)
        if turn:  # documents that fit no better together stay where they were
            before, old = pd.factorize(b["container"])
            if len(old) <= int(where.max()) + 1:
                where, names = before, old.to_numpy()
            else:
                names = np.array([f"{part}-{w}" for w in range(int(where.max()) + 1)], dtype=object)
        else:
            names = np.array([f"{part}-{w}" for w in range(int(where.max()) + 1)], dtype=object)
        bound, used = lower_bound(sizes, capacity), len(names)
        b["part"], b["bound"], b["used"], b["container"], b["open"] = part, bound, used, names[where], False
        if used > bound and not last:
            fill = np.bincount(where, weights=sizes, minlength=used)
            emptiest = np.argsort(fill, kind="stable")[: max(2, int(used * OPEN_SHARE))]
            b["open"] = np.isin(where, emptiest[fill[emptiest] < capacity])
        return b[[c.split()[0] for c in OUT.split(", ")]]

    return pack


def pieces(docs: DataFrame, bins: DataFrame, id_col: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(bin_id, capacity, doc_id, piece, tokens): whole documents, and the pieces of those larger than the container.

    Pieces of a divided document are full but for the last. Missing or negative sizes count as 0; capacities below 1 are no containers.
    """
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    kinds = bins.filter("capacity_tokens > 0 AND bin_id IS NOT NULL").select("bin_id", "capacity_tokens").dropDuplicates(["bin_id"]).limit(MAX_KINDS + 1).collect()
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    if not kinds:
        return docs.sparkSession.createDataFrame([], "bin_id long, capacity long, doc_id long, piece long, tokens long")
    # every document goes into a container of every kind: the kinds are the statement of the task, a few literals
    each = F.array(*[F.struct(F.lit(int(k)).cast("long").alias("bin_id"), F.lit(int(c)).cast("long").alias("capacity")) for k, c in sorted(map(tuple, kinds))])
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n"), F.explode(each).alias("k")).select("k.bin_id", "k.capacity", "doc_id", "n")
    count = F.greatest(F.ceil(F.col("n") / F.col("capacity").cast("double")).cast("long"), F.lit(1))
    cut = every.select("bin_id", "capacity", "doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"))
    return cut.withColumn("tokens", F.least(F.col("capacity"), F.col("n") - F.col("piece") * F.col("capacity"))).drop("n")


def pack(docs: DataFrame, bins: DataFrame, id_col: str = "doc_id", size: str = "n_tokens", part_pieces: int = PART_PIECES) -> DataFrame:
    """(bin_id, capacity, container, doc_id, piece, tokens, part, bound, used, certified): every piece in exactly one container.

    Documents are spread over partitions by their hash, so equal sizes and hot sources do not matter. A partition that needs no more
    containers than its bound is certified and closed. The others open their emptiest containers; the documents in these are exchanged
    over pools of ``part_pieces`` pieces, packed again by best-fit decreasing, and the pools are judged in the same way. A pool that
    would not save a container leaves its documents where they were, so no round makes the packing worse. ``part`` names the partition
    or pool that closed a container, ``bound`` and ``used`` are its bound and the containers it had, ``certified`` says they are equal.
    """
    todo = pieces(docs, bins, id_col, size)
    kinds = max(1, bins.count())
    parts = max(MIN_PARTS, -(-docs.count() // part_pieces))
    todo = todo.withColumn("container", F.lit(None).cast("string"))
    done: DataFrame | None = None
    for turn in range(ROUNDS + 1):
        pooled = todo.withColumn("pool", F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(parts)).cast("long"))
        if turn:  # the pieces of a container stay together
            pooled = todo.withColumn("pool", F.pmod(F.xxhash64("container", F.lit(turn)), F.lit(parts)).cast("long"))
        packed = materialize(pooled.groupBy("bin_id", "pool").applyInPandas(_packer(turn, turn == ROUNDS), OUT), f"pack{turn}")
        closed = packed.filter("not open")
        done = closed if done is None else done.unionByName(closed)
        todo = packed.filter("open").select("bin_id", "capacity", "doc_id", "piece", "tokens", "container")
        left = todo.count() if turn < ROUNDS else 0
        if not left:
            break
        parts = max(1, -(-left // (part_pieces * kinds)))
    return done.select("bin_id", "capacity", "container", "doc_id", "piece", "tokens", "part", "bound", "used", (F.col("bound") == F.col("used")).alias("certified"))


def divided(packing: DataFrame) -> DataFrame:
    """(bin_id, doc_id) of the documents that were divided."""
    return packing.filter("piece = 1").select("bin_id", "doc_id")


def bounds(docs: DataFrame, bins: DataFrame, id_col: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(bin_id, capacity, pieces, tokens, bound): the dual-feasible lower bound of containers over all pieces of a kind.

    The value of a dual-feasible function is summed over the pieces, so each function is one sum of an aggregation.
    """
    x, c = F.col("tokens"), F.col("capacity")
    values = [(x, F.lit(1))]
    for k in range(1, STEPS + 1):
        whole = F.expr(f"(tokens * {k + 1}) div capacity")
        values.append((F.when((x * (k + 1)) % c == 0, x * k).otherwise(whole * c), F.lit(k)))
    for j in range(1, GRID // 2 + 1):
        values.append((F.when(x * GRID > c * (GRID - j), c).when(x * GRID < c * j, 0).otherwise(x), F.lit(1)))
    sums = [F.sum(v).alias(f"s{i}") for i, (v, _) in enumerate(values)]
    per = pieces(docs, bins, id_col, size).filter("tokens > 0").groupBy("bin_id", "capacity").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"), *sums)
    up = [F.expr(f"(s{i} + capacity * {k} - 1) div (capacity * {k})") for i, k in enumerate([1, *range(1, STEPS + 1), *[1] * (GRID // 2)])]
    return per.select("bin_id", "capacity", "pieces", "tokens", F.greatest(*up).cast("long").alias("bound"))


def report(packing: DataFrame, bound: DataFrame) -> DataFrame:
    """Per kind of container: containers used, the dual-feasible bound over all pieces, containers above it, the share of the room filled."""
    used = packing.filter("tokens > 0").groupBy("bin_id").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("packed"))
    both = bound.join(used, "bin_id")
    return both.select(
        "bin_id", "capacity", "containers", "bound", (F.col("containers") - F.col("bound")).alias("above"),
        F.coalesce(F.try_divide(F.col("packed").cast("double"), F.col("containers") * F.col("capacity")), F.lit(0.0)).alias("filled"),
    )


def certificates(packing: DataFrame) -> DataFrame:
    """(bin_id, part, bound, used, certified): one row per partition or pool that closed containers."""
    return packing.select("bin_id", "part", "bound", "used", "certified").distinct()


def audit(docs: DataFrame, packing: DataFrame, id_col: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Per kind of container what must hold of any packing: pieces, tokens, divided documents, overfull containers, documents packed twice or torn."""
    fill = packing.groupBy("bin_id", "container").agg(F.sum("tokens").alias("t"), F.max("capacity").alias("c"))
    over = fill.groupBy("bin_id").agg(F.count_if(F.col("t") > F.col("c")).alias("overfull"))
    n = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("n"))
    per = packing.groupBy("bin_id", "doc_id").agg(F.count(F.lit(1)).alias("k"), F.countDistinct("piece").alias("d"), F.sum("tokens").alias("t"), F.max("capacity").alias("c")).join(n, "doc_id")
    wrong = (F.col("k") != F.col("d")) | (F.col("t") != F.col("n")) | (F.col("k") > 1) & (F.col("n") <= F.col("c"))
    sums = per.groupBy("bin_id").agg(F.sum("k").alias("pieces"), F.sum("t").alias("tokens"), F.count_if(F.col("k") > 1).alias("divided"), F.count_if(wrong).alias("torn"))
    return sums.join(over, "bin_id").select("bin_id", "pieces", "tokens", "divided", "torn", "overfull")
