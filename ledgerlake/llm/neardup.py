"""Near-duplicate texts under small edits, insertions and reordering.

Method: a MinHash LSH forest, then exact verification.

* A text in lower case, of its letters and numbers only, is the set of its substrings of `SHINGLE`
  characters. MinHash values come from `HASHES` hash functions with `BINS` bins each.
* Each of `TREES` trees is a prefix trie of `DEPTH` values, kept as sorted integers: tree, then the
  levels from the root. Rows of one branch meet in one task, sorted, so a bucket is a run; a branch of
  more than HEAVY rows is split into pairs of blocks, which are compared in tasks of their own.
* Prefixes are shortened from full depth to one level above `prefix_depth`, the deepest at which the trees
  together should reach the target recall for pairs just at the threshold, and from there on as long as the last level
  still adds more than the target allows to the pairs that verification confirms: what decides is the recall measured
  on the data, not their size. All pairs of a bucket are candidates, whatever its size.
* Candidates whose one-bit values already tell them apart are dropped: the limit is `SLACK` standard
  deviations below what a pair at the threshold has. The rest is compared exactly.

Equal texts are one class before the forest, so copies cost one signature each and no candidates; no
bucket is capped. Every stage is a shuffle on hashed keys; only two counts are collected.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import durable_table
from ..tables import union_all

SHINGLE = 5
HASHES, BINS = 4, 32
DEPTH, LEVEL_BITS = 5, 11
TREES = HASHES * BINS // DEPTH
#: Values in the order in which the trees use them up: neighbours come from different hash functions.
PLACES = [seed * BINS + at for at in range(BINS) for seed in range(HASHES)]
SLACK = 4.3
#: Rows of a branch that are compared in one group, and pairs that a task holds before it passes them on.
HEAVY, BATCH = 2048, 500_000
TARGET = 0.985


def prefix_depth(threshold: float, target: float = TARGET, trees: int = TREES, depth: int = DEPTH) -> int:
    """The deepest prefix at which a pair of the threshold's likeness shares a bucket of some tree with the target probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def normal_form(text: str) -> str:
    """Lower case, letters and numbers (Unicode categories L and N) only."""
    import regex

    return regex.sub(r"[^\p{L}\p{N}]+", "", text.lower())


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit values (the finaliser of splitmix64)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(texts: list[str], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values (texts x HASHES*BINS) and whether a text has a shingle at all."""
    n = len(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    rows = np.repeat(np.arange(n), lengths)
    some = lengths >= shingle
    if not some.any():
        return np.zeros((n, HASHES * BINS), np.uint32), some
    m = len(points) - shingle + 1
    base = np.zeros(m, np.uint64)
    for k in range(shingle):
        base = base * np.uint64(0x100000001B3) + points[k : k + m]
    inside = rows[:m] == rows[shingle - 1 :]
    base, rows = base[inside], rows[:m][inside]
    none = np.uint32(2**32 - 1)
    out = np.empty((n, HASHES * BINS), np.uint32)
    for seed in range(HASHES):
        h = mix(base, seed)
        least = np.full(n * BINS, none, np.uint32)
        np.minimum.at(least, rows * BINS + (h >> np.uint64(59)).astype(np.int64), ((h >> np.uint64(20)) & np.uint64(2**32 - 2)).astype(np.uint32))
        least = least.reshape(n, BINS)
        empty = least == none
        empty[~some] = False
        step = 0
        filled = least.copy()
        while empty.any():  # an empty bin takes the value of the next one that isn't, marked with the distance
            step += 1
            near = np.roll(least, -step, axis=1)
            take = empty & (near != none)
            filled[take] = near[take] + np.uint32(step * 0x9E3779B1 % 2**32)
            empty &= ~take
        out[:, seed * BINS : (seed + 1) * BINS] = filled
    return out, some


def tree_keys(values: np.ndarray) -> np.ndarray:
    """For each row the place of each tree: the tree's number above the levels of its trie."""
    keys = np.zeros((len(values), TREES), np.int64)
    hashed = mix(values.astype(np.uint64), 77)
    for tree in range(TREES):
        key = np.full(len(values), tree, np.int64)
        for at in PLACES[tree * DEPTH : (tree + 1) * DEPTH]:
            key = (key << LEVEL_BITS) | (hashed[:, at] >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)
        keys[:, tree] = key
    return keys


def sketch(values: np.ndarray) -> np.ndarray:
    """One bit of each value: two integers for each row."""
    bits = (mix(values.astype(np.uint64), 5) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def sign(texts: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Of each text that isn't null: 128 bits of its normal form, the sketch and the tree keys (null without a shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [normal_form(t) for t in batch.column(1).to_pylist()]
            digests = np.array([np.frombuffer(hashlib.blake2b(f.encode("utf-8", "surrogatepass"), digest_size=16).digest(), np.int64) for f in forms], np.int64).reshape(-1, 2)
            values, some = signatures(forms, shingle)
            keys = tree_keys(values)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(forms) + 1) * TREES, pa.int32()), pa.array(keys.reshape(-1)))
            has = pa.array(some)
            bits = sketch(values)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k]) for x in (digests, bits) for k in (0, 1)), pa.compute.if_else(has, lists, None)], names=["id", "k1", "k2", "s1", "s2", "keys"])

    return texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, k1 long, k2 long, s1 long, s2 long, keys array<long>")


def groups(classes: DataFrame, high: int, heavy: int = HEAVY) -> DataFrame:
    """Rows (branch, part, side, key, id, s1, s2) of what is compared together: a branch of at most `heavy` rows is one part.

    A larger one is dealt into blocks by id; each block is a part, and so is each pair of blocks, of which one is side 0, the other 1.
    """
    placed = classes.select(F.explode("keys").alias("key"), "id", "s1", "s2").select(F.shiftright("key", high).alias("branch"), "key", "id", "s1", "s2")
    sizes = placed.groupBy("branch").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("branch", F.ceil(F.col("n") / heavy).alias("blocks"))
    # at most one row for `heavy` rows of a tree: short enough to be sent to every task
    dealt = placed.join(F.broadcast(sizes), "branch", "left").withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    one, two = F.least("own", "other"), F.greatest("own", "other")
    return (
        dealt.withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
        .select("branch", F.coalesce(one * F.col("blocks") + two, F.lit(0).cast("long")).alias("part"), F.coalesce((F.col("own") > F.col("other")).cast("long"), F.lit(0).cast("long")).alias("side"), "key", "id", "s1", "s2")
    )


def candidates(classes: DataFrame, threshold: float, depth: int, heavy: int = HEAVY) -> DataFrame:
    """Pairs (a < b) of class representatives that share a bucket of the forest at this depth and whose sketches allow the threshold; `deeper` tells whether they share one a level deeper.

    Buckets are compared in the parts that `groups` makes of them.
    """
    high = LEVEL_BITS * (DEPTH - depth)
    below = max(high - LEVEL_BITS, 0)
    bits = HASHES * BINS
    least = math.ceil(bits * (1 + threshold) / 2 - SLACK * math.sqrt(bits * (1 + threshold) * (1 - threshold)) / 2)

    def alike(s1: np.ndarray, s2: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return bits - sum(np.bitwise_count((s[i] ^ s[j]).view(np.uint64)).astype(int) for s in (s1, s2)) >= least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by branch, part and side; the rows of a part are in one partition."""
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 5
        for batch in batches:
            held = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
            branch, part = held[1] >> high, held[0] >> 1
            differs = (branch != branch[-1:]) | (part != part[-1:])
            last = int(differs.nonzero()[0][-1]) + 1 if differs.any() else 0
            if last:
                yield from pairs(*(h[:last] for h in held))
                held = [h[last:] for h in held]
        yield from pairs(*held)

    def pairs(place: np.ndarray, key: np.ndarray, ids: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, branch, deep, part, side = len(ids), key >> high, key >> below, place >> 1, place & 1
        new = (branch[1:] != branch[:-1]) | (part[1:] != part[:-1])
        starts = np.concatenate([[0], new.nonzero()[0] + 1]) if n else np.zeros(0, np.int64)
        ends = np.concatenate([starts[1:], [n]]) if n else starts
        bucket = np.repeat(np.arange(len(starts)), ends - starts)
        crossed = np.zeros(len(starts), bool)  # parts of two blocks: only pairs across them
        crossed[bucket[side == 1]] = True
        found, size = [], 0

        def steps() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            i, step = (~crossed[bucket]).nonzero()[0], 0
            while len(i):
                step += 1
                i = i[i + step < n]
                i = i[bucket[i] == bucket[i + step]]
                yield i, i + step
            for g in crossed.nonzero()[0]:
                ones = np.arange(starts[g], ends[g])
                others = ones[side[ones] == 1]
                for one in ones[side[ones] == 0]:
                    yield np.full(len(others), one), others

        for i, j in steps():
            ok = alike(s1, s2, i, j)
            if ok.any():
                i, j = i[ok], j[ok]
                found.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), (deep[i] == deep[j]).astype(np.int64)]))
                size += len(i)
            if size > BATCH:
                yield unique(found)
                found, size = [], 0
        if found:
            yield unique(found)

    def unique(found: list[np.ndarray]) -> pa.RecordBatch:
        a, b, deeper = np.concatenate(found, axis=1)
        order = np.lexsort((-deeper, b, a))
        a, b, deeper = a[order], b[order], deeper[order]
        first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        return pa.RecordBatch.from_arrays([pa.array(x[first]) for x in (a, b, deeper)], names=["a", "b", "deeper"])

    branch, part = F.shiftright("key", high), F.shiftright("place", 1)
    split = groups(classes, high, heavy).select((F.col("part") * 2 + F.col("side")).alias("place"), "key", "id", "s1", "s2").repartition(branch, part).sortWithinPartitions(branch, "place", "id")
    return split.mapInArrow(run, "a long, b long, deeper long").groupBy("a", "b").agg(F.max("deeper").alias("deeper"))


def shorten(classes: DataFrame, check: Callable[[DataFrame], DataFrame], threshold: float, target: float = TARGET, depth: int | None = None) -> DataFrame:
    """Confirmed pairs (a, b, jaccard) of the shortest prefixes needed: a level is added as long as the one before it added more than 1 - `target` of the pairs that `check` confirms."""
    depth = max(1, prefix_depth(threshold, target) - 1) if depth is None else depth
    while True:
        found = durable_table(check(durable_table(candidates(classes, threshold, depth), "candidates")), "links")
        every, deeper = found.agg(F.count("*"), F.sum("deeper")).first()
        if depth == 1 or (every - (deeper or 0)) <= (1 - target) * every:
            return found.select("a", "b", "jaccard")
        depth -= 1


def verified(pairs: DataFrame, texts: DataFrame, id_col: str, text_col: str, threshold: float, shingle: int) -> DataFrame:
    """The pairs (a, b, deeper) that are at least the threshold alike, with `jaccard`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grams(text: str) -> frozenset[str]:
            form = normal_form(text)
            return frozenset(form[k : k + shingle] for k in range(len(form) - shingle + 1))

        for batch in batches:
            known: dict[int, frozenset[str]] = {}
            kept: list[tuple[int, int, int, float]] = []
            for a, b, deeper, x, y in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                p = known.get(a)
                if p is None:
                    p = known[a] = grams(x)
                q = known.get(b)
                if q is None:
                    q = known[b] = grams(y)
                shared = len(p & q)
                either = len(p) + len(q) - shared
                if either and shared >= threshold * either:
                    kept.append((a, b, deeper, shared / either))
            columns = list(zip(*kept, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "deeper", "jaccard"])

    needed = pairs.select("a").union(pairs.select("b").withColumnRenamed("b", "a")).distinct()
    some = texts.select(F.col(id_col).cast("long").alias("a"), F.col(text_col).alias("x")).join(needed, "a", "left_semi")
    other = some.select(F.col("a").alias("b"), F.col("x").alias("y"))
    return pairs.join(some, "a").join(other, "b").select("a", "b", "deeper", "x", "y").mapInArrow(run, "a long, b long, deeper long, jaccard double")


def near_duplicates(texts: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Links and members: (`a`, `b`, `jaccard`) between class representatives, and (`class`, `id`) of every text.

    A class is the texts with one normal form, its representative the least id. Null texts have no
    row. A text without a shingle is a class that only its copies belong to. The id must be unique.
    """
    signed = durable_table(sign(texts, id_col, text_col, shingle), "signatures")
    classes = signed.groupBy("k1", "k2").agg(F.min("id").alias("class"), F.count("*").alias("size"))
    members = durable_table(signed.select("id", "k1", "k2").join(classes, ["k1", "k2"]).select("class", "id", "size"), "members")
    heads = signed.select("id", "s1", "s2", "keys").join(members.where("class = id").select("id"), "id", "left_semi").where("keys is not null")
    return shorten(heads, lambda pairs: verified(pairs, texts, id_col, text_col, threshold, shingle), threshold), members


def all_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair of ids (`first` < `second`) that is linked or of one class; as many rows as there are such pairs."""
    one, two = members.select(F.col("class").alias("a"), F.col("id").alias("p")), members.select(F.col("class").alias("b"), F.col("id").alias("q"))
    across = links.join(one, "a").join(two, "b").select(F.least("p", "q").alias("first"), F.greatest("p", "q").alias("second"))
    copies = members.where("size > 1")
    within = copies.select("class", F.col("id").alias("first")).join(copies.select("class", F.col("id").alias("second")), "class").where("first < second")
    return union_all(across, within.select("first", "second"))


def class_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row per text: `id`, `class`, `copies` (texts of the class) and `links` (other classes that are near)."""
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("class")).agg(F.count("*").alias("links"))
    return members.join(degree, "class", "left").select("id", "class", F.col("size").alias("copies"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def components(links: DataFrame, members: DataFrame) -> DataFrame:
    """`id` and `cluster` of every text: the least class that links lead to, over any number of them.

    Each round every class takes the least label among its neighbours', then the label of that label; rounds go on until nothing changes.
    """
    edges = durable_table(links.select("a", "b").union(links.select("b", "a")), "edges")
    labels = members.select("class").distinct().withColumn("cluster", F.col("class"))
    while True:
        near = edges.join(labels, F.col("b") == F.col("class")).groupBy("a").agg(F.min("cluster").alias("_near"))
        lower = labels.join(near, F.col("class") == F.col("a"), "left").select("class", F.col("cluster").alias("_old"), F.least("cluster", "_near").alias("_new"))
        lower = durable_table(lower, "labels")
        jumped = lower.join(lower.select(F.col("class").alias("_new"), F.col("_new").alias("cluster")), "_new").select("class", "_old", "cluster")
        jumped = durable_table(jumped, "labels")
        labels = jumped.select("class", "cluster")
        if not jumped.where("_old <> cluster").limit(1).count():
            return members.join(labels, "class").select("id", "cluster")
