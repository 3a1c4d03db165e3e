"""Filling fixed-capacity containers with items of varying length.

Method: Karmarkar-Karp multiway differencing. Every item starts as a partial partition with one
non-empty window; the two partial partitions with the largest imbalances are merged so that the
full windows of one meet the empty windows of the other, until one partition is left. Its windows
are near-equal. Where a window is beyond the capacity the window count rises by one and items are differenced again; before
that, items are exchanged between windows, a step that can be left out at the price of space.

At scale the items are first parted by a hash into groups of about `GROUP_ITEMS`, whose number grows
with the data; groups are packed independently, one task holds one group at a time, and at most one
part-filled container a group is lost to the parting. An item larger than the capacity is cut into
consecutive pieces; its full pieces are containers of their own and only the rest is differenced.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
GROUP_ITEMS = 1024


def difference(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each item, and the sum of each window, by multiway differencing."""
    n = len(sizes)
    if windows == 1:
        return np.zeros(n, int), np.array([sizes.sum()])
    left, right = [-1] * n, [-1] * n  # of the merged nodes; the first n are the items
    parts = {i: (np.array([s]), np.array([i])) for i, s in enumerate(sizes)}  # sums in falling order, nodes
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    fresh = n
    while len(heap) > 1:
        a_sums, a_nodes = parts.pop(heapq.heappop(heap)[1])
        b_sums, b_nodes = parts.pop(heapq.heappop(heap)[1])
        over = len(a_sums) + len(b_sums) - windows
        if over > 0:  # the smallest of either meet: the large ones of one stand against empty windows of the other
            both_a, both_b = slice(len(a_sums) - over, None), slice(len(b_sums) - over, None)
            joined = []
            for x, y in zip(a_nodes[both_a], b_nodes[both_b][::-1], strict=True):
                joined.append(len(left))
                left.append(int(x))
                right.append(int(y))
            sums = np.concatenate([a_sums[:-over], b_sums[:-over], a_sums[both_a] + b_sums[both_b][::-1]])
            nodes = np.concatenate([a_nodes[:-over], b_nodes[:-over], np.array(joined)])
        else:
            sums, nodes = np.concatenate([a_sums, b_sums]), np.concatenate([a_nodes, b_nodes])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        parts[fresh] = (sums, nodes)
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == windows else 0)
        heapq.heappush(heap, (-spread, fresh))
        fresh += 1
    sums, nodes = parts.popitem()[1]
    window = np.zeros(n, int)
    for w, node in enumerate(nodes):
        stack = [int(node)]
        while stack:
            x = stack.pop()
            if x < n:
                window[x] = w
            else:
                stack += [left[x], right[x]]
    return window, sums


def relieve(sizes: np.ndarray, window: np.ndarray, sums: np.ndarray, capacity: int) -> None:
    """Exchanges items of windows beyond the capacity with others, in place, as far as there is an exchange.

    An exchange gives an item of the full window for a smaller one (or for nothing) of a window that
    has the space; the one that leaves the least excess is made, of equal ones the tightest.
    """
    far = np.iinfo(np.int64).max
    offer = np.concatenate([sizes, np.zeros(len(sums), sizes.dtype)])
    for w in np.argsort(-sums, kind="stable"):
        while sums[w] > capacity:
            of = np.concatenate([window, np.arange(len(sums))])
            space = capacity - sums[of]
            own = np.flatnonzero(window == w)
            gain = sizes[own][:, None] - offer[None, :]
            fits = (gain > 0) & (gain <= space[None, :]) & (of != w)[None, :]
            if not fits.any():
                break
            excess = np.where(fits, np.maximum(sums[w] - gain - capacity, 0), far)
            i, j = np.unravel_index(int(np.argmin(np.where(excess == excess.min(), space[None, :] - gain, far))), gain.shape)
            if j < len(sizes):
                window[j] = w
            window[own[i]] = of[j]
            sums[of[j]] += gain[i, j]
            sums[w] -= gain[i, j]


def pack(sizes: np.ndarray, capacity: int, exchange: bool = True) -> np.ndarray:
    """Window of each item; no window holds more than `capacity`, to which no item may come.

    The items are differenced for the least number of windows that could hold them. As long as a window is beyond the capacity the number
    rises by one and items are differenced again: all of them, or with `exchange`, which first exchanges items between windows, those of the
    windows that are still beyond it.
    """
    if not len(sizes):
        return np.zeros(0, int)
    windows = max(1, -(-int(sizes.sum()) // capacity))
    window, sums = difference(sizes, windows)
    while sums.max() > capacity:
        if exchange:
            relieve(sizes, window, sums, capacity)
            full = np.flatnonzero(sums > capacity)
            if not len(full):
                break
            again = np.flatnonzero(np.isin(window, full))
            places = np.append(full, len(sums))
            part, part_sums = difference(sizes[again], len(places))
            window[again], sums = places[part], np.append(sums, 0)
            sums[places] = part_sums
        else:
            windows += 1
            window, sums = difference(sizes, windows)
    return np.unique(window, return_inverse=True)[1]


def pack_items(items: DataFrame, rows: int, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, exchange: bool = True) -> DataFrame:
    """One row per piece: `container`, the id, `piece` (from 0), `first` (place of its first token) and `n_tokens`.

    items: one row per item; `rows` is their number, from which the number of groups follows. Items
    of size null or 0 have no row. Equal ids are items of their own but not told apart by the result.
    Ties are settled by id, so the result depends on the data only.
    """
    groups = max(1, -(-rows // group_items))
    sized = items.select(F.col(id_col).alias("_id"), F.col(size_col).cast("long").alias("_n")).where("_n > 0")
    pieces = sized.select("_id", "_n", F.explode(F.expr(f"sequence(0L, (_n - 1) div {capacity})")).alias("_k"))
    pieces = pieces.select("_id", F.col("_k").cast("int").alias("piece"), F.least(F.lit(capacity).cast("long"), F.expr(f"_n - _k * {capacity}")).alias("n_tokens"), F.pmod(F.xxhash64("_id", "_k"), F.lit(groups)).cast("int").alias("_group"))

    def windows(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_tokens", "_id", "piece"], ascending=[False, True, True], kind="stable")
        sizes = part["n_tokens"].to_numpy()
        full = int((sizes == capacity).sum())  # these come first and are containers of their own
        window = np.concatenate([np.arange(full), full + pack(sizes[full:], capacity, exchange)])
        return pd.DataFrame({"container": [f"{g}:{w}" for g, w in zip(part["_group"], window, strict=True)], id_col: part["_id"], "piece": part["piece"], "first": part["piece"].astype("int64") * capacity, "n_tokens": part["n_tokens"]})

    kind = items.schema[id_col].dataType.simpleString()
    # rows are few bytes, so the number of tasks follows from the groups, not from the size of the shuffle
    tasks = max(1, min(groups, 3 * items.sparkSession.sparkContext.defaultParallelism), groups // 64)
    return pieces.repartition(tasks, "_group").groupBy("_group").applyInPandas(windows, f"container string, `{id_col}` {kind}, piece int, first long, n_tokens long")


def container_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per container: its pieces, tokens and the space left over."""
    return packed.groupBy("container").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), (F.lit(capacity) - F.sum("n_tokens")).alias("space"))
