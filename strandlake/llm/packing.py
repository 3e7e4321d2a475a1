"""Putting texts into containers of fixed capacity.

Method: exact-complement hashing. Only the histogram of sizes is planned, at
most one entry per size up to the capacity. For each size, largest first, the
gap it leaves is looked up among the single sizes, pair sums and triple sums
that are still available; a combination that fills the gap exactly is used as
often as its counts allow. What remains is placed by best fit. A plan is a list
of patterns (sizes in a container, number of containers), so its length depends
on the capacity, not on the number of texts. Each item then finds its container
from its rank among the items of its size.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.session import materialize

CAPACITY = 4096
#: Ranks are numbered within buckets of about this many items of one size.
ITEMS_PER_BUCKET = 250_000


@dataclass(frozen=True)
class Pattern:
    """``times`` containers, each with the same items: size -> how many."""

    sizes: dict[int, int]
    times: int


def _exact(left: np.ndarray, size: int, gap: int, pair_sums: np.ndarray) -> tuple[int, ...] | None:
    """Available sizes that with ``size`` fill a container exactly: one, else two, else three."""
    have = left > 0

    def fits(*sizes: int) -> bool:
        return all(left[s] >= k for s, k in Counter((size, *sizes)).items())

    def pair(g: int, *with_: int) -> tuple[int, int] | None:
        a = np.arange(g // 2, 0, -1)
        for x in a[have[a] & have[g - a]]:
            if fits(int(x), int(g - x), *with_):
                return int(x), int(g - x)
        return None

    if gap == 0:
        return ()
    if fits(gap):
        return (gap,)
    if gap >= 2 and pair_sums[gap] and (two := pair(gap)):
        return two
    if gap >= 3:
        a = np.arange(gap - 2, 0, -1)
        for x in a[have[a] & pair_sums[gap - a]]:
            if fits(int(x)) and (two := pair(gap - int(x), int(x))):
                return (int(x), *two)
    return None


def _pair_sums(have: np.ndarray) -> np.ndarray:
    """Which sums two available sizes have: the index of pairs by their sum."""
    n = 1 << (2 * len(have) - 1).bit_length()
    f = np.fft.rfft(have.astype(np.float64), n)
    return np.fft.irfft(f * f, n)[: len(have)] > 0.5


def plan_containers(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold all items; ``counts[s]``: items of size s, for s from 1 to ``capacity``."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out: list[Pattern] = []

    def use(sizes: Counter) -> None:
        times = min(int(left[s]) // k for s, k in sizes.items())
        for s, k in sizes.items():
            left[s] -= times * k
        out.append(Pattern(dict(sizes), times))

    for size in range(capacity, 0, -1):
        sums = _pair_sums(left > 0) if left[size] else None
        while left[size] and (found := _exact(left, size, capacity - size, sums)) is not None:
            use(Counter((size, *found)))
    out += _best_fit(left, capacity)
    return out


def _best_fit(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit decreasing: each item, largest first, goes into the open container with the least gap that holds it.

    Containers of one content are one group, kept by their gap. An item leaves
    its container the least gap of all, so the next of its size follows it
    while there is room: a container takes as many of a size as fit, and only
    the last one fewer.
    """
    groups: list[list[tuple[Counter, int]]] = [[] for _ in range(capacity + 1)]
    gaps = np.zeros(capacity + 1, dtype=bool)

    def put(gap: int, sizes: Counter, times: int) -> None:
        groups[gap].append((sizes, times))
        gaps[gap] = True

    for size in np.flatnonzero(left)[::-1].tolist():
        n = int(left[size])
        while n:
            least = int(np.argmax(gaps[size:])) + size
            if gaps[least]:
                sizes, times = groups[least].pop()
                gaps[least] = bool(groups[least])
            else:
                least, sizes, times = capacity, Counter(), max(1, n // (capacity // size))
            k = min(n, least // size)
            filled = min(times, n // k)
            n -= filled * k
            put(least - k * size, sizes + Counter({size: k}), filled)
            if times > filled:
                put(least, sizes, times - filled)
    return [Pattern(dict(sizes), times) for g in groups for sizes, times in g]


class _Slots:
    """For each size the ranks that each pattern takes, to find a rank's container by binary search."""

    def __init__(self, plan: list[Pattern], capacity: int) -> None:
        per: dict[int, list[tuple[int, int]]] = {}
        base = 0
        for p in plan:
            for s, k in p.sizes.items():
                per.setdefault(s, []).append((k * p.times, k, base))
            base += p.times
        self.n = base
        self.ends, self.each, self.base = {}, {}, {}
        for s, rows in per.items():
            a = np.array(rows, dtype=np.int64)
            self.ends[s], self.each[s], self.base[s] = np.cumsum(a[:, 0]), a[:, 1], a[:, 2]

    def containers(self, size: int, ranks: np.ndarray) -> np.ndarray:
        """Containers of the items of one size with these ranks from 0; empty items are spread over all."""
        if size == 0:
            return ranks % max(self.n, 1)
        i = np.searchsorted(self.ends[size], ranks, side="right")
        first = np.concatenate(([0], self.ends[size][:-1]))[i]
        return self.base[size][i] + (ranks - first) // self.each[size][i]


def pack(rows: DataFrame, key: str, size: Column, capacity: int = CAPACITY, numbered: bool = False) -> DataFrame:
    """The container of each item.

    Columns: ``key`` (as given), ``piece_no``, ``piece_size``, ``container_id``
    from 0 and, if ``numbered``, ``item_no``, one number per row of ``rows``. An item
    over the capacity is split into full pieces and a rest; others have the one
    piece 0. A null or negative size counts as 0; items of size 0 go into any
    container (0 if there are no others). Repeated rows and null keys are items
    of their own. An empty table gives an empty result.
    """
    sized = rows.select(F.col(f"`{key}`").alias("_key"), F.monotonically_increasing_id().alias("_item"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("_size"))
    full = F.call_function("div", F.greatest(F.col("_size") - 1, F.lit(0)), F.lit(capacity))
    items = sized.select("_key", "_item", F.posexplode(F.concat(F.array_repeat(F.lit(capacity), full.cast("int")), F.array((F.col("_size") - full * capacity).cast("int")))).alias("piece_no", "piece_size"))
    items = materialize(items, "items")  # sizes are measured once

    histogram = items.groupBy("piece_size").agg(F.count("*").alias("n")).collect()  # at most capacity + 1 rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in histogram:
        counts[r["piece_size"]] = r["n"]
    slots = _Slots(plan_containers(counts, capacity), capacity)

    buckets = 8 + int(counts.max()) // ITEMS_PER_BUCKET
    spread = items.withColumn("_bucket", F.pmod(F.xxhash64("_item", "piece_no"), F.lit(buckets)).cast("int"))
    inside = F.row_number().over(Window.partitionBy("piece_size", "_bucket").orderBy("_item", "piece_no")) - 1
    counted = spread.withColumn("_in", inside)
    sizes = spread.groupBy("piece_size", "_bucket").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("piece_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("piece_size", "_bucket", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    ranked = counted.join(starts.hint("shuffle_hash"), ["piece_size", "_bucket"]).withColumn("_rank", F.col("_in") + F.col("_start"))

    shared = rows.sparkSession.sparkContext.broadcast(slots)  # bounded by the capacity

    @F.pandas_udf("long")
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        s, r = size.to_numpy(), rank.to_numpy()
        out = np.empty(len(s), dtype=np.int64)
        order = np.argsort(s, kind="stable")
        cuts = np.flatnonzero(np.diff(s[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                out[part] = shared.value.containers(int(s[part[0]]), r[part])
        return pd.Series(out)

    return ranked.select(F.col("_key").alias(key), "piece_no", "piece_size", container("piece_size", "_rank").alias("container_id"), *([F.col("_item").alias("item_no")] if numbered else []))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers in use, items, their size, the share of the room used, and the least possible number of containers."""
    per = packed.groupBy("container_id").agg(F.sum("piece_size").alias("s"), F.count("*").alias("n"))
    total = F.coalesce(F.sum("s"), F.lit(0))
    return per.agg(
        F.count("*").alias("n_containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), total.alias("total_size"),
        F.coalesce(F.max("s"), F.lit(0)).alias("fullest"), F.coalesce(total / (F.nullif(F.count("*"), F.lit(0)) * capacity), F.lit(0.0)).alias("fill"),
        F.ceil(total / F.lit(capacity)).alias("least_containers"),
    )
