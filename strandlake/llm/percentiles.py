"""Exact percentiles per group from mergeable frequencies.

Method: SQL cumulative frequencies. The rows are reduced to counts per group and
value, with partial sums before the shuffle; the counts are range-sorted by
group and value; running sums over each group's window of a range get the
offsets of the ranges before it; the first value whose running sum reaches a
target rank is the percentile. The counts move once, to their range. The frequencies of separate days or partitions add up, so the
result is exact however they are combined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.heavy_keys import key_changes
from strandlake.session import materialize


@dataclass(frozen=True)
class Measure:
    """A numeric expression and the closed range of its valid values."""

    value: Column
    low: float = -math.inf
    high: float = math.inf


def frequencies(rows: DataFrame, groups: dict[str, Column], measures: dict[str, Measure], period: Column | None = None) -> DataFrame:
    """State: one row per group, measure, value (and period) with its count ``n``.

    Columns: the groups, ``measure``, ``period`` if given, ``value`` double,
    ``n``. Nulls, NaN and values outside a measure's range aren't counted. A
    null group is a group of its own. States of any parts of the rows may be
    added by ``merge``.
    """
    # a measure is a number until the counts are made, as they move by it
    found = F.array(*(F.struct(F.lit(i).cast("tinyint").alias("_measure"), (m.value.cast("double") + F.lit(0.0)).alias("value"), F.lit(float(m.low)).alias("low"), F.lit(float(m.high)).alias("high")) for i, m in enumerate(measures.values())))
    valid = F.filter(found, lambda x: ~F.isnan(x.value) & (x.value >= x.low) & (x.value <= x.high))
    keys = [c.alias(k) for k, c in groups.items()] + ([period.alias("period")] if period is not None else [])
    long = rows.select(*keys, F.inline(valid)).drop("low", "high")
    by = [*groups, *(["period"] if period is not None else [])]
    counts = long.groupBy(*by, "_measure", "value").agg(F.count("*").alias("n"))
    return counts.select(*by, F.get(F.array(*map(F.lit, measures)), F.col("_measure").cast("int")).alias("measure"), "value", "n")


def merge(states: list[DataFrame], groups: list[str]) -> DataFrame:
    """Sum of states, over all their periods."""
    keys = [*groups, "measure", "value"]
    return reduce(DataFrame.unionByName, (s.select(*keys, "n") for s in states)).groupBy(*keys).agg(F.sum("n").alias("n"))


def _running_sums(n_keys: int):
    """For a sorted range: each row's running sum and the sum of its group, within the range, the range's number, and whether the group is its first or last.

    A group's rows are held until its sum is known, which is a range at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = TaskContext.get().partitionId()
        held: list[tuple[pa.RecordBatch, np.ndarray]] = []  # the open group, which may go on in the next batch
        held_sum, first = 0, True

        def out(batch: pa.RecordBatch, upto: np.ndarray, part: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
            ends = [pa.array(upto), pa.array(part), pa.array(np.full(len(upto), where, dtype=np.int32)), pa.array(edge)]
            return pa.RecordBatch.from_arrays([*batch.columns, *ends], names=[*batch.schema.names, "_upto", "_part", "_range", "_edge"])

        def flush(edge: bool) -> Iterator[pa.RecordBatch]:
            for b, upto in held:
                yield out(b, upto, np.full(len(upto), held_sum), np.full(len(upto), edge))
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(n_keys + 1).to_numpy()
            new = np.zeros(batch.num_rows, dtype=bool)
            for i in range(n_keys):
                new[1:] |= key_changes(batch.column(i))
            new[0] = not held or any(held[-1][0].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(n_keys))
            if new[0]:
                first_held, first = first, first and not held
                yield from flush(first_held)
                held_sum = 0
            starts = np.flatnonzero(new)
            starts = starts if new[0] else np.append(0, starts)
            sizes = np.diff(np.append(starts, len(n)))
            part = np.add.reduceat(n, starts)
            part[0] += held_sum
            total = np.cumsum(n) + held_sum
            upto = total - np.repeat(np.append(0, np.cumsum(part)[:-1]), sizes)
            last = int(starts[-1])
            if last:
                held_sum = int(part[0])
                yield from flush(first)
                yield out(batch.slice(0, last), upto[:last], np.repeat(part, sizes)[:last], (np.arange(last) < sizes[0]) & first)
                first = False
            held.append((batch.slice(last), upto[last:]))
            held_sum = int(part[-1])
        yield from flush(True)

    return run


def percentiles(state: DataFrame, groups: list[str], percents: list[int], ranges: int | None = None) -> DataFrame:
    """Nearest-rank percentiles of a state that has one row per group, measure and value.

    Columns: the groups, ``measure``, ``n_values`` and ``pNN`` per percent: the
    least value that at least that percent of the values don't exceed. Groups
    without valid values have no row. ``ranges``: number of sorted ranges
    (default: the session's shuffle partitions).
    """
    if any(p != int(p) or not 0 < p <= 100 for p in percents):
        raise ValueError("percents must be whole numbers from 1 to 100")
    spark = state.sparkSession
    keys = [*groups, "measure"]
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = state.select(*keys, "value", "n").repartitionByRange(n, *keys, "value").sortWithinPartitions(*keys, "value")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    summed = ranged.mapInArrow(_running_sums(len(keys)), f"{schema}, _upto long, _part long, _range int, _edge boolean")
    # written, as the ranges' numbers must be the same for the offsets and for what they are added to
    summed = materialize(summed, "running-sums")
    # a bound between ranges lies in one group at most: no more than 2 (n - 1) parts of split groups
    parts = summed.where("_edge").groupBy("_range", *keys).agg(F.max("_part").alias("_part"))
    same = Window.partitionBy(*keys)
    split = parts.withColumn("_parts", F.count("*").over(same)).where("_parts > 1")
    split = split.select(*(F.col(k).alias(f"_s_{k}") for k in keys), F.col("_range").alias("_s_range"), (F.sum("_part").over(same.orderBy("_range")) - F.col("_part")).alias("_before"), F.sum("_part").over(same).alias("_all"))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys), F.col("_range") == F.col("_s_range"))
    placed = summed.join(F.broadcast(split), on, "left")
    total = F.coalesce("_all", "_part")
    upto = F.col("_upto") + F.coalesce("_before", F.lit(0))

    def at(p: int) -> Column:
        rank = F.call_function("div", F.lit(p) * F.col("_total") + F.lit(99), F.lit(100))
        return F.max(F.when((F.col("_to") >= rank) & (F.col("_to") - F.col("n") < rank), F.col("value"))).alias(f"p{p:02d}")

    return placed.select(*keys, "value", "n", upto.alias("_to"), total.alias("_total")).groupBy(*keys).agg(F.max("_total").alias("n_values"), *(at(p) for p in percents))
