"""Per-key results when a few keys hold most rows.

Method: the rows are range-partitioned on the composite of key, position and a
spreading hash, with bounds from sampled quantiles (Spark's range partitioner),
so a heavy key is split over as many partitions as its share calls for, even
where all its rows have one position. Each partition makes one partial state
per key from its sorted rows; the states, at most one per key plus one per
partition, are stitched at their boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.session import materialize

_STATE = "n_rows long, sum_cov long, sum_value long, max_cov long, n_positions long, n_islands long, max_gap long, first_pos long, last_pos long"
_NAMES = ("n_rows", "sum_cov", "sum_value", "max_cov", "n_positions", "n_islands", "max_gap", "first_pos", "last_pos")
_NONE = np.iinfo(np.int64).min


def key_changes(column: pa.Array) -> np.ndarray:
    """For each row but the first, whether its value differs from the one before; nulls are equal."""
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


def _long(column: pa.Array, null: int) -> np.ndarray:
    return pc.fill_null(column, pa.scalar(null, pa.int64())).to_numpy(zero_copy_only=False)


def _runs(batch: pa.RecordBatch, n_keys: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Start row of each key's run in a sorted batch, and its state."""
    n = batch.num_rows
    new = np.ones(n, dtype=bool)
    new[1:] = False
    for i in range(n_keys):
        new[1:] |= key_changes(batch.column(i))
    starts = np.flatnonzero(new)
    pos, cov, value = (batch.column(n_keys + i) for i in range(3))
    p = _long(pos, _NONE)
    placed = p != _NONE
    before = np.empty(n, dtype=np.int64)
    before[0], before[1:] = _NONE, p[:-1]
    before[starts] = _NONE
    follows = placed & (before != _NONE)
    gap = np.where(follows, p - np.where(follows, before, 0) - 1, -1)
    fresh = placed & (gap != -1) | placed & ~follows
    c, v = _long(cov, 0), _long(value, 0)
    ends = np.append(starts[1:], n) - 1
    low = np.where(placed, p, np.iinfo(np.int64).max)
    first = np.minimum.reduceat(low, starts)
    return starts, {
        "n_rows": ends - starts + 1,
        "sum_cov": np.add.reduceat(c, starts),
        "sum_value": np.add.reduceat(v, starts),
        "max_cov": np.maximum.reduceat(_long(cov, _NONE), starts),
        "n_positions": np.add.reduceat(fresh.astype(np.int64), starts),
        "n_islands": np.add.reduceat((placed & (~follows | (gap > 0))).astype(np.int64), starts),
        "max_gap": np.maximum.reduceat(np.maximum(gap, 0), starts),
        "first_pos": np.where(first == np.iinfo(np.int64).max, _NONE, first),
        "last_pos": p[ends],
    }


def _merge(a: dict[str, int], b: dict[str, int]) -> dict[str, int]:
    """The state of rows a followed by rows b of the same key."""
    out = {k: a[k] + b[k] for k in ("n_rows", "sum_cov", "sum_value", "n_positions", "n_islands")}
    out |= {"max_cov": max(a["max_cov"], b["max_cov"]), "max_gap": max(a["max_gap"], b["max_gap"])}
    if a["last_pos"] != _NONE and b["first_pos"] != _NONE:
        gap = b["first_pos"] - a["last_pos"] - 1
        out["n_positions"] -= gap == -1
        out["n_islands"] -= gap <= 0
        out["max_gap"] = max(out["max_gap"], gap)
    out["first_pos"] = a["first_pos"] if a["first_pos"] != _NONE else b["first_pos"]
    out["last_pos"] = b["last_pos"] if b["last_pos"] != _NONE else a["last_pos"]
    return out


def _partials(n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last run may go on in the next batch

        def emit(keys: list[pa.Array], state: dict[str, np.ndarray]) -> pa.RecordBatch:
            cols = [pa.array(state[k], mask=state[k] == _NONE if k in ("max_cov", "first_pos", "last_pos") else None, type=pa.int64()) for k in _NAMES]
            return pa.RecordBatch.from_arrays([*keys, *cols], names=[*(f"_k{i}" for i in range(n_keys)), *_NAMES])

        for batch in batches:
            if not batch.num_rows:
                continue
            starts, state = _runs(batch, n_keys)
            keys = [batch.column(i).take(pa.array(starts)) for i in range(n_keys)]
            if held:
                if all(h[0].as_py() == k[0].as_py() for h, k in zip(held[0], keys)):
                    merged = _merge(held[1], {k: int(state[k][0]) for k in _NAMES})
                    for k in _NAMES:
                        state[k][0] = merged[k]
                else:
                    yield emit(held[0], {k: np.array([held[1][k]]) for k in _NAMES})
            last = len(starts) - 1
            if last:
                yield emit([k.slice(0, last) for k in keys], {k: state[k][:last] for k in _NAMES})
            held = [k.slice(last, 1) for k in keys], {k: int(state[k][last]) for k in _NAMES}
        if held:
            yield emit(held[0], {k: np.array([held[1][k]]) for k in _NAMES})

    return run


def balanced_key_stats(rows: DataFrame, keys: dict[str, Column], position: Column, coverage: Column, value: Column, tie: Column | None = None, partitions: int | None = None) -> DataFrame:
    """One row per key: counts, sums and coverage of its positions.

    Columns: the keys, then ``n_rows``; ``sum_cov``, ``sum_value`` (nulls count
    as 0); ``max_cov`` (null if all are); ``n_positions`` distinct positions;
    ``n_islands`` maximal runs of neighbouring positions; ``max_gap`` most
    positions missing between two covered ones; ``first_pos``, ``last_pos``
    (null without positions). Null keys form a key of their own; rows with a
    null position count in all but the position columns. Repeated rows count
    each time. An empty table gives no rows. Only the given expressions are
    read, so other columns and their names don't matter.

    ``tie``: what tells rows at one position of a key apart, such as a row id
    (default: coverage and value). ``partitions`` overrides the number of ranges (default: the session's).
    """
    names = [f"_k{i}" for i in range(len(keys))]
    picked = rows.select(
        *(c.cast("string").alias(n) for n, c in zip(names, keys.values())),
        position.cast("long").alias("_p"), coverage.cast("long").alias("_c"), value.cast("long").alias("_v"),
        # spreads the rows of one position; taken from the row alone, so that a task that runs again sends them the same way
        F.hash(coverage if tie is None else tie, value).alias("_s"),
    )
    order = [*names, "_p", "_s"]
    ranged = picked.repartitionByRange(partitions, *order) if partitions else picked.repartitionByRange(*order)
    kept = ranged.sortWithinPartitions(*names, "_p").select(*names, "_p", "_c", "_v")
    states = kept.mapInArrow(_partials(len(keys)), ", ".join(f"{n} string" for n in names) + ", " + _STATE)
    return _stitched(states, names).select(*(F.col(n).alias(k) for n, k in zip(names, keys)), *_NAMES)


def _stitched(states: DataFrame, names: list[str]) -> DataFrame:
    """Merge the partitions' states of each key. A key has at most one state per partition."""
    w = Window.partitionBy(*names).orderBy(F.col("first_pos").asc_nulls_first(), "last_pos").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("first_pos") - F.col("_before") - 1
    linked = states.withColumn("_before", F.max("last_pos").over(w)).withColumn("_gap", gap)
    return linked.groupBy(*names).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("sum_cov").alias("sum_cov"), F.sum("sum_value").alias("sum_value"), F.max("max_cov").alias("max_cov"),
        (F.sum("n_positions") - F.count_if(F.col("_gap") == -1)).alias("n_positions"),
        (F.sum("n_islands") - F.count_if(F.col("_gap") <= 0)).alias("n_islands"),
        F.greatest(F.max("max_gap"), F.coalesce(F.max("_gap"), F.lit(0))).alias("max_gap"),
        F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"),
    )


def heavy_keys(stats: DataFrame, per: list[str], key: str, parts: int) -> DataFrame:
    """Keys, neither null nor empty, with at least one in ``parts`` of all rows of their ``per`` group.

    All rows count in the total, those of null and empty keys too. There is one
    total per ``per`` group, that is per source table, so they are broadcast.
    """
    stats = materialize(stats, "key-stats")  # read twice; one row per key
    totals = stats.groupBy(*per).agg(F.sum("n_rows").alias("_all"))
    named = stats.where(F.col(key).isNotNull() & (F.col(key) != ""))
    return named.join(F.broadcast(totals), per).where(F.col("n_rows") * F.lit(parts) >= F.col("_all")).drop("_all")
