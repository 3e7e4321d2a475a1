"""Per-key results without skew, against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandlake.operators.heavy_keys import balanced_key_stats, heavy_keys

SCHEMA = "s string, k string, p long, c long, v long, i long, n_rows string, _p string"


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0], r[1]].append(r)
    out = {}
    for key, g in groups.items():
        pos = sorted({r[2] for r in g if r[2] is not None})
        gaps = [b - a - 1 for a, b in zip(pos, pos[1:])]
        cov = [r[3] for r in g if r[3] is not None]
        out[key] = (len(g), sum(cov), sum(r[4] or 0 for r in g), max(cov, default=None), len(pos), bool(pos) + sum(x > 0 for x in gaps), max(gaps, default=0), pos[0] if pos else None, pos[-1] if pos else None)
    return out


def run(spark, rows, partitions=None):
    df = spark.createDataFrame(rows, SCHEMA)
    return balanced_key_stats(df, {"s": F.col("s"), "k": F.col("k")}, F.col("p"), F.col("c"), F.col("v"), tie=F.col("i"), partitions=partitions)


@pytest.mark.parametrize("partitions", [None, 1, 7, 40])
def test_against_brute_force(spark, partitions):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        key = rng.choice(["hot"] * 6 + ["warm", "", None, "x", "y", "z%d" % rng.randrange(40)])
        pos = rng.choice([None, 7, 7, 7, rng.randrange(300), rng.randrange(10**9)])
        rows.append((rng.choice("ab"), key, pos, rng.choice([None, 0, 4294967295, rng.randrange(50)]), rng.choice([None, rng.randrange(9)]), i, "n", "p"))
    rows += rows[:50]
    got = {(r["s"], r["k"]): tuple(r)[2:] for r in run(spark, rows, partitions).collect()}
    assert got == brute(rows)


def test_one_position_of_one_key_is_split(spark):
    rows = [("a", "hot", 5, 1, 1, i, "", "") for i in range(4000)]
    stats = run(spark, rows, 8)
    assert [tuple(r)[2:] for r in stats.collect()] == [brute(rows)["a", "hot"]]


def test_negative_positions_nulls_only_and_empty(spark):
    rows = [("a", "k", -5, None, None, 1, "", ""), ("a", "k", -4, None, None, 2, "", ""), ("a", "n", None, None, None, 3, "", "")]
    assert {(r["s"], r["k"]): tuple(r)[2:] for r in run(spark, rows).collect()} == brute(rows)
    assert run(spark, rows).limit(0).count() == 0
    assert balanced_key_stats(spark.createDataFrame([], SCHEMA), {"k": F.col("k")}, F.col("p"), F.col("c"), F.col("v")).collect() == []


def test_heavy_keys_counts_all_rows(spark):
    rows = [("a", "half", 1, 1, 1, i, "", "") for i in range(50)] + [("a", None, 1, 1, 1, i, "", "") for i in range(30)] + [("a", "", 1, 1, 1, i, "", "") for i in range(18)] + [("a", "edge", 1, 1, 1, 0, "", ""), ("a", "edge", 1, 1, 1, 0, "", "")]
    rows += [("b", "one", 1, 1, 1, 0, "", "")]
    got = {(r["s"], r["k"]) for r in heavy_keys(run(spark, rows), ["s"], "k", 50).collect()}
    assert got == {("a", "half"), ("a", "edge"), ("b", "one")}
