"""Percentiles, against sorting."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandlake.llm.percentiles import Measure, frequencies, merge, percentiles

SCHEMA = "g string, day int, x double, y long, value string, n string, measure string"
PERCENTS = [1, 50, 90, 99, 100]


def data():
    rng = random.Random(6)
    rows = []
    for _ in range(4000):
        g = rng.choice(["hot"] * 5 + ["b", "c", None, "", "none"])
        x = None if g == "none" else rng.choice([None, math.nan, -1.0, 101.0, 0.0, -0.0, 100.0, 50.0, 50.0, rng.random() * 100])
        rows.append((g, rng.randrange(4), x, rng.choice([None, 3, rng.randrange(2000), 4294967296]), "v", "n", "m"))
    return rows + rows[:40]


def brute(rows):
    groups = defaultdict(list)
    for g, _, x, y, *_ in rows:
        if x is not None and not math.isnan(x) and 0 <= x <= 100:
            groups[g, "x"].append(x)
        if y is not None and y <= 4294967295:
            groups[g, "y"].append(float(y))
    return {k: (len(v), *(sorted(v)[-(-p * len(v) // 100) - 1] for p in PERCENTS)) for k, v in groups.items()}


def state(df, period=None):
    return frequencies(df, {"g": F.col("g")}, {"x": Measure(F.col("x"), 0, 100), "y": Measure(F.col("y"), 0, 4294967295)}, period)


def result(df):
    return {(r["g"], r["measure"]): tuple(r)[2:] for r in df.collect()}


@pytest.mark.parametrize("ranges", [None, 1, 2, 23])
def test_against_sorting(spark, ranges):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    got = percentiles(state(df), ["g"], PERCENTS, ranges)
    assert got.columns == ["g", "measure", "n_values", "p01", "p50", "p90", "p99", "p100"]
    assert result(got) == brute(rows)


def test_days_and_partitions_combine(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(percentiles(merge([state(df, F.col("day"))], ["g"]), ["g"], PERCENTS)) == brute(rows)
    parts = [state(df.where(F.col("day") == d)) for d in range(4)]
    assert result(percentiles(merge(parts, ["g"]), ["g"], PERCENTS)) == brute(rows)


def test_empty_and_ties(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert percentiles(state(df), ["g"], [50]).collect() == []
    ties = spark.createDataFrame([("a", 1, 7.0, None, "", "", "")] * 500, SCHEMA)
    assert result(percentiles(state(ties), ["g"], [1, 99])) == {("a", "x"): (500, 7.0, 7.0)}
    with pytest.raises(ValueError):
        percentiles(state(df), ["g"], [0])
