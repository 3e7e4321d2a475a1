"""Orphan references against brute force, on both join paths."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators.orphans import References, bloom_filter, orphan_references, orphan_report, parent_lifetimes, proved_shares

T0 = dt.datetime(2024, 1, 1)
PARENT = "id string, loaded_at timestamp, removed_at timestamp, sequence string"
CHILD = "k long, ref string, at timestamp, reason string, src_table string"


def hour(n):
    return None if n is None else T0 + dt.timedelta(hours=n)


def live(parents, ref, at):
    return any(i is not None and i.strip() == ref and a is not None and at is not None and a <= at and (b is None or at < b) for i, a, b, _ in parents)


def make(seed, n=400):
    rng = random.Random(seed)
    parents = []
    for _ in range(60):
        a = rng.choice([None, *range(50)])
        b = rng.choice([None, *range(50)])
        parents.append((rng.choice(["a", "b ", "\tc", "d", "e", "f", None, ""]), hour(a), hour(b), "X"))
    refs = [(i, rng.choice(["a", "a", "a", "b", " b", "c", "zz", "z\n", "A", None, "", " "]), hour(rng.choice([None, *range(55)])), "r", "s") for i in range(n)]
    return parents, refs


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "salts": 2}, {"max_words": 64, "bits_per_key": 1}])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, options):
    parents, refs = make(seed)
    p = parent_lifetimes([spark.createDataFrame(parents[:40], PARENT), spark.createDataFrame(parents[40:], PARENT)])
    t = References("t", spark.createDataFrame(refs, CHILD), F.col("k"), F.col("ref"), F.col("at"))
    got = orphan_references([t], p, **options)
    want = {k for k, ref, at, *_ in refs if ref and ref.strip() and not live(parents, ref.strip(), at)}
    rows = got.collect()
    assert sorted(r["row_key"] for r in rows) == sorted(want)
    known = {i.strip() for i, *_ in parents if i}
    assert all((r["reason"] == "missing") == (r["parent_key"] not in known) for r in rows)


def test_reasons_and_report(spark):
    parents = [("a", hour(10), hour(20), ""), ("a", hour(30), None, ""), ("b", hour(10), hour(20), ""), ("b", hour(30), hour(40), ""), ("b", hour(50), hour(60), ""), ("n", None, None, ""), ("i", hour(5), hour(5), "")]
    p = parent_lifetimes([spark.createDataFrame(parents, PARENT)])
    refs = [(1, "a", hour(9)), (2, "a", hour(10)), (3, "a", hour(20)), (4, "a", hour(29)), (5, "a", hour(30)), (6, "a", hour(9999)), (7, "b", hour(25)), (8, "b", hour(35)), (9, "b", hour(60)), (10, "n", hour(1)), (11, "i", hour(5)), (12, "q", hour(1)), (13, "a", None)]
    t = References("t", spark.createDataFrame(refs, "k long, ref string, at timestamp"), F.col("k"), F.col("ref"), F.col("at"))
    got = orphan_references([t], p)
    assert {r["row_key"]: r["reason"] for r in got.collect()} == {1: "loaded_later", 3: "removed", 4: "removed", 7: "removed", 9: "removed", 10: "never_live", 11: "never_live", 12: "missing", 13: "undated"}
    report = {(r["month"], r["reason"]): r["n_orphans"] for r in orphan_report(got).collect()}
    assert report[("unknown", "undated")] == 1 and report[("2024-01", "removed")] == 4


def test_repeated_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], PARENT)
    refs = spark.createDataFrame([(1, "a", hour(1)), (1, "a", hour(1))], "k long, ref string, at timestamp")
    t = References("t", refs, F.col("k"), F.col("ref"), F.col("at"))
    assert [r["reason"] for r in orphan_references([t], parent_lifetimes([none])).collect()] == ["missing", "missing"]
    assert orphan_references([References("t", refs.limit(0), F.col("k"), F.col("ref"), F.col("at"))], parent_lifetimes([none])).count() == 0


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("id"))
    bloom, n_words = bloom_filter(keys, 5000)
    assert bloom.count() <= n_words <= 2048
    from strandlake.operators.orphans import _word_and_mask

    def passing(df):
        w, m = _word_and_mask(F.col("id"), n_words)
        return df.withColumn("_word", w).withColumn("m", m).join(bloom, "_word").where("(_bits & m) = m").count()

    assert passing(keys) == 5000
    assert passing(spark.range(5000).select(F.concat(F.lit("other"), "id").alias("id"))) < 250


def test_proved_shares(spark):
    parents = parent_lifetimes([spark.createDataFrame([(f"k{i}", hour(0), None, "") for i in range(3000)], PARENT)])
    refs = [(i, f"k{i}" if i % 2 else f"other{i}", hour(1)) for i in range(2000)] + [(-1, None, hour(1)), (-2, " ", hour(1))]
    t = References("t", spark.createDataFrame(refs, "k long, ref string, at timestamp"), F.col("k"), F.col("ref"), F.col("at"))
    r = proved_shares([t], parents).first()
    assert r["n_references"] == 2000 and r["n_proved"] + r["n_verified"] == 2000 and 980 <= r["n_proved"] <= 1000
    full = proved_shares([t], parents, bits_per_key=1, max_words=64).first()
    assert full["n_proved"] < r["n_proved"] and orphan_references([t], parents, bits_per_key=1, max_words=64).count() == 1000
