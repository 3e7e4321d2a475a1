"""Mixes: budgets, uses and shares."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandlake.llm.mixing import Leaf, budgets, distribute, language, mix

DOCS = "id long, source string, lang string, n long, n_uses string, _source string"
TARGETS = "source string, target_share double, max_uses int"


def test_distribute():
    assert distribute(100, [1, 1, 2], [1000, 1000, 1000]) == [25, 25, 50]
    assert distribute(100, [1, 1, 2], [10, 1000, 1000]) == pytest.approx([10, 30, 60])
    assert distribute(100, [1, 1], [10, 20]) == [10, 20] and distribute(5, [], []) == [] and distribute(5, [0, 1], [9, 9]) == [0, 5]


def test_shortage_goes_to_siblings_first():
    leaves = [Leaf(("d", "en", "a"), 0.25, 10, 10), Leaf(("d", "en", "b"), 0.25, 500, 500), Leaf(("d", "de", "a"), 0.25, 500, 500), Leaf(("d", "de", "b"), 0.25, 500, 500)]
    assert budgets(leaves, 400) == {("d", "en", "a"): 10, ("d", "en", "b"): 190, ("d", "de", "a"): 100, ("d", "de", "b"): 100}
    leaves[1] = Leaf(("d", "en", "b"), 0.25, 50, 50)
    assert budgets(leaves, 400) == {("d", "en", "a"): 10, ("d", "en", "b"): 50, ("d", "de", "a"): 170, ("d", "de", "b"): 170}
    assert budgets([], 5) == {}


def test_language(spark):
    values = ["EN", " en-GB", "eng", "de", None, "und", "", "english", "zh_CN"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "l string").select(language(F.col("l"))).collect()]
    assert got == ["en", "en", "en", "de", "und", "und", "und", "und", "zh"]


def make(n=4000):
    rng = random.Random(9)
    rows = [(i, rng.choice(["Big", " big", "BIG ", "big", "mid", "small", None, "other"]), rng.choice(["en", "EN", "de", None]), rng.choice([None, 0, rng.randrange(1, 60)]), "x", "y") for i in range(n)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = make()
    goals = [("big", 0.4, 1), ("mid", 0.2, 3), ("small", 0.3, 5), ("absent", 0.1, 2)]
    out = mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame(goals, TARGETS), "id", "source", "lang", F.col("n"), seed)
    uses = out.uses.collect()
    own = lambda s: (s or "").strip().lower()
    by_id = {r[0]: r for r in rows}
    most = {s: m for s, _, m in goals}
    taken = defaultdict(int)
    assert len({r["id"] for r in uses}) == len(uses)
    for r in uses:
        assert own(by_id[r["id"]][1]) == r["source"] and 1 <= r["n_uses"] <= most[r["source"]] and r["size"] == (by_id[r["id"]][3] or 0)
        taken[r["source"]] += r["size"] * r["n_uses"]
    sizes = {s: sum(r[3] or 0 for r in rows if own(r[1]) == s) for s in most}
    total = sum(sizes.values())
    shares = {r["source"]: r for r in out.shares.collect()}
    assert {s: r["reachable"] for s, r in shares.items()} == {s: sizes[s] * m >= w * total for s, w, m in goals}
    for s, r in shares.items():
        assert r["taken"] == taken[s] and r["available"] == sizes[s] and r["share"] == pytest.approx(taken[s] / sum(taken.values()))
        assert abs(r["taken"] - r["budget"]) <= 60 * 4  # half a document per language
    assert abs(sum(taken.values()) - total) < 0.01 * total
    again = mix(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(goals, TARGETS), "id", "source", "lang", F.col("n"), seed)
    assert {tuple(r) for r in again.uses.collect()} == {tuple(r) for r in uses}


def test_uses_differ_by_at_most_one_within_a_leaf(spark):
    rows = [(i, "a", "en", 10, "", "") for i in range(100)] + [(1000 + i, "b", "en", 10, "", "") for i in range(300)]
    out = mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("a", 0.6, 9), ("b", 0.4, 9)], TARGETS), "id", "source", "lang", F.col("n"))
    counts = defaultdict(int)
    for r in out.uses.collect():
        counts[r["source"], r["n_uses"]] += 1
    assert counts == {("a", 2): 60, ("a", 3): 40, ("b", 1): 160}


def test_edges(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    out = mix(docs, targets, "id", "source", "lang", F.col("n"))
    assert out.uses.collect() == [] and [tuple(r) for r in out.shares.collect()] == [("a", 1.0, 1, 0, 0, 0, 0.0, True)]
    some = spark.createDataFrame([(1, "a", "en", 5, "", ""), (1, "a", "en", 5, "", "")], DOCS)
    none = mix(some, targets.limit(0), "id", "source", "lang", F.col("n"))
    assert none.uses.collect() == [] and none.shares.collect() == []
    odd = mix(some, spark.createDataFrame([("a", None, 1), ("b", -1.0, None), (None, 1.0, 1)], TARGETS), "id", "source", "lang", F.col("n"))
    assert odd.uses.collect() == [] and odd.shares.count() == 2
    assert mix(some, targets, "id", "source", "lang", F.col("n")).uses.count() == 2


def test_two_domains(spark):
    """What one domain can't give comes from its own sources and languages first, then from the other domain."""
    rows = [(i, "a", "en", 10, "web", "") for i in range(100)] + [(1000 + i, "b", "en", 10, "web", "") for i in range(300)] + [(2000 + i, "a", "en", 10, "books", "") for i in range(40)] + [(3000 + i, "a", "en", 10, None, "") for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, source string, lang string, n long, shelf string, domain string")
    out = mix(docs, spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 2)], TARGETS), "id", "source", "lang", F.col("n"), domain=F.col("shelf"))
    leaves = {(r["domain"], r["source"]): r for r in out.leaves.collect()}
    assert set(leaves) == {(d, s) for d in ("web", "books", "") for s in ("a", "b")}
    # the fair part of a is 5000 * 0.7, of which web, books and the unnamed domain have 100, 40 and 60 of 200 documents
    assert [leaves[d, "a"]["budget"] for d in ("web", "books", "")] == [1750, 700, 1050] and leaves["web", "b"]["budget"] == 1500
    assert all(r["taken"] == r["budget"] <= r["most"] for r in leaves.values())
    assert {r["source"]: r["reachable"] for r in out.shares.collect()} == {"a": True, "b": True}
    short = mix(docs, spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 2)], TARGETS), "id", "source", "lang", F.col("n"), domain=F.col("shelf"))
    got = {r["source"]: r for r in short.shares.collect()}
    assert not got["a"]["reachable"] and got["a"]["taken"] == 2000 and got["b"]["reachable"] and got["b"]["taken"] == 3000


def test_documents_without_keys(spark):
    rows = [(None, "a", "en", 10, "", "")] * 200 + [(None, "b", "en", 7, "", "")] * 100
    out = mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGETS), "id", "source", "lang", F.col("n"))
    taken = defaultdict(int)
    for r in out.uses.collect():
        taken[r["source"]] += r["size"] * r["n_uses"]
    assert taken["b"] == 1351 and taken["a"] == 1350
