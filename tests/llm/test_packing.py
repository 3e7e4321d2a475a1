"""Containers: whole items, capacities, exact fills, and the plan's size."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm.packing import _best_fit, _Slots, fill_report, pack, plan_containers


def check_plan(counts, capacity):
    plan = plan_containers(np.array(counts), capacity)
    used = Counter()
    for p in plan:
        assert p.times > 0 and sum(s * k for s, k in p.sizes.items()) <= capacity
        for s, k in p.sizes.items():
            used[s] += k * p.times
    assert used == Counter({s: n for s, n in enumerate(counts) if n and s})
    return plan


def test_exact_combinations():
    counts = [0] * 11
    for s in (7, 3, 6, 2, 2, 10):
        counts[s] += 1
    assert sum(p.times for p in check_plan(counts, 10)) == 3
    counts = [0] * 11
    counts[4], counts[3], counts[2], counts[1] = 1, 1, 1, 1  # one and three others
    assert [p.sizes for p in check_plan(counts, 10)] == [{4: 1, 3: 1, 2: 1, 1: 1}]


@pytest.mark.parametrize("seed", range(8))
def test_random_plans(seed):
    rng = random.Random(seed)
    capacity = rng.choice([5, 12, 64])
    counts = [0] + [rng.choice([0, 0, 1, 3, 10**9]) for _ in range(capacity)]
    plan = check_plan(counts, capacity)
    assert len(plan) <= 40 * capacity
    total, containers = sum(s * n for s, n in enumerate(counts)), sum(p.times for p in plan)
    assert containers * capacity < 2 * total + capacity  # no two containers could share one


def test_rest_goes_where_the_gap_is_least():
    """2 fits the first container, with 60 in it, but leaves less room in the second, with 55 and 42."""
    counts = np.bincount([60, 55, 42, 2], minlength=101)
    assert sorted(tuple(sorted(p.sizes)) for p in check_plan(counts, 100)) == [(2, 42, 55), (60,)]


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_of_single_items(seed):
    rng = random.Random(seed)
    capacity = rng.choice([5, 12, 30, 64])
    left = np.array([0] + [rng.choice([0, 0, 0, 1, 2, 7]) for _ in range(capacity)])
    open_containers = []
    for s in range(capacity, 0, -1):
        for _ in range(left[s]):
            fitting = [i for i, used in enumerate(open_containers) if used + s <= capacity]
            if fitting:
                open_containers[max(fitting, key=lambda i: open_containers[i])] += s
            else:
                open_containers.append(s)
    got = [sum(s * k for s, k in p.sizes.items()) for p in _best_fit(left, capacity) for _ in range(p.times)]
    assert sorted(got) == sorted(open_containers)


def test_slots_number_each_item_once():
    counts = np.array([3, 5, 4, 9, 0, 2, 1, 0, 1])
    slots = _Slots(plan_containers(counts, 8), 8)
    room = Counter()
    for s, n in enumerate(counts):
        for c in slots.containers(s, np.arange(n)) if n else []:
            room[int(c)] += s
    assert max(room.values()) <= 8 and set(room) <= set(range(slots.n))


def test_pack(spark):
    rng = random.Random(1)
    sizes = [rng.choice([0, None, -3, 1, 5, 17, 17, 17, 40, 99, 100, 101, 250, 300]) for _ in range(3000)]
    rows = [(i if i % 50 else None, s, "x", "y") for i, s in enumerate(sizes)] + [(1, 30, "x", "y"), (1, 30, "x", "y")]
    df = spark.createDataFrame(rows, "id long, s long, piece_no string, container_id string")
    got = pack(df, "id", F.col("s"), 100).collect()
    room, pieces = Counter(), defaultdict(list)
    for r in got:
        room[r["container_id"]] += r["piece_size"]
        pieces[r["id"]].append((r["piece_no"], r["piece_size"]))
    assert max(room.values()) <= 100 and sum(room.values()) == sum(max(r[1] or 0, 0) for r in rows)
    for i, s in enumerate(sizes):
        if i % 50 and i != 1:
            s = max(s or 0, 0)
            assert sorted(pieces[i]) == [(j, x) for j, x in enumerate([100] * ((s - 1) // 100) + [s - (s - 1) // 100 * 100] if s else [0])]
    report = fill_report(pack(df, "id", F.col("s"), 100), 100).first()
    assert report["n_containers"] == len([c for c in room if True]) and report["fullest"] <= 100 and report["fill"] > 0.98
    assert report["least_containers"] <= report["n_containers"]


def test_pack_edges(spark):
    df = spark.createDataFrame([], "id long, s long")
    assert pack(df, "id", F.col("s")).collect() == []
    assert tuple(fill_report(pack(df, "id", F.col("s")))
                 .select("n_containers", "fill").first()) == (0, 0.0)
    empty = spark.createDataFrame([(1, 0), (2, None)], "id long, s long")
    assert {tuple(r) for r in pack(empty, "id", F.col("s")).collect()} == {(1, 0, 0, 0), (2, 0, 0, 0)}
