"""Cutting sequences, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.llm import split

SCHEMA = "row long, seq string, piece_no string, _key string"


def brute_stretches(seq, gap):
    bases = "".join(seq.split())
    unknown = [c in "Nn-" for c in bases]
    in_gap, i = [False] * len(bases), 0
    while i < len(bases):
        j = i
        while j < len(bases) and unknown[j]:
            j += 1
        if j - i >= gap:
            in_gap[i:j] = [True] * (j - i)
        i = max(j, i + 1)
    starts = [i for i in range(len(bases)) if not in_gap[i] and (i == 0 or in_gap[i - 1])]
    ends = [next((j for j in range(s, len(bases)) if in_gap[j]), len(bases)) for s in starts]
    return bases, starts, ends


def texts():
    rng = random.Random(4)
    out = []
    for _ in range(150):
        s = "".join(rng.choice(["A", "C", "g", "N" * rng.randrange(1, 9), "-n", "\n", " ", "ACGT" * rng.randrange(1, 20)]) for _ in range(rng.randrange(60)))
        out.append(s)
    return [*out, "", None, "N" * 200, "N" * 30 + "A" * 50, "A" * 100 + "-" * 30, "é" * 120 + " " + "N" * 9 + "ü" * 60, "A" * 40, "A" * 41, ("A" * 40) + "\n"]


@pytest.mark.parametrize("limit,overlap,gap", [(40, 5, 5), (40, 0, 3), (40, 39, 5), (1, 0, 1)])
def test_against_brute_force(spark, limit, overlap, gap):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, s, "x", "y") for i, s in rows], SCHEMA)
    got = split.split_long(df, "row", "seq", limit, overlap, gap).collect()
    for i, s in rows:
        mine = sorted((r for r in got if r["row"] == i), key=lambda r: r["piece_no"])
        bases, starts, ends = brute_stretches(s or "", gap)
        if len(bases) <= limit:
            assert not mine
            continue
        assert [x for r in mine for x in r["stretch_starts"]] == starts
        for a, b in zip(mine, mine[1:]):
            cut = a["piece_end"] in ends and b["piece_start"] in starts
            assert cut or a["piece_end"] - b["piece_start"] == overlap
            assert cut or not any(a["piece_start"] < e <= a["piece_start"] + limit for e in ends)  # no boundary was in reach
            later = [e for e in ends if a["piece_end"] < e <= a["piece_start"] + limit]
            assert not later
        for r in mine:
            assert 0 < r["piece_end"] - r["piece_start"] <= limit and r["bases"] == bases[r["piece_start"] : r["piece_end"]]
        covered = {p for r in mine for p in range(r["piece_start"], r["piece_end"])}
        assert {p for s_, e in zip(starts, ends) for p in range(s_, e)} <= covered


def test_edges(spark):
    df = spark.createDataFrame([(None, "A" * 50, "", ""), (1, "A" * 50, "", ""), (1, "A" * 50, "", "")], SCHEMA)
    assert split.split_long(df, "row", "seq", 40, 5).count() == 6
    assert split.split_long(df.limit(0), "row", "seq").collect() == []
    assert split.split_long(df, "row", "seq", 40, 5, with_text=False).columns == ["row", "piece_no", "piece_start", "piece_end", "stretch_starts"]
    long = spark.createDataFrame([(1, "ACGT" * 750_000 + "N" * 25 + "A")], "row long, seq string")
    out = split.split_long(long, "row", "seq")
    assert out.agg(F.max(F.length("bases"))).first()[0] == 10_000 and out.agg(F.sum(F.size("stretch_starts"))).first()[0] == 2
    with pytest.raises(ValueError):
        split.split_long(df, "row", "seq", 10, 10)
