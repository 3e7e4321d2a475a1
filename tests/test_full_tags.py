"""Reads whose tags call every A and C to the end, which the derived reads of the queries don't."""

import random

import pytest

from strandlake.functions.modtags import Descriptor
from strandlake.functions.motif import Motif
from strandlake.operators import reads, tags

LENGTHS = (1, 300, 20_000)


@pytest.fixture(scope="module")
def full():
    rng = random.Random(3)
    out = []
    for i, n in enumerate(LENGTHS):
        seq = "".join(rng.choices("ACGT", k=n - 1)) + "A"
        segments = [(d, [rng.randrange(256) for _ in range(seq.count(b))]) for b, d in (("A", "A+a."), ("C", "C+m.")) if b in seq]
        out.append((f"read_{i}", seq, "".join(f"{d},{','.join('0' * len(q))};" for d, q in segments), [x for _, q in segments for x in q]))
    return out


def _frame(spark, full):
    return spark.createDataFrame(full, "read_id string, seq string, mm string, ml array<int>")


def _calls(read):
    _, seq, _, ml = read
    at = [p for b in "AC" for p, c in enumerate(seq) if c == b]
    return {p: ("a" if seq[p] == "A" else "m", q) for p, q in zip(at, ml)}


def test_every_base_is_called(spark, full):
    got = {(r.read_id, r.position): (r.mod_type, r.quality) for r in reads.read_calls(_frame(spark, full)).collect()}
    assert got == {(r[0], p): c for r in full for p, c in _calls(r).items()}


def test_hits_to_the_end_have_their_quality(spark, full):
    got = {(r.read_id, r.start): r.quality for r in reads.read_fastq_pattern(_frame(spark, full), [Motif.new("GATC", "a", 1)]).collect()}
    want = {(r[0], p + 1): _calls(r)[p + 1][1] for r in full for p in range(len(r[1])) if r[1].startswith("GATC", p)}
    assert got == want and max(p for _, p in want) > 19_000


def test_long_tags_are_removed_and_merged(spark, full):
    frame, m, a = _frame(spark, full), Descriptor.parse("C+m."), Descriptor.parse("A+a.")
    only_a = tags.remove_tags(frame, [m])
    assert {r.read_id: len(r.ml) for r in only_a.collect()} == {r[0]: r[1].count("A") for r in full}
    merged = {r.read_id: (r.mm, list(r.ml)) for r in tags.merge_tags(frame.drop("seq"), only_a.drop("seq"), ignore=[a]).collect()}
    assert merged == {r[0]: (r[2], r[3]) for r in full}
