"""Tags, alignments and motifs on reads."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import modtags
from strandlake.functions.modtags import Descriptor, TagError, parse_rename
from strandlake.functions.motif import parse_motifs
from strandlake.operators import reads as ops
from strandlake.operators import tags
from strandlake.operators.cigar import cigar_blocks

READ = "read_id string, seq string, mm string, ml array<int>"


def calls(*args, **kw):
    p, k, q = ops.decode_calls(*args, **kw)
    return {int(a): (b, int(c)) for a, b, c in zip(p, k, q)}


def test_decoding():
    assert calls("TTACGATAGCAAT", "A+a.,0,1;", [31, 190]) == {2: ("a", 31), 7: ("a", 190)}
    assert calls("CC", "C+m.,0;C+21839.,0;", [18, 3]) == {0: ("m", 18)} and calls("CC", "C+m.,0;C+21839.,0;", [7, 7]) == {}
    assert calls("AA", "A+a.,5;", [1]) == {} and calls("AA", None, None) == {} and calls("AA", "", []) == {} and calls("", "A+a.,0;", [1]) == {}
    with pytest.raises(ops.ReadError, match="MM/ML length mismatch: 1 modifications but 2 quality scores"):
        calls("A", "A+a.,0;", [1, 2])


def test_spec_and_compat():
    mm, ml = "C+h?,0,0;C+m?,0,0;", [1, 2, 3, 4]
    assert calls("CC", mm, ml) == {0: ("m", 3), 1: ("m", 4)} and calls("CC", mm, ml, mode="compat") == {0: ("m", 1), 1: ("m", 2)}
    assert calls("CC", "C+m,0;", [9]) == {0: ("m", 9)} and calls("CC", "C+m,0;", [9], mode="compat") == {}
    assert calls("CC", "C+m.,0;C+m.,1;", [9, 8], mode="compat") == {1: ("m", 8)}


def test_cigar():
    assert ops.position_map("2S3M1I2=1D1X4H", 10, 9).tolist() == [-1, -1, 10, 11, 12, -1, 13, 14, 16]
    assert ops.reference_position("2S3M", 10, 3) == 11 and ops.reference_position("2S3M", 10, 0) is None
    assert ops.position_map("100M", 0, 3).tolist() == [0, 1, 2] and ops.position_map("*", 0, 2).tolist() == [-1, -1]


def test_status():
    ref = ops.position_map("2S3M1D4M", 10, 9)
    at = np.array([1, 3, 4, 2])
    assert ops.mapping_status(ref, at, ref[at], 3).tolist() == ["unmapped", "gapped", "gapped", "complete"]
    assert ops.mapping_status(ref, np.array([-1, 8]), np.array([5, 5]), 2).tolist() == ["partial", "partial"]


def test_blocks_agree_with_the_map(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        rows.append((f"r{i}", "".join(f"{rng.randrange(1, 9)}{rng.choice('MIDNSHP=X')}" for _ in range(rng.randrange(1, 8))), rng.randrange(100)))
    got = cigar_blocks(spark.createDataFrame(rows, "read_id string, cigar string, start int")).collect()
    for read, cigar, start in rows:
        m = ops.position_map(cigar, start, 200)
        want = {i: int(p) for i, p in enumerate(m) if p >= 0}
        assert {b.read_from + i: b.ref_from + i for b in got if b.read_id == read for i in range(b.length)} == want


def test_patterns(spark):
    motifs = parse_motifs(["GATC_a_1"])
    seq = "TTGATCTTGATCTT"
    data = [("f", seq, "A+a.,0,0;", [200, 100], "c", 0, "+", "14M", 60), ("r", seq, None, None, "c", 0, "-", "4S10M", None), ("x", seq, None, None, "other", 0, "+", "14M", 1), ("n", None, None, None, "c", 0, "+", "1M", 1)]
    df = spark.createDataFrame(data, READ + ", contig string, start int, strand string, cigar string, mapq int")
    fastq = sorted(tuple(r) for r in ops.read_fastq_pattern(df, motifs).collect())
    assert fastq[:2] == [("f", 3, 14, "GATC", "a", 1, 200), ("f", 9, 14, "GATC", "a", 1, 100)] and len(fastq) == 6
    contigs = spark.createDataFrame([("c", seq)], "contig string, sequence string")
    bam = {(r.read_id, r.start_read): r for r in ops.read_bam_pattern(df, contigs, motifs).collect()}
    assert set(bam) == {("f", 3), ("f", 9), ("r", 3), ("r", 9)}
    assert bam["f", 3].reference_has_motif and bam["f", 3].mapping_status == "complete" and bam["f", 3].basecall_quality == 200
    assert bam["r", 3].start_contig == 6 and bam["r", 9].start_contig == 0 and bam["r", 9].mapping_quality == 0
    assert bam["r", 9].mapping_status == "partial"
    assert ops.filter_reads(df, ["f", "zz"]).count() == 1
    assert ops.read_calls(df).count() == 2


def test_descriptors():
    for good in ("C+m", "A+a.", "T+g?", "C+21839", "C+."):
        assert str(Descriptor.parse(good)) == good
    for bad in ("", "C", "C+", "X+m", "C+mM", "C+m1"):
        with pytest.raises(TagError):
            Descriptor.parse(bad)
    old, new = parse_rename("C+21839.:m")
    assert (str(old), str(new)) == ("C+21839.", "C+m.")


def one(spark, expr, mm, ml=None):
    return spark.createDataFrame([(mm, ml)], "mm string, ml array<int>").select(*expr).first()


def test_tag_strings(spark):
    mm, ml = "C+m,0,1,2;A+a,3,4;", [100, 150, 200, 50, 75]
    c, q = F.col("mm"), F.col("ml")
    assert one(spark, [modtags.rename(c, "C+m", "C+h")], mm)[0] == "C+h,0,1,2;A+a,3,4;"
    assert one(spark, [modtags.rename(c, "C+m", "C+h")], None)[0] is None and one(spark, [modtags.rename(c, "C+m", "C+h")], "")[0] == ""
    assert tuple(one(spark, modtags.remove(c, q, ["C+m"]), mm, ml)) == ("A+a,3,4;", [50, 75])
    assert tuple(one(spark, modtags.remove(c, q, ["C+m", "A+a"]), mm, ml)) == (None, None)
    assert tuple(one(spark, modtags.remove(c, q, ["C+x"]), mm, ml)) == (mm, ml) and tuple(one(spark, modtags.remove(c, q, ["C+m"]), None, [1])) == (None, [1])
    assert tuple(one(spark, modtags.append(c, q, F.lit("A+a,1;"), F.lit([1])), None, None)) == ("A+a,1;", [1])
    with pytest.raises(Exception, match="an MM tag but no ML qualities"):
        one(spark, [modtags.checked(c, q)], mm, None)
    head = "MM:Z:A+a.,0; ML:B:C,5,255 x"
    assert one(spark, [modtags.header_tag(c, "MM"), modtags.ml_values(modtags.header_tag(c, "ML")), modtags.header_tag(c, "XX")], head)[:] == ("A+a.,0;", [5, 255], None)
    with pytest.raises(Exception, match="Parse error: '256'"):
        one(spark, [modtags.ml_values(c)], "C,256")


def test_merge(spark):
    s = "read_id string, mm string, ml array<int>"
    src = spark.createDataFrame([("a", "C+m.,1;", [1], 1), ("a", "C+m.,2;", [2], 2), ("b", "", [], 1), ("z", "C+m.,9;", [9], 1)], s + ", n int")
    dst = spark.createDataFrame([("a", "A+a.,0;", [7], "k"), ("b", None, None, "k"), ("c", "A+a.,3;", [3], "k")], s + ", other string")
    got = {r.read_id: (r.mm, r.ml) for r in tags.merge_tags(src, dst, order="n").collect()}
    assert got == {"a": ("A+a.,0;C+m.,2;", [7, 2]), "b": (None, None), "c": ("A+a.,3;", [3])}
    with pytest.raises(TagError):
        tags.merge_tags(dst.select("read_id", "mm", "ml"), dst)
    d = Descriptor.parse("A+a.")
    got = {r.read_id: r.mm for r in tags.merge_tags(dst.select("read_id", "mm", "ml"), dst, rename_source=[(d, d.with_code("x"))]).collect()}
    assert got["c"] == "A+a.,3;A+x.,3;"
