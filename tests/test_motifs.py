"""Alphabet, motifs, scans and motif tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandlake.functions import iupac
from strandlake.functions.motif import Motif, MotifError, collapse_children, parse_motifs, patterns, union_motif
from strandlake.operators import motifs as ops
from strandlake.operators.scan import find_motif, motif_blocks, motif_positions, occurrences, with_motifs


def test_alphabet():
    assert {x: iupac.COMPLEMENTS[x] for x in "RYKMBVDHSWN"} == dict(zip("RYKMBVDHSWN", "YRMKVBHDSWN"))
    assert iupac.overlap_class("A") == "[ARWMDHVN]" and iupac.display_regex("R") == "[AG]" and iupac.display_regex("N") == "."
    assert iupac.from_bases("ga") == "R" and "".join(iupac.EXPANSIONS["N"]) == "ATGC"
    for bad in ("", "AX"):
        with pytest.raises(iupac.IupacError):
            iupac.from_bases(bad)


@pytest.mark.parametrize("args,message", [
    (("CCAGG", "m", 5), "mod_position 5 is out of bounds for sequence of length 5. Note mod_position is 0-indexed."),
    (("CCAGG", "q", 1), "Unsupported mod type: q"),
    (("CCAGG", "m", 3), "mod_position 3 points to base 'G' which is invalid for 5mC (m) modification type."),
    (("CCAGG", "a", 1), "mod_position 1 points to base 'C' which is invalid for 6mA."),
    (("NCAGG", "m", 1), "Motif sequence starts or ends with N, which is invalid: NCAGG"),
    (("CCAGN", "m", 1), "Motif sequence starts or ends with N, which is invalid: CCAGN"),
    (("CXAGG", "a", 2), "Base 'X' in sequence 'CXAGG' is not a valid IUPAC code"),
])
def test_motif_errors(args, message):
    with pytest.raises(MotifError, match=re.escape(message)):
        Motif.new(*args)


def test_motif_parsing_and_reverse_complement():
    assert str(Motif.parse("RCATGY_a_2").reverse_complement()) == "RCATGY_a_3"
    assert str(Motif.parse("ATCCAT_m_2").reverse_complement()) == "ATGGAT_m_3" and Motif.parse("RCATGY_a_2").to_regex() == "[AG]CATG[CT]"
    assert str(Motif.parse("GATC_a_1").extend_with_n(2)) == "GATCNN_a_1" and str(Motif.parse("GATC_a_1").prepend_n(2)) == "NNGATC_a_3"
    for bad in ("GATC_a", "GATC_a_x", "GATC_a_256", "GATC_a_1_2"):
        with pytest.raises(MotifError):
            Motif.parse(bad)


def test_collapse_and_union():
    listed = parse_motifs(["CCWGG_m_1", "ACCWGG_m_2", "TTCAA_m_2", "CCWGGT_m_1", "GAAG_a_1"])
    assert [str(m) for m in collapse_children(listed)] == ["CCWGG_m_1", "TTCAA_m_2", "GAAG_a_1"]
    assert [str(m) for m in collapse_children(parse_motifs(["CATG_a_1", "CATG_m_0", "RCATGY_a_2"]))] == ["CATG_a_1", "CATG_m_0"]
    assert collapse_children(parse_motifs(["GATC_a_1", "GATC_a_1"])) == []
    assert [str(m) for m in collapse_children(parse_motifs(["GATM_a_1", "GATC_a_1"]))] == ["GATM_a_1"]
    assert str(union_motif(parse_motifs(["GATC_a_1", "CATC_a_1"]))) == "SATC_a_1"
    with pytest.raises(MotifError):
        union_motif(parse_motifs(["GATC_a_1", "GATCC_a_1"]))


@pytest.mark.parametrize("sequence,motif,want", [
    ("CAGATCTGATCA", "GATC_m_3", [5, 10]), ("CAGATCTGATCA", "RGATCY_m_4", [5]), ("CAGATCTGATCA", "GATC_a_1", [3, 8]), ("TTCAGGTGCACTTG", "CANNTG_a_1", [3, 9]),
    ("AAAA", "AA_a_0", [0, 1, 2]), ("GNTC", "GATC_a_1", [1]), ("GA", "GATC_a_1", []), ("", "GATC_a_1", []),
])
def test_find(sequence, motif, want):
    assert find_motif(sequence, Motif.parse(motif)) == want


def brute(sequence, p):
    return [i + p.offset for i in range(len(sequence) - len(p.letters) + 1) if all(iupac.MASKS[a] & iupac.MASKS[b] for a, b in zip(p.letters, sequence[i:]))]


@pytest.mark.parametrize("tile", [7, 50, 10**6])
def test_positions_by_tiles(spark, tile):
    rng = random.Random(2)
    contigs = [(f"c{i}", "".join(rng.choices("ACGTNR", [9, 9, 9, 9, 1, 1], k=rng.randrange(400)))) for i in range(20)] + [("null", None), ("empty", "")]
    motifs = parse_motifs(["GATC_a_1", "CCWGG_m_1", "AA_a_0", "GANNC_a_1"])
    df = spark.createDataFrame(contigs, "contig string, sequence string")
    got = motif_positions(df, motifs, tile=tile)
    want = {(c, motifs.index(p.motif), p.strand, x) for c, s in contigs if s for p in patterns(motifs) for x in brute(s, p)}
    rows = [tuple(r) for r in got.select("contig", "motif_id", "strand", "position").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    totals = {(r["contig"], r["motif"], r["strand"]): r["n_occurrences"] for r in with_motifs(occurrences(motif_blocks(df, motifs, tile=tile)), motifs).collect()}
    assert sum(totals.values()) == len(want)


def test_tables_agree_with_python(spark):
    listed = parse_motifs(["CATG_m_0", "GCATG_m_1", "TTCAA_m_2", "CATGC_m_0", "CATG_a_1", "CATR_a_1", "RCATGY_a_2", "CCWGG_m_1", "CCWGG_m_1"])
    df = ops.motif_frame(spark, listed).withColumn("n", F.monotonically_increasing_id())
    assert [f"{r.motif}_{r.mod_type}_{r.mod_position}" for r in ops.collapse(df, "n").collect()] == [str(m) for m in collapse_children(listed)]
    assert {(r.motif, r.mod_position) for r in ops.reverse_complements(df).collect()} == {(m.reverse_complement().sequence, m.reverse_complement().mod_position) for m in listed}
    assert sorted(r.dna for r in ops.expansions(df).collect()) == sorted(x for m in listed for x in m.expansions())
    pairs = {(r.parent, r.child) for r in ops.parent_child(df).collect()}
    assert pairs == {(a.sequence, b.sequence) for a in listed for b in listed if a != b and (a.sequence, a.mod_position) != (b.sequence, b.mod_position) and a.has_child(b)}
    keys = [r.motif for r in df.orderBy(iupac.sequence_key(F.col("motif"))).select("motif").collect()]
    assert keys == [m.sequence for m in sorted(listed, key=lambda m: m.sort_key()[0])]


def test_column_functions(spark):
    row = spark.createDataFrame([("RGATCY",)], "s string").select(iupac.reverse_complement(F.col("s")), iupac.regex_of(F.col("s")), iupac.is_iupac(F.col("s")), iupac.is_plain(F.col("s")), iupac.mask(F.lit("R")), iupac.letter_of_mask(F.lit(5)), iupac.mod_name(F.lit("m")), iupac.mod_of_sam_code(F.lit("C"), F.lit("m")), iupac.base_of_mod(F.lit("21839"))).first()
    assert tuple(row) == ("RGATCY", "[AG]GATC[CT]", True, False, 5, "R", "5mC (m)", "m", "C")
