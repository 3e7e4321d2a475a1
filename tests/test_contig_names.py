"""Contigs with stray white space: found, listed and compared by their stripped names."""

from pyspark.sql import functions as F

from strandlake import api
from strandlake.operators import pileup
from strandlake.operators.pileup import COLUMNS
from strandlake.sources.bgzf import PileupWriter
from tests.test_sources import SEQ, pileup_line


def _rows(spark, *contigs):
    row = dict(zip(COLUMNS, pileup_line("x", 3).split("\t")))
    kinds = dict(x.replace("`", "").split() for x in pileup.SCHEMA.split(", "))
    named = spark.createDataFrame([(i, c) for i, c in enumerate(contigs)], "row_id long, contig string")
    return named.select("row_id", "contig", *(F.lit(row[c]).cast(kinds[c]).alias(c) for c in COLUMNS if c != "contig"))


def test_stripped_names(spark):
    rows = _rows(spark, "a", " a", "a\t", "b", "\u00a0c ", None)
    got = pileup.query_contigs(rows, ["c", "a "], ["contig", "start"], order="row_id").collect()
    assert [tuple(r) for r in got] == [("c", 3), ("a", 3), ("a", 3), ("a", 3)]
    assert sorted(str(r[0]) for r in pileup.list_contigs(rows).collect()) == ["None", "a", "b", "c"]
    known = spark.createDataFrame([("a",), ("c",), ("d ",)], "contig string")
    assert [r[0] for r in pileup.not_in(rows, known).collect()] == ["b"]
    assert [r[0] for r in pileup.not_in(known, rows).collect()] == ["d"]


def test_exact_names(spark):
    rows = _rows(spark, "a", " a", "a ", None)
    assert pileup.query_contigs(rows, ["a"], order="row_id", exact=True).count() == 1
    assert pileup.list_contigs(rows, exact=True).count() == 4
    assert sorted(r[0] for r in pileup.not_in(rows, spark.createDataFrame([("a",)], "contig string"), exact=True).collect()) == [" a", "a "]


def test_files_with_stray_white_space(spark, tmp_path):
    table = str(tmp_path / "p.parquet")
    _rows(spark, "c1", " c1", "c1\t").select(*COLUMNS).write.parquet(table)
    assert api.query_pileup_records(table, ["c1"], ["contig"]).count() == 3
    assert api.methylation_pattern(table, SEQ, ["GATC_a_1"], contigs=["c1"]).first()["n_motif_obs"] == 1
    path = str(tmp_path / "p.bed.gz")
    with PileupWriter(path) as w:
        w.write_lines([pileup_line("c1", 3), pileup_line(" c1", 9), pileup_line("c2", 1)])
    assert [(r.contig, r.start) for r in api.query_pileup_records(path, ["c1"]).collect()] == [("c1", 3), ("c1", 9)]
