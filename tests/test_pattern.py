"""Pileup operators and methylation patterns."""

import pytest
from pyspark.sql import functions as F

from strandlake.functions.motif import parse_motifs
from strandlake.operators import pattern, pileup
from strandlake.operators.assembly import latest_loads
from strandlake.operators.scan import motif_blocks

MOTIFS = parse_motifs(["GATC_a_1", "GATC_m_3", "GATC_21839_3"])


def row(start, mod="a", strand="+", cov=20, modified=10, other=0, diff=0, fail=6, contig="contig_3", n=0):
    return dict(zip(pileup.COLUMNS, (contig, start, start + 1, mod, cov, strand, start, start + 1, "255,0,0", cov, 0.0, modified, 0, other, 0, fail, diff, 0))) | {"n": n}


def frame(spark, rows):
    return spark.createDataFrame(rows or [], pileup.SCHEMA + ", n long") if rows == [] else spark.createDataFrame([tuple(r[c] for c in pileup.COLUMNS) + (r["n"],) for r in rows], pileup.SCHEMA + ", n long")


def test_pattern_by_hand(spark):
    # GATC lies at 2 and 8: adenines at 3 and 9 forward, 4 and 10 reverse; cytosines at 5 and 11, 2 and 8
    rows = [row(3, cov=10, modified=9), row(9, cov=30, modified=6), row(4, strand="-", cov=8, modified=8), row(5, "m", cov=16, modified=4), row(6, cov=12, modified=12)]
    contigs = spark.createDataFrame([("contig_3", "CTGATCAAGATCTTC")], "contig string, sequence string")
    meth = pileup.methylation(frame(spark, rows), 1, 0.8, order="n")
    got = {r.mod_type: tuple(r)[4:] for r in pattern.median(contigs, meth, MOTIFS).collect()}
    assert got == {"a": (0.9, 16.0, 3, 4), "m": (0.25, 16.0, 1, 4)}
    assert {r.mod_type: r.methylation_value for r in pattern.weighted_mean(contigs, meth, MOTIFS).collect()} == {"a": 23 / 48, "m": 0.25}
    raw = pattern.raw(contigs, meth, MOTIFS)
    assert raw.columns == list(pattern.RAW_COLUMNS) and raw.count() == 4
    again = {r.mod_type: (r.median, r.n_motif_obs) for r in pattern.degrees_from_raw(raw).collect()}
    assert again == {"a": (0.9, 3), "m": (0.25, 1)}
    assert pattern.median(contigs, meth.limit(0), MOTIFS).count() == 0


def test_filters_and_netting(spark):
    rows = [row(1, cov=4, diff=1), row(2, cov=2), row(3, modified=3, other=4), row(4, cov=4, diff=2, modified=1), row(5, cov=0, modified=0), row(6, cov=5, modified=2, other=2)]
    kept = {r.start for r in pileup.filter_pileup(frame(spark, [row(1, cov=4, diff=1, modified=4), *rows[1:]]), 3, 0.8).collect()}
    assert kept == {1, 6}
    assert {r.start for r in pileup.filter_pileup(frame(spark, rows), 0, 0.8).collect()} >= {5}
    assert pileup.net_coverage(frame(spark, [rows[5]])).first().n_valid_cov == 3
    bad = frame(spark, [row(1, cov=5, modified=10)])
    with pytest.raises(Exception, match=r"Invalid coverage: n_valid_cov \(5\) cannot be less than n_modified \(10\)"):
        pileup.net_coverage(bad).collect()
    assert pileup.net_coverage(bad, "drop").count() == 0
    with pytest.raises(Exception, match="Unsupported mod type: h"):
        pileup.check_mod_types(frame(spark, [row(1, "h")])).collect()


def test_rejected_later_duplicate_does_not_shadow(spark):
    rows = [row(6, cov=10, modified=1, n=1), row(6, cov=12, modified=2, n=2), row(6, cov=2, modified=2, n=3)]
    meth = pileup.methylation(frame(spark, rows), 3, 0.8, order="n")
    got = pileup.last_wins(meth, pileup.KEY).collect()
    assert [(r.n_valid_cov, r.n_modified) for r in got] == [(12, 2)]


def test_query(spark):
    rows = [row(5, contig="a", n=2), row(1, contig="a", n=3), row(7, contig="b", n=1)]
    df = frame(spark, rows)
    got = pileup.query_contigs(df, ["b", "a", "b"], ["contig", "start"], order="n")
    assert [tuple(r) for r in got.collect()] == [("b", 7), ("a", 5), ("a", 1), ("b", 7)]
    assert pileup.query_contigs(df, []).count() == 0 and pileup.query_contigs(df, []).columns == list(pileup.COLUMNS)
    with pytest.raises(pileup.PileupError):
        pileup.query_contigs(df, ["zz"])
    with pytest.raises(pileup.PileupError):
        pileup.query_contigs(df, ["a"], ["nothing"])


def test_contig_checks(spark):
    p, a = frame(spark, [row(1, contig="a"), row(1, contig="b")]), spark.createDataFrame([("b",), ("c",)], "contig string")
    for kind in ("indexed", "sequential"):
        with pytest.raises(pileup.PileupError):
            pileup.check_contigs(p, a, kind, False)
        pileup.check_contigs(p, a, kind, True)
    pileup.check_contigs(p, a, "frame", False)
    pileup.check_contigs(p, a.where("contig = 'b'"), "indexed", False)


def test_order_of_results(spark):
    rows = [("c", m, t, 1, 0.5, 1.0, 1, 1) for m, t in (("GACM", "a"), ("GACY", "a"), ("GACT", "21839"), ("GACT", "m"))]
    df = spark.createDataFrame(rows, "contig string, motif string, mod_type string, mod_position int, methylation_value double, mean_read_cov double, n_motif_obs long, motif_occurences_total long")
    assert [(r.motif, r.mod_type) for r in pattern.ordered(df).collect()] == [("GACT", "m"), ("GACT", "21839"), ("GACY", "a"), ("GACM", "a")]
    assert pattern.Output.parse("Weighted-Mean") is pattern.Output.WEIGHTED_MEAN
    with pytest.raises(ValueError):
        pattern.Output.parse("mode")


def test_latest_load_counts(spark):
    rows = [(" a", "acg\nt-", 1, 1), ("a\t", "GG", 2, 2), ("a", "GG", 2, 2), ("", "A", 1, 3), (None, "A", 1, 4), ("b", None, 1, 5)]
    got = latest_loads(spark.createDataFrame(rows, "id string, sequence string, loaded_at long, contig_row long"))
    assert sorted(map(tuple, got.collect())) == [("a", "GG"), ("b", None)]
    assert latest_loads(spark.createDataFrame(rows[:1], "id string, sequence string, loaded_at long, contig_row long")).first().sequence == "ACGTN"


def test_loads_of_one_time_and_row(spark):
    rows = [("a", "ACG", 1, 0), ("a", "ACGT", 1, 0), ("a", "TTTT", 1, 0), ("a", None, 1, 0), ("b", "A", 1, 0), ("b", "A", 1, 0)]
    df = spark.createDataFrame(rows, "id string, sequence string, loaded_at long, contig_row long")
    got = {r.contig: r.sequence for r in latest_loads(df).collect()}
    assert set(got) == {"a", "b"} and got["a"] in ("ACGT", "TTTT") and got["b"] == "A"
    assert {r.contig: r.sequence for r in latest_loads(df.repartition(3)).collect()} == got


def test_sequences_move_once(spark):
    contigs = latest_loads(spark.createDataFrame([("a", "GATC", 1, 1)], "id string, sequence string, loaded_at long, contig_row long"))
    plan = motif_blocks(contigs, MOTIFS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "MapInArrow" in plan


def test_numbered_rows(spark):
    rows = [(f"c{i % 7}", "GATC", "a", 1, i / 10, 1.0, 1, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "contig string, motif string, mod_type string, mod_position int, methylation_value double, mean_read_cov double, n_motif_obs long, motif_occurences_total long")
    got = pattern.numbered(df).orderBy("row_no").collect()
    assert [r.row_no for r in got] == list(range(1, 201)) and [(r.contig, r.methylation_value) for r in got] == sorted((r[0], r[4]) for r in rows)
    assert pattern.numbered(df.limit(0)).count() == 0


def test_first_seen(spark):
    df = frame(spark, [row(1, contig="b", n=5), row(1, contig=" a", n=2), row(1, contig="a", n=9), row(1, contig="b ", n=7)])
    assert [tuple(r) for r in pileup.list_contigs(df, order="n").collect()] == [("a", 2), ("b", 5)]
