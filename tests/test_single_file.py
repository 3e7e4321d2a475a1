"""One BGZF file of many partitions: executors write its parts, the driver joins blocks and indexes."""

import gzip
import os

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from strandlake.plans import registry
from strandlake.sources import bgzf, readers, writers
from tests.parity import FOLDER, assert_same
from tests.test_sources import pileup_line

BIG = 9_000
LINES = [*(pileup_line("a", i, fraction="50") for i in range(3)), *(pileup_line("big", 40 * i, fraction="50") for i in range(BIG)), pileup_line("c", 20_000, fraction="50")]


@pytest.fixture
def no_partition_in_driver(monkeypatch):
    def refused(*_):
        raise AssertionError("a partition came to the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)


def _part(path, lines):
    with bgzf.PileupWriter(path) as w:
        w.write_lines(lines)
    return path, w.index


def _in_windows(path):
    """Per contig and window of the linear index the first line at its offset."""
    out = {}
    with open(path, "rb") as f:
        for name, _, linear in bgzf._indexed(path):
            out[name] = [next(bgzf.BgzfReader(f, v).lines())[1] for v in linear]
    return out


@pytest.mark.parametrize("cuts", [[], [0], [3], [1, 2, 3], [3, 700, 701, 5_000, 3 + BIG], [4_000, 4_000, len(LINES)]])
def test_joined_file_is_as_written_at_once(tmp_path, cuts):
    whole, joined = str(tmp_path / "whole.bed.gz"), str(tmp_path / "joined.bed.gz")
    _part(whole, LINES)
    w = bgzf.PileupWriter(joined)
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(LINES)])):
        w.append(*_part(str(tmp_path / f"{i}.bed.gz"), LINES[a:b]))
    w.finish()
    with gzip.open(joined, "rt") as f:
        assert f.read().splitlines() == LINES
    with open(joined, "rb") as f:
        assert f.read().count(bgzf.END_BLOCK) == 1
    assert _in_windows(joined) == _in_windows(whole)
    for contig, parts in bgzf.index_parts(joined, 1).items():
        got = [line for a, b in parts for frame in readers._frames(joined, contig, a, b, 700) for line in frame["line"]]
        assert got == [x for x in LINES if x.startswith(f"{contig}\t")]
    assert list(bgzf.read_index(joined)) == ["a", "big", "c"]


def test_lines_before_and_behind_a_joined_file(tmp_path):
    joined = str(tmp_path / "joined.bed.gz")
    with bgzf.PileupWriter(joined) as w:
        w.write_lines(LINES[:100])
        w.append(*_part(str(tmp_path / "0.bed.gz"), LINES[100:200]))
        w.write_lines(LINES[200:])
    with gzip.open(joined, "rt") as f:
        assert f.read().splitlines() == LINES
    assert _in_windows(joined)["c"][-1] == LINES[-1]


def test_contig_in_two_places_is_an_error(tmp_path):
    w = bgzf.PileupWriter(str(tmp_path / "joined.bed.gz"))
    w.append(*_part(str(tmp_path / "0.bed.gz"), [pileup_line("a", 1), pileup_line("b", 1)]))
    with pytest.raises(bgzf.BgzfError, match="together"):
        w.append(*_part(str(tmp_path / "1.bed.gz"), [pileup_line("a", 2)]))


def test_part_cut_short_is_an_error(tmp_path, monkeypatch):
    path, index = _part(str(tmp_path / "0.bed.gz"), LINES)
    size = os.path.getsize(path)
    monkeypatch.setattr(bgzf.files, "size_of", lambda _: size + 100)
    with pytest.raises(bgzf.BgzfError, match="cut short"):
        bgzf.PileupWriter(str(tmp_path / "joined.bed.gz")).append(path, index)


@pytest.mark.parametrize("partitions", [1, 7])
def test_frame_in_its_order(spark, tmp_path, no_partition_in_driver, partitions):
    bed, path = tmp_path / "p.bed", str(tmp_path / "joined.bed.gz")
    bed.write_text("\n".join(x.replace("\t50\t", "\t50.00\t") for x in reversed(LINES)) + "\n")
    spread = spark.read.text(str(bed)).toDF("line").selectExpr("line", "split(line, '\t')[0] as contig", "int(split(line, '\t')[1]) as start")
    lines = spread.repartitionByRange(partitions, "contig", "start").sortWithinPartitions("contig", "start").select("line")
    writers.write_bgzf_joined(lines, path, bgzf.RecordWriter)
    with gzip.open(path, "rt") as f:
        assert f.read().splitlines() == LINES
    got = readers.read_indexed_pileup(spark, path, ["big"]).orderBy("_order").select("start").collect()
    assert [r.start for r in got] == [40 * i for i in range(BIG)]


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "joined.bed.gz")
    writers.write_bgzf_joined(spark.createDataFrame([], "line string"), path)
    assert bgzf.read_index(path) == {}
    with gzip.open(path) as f:
        assert f.read() == b""


def test_line_that_is_no_record_fails_the_run(spark, tmp_path):
    path = tmp_path / "joined.bed.gz"
    with pytest.raises(Exception, match="a pileup line has 18 fields"):
        writers.write_bgzf_joined(spark.createDataFrame([("a\t1\t2",)], "line string"), str(path), bgzf.RecordWriter)
    assert not path.exists()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_query_without_partitions_in_the_driver(spark, no_partition_in_driver):
    assert_same(spark, registry.QUERIES["pileup_single_file"], registry.ORACLE["pileup_single_file"])
