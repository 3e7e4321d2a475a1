"""Whole records, folder writers, streams of lines, addresses of files, foreign frames and bounds."""

import gzip
import io
import random
import struct
import sys

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake import api, cli
from strandlake.operators import pileup, reads
from strandlake.operators.pileup import COLUMNS, PileupError
from strandlake.session import materialize, released
from strandlake.sources import bam, bgzf, files, readers, writers
from tests.test_sources import SEQ, pileup_line

TAGS = b"NMi" + struct.pack("<i", -3) + b"XAAq" + b"XZZsome text\0" + b"XFf" + struct.pack("<f", 0.25) + b"XBBs" + struct.pack("<ihh", 2, -1, 7) + b"XCC\x09"
HEADER, REFERENCES = "@HD\tVN:1.6\n@SQ\tSN:c1\tLN:14\n", [("c1", 14), ("c2", 10)]
FULL = ", ".join(bam.FULL.split(", "))


def records(spark, n=50):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        size = rng.randrange(1, 40)
        seq, qual = "".join(rng.choices("ACGTN", k=size)), "".join(rng.choices("!+5I~", k=size))
        flag = rng.choice([0, 16, 256, 2048])
        rows.append((f"r{i}", flag, "c1", i, 60, f"{size}M", "-" if flag & 16 else "+", seq, "A+a.,0;", [i % 256], qual, rng.choice([None, "c2"]), rng.choice([None, 5]), -7, TAGS if i % 3 else b""))
    rows.append(("un", 4, None, None, 0, None, "+", None, None, None, None, None, None, 0, b""))
    return spark.createDataFrame(rows, FULL)


def texts(df):
    return sorted(str([bytes(x) if isinstance(x, bytearray) else x for x in r]) for r in df.collect())


def test_whole_records(spark, tmp_path):
    rows = records(spark)
    one = "file://" + str(tmp_path / "one.bam")
    bam.write_bam(rows, one, HEADER, REFERENCES)
    assert bam.header_of(one) == (HEADER, REFERENCES)
    assert texts(readers.read_bam(spark, one, primary_only=False, full=True)) == texts(rows)
    folder = str(tmp_path / "many")
    bam.write_bam_folder(rows.repartition(3), folder, HEADER, REFERENCES)
    assert len(files.found(folder, "*.bam")) == 3 and texts(readers.read_bam(spark, folder, primary_only=False, full=True)) == texts(rows)
    assert readers.bam_contigs(folder) == ["c1", "c2"] and readers.read_bam(spark, folder).columns == [x.split()[0] for x in bam.SCHEMA.split(", ")]


def test_alignment_lines(spark, tmp_path):
    path = str(tmp_path / "x.sam")
    row = records(spark).where("read_id = 'r1'")
    writers.write_sam_file(row, path, HEADER)
    lines = open(path).read().split("\n")
    assert lines[:2] == HEADER.rstrip("\n").split("\n") and lines[3:] == [""]
    fields, r = lines[2].split("\t"), row.first()
    assert fields[5] == r.cigar and fields[6] == (r.mate_contig or "*") and fields[8] == "-7" and fields[10] == (r.qual[::-1] if r.strand == "-" else r.qual)
    assert fields[11:] == ["NM:i:-3", "XA:A:q", "XZ:Z:some text", "XF:f:0.25", "XB:B:s,-1,7", "XC:i:9", "MM:Z:A+a.,0;", "ML:B:C,1"]


@pytest.mark.parametrize("end", ["bam", "sam"])
def test_merged_tags_keep_the_record(spark, tmp_path, end):
    path, out = str(tmp_path / "t.bam"), str(tmp_path / f"out.{end}")
    bam.write_bam(records(spark), path, HEADER, REFERENCES)
    assert cli.main(["merge-tags", "--from-bam", path, "--to-bam", path, "-o", out, "--rename-tags-from-bam", "A+a.:z"]) == 0
    if end == "bam":
        got = {r.read_id: r for r in readers.read_bam(spark, out, primary_only=False, full=True).collect()}
        assert bam.header_of(out) == (HEADER, REFERENCES)
        for r in records(spark).where("mm is not null").collect():
            assert got[r.read_id].mm == "A+a.,0;A+z.,0;" and got[r.read_id].ml == r.ml * 2 and got[r.read_id].qual == r.qual and got[r.read_id].tags == r.tags
    else:
        lines = [x for x in open(out).read().splitlines() if not x.startswith("@")]
        assert len(lines) == 51 and all("MM:Z:A+a.,0;A+z.,0;" in x for x in lines if not x.startswith("un\t"))


def test_lines_are_parsed_and_rendered(tmp_path):
    path = str(tmp_path / "x.bed.gz")
    with api.BgzfWriter(path) as w:
        w.write_lines([pileup_line("c1", 3, fraction="50.00"), "", pileup_line("c1", 7, fraction="0.10").replace("\t7\t", "\t007\t")])
    first, second = gzip.open(path, "rt").read().splitlines()
    assert first == pileup_line("c1", 3, fraction="50") and second.split("\t")[1] == "7" and second.split("\t")[10] == "0.1"
    for bad in ("c1\t1\t2", pileup_line("c1", 1).replace("\t1\t", "\tx\t"), pileup_line("c1", -1), pileup_line("c1", 1, fraction="half")):
        with pytest.raises(bgzf.BgzfError):
            bgzf.record_line(bad)


def test_streams(spark, tmp_path, monkeypatch, capsysbinary):
    lines = [pileup_line("c1", i, fraction="50") for i in range(1000)]
    text = "\n".join(lines) + "\n"
    out = str(tmp_path / "s.bed.gz")
    monkeypatch.setattr(sys, "stdin", io.StringIO(text))
    assert cli.main(["bgzip", "compress", "--stdin", "-o", out]) == 0
    assert gzip.open(out, "rt").read() == text and readers.indexed_contigs(out) == ["c1"]
    with pytest.raises(FileExistsError):
        api.bgzf_lines(lines, out)
    plain = tmp_path / "p.bed"
    plain.write_text(text)
    capsysbinary.readouterr()
    assert cli.main(["bgzip", "compress", "-i", str(plain), "--stdout", "--keep"]) == 0
    assert gzip.decompress(capsysbinary.readouterr().out).decode() == text and plain.exists()
    assert cli.main(["bgzip", "decompress", "-i", out, "-c", "c1"]) == 0
    assert capsysbinary.readouterr().out.decode() == text
    for wrong in ([], ["-i", "x", "--stdin"], ["--stdin"], ["--stdin", "--stdout", "--keep"], ["-i", "x", "-o", "y", "--stdout"]):
        with pytest.raises(SystemExit):
            cli.main(["bgzip", "compress", *wrong])


def test_folder_with_indexes(spark, tmp_path):
    rows = spark.range(4000).select(*(F.lit(v).alias(c) for c, v in zip(COLUMNS, pileup_line("c", 1).split("\t"))), "id").withColumns({"contig": F.concat(F.lit("k"), (F.col("id") % 3).cast("string")), "start": F.col("id"), "end": F.col("id") + 1})
    rows = readers.pileup_from_frame(rows.select(*COLUMNS))
    folder = str(tmp_path / "f")
    writers.write_bgzf_folder(rows, folder, 4)
    assert len(files.found(folder, "*.bed.gz")) == len(files.found(folder, "*.tbi")) > 1 and readers.indexed_contigs(folder) == ["k0", "k1", "k2"]
    got = api.query_pileup_records(folder, ["k2", "k0"], ["contig", "start"]).collect()
    assert [tuple(r) for r in got] == [(f"k{c}", i) for c in (2, 0) for i in range(c, 4000, 3)]


def test_last_file_counts(spark, tmp_path):
    folder = tmp_path / "d"
    folder.mkdir()
    (folder / "a.bed").write_text("\n".join([pileup_line("c1", 3, modified=5)] * 300) + "\n")  # larger, so read first
    (folder / "b.bed").write_text(pileup_line("c1", 3, modified=20) + "\n")
    (folder / "0.bed").write_text("\n".join([pileup_line("c1", 3, modified=7)] * 600) + "\n")
    assert api.methylation_pattern(str(folder), SEQ, ["GATC_a_1"]).first()["methylation_value"] == 1.0
    fasta = tmp_path / "fa"
    fasta.mkdir()
    (fasta / "a.fasta").write_text(">x\n" + "A" * 1000 + "\n")
    (fasta / "b.fasta").write_text(">x\nCC\n")
    assert readers.read_fasta(spark, str(fasta)).first().sequence == "CC"


class Other:
    def __init__(self, table):
        self.table = table

    def to_arrow(self):
        return self.table


def test_foreign_frames(spark):
    values = {c: [v] * 2 for c, v in zip(COLUMNS, pileup_line("c1", 3).split("\t"))}
    frame = pd.DataFrame(values)
    table = pa.Table.from_pandas(frame, preserve_index=False)
    for rows in (frame, table, Other(table)):
        got = api.methylation_pattern_from_dataframe(rows, SEQ, ["GATC_a_1"], spark=spark).collect()
        assert [(r.contig, r.methylation_value, r.n_motif_obs) for r in got] == [("c1", 0.5, 1)]
    with pytest.raises(TypeError):
        api.methylation_pattern_from_dataframe([1], SEQ, ["GATC_a_1"], spark=spark)


def test_bounds(spark, tmp_path):
    bed = tmp_path / "p.bed"
    bed.write_text(pileup_line("c1", 13) + "\n")
    assert api.methylation_pattern(str(bed), SEQ, ["GATC_a_1"]).count() == 0
    bed.write_text(pileup_line("c1", 14) + "\n" + pileup_line("c2", 3, cov=1, modified=0) + "\n")
    with pytest.raises(PileupError, match="beyond the end"):
        api.methylation_pattern(str(bed), SEQ, ["GATC_a_1"])
    rows = readers.read_pileup(spark, str(bed))
    assert pileup.methylation(rows, filtered=False).count() == 2 and pileup.methylation(rows).count() == 1


def test_batches_of_reads_are_bounded(spark, monkeypatch):
    seq = "GATC" * 50
    df = spark.createDataFrame([(f"r{i}", seq, "A+a.,0,0;", [1, 2]) for i in range(30)] + [("none", None, None, None), ("plain", seq, None, None)], "read_id string, seq string, mm string, ml array<int>")
    from strandlake.functions.motif import Motif

    whole = sorted(map(str, reads.read_fastq_pattern(df, [Motif.new("GATC", "a", 1)]).collect()))
    monkeypatch.setattr(reads, "MOST_ROWS", 7)
    assert sorted(map(str, reads.read_fastq_pattern(df, [Motif.new("GATC", "a", 1)]).collect())) == whole and len(whole) == 31 * 50
    assert reads.read_calls(df).count() == 60


def test_released_tables(spark):
    with released(spark):
        kept = materialize(spark.range(5), "five")
        path = kept.inputFiles()[0]
        assert kept.count() == 5 and files.exists(path)
    assert not files.exists(path)
