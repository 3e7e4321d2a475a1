"""File readers and writers, the public functions, the command line and the stream."""

import gzip
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from strandlake import api, cli
from strandlake.functions.iupac import COMPLEMENTS
from strandlake.operators.pileup import COLUMNS, PileupError
from strandlake.sources import bam, bgzf, readers, writers
from strandlake.sources.formats import plain_number, tsv_lines
from strandlake.streaming.pileup_stream import coverage_windows, load_stream


def pileup_line(contig, start, mod="a", strand="+", cov=20, modified=10, fraction="50.00"):
    return "\t".join(map(str, (contig, start, start + 1, mod, cov, strand, start, start + 1, "255,0,0", cov, fraction, modified, cov - modified, 0, 0, 0, 0, 0)))


SEQ = {"c1": "TTGATCTTGATCTT", "c2": "GATCNNGATC"}


@pytest.fixture
def files(tmp_path):
    fasta = tmp_path / "a.fasta"
    fasta.write_text(">c1 first\nTTGATC\nTTgatcTT\n>c2\r\nGATCNNGATC\n>c3\nAAAA\n>c3 again\nCCCC\n")
    rows = [pileup_line("c1", 3), pileup_line("c1", 9, modified=20), pileup_line("c1", 4, strand="-"), pileup_line("c2", 1, cov=5, modified=0), "", pileup_line("c1", 9, modified=5)]
    bed = tmp_path / "p.bed"
    bed.write_text("\n".join(rows) + "\n")
    return tmp_path, str(fasta), str(bed)


def test_fasta(spark, files):
    tmp, fasta, _ = files
    got = {r.contig: r.sequence for r in readers.read_fasta(spark, fasta).collect()}
    assert got == {**SEQ, "c3": "CCCC"}
    assert [r.contig for r in readers.read_fasta(spark, fasta, ["c2"]).collect()] == ["c2"]
    (tmp / "bad.fasta").write_text(">x\nACRT\n")
    with pytest.raises(Exception, match="Could not parse sequence"):
        readers.read_fasta(spark, str(tmp / "bad.fasta")).collect()
    with pytest.raises(TypeError):
        readers.assembly_from_dict(spark, {"a": 5})
    with pytest.raises(ValueError):
        readers.assembly_from_dict(spark, {"a": "acgt"})


def test_pileup_files(spark, files):
    tmp, _, bed = files
    rows = readers.read_pileup(spark, bed)
    assert rows.count() == 5 and rows.columns == [*COLUMNS, "_order"]
    with gzip.open(tmp / "p2.bed.gz", "wt") as f:
        f.write(open(bed).read())
    assert readers.read_pileup(spark, str(tmp / "p2.bed.gz")).count() == 5
    writers.write_contig_parquet(rows, str(tmp / "p.parquet"), 2)
    assert readers.read_pileup(spark, str(tmp / "p.parquet")).count() == 5
    (tmp / "h.bed").write_text(pileup_line("c1", 1, mod="h") + "\n")
    with pytest.raises(Exception, match="Unsupported mod type: h"):
        readers.read_pileup(spark, str(tmp / "h.bed")).collect()
    with pytest.raises(PileupError, match="Unsupported file type"):
        readers.read_pileup(spark, "x.txt")
    (tmp / "ids").write_text("# c\n c1 \n\n")
    assert readers.read_contig_list(str(tmp / "ids")) == ["c1"]
    (tmp / "none").write_text("#\n")
    with pytest.raises(PileupError, match="No contigs found in file"):
        readers.read_contig_list(str(tmp / "none"))


def test_bgzf_round_trip(spark, tmp_path):
    rng = random.Random(1)
    lines = [pileup_line(f"k{c}", s) for c in range(5) for s in sorted(rng.sample(range(200_000), 2000))]
    path = str(tmp_path / "x.bed.gz")
    with bgzf.PileupWriter(path) as w:
        w.write_lines(lines[:4000])
        w.write_lines(line + "\n" for line in lines[4000:])
    w.finish()
    w.write_lines(["ignored"])
    assert gzip.open(path, "rt").read().splitlines() == lines
    assert readers.indexed_contigs(path) == [f"k{c}" for c in range(5)]
    got = api.query_pileup_records(path, ["k3", "k0", "k3"], ["contig", "start"]).collect()
    want = [(c, int(line.split("\t")[1])) for c in ("k3", "k0", "k3") for line in lines if line.startswith(c + "\t")]
    assert [tuple(r) for r in got] == want
    assert api.query_pileup_records(path, ["k1"]).columns == list(COLUMNS)
    with pytest.raises(PileupError):
        api.query_pileup_records(path, ["zz"])
    with pytest.raises(FileExistsError):
        bgzf.PileupWriter(path)
    with pytest.raises(bgzf.BgzfError):
        with bgzf.PileupWriter(path, force=True) as w:
            w.write_lines([pileup_line("a", 1), pileup_line("b", 1), pileup_line("a", 2)])


def test_compress_and_extract(spark, files):
    tmp, _, bed = files
    out = api.bgzf_pileup(bed, keep=True)
    assert out == bed + ".gz"
    api.extract_pileup(out, str(tmp / "c2.bed"), ["c2"])
    assert (tmp / "c2.bed").read_text() == pileup_line("c2", 1, cov=5, modified=0, fraction="50") + "\n"
    with pytest.raises(FileExistsError):
        api.bgzf_pileup(bed)
    assert cli.main(["bgzip", "compress", "-i", bed, "--force"]) == 0 and not (tmp / "p.bed").exists()
    for bad in ({}, {"contigs": ["a"], "contigs_file": "f"}):
        with pytest.raises(ValueError):
            api.extract_pileup(out, "x", **bad)
    with pytest.raises(ValueError, match="bed.gz extension"):
        api.bgzf_pileup(bed, "x.gz")


def test_methylation_pattern(spark, files):
    tmp, fasta, bed = files
    got = {(r.contig, r.motif): tuple(r)[4:] for r in api.methylation_pattern(bed, fasta, ["GATC_a_1"]).collect()}
    assert set(got) == {("c1", "GATC"), ("c2", "GATC")} and got["c2", "GATC"] == (0.0, 5.0, 1, 4)
    assert got["c1", "GATC"][1:] == (20.0, 3, 4) and got["c1", "GATC"][0] == 0.5
    out = tmp / "sub" / "r.tsv"
    assert api.methylation_pattern(bed, SEQ, ["GATC_a_1"], "weighted_mean", output=str(out)) is None
    assert out.read_text().splitlines() == ["contig\tmotif\tmod_type\tmod_position\tmethylation_value\tmean_read_cov\tn_motif_obs\tmotif_occurences_total", "c1\tGATC\ta\t1\t0.4166666666666667\t20\t3\t4", "c2\tGATC\ta\t1\t0\t5\t1\t4"]
    with pytest.raises(PileupError):
        api.methylation_pattern(bed, {"c1": SEQ["c1"]}, ["GATC_a_1"])
    assert api.methylation_pattern(bed, {"c1": SEQ["c1"]}, ["GATC_a_1"], allow_assembly_pileup_mismatch=True).count() == 1
    assert api.methylation_pattern(bed, SEQ, ["GATC_a_1"], contigs=["c2"]).count() == 1
    with pytest.raises(ValueError, match="Should be tsv"):
        api.methylation_pattern(bed, SEQ, ["GATC_a_1"], output="x.csv")
    with pytest.raises(TypeError):
        api.methylation_pattern(bed, 5, ["GATC_a_1"])
    with pytest.raises(ValueError):
        api.methylation_pattern(bed, fasta, ["GATC_a_1"], "mode")
    rows = readers.read_pileup(spark, bed).drop("_order").toDF(*(f"x{i}" for i in range(18)))
    assert {r.contig for r in api.methylation_pattern_from_dataframe(rows, SEQ, ["GATC_a_1"], "raw").collect()} == {"c1", "c2"}
    assert cli.main(["methylation-pattern", "contig", "-p", bed, "-a", fasta, "-m", "GATC_a_1", "-o", str(tmp / "cli.tsv"), "--output-type", "raw"]) == 0
    assert len((tmp / "cli.tsv").read_text().splitlines()) == 5


def test_motif_cluster(tmp_path):
    out = tmp_path / "m.tsv"
    assert api.remove_child_motifs(str(out), ["GATC_a_1", "GATC_m_3", "RGATCY_a_2"]) == ["GATC_a_1", "GATC_m_3"]
    assert out.read_text() == "motif\tmod_type\tmod_position\nGATC\ta\t1\nGATC\tm\t3\n"
    assert api.MethylationOutput("median") is api.MethylationOutput.MEDIAN and [c.value for c in api.PileupColumn] == list(COLUMNS)


@pytest.mark.parametrize("suffix,chunk", [("fastq", 40), ("fastq", 97), ("fastq", 1 << 20), ("fastq.gz", 10)])
def test_fastq(spark, tmp_path, suffix, chunk):
    rng = random.Random(3)
    records = []
    for i in range(40):
        seq = "".join(rng.choices("ACGT", k=rng.randrange(1, 30)))
        records.append((f"r{i}", seq, "@" + "".join(rng.choices("@+I#", k=len(seq) - 1))))
    text = "".join(f"@{n} MM:Z:A+a.,0; ML:B:C,{i}\n{s}\n+\n{q}\n" for i, (n, s, q) in enumerate(records))
    path = tmp_path / f"x.{suffix}"
    (gzip.open(path, "wt") if suffix.endswith("gz") else open(path, "w")).write(text)
    got = {r.read_id: (r.seq, r.mm, r.ml) for r in readers.read_fastq(spark, str(path), chunk=chunk).collect()}
    assert got == {n: (s, "A+a.,0;", [i]) for i, (n, s, _) in enumerate(records)}
    assert readers.read_fastq(spark, str(path), ["r1", "r2"]).count() == 2


def record(name, flag, ref, pos, cigar, seq, mm=None, ml=None):
    ops = [(int(n), "MIDNSHP=X".index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    tags = b"NMi" + struct.pack("<i", 3) + b"XAAq"
    if mm is not None:
        tags += b"MMZ" + mm.encode() + b"\0"
    if ml is not None:
        tags += b"MLBC" + struct.pack("<i", len(ml)) + bytes(ml)
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
    body += b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + packed + b"\xff" * len(seq) + tags
    return struct.pack("<i", len(body)) + body


def write_bam(path, groups, index):
    """groups: per reference its records; each goes into blocks of its own."""
    head = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 2)
    for name, s in SEQ.items():
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", len(s))
    bai = b"BAI\1" + struct.pack("<i", 2)
    with open(path, "wb") as f:
        f.write(bgzf.compress_block(head))
        for g in groups:
            begin = f.tell() << 16
            for r in g:
                f.write(bgzf.compress_block(r[: len(r) // 2]))
                f.write(bgzf.compress_block(r[len(r) // 2 :]))
            bai += struct.pack("<iIiQQi", 1, 0, 1, begin, f.tell() << 16, 0) if groups.index(g) < 2 else b""
        f.write(bgzf.END_BLOCK)
    if index:
        open(f"{path}.bai", "wb").write(bai)


@pytest.mark.parametrize("index", [False, True])
def test_bam(spark, tmp_path, index):
    rc = "".join(COMPLEMENTS[c] for c in SEQ["c1"][::-1])
    path = str(tmp_path / "x.bam")
    write_bam(path, [[record("f", 0, 0, 0, "14M", SEQ["c1"], "A+a.,0;", [200]), record("r", 16, 0, 0, "14M", SEQ["c1"]), record("s", 256, 0, 0, "14M", SEQ["c1"])], [record("g", 2048, 1, 0, "10M", SEQ["c2"])], [record("u", 4, -1, -1, "", "ACG", "A+a.,0;", [1])]], index)
    rows = {r.read_id: r for r in readers.read_bam(spark, path).collect()}
    assert set(rows) == {"f", "r", "g"} and rows["f"].ml == [200] and rows["f"].mm == "A+a.,0;" and rows["r"].strand == "-" and rows["r"].seq == rc and rows["r"].mm is None
    assert rows["f"].cigar == "14M" and rows["f"].start == 0 and rows["f"].mapq == 60
    assert {r.read_id for r in readers.read_bam_tags(spark, path).collect()} == {"f", "r", "s", "g", "u"}
    assert readers.bam_contigs(path) == ["c1", "c2"]
    hits = {(r.read_id, r.start_read): r for r in api.read_bam_pattern(path, SEQ, ["GATC_a_1"]).collect()}
    assert hits["f", 3].basecall_quality == 200 and hits["f", 3].mapping_status == "complete" and hits["r", 3].start_contig == 10 and hits["r", 3].reference_has_motif
    line = writers.sam_lines(readers.read_bam(spark, path).where("read_id = 'f'")).first()[0].split("\t")
    assert line[:6] == ["f", "0", "c1", "1", "60", "14M"] and line[9] == SEQ["c1"] and line[-2:] == ["MM:Z:A+a.,0;", "ML:B:C,200"]
    merged = {r.read_id: r.mm for r in api.merge_bam_tags(path, path, ignore=None, rename_source=[_renamed()]).collect()}
    assert merged["f"] == "A+a.,0;A+z.,0;"
    assert cli.main(["methylation-pattern", "read-bam", "-i", path, "-a", _fasta(tmp_path), "-m", "GATC_a_1", "-o", str(tmp_path / "b.tsv")]) == 0
    again = str(tmp_path / "again.bam")
    every = readers.read_bam(spark, path, primary_only=False)
    bam.write_bam(every, again, "@HD\n", [(n, len(x)) for n, x in SEQ.items()])
    assert sorted(map(str, readers.read_bam(spark, again, primary_only=False).collect())) == sorted(map(str, every.collect()))
    with pytest.raises(FileExistsError):
        bam.write_bam(every, again, "", [])
    with pytest.raises(FileNotFoundError):
        bam._Reader(str(tmp_path / "nothing.bam")).partitions()


def _renamed():
    from strandlake.functions.modtags import Descriptor

    d = Descriptor.parse("A+a.")
    return d, d.with_code("z")


def _fasta(tmp):
    (tmp / "f.fasta").write_text("".join(f">{k}\n{v}\n" for k, v in SEQ.items()))
    return str(tmp / "f.fasta")


def test_numbers_as_text(spark, tmp_path):
    assert [plain_number(x) for x in (0.0, 1.0, 1e-4, 1e-20, 0.1 + 0.2, 1e22, float("nan"))] == ["0", "1", "0.0001", "0.00000000000000000001", "0.30000000000000004", "10000000000000000000000", "NaN"]
    df = spark.createDataFrame([("a", 0.5, None, 3)], "s string, d double, e double, n int")
    assert tsv_lines(df).first()[0] == "a\t0.5\t\t3"
    writers.write_tsv(df, str(tmp_path / "out"), sort=False)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).distinct().collect()) == ["a\t0.5\t\t3", "s\td\te\tn"]


def test_stream(spark, tmp_path):
    lines = spark.createDataFrame([(1, pileup_line("c", 1)), (2, "bad"), (3, "# no")], "line_id long, line string")
    lines.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    load_stream(stream, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r.line_id for r in spark.read.parquet(str(tmp_path / "good")).collect()] == [1]
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["columns"]
    rows = spark.sql("select ' c ' as contig, timestamp'2024-01-01 05:00:00' as called_at, 3L as n_valid_cov union all select 'c', timestamp'2024-01-01 06:00:00', 4L")
    assert [(r.contig, r.n_rows, r.sum_cov) for r in coverage_windows(rows).collect()] == [("c", 2, 7)]
