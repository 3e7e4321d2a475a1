"""Readers of assemblies, pileups, reads and id lists."""

from __future__ import annotations

import gzip
import io
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandlake.functions import modtags
from strandlake.functions.iupac import check_letters, is_plain
from strandlake.functions.text import WHITESPACE
from strandlake.operators.pileup import COLUMNS, SCHEMA, PileupError, check_mod_types
from strandlake.session import local_frame, wide
from strandlake.sources import files
from strandlake.sources.bam import BamSource, reference_names
from strandlake.sources.bgzf import BgzfReader, index_parts, read_index


def in_file_order(scan: DataFrame, name: str) -> DataFrame:
    """A scan of files with a column that sorts its rows as they stand in the files, these by name.

    Spark reads the splits of several files by size, so a row's number alone
    doesn't tell the order of files. The list of files is broadcast: a path and
    a number for each.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    placed = scan.select("*", F.col("_metadata.file_path").alias("_path"), place.alias("_place"))
    names = local_frame(scan.sparkSession, [(f, i) for i, f in enumerate(sorted(scan.inputFiles()))], "_path string, _file int")
    ranked = placed.join(F.broadcast(names), "_path", "left")
    return ranked.select(*scan.columns, F.struct("_file", "_place").alias(name))


def read_fasta(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """``contig, sequence``: id up to the first white space, sequence upper-cased, of A, C, G, T and N only.

    Records are split by the text reader itself, so a file is read by many
    tasks. Of a repeated id the last record counts.
    """
    text = in_file_order(spark.read.option("lineSep", "\n>").text(path), "_at")
    record = text.select("_at", F.regexp_replace("value", r"\A>", "").alias("r")).where(F.trim("r") != "")
    head, body = F.substring_index("r", "\n", 1), F.when(F.contains("r", F.lit("\n")), F.substring(F.col("r"), F.length(F.substring_index("r", "\n", 1)) + 2, F.length("r"))).otherwise("")
    rows = record.select("_at", F.regexp_extract(head, r"\A\s*(\S*)", 1).alias("contig"), F.regexp_replace(body, r"\s+", "").alias("s"))
    if ids is not None:
        rows = rows.where(F.col("contig").isin(*ids))
    last = rows.repartition(wide(spark), "contig").groupBy("contig").agg(F.max_by("s", "_at").alias("s"))
    wrong = F.raise_error(F.concat(F.lit("Could not parse sequence of contig "), F.col("contig"))).cast("string")
    return last.select("contig", F.when(is_plain(F.col("s")), F.upper("s")).otherwise(wrong).alias("sequence"))


def assembly_from_dict(spark: SparkSession, sequences: dict) -> DataFrame:
    """From ``{id: text or object with .seq}``; the 15 upper-case letters are allowed."""
    rows = []
    for name, value in sequences.items():
        value = getattr(value, "seq", value)
        if not isinstance(value, str):
            try:
                value = str(value) if type(value).__name__ in ("Seq", "MutableSeq") else None
            except Exception:
                value = None
        if not isinstance(name, str) or value is None:
            raise TypeError("assembly values must be str or records with a sequence")
        rows.append((name, check_letters(value)))
    return spark.createDataFrame(rows, "contig string, sequence string")


def read_pileup(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The 18 columns, in file order by ``_order``. Plain and gzip text, and Parquet.

    ``strict`` fails on lines that don't parse and on unknown modification
    codes; blank lines are skipped. ``operators.rejects`` separates bad lines
    instead.
    """
    if path.rstrip("/").endswith(".parquet"):
        rows = spark.read.parquet(path).select(*COLUMNS)
    elif path.endswith((".bed", ".gz", ".bgz")) or files.is_folder(path):
        rows = spark.read.schema(SCHEMA).csv(path, sep="\t", quote="", mode="FAILFAST" if strict else "PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    else:
        raise PileupError(f"Unsupported file type: {path}")
    rows = in_file_order(rows, "_order")
    return check_mod_types(rows) if strict else rows


def pileup_from_frame(rows: DataFrame) -> DataFrame:
    """Any frame that has the 18 columns, by name; without the names, by place.

    Frames of pandas, and any other that can give an Arrow table, are taken over
    into Spark first.
    """
    if not set(COLUMNS) <= set(rows.columns):
        if len(rows.columns) < len(COLUMNS):
            raise PileupError(f"a pileup has {len(COLUMNS)} columns")
        rows = rows.toDF(*COLUMNS, *rows.columns[len(COLUMNS) :])
    kinds = dict(x.replace("`", "").split() for x in SCHEMA.split(", "))
    rows = rows.withColumns({c: F.col(f"`{c}`").cast(kinds[c]) for c in COLUMNS})
    return rows.select(*COLUMNS, *(["_order"] if "_order" in rows.columns else [F.monotonically_increasing_id().alias("_order")]))


def _frames(path: str, contig: str, begin: int, end: int, most: int) -> Iterator[pd.DataFrame]:
    """Lines of a contig between two virtual offsets, at most so many in a frame."""
    with files.open_read(path) as f:
        found = ((v, line) for v, line in BgzfReader(f, begin).lines(end) if line.split("\t", 1)[0] == contig)
        while rows := list(islice(found, most)):
            yield pd.DataFrame(rows, columns=["_order", "line"])


def read_indexed_pileup(spark: SparkSession, path: str, contigs: list[str], part_bytes: int = 8 << 20, frame_rows: int = 20_000) -> DataFrame:
    """Rows of some contigs of a BGZF pileup through its tabix index: only their blocks are read.

    A contig is cut into tasks of about ``part_bytes`` of the file, as far as
    its index has offsets to cut at, and a task holds ``frame_rows`` lines at once.
    A folder is read by the indexes of its files, as ``write_bgzf_folder`` makes them.
    """
    names = files.found(path, "*.gz")
    if not names:
        raise FileNotFoundError(path)
    asked = {c.strip(WHITESPACE) for c in contigs}
    parts, known, task, filled = [], set(), 0, 0
    for at, name in enumerate(names):
        for c, cuts in index_parts(name, part_bytes).items():
            if c.strip(WHITESPACE) in asked:
                known.add(c.strip(WHITESPACE))
                for a, b in cuts:
                    size = (b >> 16) - (a >> 16)
                    if filled and filled + size > part_bytes:  # small contigs share a task
                        task, filled = task + 1, 0
                    filled += max(size, 1)
                    parts.append((task, at, name, c, a, b))
    if asked - known:
        raise PileupError(f"contigs not in the pileup: {sorted(asked - known)}")
    spans = spark.createDataFrame(parts, "task long, at long, name string, contig string, a long, b long").repartitionByRange(task + 1, "task")

    def fetch(batches):
        for pdf in batches:
            for _, at, name, c, a, b in pdf.itertuples(index=False):
                for frame in _frames(name, c, a, b, frame_rows):
                    frame["_order"] += at << 48  # virtual offsets have 48 bits in files below 4 GB and more only by what they add up to
                    yield frame

    lines = spans.mapInPandas(fetch, "_order long, line string")
    parts = F.split("line", "\t")
    kinds = dict(x.replace("`", "").split() for x in SCHEMA.split(", "))
    return lines.select(*(F.trim(parts[i]).cast(kinds[c]).alias(c) for i, c in enumerate(COLUMNS)), "_order")


def to_spark(spark: SparkSession, rows) -> DataFrame:
    """A Spark frame of a frame of Spark, pandas, Arrow, or any with ``to_arrow``; the order of its rows goes into ``_order``."""
    if isinstance(rows, DataFrame):
        return rows
    table = rows if isinstance(rows, pa.Table) else pa.Table.from_pandas(rows, preserve_index=False) if isinstance(rows, pd.DataFrame) else rows.to_arrow() if hasattr(rows, "to_arrow") else None
    if table is None:
        raise TypeError(f"not a frame: {type(rows).__name__}")
    names = [*table.column_names, "_order"]
    return spark.createDataFrame(pa.Table.from_arrays([*table.columns, pa.array(range(table.num_rows), pa.int64())], names=names))


def indexed_contigs(path: str) -> list[str]:
    return sorted({c for name in files.found(path, "*.gz") for c in read_index(name)})


def read_ids(spark: SparkSession, path: str, column: str = "read_id") -> DataFrame:
    """Ids, one per line, as they stand."""
    return spark.read.text(path).select(F.col("value").alias(column))


def read_contig_list(path: str) -> list[str]:
    """Contigs of a small file: trimmed, without blank lines and comments."""
    with io.TextIOWrapper(files.open_read(path)) as f:
        out = [x for line in f if (x := line.strip()) and not x.startswith("#")]
    if not out:
        raise PileupError("No contigs found in file")
    return out


def read_bam(spark: SparkSession, path: str, primary_only: bool = True, full: bool = False) -> DataFrame:
    """Mapped reads of BAM files; secondary alignments are left out. Unmapped reads are no error: they have no reference to look at. ``full``: all that a record holds."""
    spark.dataSource.register(BamSource)
    rows = spark.read.format("strandlake_bam").option("full", str(full).lower()).load(path)
    return rows.where(F.col("flag").bitwiseAND(256) == 0).where("contig is not null") if primary_only else rows


def read_bam_tags(spark: SparkSession, path: str) -> DataFrame:
    """``read_id, mm, ml`` of all records."""
    return read_bam(spark, path, primary_only=False).select("read_id", "mm", "ml")


def bam_contigs(path: str) -> list[str]:
    return reference_names(files.found(path, "*.bam")[0])


@dataclass
class _Chunk(InputPartition):
    path: str
    begin: int
    end: int | None


class _FastqReader(DataSourceReader):
    def __init__(self, path: str, chunk: int) -> None:
        self.path, self.chunk = path, chunk

    def partitions(self) -> list[InputPartition]:
        names = [x for x in files.found(self.path) if ".fastq" in x or ".fq" in x or x == self.path or x.rpartition("/")[2].startswith("part-")]
        if not names:
            raise FileNotFoundError(self.path)
        out: list[InputPartition] = []
        for f in names:
            if f.endswith(".gz"):
                out.append(_Chunk(f, 0, None))
            else:
                size = files.size_of(f)
                out += [_Chunk(f, a, min(a + self.chunk, size)) for a in range(0, max(size, 1), self.chunk)]
        return out

    def read(self, p: _Chunk) -> Iterator[tuple]:
        with files.open_read(p.path) as raw, gzip.open(raw, "rb") if p.path.endswith(".gz") else raw as f:
            if p.begin:
                f.seek(p.begin - 1)
                f.readline()
                self._synchronize(f)
            while p.end is None or f.tell() < p.end:
                head = f.readline()
                if not head:
                    return
                if not head.strip():
                    continue
                seq, plus, qual = f.readline(), f.readline(), f.readline()
                if not head.startswith(b"@") or not plus.startswith(b"+") or not qual and seq.strip():
                    raise ValueError(f"broken FASTQ record in {p.path}: {head[:80]!r}")
                name, _, description = head[1:].decode().rstrip("\r\n").replace("\t", " ", 1).partition(" ")
                yield name, description, seq.decode().strip(), qual.decode().strip()

    @staticmethod
    def _synchronize(f) -> None:
        """Go to the next record: a line with '@' whose next but one begins with '+' and whose sequence and quality have one length."""
        starts, lines = [], []
        for _ in range(8):
            starts.append(f.tell())
            lines.append(f.readline().rstrip(b"\r\n"))
        for i in range(4):
            if lines[i].startswith(b"@") and lines[i + 2].startswith(b"+") and len(lines[i + 1]) == len(lines[i + 3]):
                f.seek(starts[i])
                return
        f.seek(0, os.SEEK_END)  # what is left is the end of a record


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandlake_fastq"

    def schema(self) -> str:
        return "read_id string, description string, seq string, qual string"

    def reader(self, schema) -> DataSourceReader:
        return _FastqReader(self.options["path"], int(self.options.get("chunk", 64 << 20)))


def read_fastq(spark: SparkSession, path: str, ids: DataFrame | list[str] | None = None, chunk: int = 64 << 20) -> DataFrame:
    """``read_id, seq, mm, ml`` of FASTQ files; the tags come from the headers. Plain files are read in chunks."""
    from strandlake.operators.reads import filter_reads

    spark.dataSource.register(FastqSource)
    rows = spark.read.format("strandlake_fastq").option("chunk", chunk).load(path)
    if ids is not None:
        rows = filter_reads(rows, ids)
    wrong = F.raise_error(F.concat(F.lit("Invalid base in read "), F.col("read_id"))).cast("string")
    ml = modtags.header_tag(F.col("description"), "ML")
    return rows.select("read_id", F.when(is_plain(F.col("seq")), F.upper("seq")).otherwise(wrong).alias("seq"), modtags.header_tag(F.col("description"), "MM").alias("mm"), modtags.ml_values(ml).alias("ml"))
