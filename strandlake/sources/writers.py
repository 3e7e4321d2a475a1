"""Writers of results, pileups and tagged reads."""

from __future__ import annotations

import io
import pickle
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.pattern import ordered
from strandlake.operators.pileup import pileup_lines
from strandlake.session import released, scratch
from strandlake.sources import files
from strandlake.sources.bgzf import PileupWriter
from strandlake.sources.formats import tsv_lines


def check_tsv(path: str | Path) -> Path:
    """The path, if it ends in .tsv; its folder is made."""
    p = Path(path)
    if p.suffix != ".tsv":
        raise ValueError(f'Incorrect file extension "{p.suffix.lstrip(".")}". Should be tsv')
    p.parent.mkdir(parents=True, exist_ok=True)
    return p


def write_tsv_file(rows: DataFrame, path: str | Path, sort: bool = True) -> None:
    """One local file with a header; rows come to the driver one partition at a time, in result order."""
    p = check_tsv(path)
    lines = tsv_lines(ordered(rows) if sort else rows)
    with p.open("w") as f:
        f.write("\t".join(rows.columns) + "\n")
        for r in lines.toLocalIterator():
            f.write(r["line"] + "\n")


def write_tsv(rows: DataFrame, folder: str, sort: bool = True) -> None:
    """A folder of part files in result order, each with the header; nothing passes the driver."""
    lines = tsv_lines(ordered(rows) if sort else rows)
    head = "\t".join(rows.columns)
    lines.mapInPandas(lambda it: _with_header(it, head), "line string").write.text(folder)


def _with_header(batches, head: str):
    import pandas as pd

    yield pd.DataFrame({"line": [head]})
    yield from batches


def write_contig_parquet(pileup: DataFrame, path: str, partitions: int | None = None) -> None:
    """Pileup sorted by contig and start, so that a contig's rows are found by the statistics of few files and row groups."""
    keys = ["contig", "start"]
    ranged = pileup.repartitionByRange(partitions, *keys) if partitions else pileup.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_bgzf(pileup: DataFrame, path: str | Path, force: bool = False) -> None:
    """One BGZF file with a tabix index, sorted by contig and start, rows of one start in file order; streamed through the driver as it is one file."""
    ties = ["_order"] if "_order" in pileup.columns else ["strand", "mod_type"]
    rows = pileup.orderBy("contig", "start", *ties)
    with PileupWriter(path, force) as w:
        w.write_lines(r["line"] for r in pileup_lines(rows).toLocalIterator())


def write_bgzf_folder(pileup: DataFrame, folder: str, partitions: int | None = None) -> None:
    """A folder of BGZF files with their indexes, together sorted by contig and start; nothing passes the driver.

    ``readers.read_indexed_pileup`` takes the folder. A task that runs again
    replaces its files.
    """
    ties = ["_order"] if "_order" in pileup.columns else ["strand", "mod_type"]
    ranged = pileup.repartitionByRange(partitions, "contig", "start") if partitions else pileup.repartitionByRange("contig", "start")
    lines = pileup_lines(ranged.sortWithinPartitions("contig", "start", *ties))
    files.make_folder(folder)

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        path = f"{folder.rstrip('/')}/part-{task.partitionId():05d}.bed.gz"
        w = None
        for b in batches:
            w = w or PileupWriter(f"{path}.{task.taskAttemptId()}", force=True)
            w.write_lines(b.column(0).to_pylist())
        if w:
            w.finish()
            files.move(f"{w.path}.tbi", f"{path}.tbi")
            files.move(w.path, path)
        return iter(())

    lines.mapInArrow(write, "done int").write.format("noop").mode("overwrite").save()


def write_bgzf_joined(lines: DataFrame, path: str, writer: type[PileupWriter] = PileupWriter) -> None:
    """Sorted pileup lines as one BGZF file with a tabix index; the lines don't pass the driver.

    The executors write a file per partition to the shared folder, line by line,
    and the driver joins their blocks and indexes. Only files of attempts that
    came through are joined.
    """
    spark = lines.sparkSession
    with released(spark):
        folder = scratch(spark, "parts")
        files.make_folder(folder)

        def write(batches):
            from pyspark import TaskContext

            task = TaskContext.get()
            w = None
            for b in batches:
                w = w or writer(f"{folder}/part-{task.partitionId():05d}.{task.taskAttemptId()}")
                w.write_lines(b.column(0).to_pylist())
            if w:
                w.finish()
                yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([w.path]), pa.array([pickle.dumps(w.index)], pa.binary())], names=["part", "path", "index"])

        parts = lines.mapInArrow(write, "part int, path string, index binary").collect()
        w = writer(path)
        for p in sorted(parts, key=lambda p: p["part"]):
            w.append(p["path"], pickle.loads(p["index"]))
        w.finish()


def sam_lines(reads: DataFrame) -> DataFrame:
    """Alignment lines with their tags, column ``line``; ``reads`` as the BAM source gives them, best with all columns (``full``)."""
    from strandlake.functions.iupac import reverse_complement
    from strandlake.sources.bam import tag_texts

    text = lambda c, missing: F.coalesce(F.col(c).cast("string"), F.lit(missing)) if c in reads.columns else F.lit(missing)
    turned = F.col("strand") == "-"
    seq = F.when(turned, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    qual = F.coalesce(F.when(turned, F.reverse("qual")).otherwise(F.col("qual")), F.lit("*")) if "qual" in reads.columns else F.lit("*")
    one = lambda c: F.coalesce(F.col(c) + 1, F.lit(0)).cast("string") if c in reads.columns else F.lit("0")
    fields = [text("read_id", "*"), text("flag", "0"), text("contig", "*"), one("start"), text("mapq", "255"), text("cigar", "*"), text("mate_contig", "*"), one("mate_start"), text("template_length", "0"), F.coalesce(seq, F.lit("*")), qual]
    tags = [F.concat(F.lit("MM:Z:"), "mm"), F.concat(F.lit("ML:B:C,"), F.array_join("ml", ","))]
    if "tags" in reads.columns:

        @F.pandas_udf("string")
        def rest(values):
            return values.map(lambda v: "\t".join(tag_texts(v)) or None, na_action="ignore").astype(object)

        tags.insert(0, rest("tags"))
    return reads.select(F.concat_ws("\t", *fields, *tags).alias("line"))


def write_sam(reads: DataFrame, folder: str, header: str = "") -> None:
    """A folder of text files; the header goes into a folder of its own beside it, with ``-header`` behind the name."""
    sam_lines(reads).write.text(folder)
    if header:
        reads.sparkSession.createDataFrame([(x,) for x in header.rstrip("\n").split("\n")], "line string").coalesce(1).write.text(folder.rstrip("/") + "-header")


def write_sam_file(reads: DataFrame, path: str, header: str = "") -> None:
    """One file with the header first; lines pass the driver one partition at a time."""
    with io.TextIOWrapper(files.open_write(path)) as f:
        f.write(header.rstrip("\n") + "\n" * bool(header))
        for r in sam_lines(reads).toLocalIterator():
            f.write(r["line"] + "\n")


def write_fasta(contigs: DataFrame, folder: str) -> None:
    """A folder of FASTA files."""
    contigs.select(F.concat(F.lit(">"), "contig", F.lit("\n"), "sequence")).write.text(folder)


def write_pileup(pileup: DataFrame, folder: str) -> None:
    """A folder of plain pileup files, in the frame's order."""
    pileup_lines(pileup).write.text(folder)


def write_fastq(reads: DataFrame, folder: str) -> None:
    """A folder of FASTQ files with the tags in the headers. ``reads``: ``read_id, seq, mm, ml`` and maybe ``qual``."""
    qual = F.coalesce(F.col("qual"), F.repeat(F.lit("!"), F.length("seq"))) if "qual" in reads.columns else F.repeat(F.lit("!"), F.length("seq"))
    head = F.concat_ws(" ", F.concat(F.lit("@"), "read_id"), F.concat(F.lit("MM:Z:"), "mm"), F.concat(F.lit("ML:B:C,"), F.array_join("ml", ",")))
    lines = F.concat_ws("\n", head, "seq", F.lit("+"), qual)
    reads.select(lines.alias("line")).write.text(folder)
