"""Public functions: the calls that users of the file-based tools make."""

from __future__ import annotations

import io
import shutil
from collections.abc import Iterable
from contextlib import nullcontext
from enum import Enum
from pathlib import Path
from typing import BinaryIO, TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake import __version__
from strandlake.functions.motif import collapse_children, parse_motifs
from strandlake.functions.text import stripped
from strandlake.operators import pattern, pileup, reads, tags
from strandlake.operators.pattern import Output as MethylationOutput
from strandlake.session import released, scratch
from strandlake.sources import bam, files, readers, writers
from strandlake.sources.bgzf import END_BLOCK, record_line
from strandlake.sources.bgzf import RecordWriter as BgzfWriter

__all__ = [
    "BgzfWriter", "MethylationOutput", "PileupColumn", "__version__", "bgzf_lines", "bgzf_pileup", "extract_pileup", "merge_bam_tags", "methylation_pattern",
    "methylation_pattern_from_dataframe", "query_pileup_records", "read_bam_pattern", "read_fastq_pattern", "remove_child_motifs",
]

PileupColumn = Enum("PileupColumn", {c: c for c in pileup.COLUMNS}, type=str)


def _spark(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.appName("strandlake").getOrCreate()


def _assembly(spark: SparkSession, assembly) -> DataFrame:
    if isinstance(assembly, DataFrame):
        out = assembly
    elif isinstance(assembly, dict):
        out = readers.assembly_from_dict(spark, assembly)
    elif isinstance(assembly, str | Path):
        out = readers.read_fasta(spark, str(assembly))
    else:
        raise TypeError("an assembly is a path, a frame or a dict of sequences")
    if out.isEmpty():
        raise ValueError("the assembly is empty")
    return out


def _pattern(contigs: DataFrame, rows: DataFrame, motifs: list[str], output_type, min_coverage: int, min_fraction: float) -> DataFrame:
    kind = output_type if isinstance(output_type, MethylationOutput) else MethylationOutput.parse(output_type)
    counts = pileup.methylation(rows, min_coverage, min_fraction, order="_order")
    make = {MethylationOutput.RAW: pattern.raw, MethylationOutput.MEDIAN: pattern.median, MethylationOutput.WEIGHTED_MEAN: pattern.weighted_mean}[kind]
    return make(contigs, counts, parse_motifs(motifs))


def methylation_pattern(pileup_path, assembly, motifs: list[str], output_type="median", contigs: list[str] | None = None, output: str | None = None, threads: int = 1, min_valid_read_coverage: int = 3, batch_size: int = 100, min_valid_cov_to_diff_fraction: float = 0.8, allow_assembly_pileup_mismatch: bool = False, spark: SparkSession | None = None) -> DataFrame | None:
    """Methylation of motifs per contig from files.

    Plain text is checked for contigs outside the assembly, gzip text for
    assembly contigs without rows. ``threads`` and ``batch_size`` are accepted;
    Spark's partitions take their place. With ``output`` a sorted .tsv is
    written, else a frame returned.
    """
    s = _spark(spark)
    if output:
        writers.check_tsv(output)
    known = _assembly(s, assembly)
    if contigs is not None:
        known = known.where(F.col("contig").isin(*contigs))
    rows = readers.read_pileup(s, str(pileup_path))
    if contigs is not None:
        rows = rows.where(stripped(F.col("contig")).isin(*contigs))
    pileup.check_bounds(pileup.filter_pileup(rows, min_valid_read_coverage, min_valid_cov_to_diff_fraction), known)
    pileup.check_contigs(rows, known, "indexed" if str(pileup_path).endswith("gz") else "sequential", allow_assembly_pileup_mismatch)
    result = _pattern(known, rows, motifs, output_type, min_valid_read_coverage, min_valid_cov_to_diff_fraction)
    if output:
        writers.write_tsv_file(result, output)
        return None
    return result


def methylation_pattern_from_dataframe(pileup_df, assembly, motifs: list[str], output_type="median", threads: int = 1, min_valid_read_coverage: int = 5, min_valid_cov_to_diff_fraction: float = 0.8, spark: SparkSession | None = None) -> DataFrame:
    """The same from a frame of Spark, pandas, Arrow or one with ``to_arrow``; contigs that only one side has are left out."""
    s = pileup_df.sparkSession if isinstance(pileup_df, DataFrame) else _spark(spark)
    return _pattern(_assembly(s, assembly), readers.pileup_from_frame(readers.to_spark(s, pileup_df)), motifs, output_type, min_valid_read_coverage, min_valid_cov_to_diff_fraction)


def remove_child_motifs(output: str | None, motifs: list[str]) -> list[str]:
    """Motifs without the children of others, in order; written as .tsv if ``output`` is given."""
    kept = collapse_children(parse_motifs(motifs))
    if output:
        rows = ["motif\tmod_type\tmod_position", *(f"{m.sequence}\t{m.mod_type}\t{m.mod_position}" for m in kept)]
        writers.check_tsv(output).write_text("\n".join(rows) + "\n")
    return [str(m) for m in kept]


def _indexed(path: str) -> bool:
    """Whether a file, or each of a folder's BGZF files, has an index."""
    names = files.found(path, "*.gz")
    return bool(names) and all(files.exists(f"{x}.tbi") for x in names)


def query_pileup_records(pileup_path: str, contigs: list[str], columns: list | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Rows of contigs in the order asked for; through the tabix index where there is one."""
    s, path = _spark(spark), str(pileup_path)
    names = [c.value if isinstance(c, Enum) else c for c in columns] if columns else None
    rows = readers.read_indexed_pileup(s, path, contigs) if contigs and _indexed(path) else readers.read_pileup(s, path)
    return pileup.query_contigs(rows, contigs, names, order="_order")


def bgzf_pileup(input: str, output: str | None = None, keep: bool = False, force: bool = False, spark: SparkSession | None = None) -> str:
    """Compress a pileup to BGZF with an index; the input is removed unless kept."""
    out = output or f"{input}.gz"
    if not out.endswith("bed.gz"):
        raise ValueError(f"the output needs a bed.gz extension: {out}")
    writers.write_bgzf(readers.read_pileup(_spark(spark), input), out, force)
    if not keep:
        files.remove(input)
    return out


def bgzf_lines(lines: Iterable[str], output: str | BinaryIO, force: bool = False) -> None:
    """Compress the lines of a stream, such as standard input, in their order; each is parsed and rendered anew.

    To a path, with an index, or to a binary stream such as standard output,
    without.
    """
    if isinstance(output, str | Path):
        if not str(output).endswith(".gz"):
            raise ValueError(f"the output needs a bed.gz extension: {output}")
        with BgzfWriter(output, force) as w:
            w.write_lines(lines)
        return
    text = (record_line(line).encode() + b"\n" for line in lines if line.strip())
    for block in bam.blocks_of(text):
        output.write(block)
    output.write(END_BLOCK)


def extract_pileup(pileup_path: str, output: str | TextIO, contigs: list[str] | None = None, contigs_file: str | None = None, spark: SparkSession | None = None) -> None:
    """Write the rows of contigs as plain text, to a path or a text stream such as standard output.

    The executors write the lines to the shared folder and the driver joins
    these files: a partition of any size takes none of its memory.
    """
    if contigs and contigs_file:
        raise ValueError("contigs can be named or listed in a file, but not both")
    if not contigs and not contigs_file:
        raise ValueError("contigs must be named or listed in a file")
    rows = query_pileup_records(pileup_path, contigs or readers.read_contig_list(contigs_file), spark=spark)
    s = rows.sparkSession
    with released(s), nullcontext(output) if hasattr(output, "write") else io.TextIOWrapper(files.open_write(output), encoding="utf-8", newline="") as f:
        folder = scratch(s, "lines")
        pileup.pileup_lines(rows).write.option("compression", "none").option("lineSep", "\n").text(folder)
        for part in sorted(s.read.text(folder).inputFiles()):  # named in the order of the rows
            with io.TextIOWrapper(files.open_read(part), encoding="utf-8", newline="") as lines:
                shutil.copyfileobj(lines, f, 1 << 20)


def read_fastq_pattern(path: str, motifs: list[str], read_ids: list[str] | None = None, mode: str = "spec", spark: SparkSession | None = None) -> DataFrame:
    return reads.read_fastq_pattern(readers.read_fastq(_spark(spark), path, read_ids), parse_motifs(motifs), mode)


def read_bam_pattern(path: str, assembly, motifs: list[str], mode: str = "spec", spark: SparkSession | None = None) -> DataFrame:
    s = _spark(spark)
    return reads.read_bam_pattern(readers.read_bam(s, path), _assembly(s, assembly), parse_motifs(motifs), mode)


def merge_bam_tags(source: str, target: str, rename_source: list | None = None, rename_target: list | None = None, ignore: list | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Records of ``target``, whole, with the tags of ``source`` added. Of a read repeated in the source the last record counts."""
    s = _spark(spark)
    src = readers.read_bam_tags(s, source).withColumn("_n", F.monotonically_increasing_id())
    return tags.merge_tags(src, readers.read_bam(s, target, primary_only=False, full=True), rename_source, rename_target, ignore, order="_n")


def write_alignments(reads: DataFrame, output: str, like: str) -> None:
    """One file, BAM or SAM by its ending, with the header and the references of the BAM file ``like``."""
    header, references = bam.header_of(files.found(like, "*.bam")[0])
    if output.endswith(".bam"):
        bam.write_bam(reads, output, header, references)
    else:
        writers.write_sam_file(reads, output, header)
