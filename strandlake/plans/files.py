"""Queries that write the tables as files, read these back by the library's own sources, and compare with the tables by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake import api
from strandlake.functions import iupac
from strandlake.functions.text import sql_stripped, stripped
from strandlake.operators import pattern, pileup
from strandlake.plans import methylation as m
from strandlake.plans.tables import table
from strandlake.session import local_frame, scratch
from strandlake.sources import bam, readers, writers
from strandlake.sources.formats import tsv_lines

CONTIGS = ["spike_01", "spike_03"]
SAM_HEADER = "@HD\tVN:1.6\n"


# -- assemblies


def _plain_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Contigs that a FASTA file may hold: bases A, C, G, T and N, names without white space."""
    return m.assembly(spark, d).where(iupac.is_plain(F.col("sequence")) & ~F.col("contig").rlike(r"\s"))


def _fasta(spark: SparkSession, d: str) -> str:
    folder = scratch(spark, "fasta")
    writers.write_fasta(_plain_assembly(spark, d), folder)
    return folder


def _controls(spark: SparkSession, d: str) -> list[str]:
    """Ids of the controls, a small fixed table, by way of a list file."""
    folder = scratch(spark, "ids")
    table(spark, d, "control_contigs").select(stripped(F.col("id")).alias("id")).where("id <> ''").distinct().write.text(folder)
    return [r["id"] for r in readers.read_ids(spark, folder, "id").collect()]


def fasta_scan(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_fasta(spark, _fasta(spark, d))


def fasta_filter(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_fasta(spark, _fasta(spark, d), _controls(spark, d))


def assembly_dict(spark: SparkSession, d: str) -> DataFrame:
    """The controls as a dict of sequences."""
    rows = m.assembly(spark, d).where(F.col("contig").isin(*_controls(spark, d)) & F.col("sequence").isNotNull()).collect()
    return readers.assembly_from_dict(spark, {r["contig"]: r["sequence"] for r in rows})


# -- pileups


def _storable(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a pileup file can hold: nothing null, no NaN, a contig."""
    rows = m.pileup_rows(spark, d).withColumn("contig", stripped(F.col("contig")))
    kept = rows.where("contig <> '' and color is not null and fraction_modified is not null and not isnan(fraction_modified) and n_valid_cov is not null")
    return kept.select(*pileup.COLUMNS, F.col("row_id").alias("_order"))


def _plain_folder(spark: SparkSession, d: str) -> str:
    folder = scratch(spark, "pileup")
    writers.write_pileup(_storable(spark, d), folder)
    return folder


def _indexed_folder(spark: SparkSession, d: str) -> str:
    folder = scratch(spark, "bgzf")
    writers.write_bgzf_folder(_storable(spark, d), folder)
    return folder


def pileup_text_scan(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_pileup(spark, _plain_folder(spark, d)).select(*pileup.COLUMNS)


def pileup_indexed_query(spark: SparkSession, d: str) -> DataFrame:
    """Two contigs through the indexes of a BGZF folder, by the public function and its column names."""
    return api.query_pileup_records(_indexed_folder(spark, d), CONTIGS, list(api.PileupColumn), spark=spark)


def pileup_index_names(spark: SparkSession, d: str) -> DataFrame:
    return local_frame(spark, [(c,) for c in readers.indexed_contigs(_indexed_folder(spark, d))], "contig string")


def pileup_extract(spark: SparkSession, d: str) -> DataFrame:
    """The lines of two contigs listed in a file, extracted to one plain file."""
    names, out = scratch(spark, "names"), scratch(spark, "extract")
    with readers.files.open_write(names) as f:
        f.write("\n".join(["# asked for", *CONTIGS, ""]).encode())
    api.extract_pileup(_indexed_folder(spark, d), out, contigs_file=names, spark=spark)
    return spark.read.text(out).select(F.col("value").alias("line"))


def pileup_single_file(spark: SparkSession, d: str) -> DataFrame:
    """Two contigs written as one BGZF file with its index, line by line, and read by the plain scan."""
    rows = _storable(spark, d).where(F.col("contig").isin(*CONTIGS)).orderBy("contig", "start", "_order")
    path = f"{scratch(spark, 'single')}.bed.gz"
    writers.write_bgzf_joined(pileup.pileup_lines(rows), path, api.BgzfWriter)
    return readers.read_pileup(spark, path).select(*pileup.COLUMNS)


# -- results


def pattern_from_files(spark: SparkSession, d: str) -> DataFrame:
    """The public function on FASTA and pileup files, for two contigs."""
    rows = _storable(spark, d).where("n_modified <= n_valid_cov")
    folder = scratch(spark, "pileup")
    writers.write_pileup(rows.orderBy("_order"), folder)
    return api.methylation_pattern(folder, _fasta(spark, d), [str(x) for x in m.motif_list(spark, d)], "weighted-mean", contigs=CONTIGS, spark=spark)


def pattern_from_frame(spark: SparkSession, d: str) -> DataFrame:
    """The public function on a frame, raw results."""
    rows = m.pileup_rows(spark, d).where("n_modified <= n_valid_cov").withColumn("_order", F.col("row_id"))
    return api.methylation_pattern_from_dataframe(rows, m.assembly(spark, d), [str(x) for x in m.motif_list(spark, d)], "raw", min_valid_read_coverage=m.MIN_COVERAGE)


def tsv_raw_lines(spark: SparkSession, d: str) -> DataFrame:
    return tsv_lines(m.contig_raw(spark, d))


def tsv_weighted_file(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the written result, without the headers."""
    folder = scratch(spark, "tsv")
    writers.write_tsv(m.contig_weighted_mean(spark, d), folder)
    return spark.read.text(folder).select(F.col("value").alias("line")).where(~F.col("line").startswith("contig\tmotif\t"))


def result_order_raw(spark: SparkSession, d: str) -> DataFrame:
    return pattern.numbered(m.contig_raw(spark, d)).select("row_no", "contig", "motif", "mod_type", "mod_position", "start", "strand")


def result_order_degrees(spark: SparkSession, d: str) -> DataFrame:
    return pattern.numbered(m.contig_weighted_mean(spark, d)).select("row_no", "contig", "motif", "mod_type", "mod_position")


# -- reads


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Reads as records of an alignment; every tenth one is secondary."""
    second = F.when(F.substring_index("read_id", "_", -1).cast("long") % 10 == 0, 256).otherwise(0)
    return m.tagged_reads(spark, d).withColumn("flag", (second + F.when(F.col("strand") == "-", 16).otherwise(0)).cast("int"))


def _bam(spark: SparkSession, d: str) -> str:
    """A folder of BAM files; the header's list of references is the driver's, as the format has it."""
    rows = _records(spark, d)
    references = [(r["contig"], r["n"]) for r in rows.groupBy("contig").agg(F.max(F.length("seq")).alias("n")).orderBy("contig").collect()]
    folder = scratch(spark, "bam")
    bam.write_bam_folder(rows, folder, SAM_HEADER, references)
    return folder


def bam_scan(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_bam(spark, _bam(spark, d)).select("read_id", "contig", "start", "strand", "cigar", "mapq", "seq")


def bam_tags(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_bam_tags(spark, _bam(spark, d)).select("read_id", "mm", F.array_join("ml", ",").alias("ml"))


def bam_names(spark: SparkSession, d: str) -> DataFrame:
    return local_frame(spark, [(c,) for c in readers.bam_contigs(_bam(spark, d))], "contig string")


def sam_text(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all records, secondary ones too."""
    return writers.sam_lines(readers.read_bam(spark, _bam(spark, d), primary_only=False, full=True))


def _fastq(spark: SparkSession, d: str) -> str:
    folder = scratch(spark, "fastq")
    writers.write_fastq(m.tagged_reads(spark, d).where(iupac.is_plain(F.col("seq"))), folder)
    return folder


def fastq_scan(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_fastq(spark, _fastq(spark, d)).select("read_id", "seq", "mm", F.array_join("ml", ",").alias("ml"))


def fastq_id_filter(spark: SparkSession, d: str) -> DataFrame:
    """The reads listed in a file of ids."""
    ids = scratch(spark, "ids")
    m.tagged_reads(spark, d).where("strand = '-'").select("read_id").write.text(ids)
    return readers.read_fastq(spark, _fastq(spark, d), readers.read_ids(spark, ids)).select("read_id", F.length("seq").alias("read_length"))


QUERIES = {
    f.__name__: f
    for f in (
        fasta_scan, fasta_filter, assembly_dict, pileup_text_scan, pileup_indexed_query, pileup_index_names, pileup_extract, pileup_single_file, pattern_from_files, pattern_from_frame,
        tsv_raw_lines, tsv_weighted_file, result_order_raw, result_order_degrees, bam_scan, bam_tags, bam_names, sam_text, fastq_scan, fastq_id_filter,
    )
}

# -- SQL

_PLAIN = "regexp_full_match(sequence, '[ACGTN]*')"
_HELD = rf"{m._ASM}, held as (select * from asm where {_PLAIN} and not regexp_matches(contig, '\s'))"
_ASKED = f"({', '.join(repr(c) for c in CONTIGS)})"
_NAMED = ", ".join({"start": "ref_start as start", "end": 'ref_end as "end"', "contig": f"{sql_stripped('contig')} as contig"}.get(c, c) for c in pileup.COLUMNS)
_FILED = f"filed as (select row_id, {_NAMED} from pileup where {sql_stripped('contig')} <> '' and color is not null and fraction_modified is not null and not isnan(fraction_modified) and n_valid_cov is not null)"
_COLUMNS = ", ".join(f'"{c}"' for c in pileup.COLUMNS)
#: Decimals without an exponent and without '.0'; these results have none below 0.0001.
_SHOWN = lambda x: rf"regexp_replace(cast({x} as varchar), '\.0$', '')"
_LINE = "concat_ws(chr(9), " + ", ".join(_SHOWN(c) if c == "fraction_modified" else f'"{c}"' for c in pileup.COLUMNS) + ")"
_KEY = "contig, translate(motif, 'ACGTRYSWKMBDHVN', 'ABCDEFGHIJKLMNO'), case mod_type when 'a' then 0 when 'm' then 1 else 2 end, mod_position"
_WEIGHTED = m._DEGREE.format(value=m._WMEAN)
_RAW = f"with {m._POS}, {m._METH}, {m._OBS} select * from obs"
_SEQ = "case when strand = '-' then {rc} else sequence end".format(rc=m._RC("sequence"))
_FLAG = "(case when cast(split_part(read_id, '_', 2) as bigint) % 10 = 0 then 256 else 0 end + case when strand = '-' then 16 else 0 end)"

ORACLE = {
    "fasta_scan": f"with {_HELD} select contig, sequence from held",
    "fasta_filter": f"with {_HELD} select contig, sequence from held where contig in (select {sql_stripped('id')} from control_contigs)",
    "assembly_dict": f"with {m._ASM} select contig, sequence from asm where sequence is not null and contig in (select {sql_stripped('id')} from control_contigs)",
    "pileup_text_scan": f"with {_FILED} select {_COLUMNS} from filed",
    "pileup_indexed_query": f"with {_FILED} select {_COLUMNS} from filed where contig in {_ASKED}",
    "pileup_index_names": f"with {_FILED} select distinct contig from filed",
    "pileup_extract": f"with {_FILED} select {_LINE} as line from filed where contig in {_ASKED}",
    "pileup_single_file": f"with {_FILED} select {_COLUMNS} from filed where contig in {_ASKED}",
    "pattern_from_files": f"""with {m._POS}, {_FILED}, {m._METH.replace("from pileup where", "from pileup where row_id in (select row_id from filed) and")}, {m._OBS},
      tot as (select contig, motif, mod_type, mod_position, count(*) as motif_occurences_total from pos group by all)
      select contig, motif, mod_type, mod_position, {m._WMEAN} as methylation_value, avg(n_valid_cov) as mean_read_cov, count(*) as n_motif_obs, any_value(motif_occurences_total) as motif_occurences_total
      from obs join tot using (contig, motif, mod_type, mod_position) where n_valid_cov > 0 and contig in {_ASKED} group by contig, motif, mod_type, mod_position""",
    "pattern_from_frame": _RAW,
    "tsv_raw_lines": f"select concat_ws(chr(9), contig, start, strand, motif, mod_type, mod_position, n_modified, n_valid_cov, n_diff, n_fail) as line from ({_RAW})",
    "tsv_weighted_file": f"select concat_ws(chr(9), contig, motif, mod_type, mod_position, {_SHOWN('methylation_value')}, {_SHOWN('mean_read_cov')}, n_motif_obs, motif_occurences_total) as line from ({_WEIGHTED})",
    "result_order_raw": f"select row_number() over (order by {_KEY}, start, case strand when '+' then 0 else 1 end) as row_no, contig, motif, mod_type, mod_position, start, strand from ({_RAW})",
    "result_order_degrees": f"select row_number() over (order by {_KEY}) as row_no, contig, motif, mod_type, mod_position from ({_WEIGHTED})",
    "bam_scan": f"with {m._READS} select read_id, contig, cast(start as int) as start, strand, cigar, cast(mapq as int) as mapq, sequence as seq from reads where {_FLAG} < 256",
    "bam_tags": f"with {m._READS} select read_id, mm, array_to_string(ml, ',') as ml from reads",
    "bam_names": f"with {m._READS} select distinct contig from reads",
    "sam_text": f"with {m._READS} select concat_ws(chr(9), read_id, {_FLAG}, contig, start + 1, mapq, cigar, '*', 0, 0, {_SEQ}, '*', 'MM:Z:' || mm, 'ML:B:C,' || array_to_string(ml, ',')) as line from reads",
    "fastq_scan": f"with {m._READS} select read_id, sequence as seq, mm, array_to_string(ml, ',') as ml from reads where {_PLAIN}",
    "fastq_id_filter": f"with {m._READS} select read_id, length(sequence) as read_length from reads where {_PLAIN} and strand = '-'",
}
