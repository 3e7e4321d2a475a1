"""Queries of the alphabet's, the motifs' and the tags' functions, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import iupac, modtags
from strandlake.functions.modtags import Descriptor
from strandlake.functions.motif import Motif, parse_motifs
from strandlake.functions.text import sql_stripped
from strandlake.operators import pileup, reads, tags
from strandlake.plans import methylation as m
from strandlake.plans.tables import table
from strandlake.session import local_frame


def sequence_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Of each load with a sequence: whether it has letters of the alphabet only, and whether plain bases only."""
    rows = table(spark, d, "contigs").where("sequence is not null")
    return rows.select("contig_row", iupac.is_iupac(F.col("sequence")).alias("is_iupac"), iupac.is_plain(F.col("sequence")).alias("is_plain"))


def mod_names(spark: SparkSession, d: str) -> DataFrame:
    """Each modification code of the motifs with its base, its name, and what its code is in tags of three bases."""
    codes = table(spark, d, "motifs").select("mod_type").distinct()
    code = F.col("mod_type")
    return codes.select("mod_type", iupac.base_of_mod(code).alias("base"), iupac.mod_name(code).alias("name"), *(iupac.mod_of_sam_code(F.lit(b), code).alias(f"on_{b.lower()}") for b in "ACG"))


def _listed(spark: SparkSession, d: str) -> list[Motif]:
    """The motif table, fixed and small, by way of its text form."""
    return parse_motifs([str(x) for x in m.motif_list(spark, d)])


def motif_parsed(spark: SparkSession, d: str) -> DataFrame:
    return local_frame(spark, [(str(x), x.sequence, x.mod_type, x.mod_position) for x in _listed(spark, d)], "text string, motif string, mod_type string, mod_position int")


def motif_extended(spark: SparkSession, d: str) -> DataFrame:
    """Motifs with one N in front and two behind."""
    wider = [x.prepend_n(1).extend_with_n(2) for x in _listed(spark, d)]
    return local_frame(spark, [(x.sequence, x.mod_type, x.mod_position) for x in wider], "motif string, mod_type string, mod_position int")


def tag_parse(spark: SparkSession, d: str) -> DataFrame:
    """The parts of each descriptor of the reads, and its text with another code. Descriptors are few."""
    found = [Descriptor.parse(r["descriptor"]) for r in tags.tag_descriptors(m.tagged_reads(spark, d)).collect()]
    return local_frame(spark, [(str(x), x.base, x.strand, x.code, x.flag, str(x.with_code("z"))) for x in found], "descriptor string, base string, strand string, code string, flag string, with_z string")


def tag_checked(spark: SparkSession, d: str) -> DataFrame:
    """Tags, failing where a read has one of the two only."""
    return m.tagged_reads(spark, d).select("read_id", modtags.checked(F.col("mm"), F.col("ml")).alias("mm"))


def tag_headers(spark: SparkSession, d: str) -> DataFrame:
    """Tags found in the text of a read's header."""
    head = F.concat(F.lit("ch=1 MM:Z:"), F.col("mm"), F.lit(" x:y ML:B:C,"), F.array_join("ml", ","))
    rows = m.tagged_reads(spark, d).select("read_id", head.alias("head"))
    return rows.select("read_id", modtags.header_tag(F.col("head"), "MM").alias("mm"), F.array_join(modtags.ml_values(modtags.header_tag(F.col("head"), "ML")), ",").alias("ml"))


def tag_appended(spark: SparkSession, d: str) -> DataFrame:
    """A read's tags put behind themselves; every other read has none to add."""
    odd = F.col("strand") == "-"
    mm, ml = modtags.append(F.col("mm"), F.col("ml"), F.when(odd, F.col("mm")), F.when(odd, F.col("ml")))
    return m.tagged_reads(spark, d).select("read_id", mm.alias("mm"), F.array_join(ml, ",").alias("ml"))


def mm_calls_compat(spark: SparkSession, d: str) -> DataFrame:
    """Decoding that doesn't skip unknown segments; these reads have none, so the calls are the same."""
    return reads.read_calls(m.tagged_reads(spark, d), mode="compat")


def read_middle_position(spark: SparkSession, d: str) -> DataFrame:
    """Where the reference has the base in the middle of a read; null where it isn't aligned."""

    @F.pandas_udf("long")
    def place(cigar: pd.Series, start: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([reads.reference_position(c, int(s), int(a)) for c, s, a in zip(cigar, start, at)], dtype="Int64")

    rows = m.tagged_reads(spark, d)
    return rows.select("read_id", place("cigar", "start", F.call_function("div", F.length("seq"), F.lit(2)).cast("int")).alias("position"))


def pileup_unfiltered(spark: SparkSession, d: str) -> DataFrame:
    """Netted positions of all rows, without the filters."""
    rows = pileup.methylation(m.pileup_rows(spark, d), on_error="drop", order="row_id", filtered=False)
    return rows.select(F.col("_order").alias("row_id"), "contig", "start", "strand", "mod_type", "n_modified", "n_valid_cov", "n_diff", "n_fail")


def pileup_beyond_end(spark: SparkSession, d: str) -> DataFrame:
    """Contigs with rows at or behind the end of their sequence."""
    return pileup.beyond_end(m.pileup_rows(spark, d), m.assembly(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        sequence_kinds, mod_names, motif_parsed, motif_extended, tag_parse, tag_checked, tag_headers, tag_appended, mm_calls_compat, read_middle_position, pileup_unfiltered, pileup_beyond_end,
    )
}

_ODD = "case when strand = '-' then {} else {} end"

ORACLE = {
    "sequence_kinds": "select contig_row, regexp_full_match(sequence, '[ACGTRYSWKMBDHVN]*') as is_iupac, regexp_full_match(sequence, '[ACGTNacgtn]*') as is_plain from contigs where sequence is not null",
    "mod_names": """select distinct mod_type, case when mod_type = 'a' then 'A' else 'C' end as base, case mod_type when 'a' then '6mA (a)' when 'm' then '5mC (m)' else '4mC (21839)' end as name,
      case when mod_type = 'a' then 'a' end as on_a, case when mod_type <> 'a' then mod_type end as on_c, cast(null as varchar) as on_g from motifs""",
    "motif_parsed": "select motif || '_' || mod_type || '_' || mod_position as text, motif, mod_type, mod_position from motifs",
    "motif_extended": "select 'N' || motif || 'NN' as motif, mod_type, mod_position + 1 as mod_position from motifs",
    "tag_parse": f"""with {m._READS}, {m._SEGS}, x as (select distinct descriptor from segs)
      select descriptor, left(descriptor, 1) as base, substr(descriptor, 2, 1) as strand, regexp_extract(descriptor, '^..([a-z0-9]*)', 1) as code, regexp_extract(descriptor, '([.?]?)$', 1) as flag,
        left(descriptor, 2) || 'z' || regexp_extract(descriptor, '([.?]?)$', 1) as with_z from x""",
    "tag_checked": f"with {m._READS} select read_id, mm from reads",
    "tag_headers": f"with {m._READS} select read_id, mm, array_to_string(ml, ',') as ml from reads",
    "tag_appended": f"with {m._READS} select read_id, {_ODD.format('mm || mm', 'mm')} as mm, array_to_string({_ODD.format('list_concat(ml, ml)', 'ml')}, ',') as ml from reads",
    "mm_calls_compat": m.ORACLE["mm_calls"],
    "read_middle_position": f"""with {m._READS}, {m._OPS}, x as (select read_id, length(sequence) // 2 as middle from reads)
      select x.read_id, cast(ref_from + middle - read_from as bigint) as position from x left join blocks b on x.read_id = b.read_id and middle >= read_from and middle < read_from + b.length""",
    "pileup_unfiltered": f"select row_id, {sql_stripped('contig')} as contig, ref_start as start, strand, mod_type, n_modified, n_valid_cov - n_other_mod as n_valid_cov, n_diff, n_fail from pileup where n_modified <= n_valid_cov",
    "pileup_beyond_end": f"""with {m._ASM} select a.contig, cast(coalesce(length(a.sequence), 0) as int) as length, max(p.ref_start) as last_start
      from pileup p join asm a on {sql_stripped('p.contig')} = a.contig group by a.contig, a.sequence having max(p.ref_start) >= coalesce(length(a.sequence), 0)""",
}
