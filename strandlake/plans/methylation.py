"""Queries of the contig, motif, read and tag operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import iupac, modtags
from strandlake.functions.modtags import Descriptor, parse_rename
from strandlake.functions.motif import Motif
from strandlake.functions.text import sql_stripped, stripped
from strandlake.operators import motifs as motif_ops
from strandlake.operators import pattern, pileup, reads, scan, tags
from strandlake.operators.assembly import clean_sequence, latest_loads
from strandlake.operators.cigar import cigar_blocks
from strandlake.plans.tables import table
from strandlake.session import spread

MIN_COVERAGE, MIN_FRACTION = 3, 0.8


def assembly(spark: SparkSession, d: str) -> DataFrame:
    controls = table(spark, d, "control_contigs").select("id", "sequence", "loaded_at", F.lit(0).cast("long").alias("contig_row"))
    return latest_loads(table(spark, d, "contigs").select("id", "sequence", "loaded_at", "contig_row").unionByName(controls))


def motif_list(spark: SparkSession, d: str) -> list[Motif]:
    """The fixed motif table, checked."""
    return [Motif.new(r["motif"], r["mod_type"], r["mod_position"]) for r in table(spark, d, "motifs").orderBy("motif", "mod_type", "mod_position").collect()]


def pileup_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pileup").withColumnsRenamed({"ref_start": "start", "ref_end": "end"})


def meth(spark: SparkSession, d: str) -> DataFrame:
    return pileup.methylation(pileup_rows(spark, d), MIN_COVERAGE, MIN_FRACTION, on_error="drop", order="row_id")


def contig_median(spark: SparkSession, d: str) -> DataFrame:
    return pattern.median(assembly(spark, d), meth(spark, d), motif_list(spark, d))


def contig_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return pattern.weighted_mean(assembly(spark, d), meth(spark, d), motif_list(spark, d))


def contig_raw(spark: SparkSession, d: str) -> DataFrame:
    return pattern.raw(assembly(spark, d), meth(spark, d), motif_list(spark, d))


def contig_verify_from_raw(spark: SparkSession, d: str) -> DataFrame:
    return pattern.degrees_from_raw(contig_raw(spark, d))


def motif_positions(spark: SparkSession, d: str) -> DataFrame:
    motifs = motif_list(spark, d)
    return scan.with_motifs(scan.motif_positions(assembly(spark, d), motifs), motifs)


def motif_occurrences(spark: SparkSession, d: str) -> DataFrame:
    motifs = motif_list(spark, d)
    return scan.with_motifs(scan.occurrences(scan.motif_blocks(assembly(spark, d), motifs)), motifs)


def pileup_filtered(spark: SparkSession, d: str) -> DataFrame:
    return pileup.filter_pileup(pileup_rows(spark, d), MIN_COVERAGE, MIN_FRACTION).select("row_id")


def pileup_netted(spark: SparkSession, d: str) -> DataFrame:
    rows = pileup.net_coverage(pileup.filter_pileup(pileup_rows(spark, d), MIN_COVERAGE, MIN_FRACTION), "drop")
    return rows.select("row_id", "n_modified", "n_valid_cov", pileup.fraction(F.col("n_modified"), F.col("n_valid_cov")).alias("fraction"))


def pileup_dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    return pileup.last_wins(meth(spark, d), pileup.KEY)


REQUEST = ("spike_03", "spike_01", "spike_03")


def pileup_query_contigs(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the requested contigs, by stripped names. NaN and null fractions are told apart by ``fraction_is_nan``, as NaN is equal to nothing in a comparison."""
    rows = pileup.query_contigs(pileup_rows(spark, d), list(REQUEST), order="row_id")
    nan = F.coalesce(F.isnan("fraction_modified"), F.lit(False))
    return rows.withColumns({"fraction_modified": F.when(~nan, F.col("fraction_modified")), "fraction_is_nan": nan})


def pileup_projection(spark: SparkSession, d: str) -> DataFrame:
    return pileup.query_contigs(pileup_rows(spark, d), list(REQUEST), ["contig", "start", "score"], order="row_id")


def pileup_list_contigs(spark: SparkSession, d: str) -> DataFrame:
    return pileup.list_contigs(pileup_rows(spark, d))


def pileup_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Contigs in the order in which the pileup first has them."""
    return pileup.list_contigs(pileup_rows(spark, d), order="row_id")


def pileup_missing_in_assembly(spark: SparkSession, d: str) -> DataFrame:
    return pileup.not_in(pileup_rows(spark, d), assembly(spark, d))


def assembly_missing_in_pileup(spark: SparkSession, d: str) -> DataFrame:
    return pileup.not_in(assembly(spark, d), pileup_rows(spark, d))


def assembly_missing_in_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Contigs of the assembly without a row that passes the filters."""
    return pileup.not_in(assembly(spark, d), meth(spark, d))


def pileup_netted_strict(spark: SparkSession, d: str) -> DataFrame:
    """Netting that fails on a row with more modified than valid reads, over the rows that have none."""
    rows = pileup_rows(spark, d).where("n_modified <= n_valid_cov")
    netted = pileup.net_coverage(pileup.filter_pileup(rows, MIN_COVERAGE, MIN_FRACTION), "raise")
    return netted.select("row_id", "n_valid_cov")


def sequence_revcomp(spark: SparkSession, d: str) -> DataFrame:
    return assembly(spark, d).select("contig", iupac.reverse_complement(F.col("sequence")).alias("revcomp"))


def _motifs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "motifs").select("motif", "mod_type", "mod_position")


def motif_revcomp(spark: SparkSession, d: str) -> DataFrame:
    return motif_ops.reverse_complements(_motifs(spark, d))


def motif_regex(spark: SparkSession, d: str) -> DataFrame:
    return _motifs(spark, d).select("motif", "mod_type", "mod_position", iupac.regex_of(F.col("motif")).alias("regex"))


def motif_expansions(spark: SparkSession, d: str) -> DataFrame:
    return motif_ops.expansions(_motifs(spark, d))


def motif_parent_child(spark: SparkSession, d: str) -> DataFrame:
    return motif_ops.parent_child(_motifs(spark, d))


def motif_collapse(spark: SparkSession, d: str) -> DataFrame:
    return motif_ops.collapse(_motifs(spark, d))


def motif_union(spark: SparkSession, d: str) -> DataFrame:
    return motif_ops.union(_motifs(spark, d), ["mod_type", "mod_position"])


def tagged_reads(spark: SparkSession, d: str) -> DataFrame:
    """One long read per loaded contig, with tags and an alignment made from its row number.

    As in the SQL each segment has 12 calls whatever the length, so only the
    start of a read is called.
    """
    rows = spread(table(spark, d, "contigs")).select(F.col("contig_row").alias("r"), stripped(F.col("id")).alias("contig"), clean_sequence(F.col("sequence")).alias("s")).where("length(s) > 0 and contig <> ''")
    n, clip = F.length("s"), 5 + F.col("r") % 7
    skips = lambda e: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), e), ",")
    r = F.col("r")
    mm = F.concat(F.lit("A+a.,"), skips(lambda k: (r * 7 + k * 3) % 4), F.lit(";C+m.,"), skips(lambda k: (r * 5 + k) % 3), F.lit(";C+21839.,"), skips(lambda k: (r + k * 2) % 3), F.lit(";"))
    q = lambda a, b: F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: ((r * a + k * b) % 256).cast("int"))
    cigar = F.when(n >= 200, F.concat(clip, F.lit("S40M2I30="), 1 + r % 3, F.lit("D"), n - clip - 72, F.lit("M"))).otherwise(F.concat(n, F.lit("M")))
    return rows.select(
        F.concat(F.lit("read_"), r).alias("read_id"), "contig", F.when(r % 2 == 1, "-").otherwise("+").alias("strand"),
        F.when(r % 2 == 1, iupac.reverse_complement(F.col("s"))).otherwise(F.col("s")).alias("seq"), mm.alias("mm"), F.concat(q(31, 17), q(13, 29), q(11, 41)).alias("ml"),
        F.when(n >= 200, clip).otherwise(0).cast("int").alias("start"), cigar.alias("cigar"), (r % 61).cast("int").alias("mapq"),
    )


def mm_parse(spark: SparkSession, d: str) -> DataFrame:
    return tagged_reads(spark, d).select("read_id", F.inline(modtags.segment_table(F.col("mm"))))


def mm_calls(spark: SparkSession, d: str) -> DataFrame:
    return reads.read_calls(tagged_reads(spark, d))


def read_fastq_pattern(spark: SparkSession, d: str) -> DataFrame:
    return reads.read_fastq_pattern(tagged_reads(spark, d), motif_list(spark, d))


def read_bam_pattern(spark: SparkSession, d: str) -> DataFrame:
    return reads.read_bam_pattern(tagged_reads(spark, d), assembly(spark, d), motif_list(spark, d))


def read_mapping_status(spark: SparkSession, d: str) -> DataFrame:
    return read_bam_pattern(spark, d).groupBy("mapping_status", "reference_has_motif").agg(F.count("*").alias("n"))


def read_id_filter(spark: SparkSession, d: str) -> DataFrame:
    """Reads whose contig is in the pileup, by a list of read ids."""
    all_reads = tagged_reads(spark, d)
    listed = all_reads.join(table(spark, d, "pileup").select(stripped(F.col("contig")).alias("contig")).distinct(), "contig", "left_semi")
    return reads.filter_reads(all_reads, listed.select("read_id")).select("read_id", F.length("seq").alias("read_length"))


def cigar_positions(spark: SparkSession, d: str) -> DataFrame:
    return cigar_blocks(tagged_reads(spark, d))


def tag_descriptors(spark: SparkSession, d: str) -> DataFrame:
    return tags.tag_descriptors(tagged_reads(spark, d))


def tag_rename(spark: SparkSession, d: str) -> DataFrame:
    return tags.rename_tags(tagged_reads(spark, d), [parse_rename("C+21839.:h")]).select("read_id", "mm")


def tag_remove(spark: SparkSession, d: str) -> DataFrame:
    rows = tags.remove_tags(tagged_reads(spark, d), [Descriptor.parse("C+m.")])
    return rows.select("read_id", "mm", F.array_join("ml", ",").alias("ml"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Source: all calls of reverse reads; target: 6mA calls of all reads."""
    all_reads = tagged_reads(spark, d).select("read_id", "strand", "mm", "ml")
    return all_reads.where("strand = '-'"), tags.remove_tags(all_reads, [Descriptor.parse("C+m."), Descriptor.parse("C+21839.")])


def tag_overlap(spark: SparkSession, d: str) -> DataFrame:
    return tags.overlapping_tags(*_sides(spark, d))


def tag_merge(spark: SparkSession, d: str) -> DataFrame:
    source, target = _sides(spark, d)
    merged = tags.merge_tags(source, target, ignore=[Descriptor.parse("A+a.")])
    return merged.select("read_id", "mm", F.array_join("ml", ",").alias("ml"))


def result_ordering(spark: SparkSession, d: str) -> DataFrame:
    rows = _motifs(spark, d)
    return rows.select("motif", "mod_type", "mod_position", iupac.sequence_key(F.col("motif")).alias("sequence_key"), iupac.mod_rank(F.col("mod_type")).alias("mod_rank"))


def tsv_lines(spark: SparkSession, d: str) -> DataFrame:
    from strandlake.sources.formats import tsv_lines as lines

    return lines(pattern.ordered(contig_median(spark, d)))


QUERIES = {
    f.__name__: f
    for f in (
        contig_median, contig_weighted_mean, contig_raw, contig_verify_from_raw, motif_positions, motif_occurrences, pileup_filtered, pileup_netted, pileup_dedupe_last,
        pileup_query_contigs, pileup_projection, pileup_list_contigs, pileup_first_seen, pileup_missing_in_assembly, assembly_missing_in_pileup, assembly_missing_in_filtered, pileup_netted_strict, sequence_revcomp, motif_revcomp, motif_regex,
        motif_expansions, motif_parent_child, motif_collapse, motif_union, mm_parse, mm_calls, read_fastq_pattern, read_bam_pattern, read_mapping_status, read_id_filter,
        cigar_positions, tag_descriptors, tag_rename, tag_remove, tag_overlap, tag_merge, result_ordering, tsv_lines,
    )
}

# -- SQL

_CASE = lambda table, x: f"case {x} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"
_RC = lambda x: f"reverse(translate({x}, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN'))"
_CLEAN = lambda x: rf"replace(upper(regexp_replace({x}, '\s', '', 'g')), '-', 'N')"
_LIST = lambda x, body: f"list_transform(string_split({x}, ''), lambda c: {body})"
_CLASSES = {x: "[" + "".join(y for y in iupac.LETTERS if iupac.MASKS[y] & iupac.MASKS[x]) + "]" for x in iupac.LETTERS}
_BASE_SETS = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
_SHOWN = {k: "." if k == "N" else v if len(v) == 1 else f"[{v}]" for k, v in _BASE_SETS.items()}

_ASM = f"""asm as (
  select contig, {_CLEAN("sequence")} as sequence from (
    select {sql_stripped("id")} as contig, sequence, loaded_at, contig_row from contigs union all select {sql_stripped("id")}, sequence, loaded_at, 0 from control_contigs)
  where contig <> '' qualify row_number() over (partition by contig order by loaded_at desc, contig_row desc) = 1)"""
_PATS = f"""pats as materialized (
  select *, {_LIST("letters", _CASE(_CLASSES, "c"))} as cl, length(letters) as k from (
    select motif, mod_type, mod_position, '+' as strand, motif as letters, mod_position as off from motifs
    union all select motif, mod_type, mod_position, '-', {_RC("motif")}, length(motif) - mod_position - 1 from motifs))"""


def _scan(source: str, key: str, name: str, strands: str) -> str:
    """CTEs that give ``name``(key, motif, mod_type, mod_position, strand, k, s, position) for sequences of ``source``(key, sequence)."""
    return f"""{name}_kmers as materialized (
      select {key}, t0 + i as s, k, substr(piece, i + 1, k) as kmer
      from (select {key}, n, t0, piece, unnest(range(500)) as i from (
        select {key}, length(sequence) as n, t * 500 as t0, substr(sequence, t * 500 + 1, 530) as piece
        from (select {key}, sequence, unnest(range((length(sequence) + 499) // 500)) as t from {source})))
      join (select distinct k from pats where strand in ({strands})) on t0 + i + k <= n),
    {name}_known as materialized (
      select kmer, p.* from (select distinct kmer, k as kk from {name}_kmers) join (select * from pats where strand in ({strands})) p on kk = k and contains(cl[p.off + 1], kmer[p.off + 1]) and len(list_filter(range(1, kk + 1), lambda i: contains(cl[i], kmer[i]))) = kk),
    {name} as materialized (
      select {key}, motif, mod_type, mod_position, strand, x.k, s, s + off as position from {name}_kmers x join {name}_known y on x.kmer = y.kmer and x.k = y.k)"""


_POS = f"{_ASM}, {_PATS}, {_scan('asm', 'contig', 'pos', chr(39) + '+' + chr(39) + ', ' + chr(39) + '-' + chr(39))}"
_PASS = f"n_valid_cov >= {MIN_COVERAGE} and n_other_mod <= n_modified and (n_diff + n_valid_cov = 0 or cast(n_valid_cov as float) / cast(n_diff + n_valid_cov as float) >= cast({MIN_FRACTION} as float))"
_METH = f"""meth as (
  select contig, start, strand, mod_type, n_modified, n_valid_cov - n_other_mod as n_valid_cov, n_diff, n_fail from (
    select *, {sql_stripped("contig")} as c, ref_start as start from pileup where {_PASS} and n_modified <= n_valid_cov) x(row_id, run_id, raw_contig, ref_start, ref_end, mod_type, score, strand, start_pos, end_pos, color, n_valid_cov, fraction_modified, n_modified, n_canonical, n_other_mod, n_delete, n_fail, n_diff, n_no_call, called_at, loaded_at, contig, start)
  qualify row_number() over (partition by contig, start, strand, mod_type order by row_id desc) = 1)"""
_OBS = """obs as (select p.contig, m.start, p.strand, p.motif, p.mod_type, p.mod_position, n_modified, n_valid_cov, n_diff, n_fail
  from pos p join meth m on p.contig = m.contig and p.position = m.start and p.strand = m.strand and p.mod_type = m.mod_type)"""
_DEGREE = f"""with {_POS}, {_METH}, {_OBS},
  tot as (select contig, motif, mod_type, mod_position, count(*) as motif_occurences_total from pos group by all)
  select contig, motif, mod_type, mod_position, {{value}} as methylation_value, avg(n_valid_cov) as mean_read_cov, count(*) as n_motif_obs, any_value(motif_occurences_total) as motif_occurences_total
  from obs join tot using (contig, motif, mod_type, mod_position) where n_valid_cov > 0 group by contig, motif, mod_type, mod_position"""
_MEDIAN, _WMEAN = "median(n_modified / n_valid_cov)", "sum(n_modified) / sum(n_valid_cov)"

_SKIPS = lambda e: f"array_to_string(list_transform(range(12), lambda k: {e}), ',')"
_READS = f"""reads as materialized (
  select 'read_' || r as read_id, contig, case when r % 2 = 1 then '-' else '+' end as strand, case when r % 2 = 1 then {_RC("s")} else s end as sequence,
    'A+a.,' || {_SKIPS("(r * 7 + k * 3) % 4")} || ';C+m.,' || {_SKIPS("(r * 5 + k) % 3")} || ';C+21839.,' || {_SKIPS("(r + k * 2) % 3")} || ';' as mm,
    list_concat(list_concat(list_transform(range(12), lambda k: (r * 31 + k * 17) % 256), list_transform(range(12), lambda k: (r * 13 + k * 29) % 256)), list_transform(range(12), lambda k: (r * 11 + k * 41) % 256)) as ml,
    case when length(s) >= 200 then 5 + r % 7 else 0 end as start,
    case when length(s) >= 200 then (5 + r % 7) || 'S40M2I30=' || (1 + r % 3) || 'D' || (length(s) - 77 - r % 7) || 'M' else length(s) || 'M' end as cigar, r % 61 as mapq
  from (select contig_row as r, {sql_stripped("id")} as contig, {_CLEAN("sequence")} as s from contigs) where length(s) > 0 and contig <> '')"""
_SEGS = """segs as (
  select read_id, i, string_split(seg, ',')[1] as descriptor, array_to_string(string_split(seg, ',')[2:], ',') as skips, len(string_split(seg, ',')) - 1 as n
  from (select read_id, unnest(list_filter(string_split(mm, ';'), lambda x: x <> '')) as seg, generate_subscripts(list_filter(string_split(mm, ';'), lambda x: x <> ''), 1) as i from reads)),
  placed as (select *, coalesce(sum(n) over (partition by read_id order by i rows between unbounded preceding and 1 preceding), 0) as first from segs)"""
_CALLS = f"""{_SEGS},
  one as (select read_id, descriptor, first, unnest(string_split(skips, ',')) as skip, generate_subscripts(string_split(skips, ','), 1) as j from placed),
  idx as (select read_id, case descriptor when 'A+a.' then 'a' when 'C+m.' then 'm' else '21839' end as mod_type, left(descriptor, 1) as base, first + j as q,
    sum(cast(skip as int)) over (partition by read_id, descriptor order by j) + j as nth from one),
  bases as (select read_id, b as base, p, row_number() over (partition by read_id, b order by p) as nth
    from (select read_id, unnest(string_split(sequence, '')) as b, generate_subscripts(string_split(sequence, ''), 1) - 1 as p from reads) where b in ('A', 'C')),
  called as (select i.read_id, p as position, mod_type, ml[cast(q as bigint)] as quality from idx i join bases b on i.read_id = b.read_id and i.base = b.base and i.nth = b.nth join reads r on r.read_id = i.read_id),
  calls as (select read_id, position, max_by(mod_type, quality) as mod_type, max(quality) as quality from
    (select *, max(quality) over (partition by read_id, position) as best from called) where quality = best group by read_id, position having count(*) = 1)"""
_OPS = """ops as (
  select read_id, start, j, cast(regexp_extract(o, '[0-9]+') as int) as n, right(o, 1) as op
  from (select read_id, start, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) as o, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), 1) as j from reads)),
  blocks as materialized (select read_id, cast(r as int) as read_from, cast(g as int) as ref_from, n as length from (
    select *, coalesce(sum(case when op in ('M', '=', 'X', 'I', 'S') then n else 0 end) over w, 0) as r, start + coalesce(sum(case when op in ('M', '=', 'X', 'D', 'N') then n else 0 end) over w, 0) as g
    from ops window w as (partition by read_id order by j rows between unbounded preceding and 1 preceding)) where op in ('M', '=', 'X'))"""
_HITS = f"{_PATS}, {_READS}, {_scan('reads', 'read_id', 'hits', chr(39) + '+' + chr(39))}, {_CALLS}"
_BAM = f"""with {_ASM}, {_HITS}, {_scan("asm", "contig", "own", chr(39) + "+" + chr(39) + ", " + chr(39) + "-" + chr(39))}, {_OPS},
  h as (select row_number() over () as id, r.*, length(r.sequence) as n, x.motif, x.mod_type, x.mod_position, x.k, x.position,
    case when r.strand = '-' then length(r.sequence) - x.position - 1 else x.position end as original from hits x join reads r on x.read_id = r.read_id where r.contig in (select contig from asm)),
  g as (select h.id, ref_from + original - read_from as ref from h join blocks b on h.read_id = b.read_id and original >= read_from and original < read_from + b.length),
  win as (select id, read_id, original - mod_position + unnest(range(k)) as p from h),
  seen as (select w.id, count(*) as m, max(ref_from + p - read_from) - min(ref_from + p - read_from) + 1 as span from win w join blocks b on w.read_id = b.read_id and p >= read_from and p < read_from + b.length group by w.id)
  select h.contig as contig_id, cast(coalesce(g.ref, -1) as int) as start_contig, o.contig is not null as reference_has_motif, h.strand, h.read_id, cast(h.n as int) as read_length, cast(h.mapq as int) as mapping_quality,
    cast(h.position as int) as start_read, h.motif, h.mod_type, cast(h.mod_position as varchar) as mod_position, cast(coalesce(c.quality, 0) as int) as basecall_quality,
    case when g.ref is null then 'unmapped' when coalesce(m, 0) < h.k then 'partial' when span = h.k then 'complete' else 'gapped' end as mapping_status
  from h left join g on h.id = g.id left join seen on h.id = seen.id left join calls c on h.read_id = c.read_id and h.position = c.position
  left join own o on o.contig = h.contig and o.motif = h.motif and o.mod_type = h.mod_type and o.mod_position = h.mod_position and o.strand = h.strand and o.position = g.ref"""
_KEPT = lambda keep: f"""select read_id, array_to_string(list_transform(list_filter(l, lambda s: {keep.format('s.d')}), lambda s: s.d || ',' || s.v), ';') || ';' as mm,
  array_to_string(flatten(list_transform(list_filter(l, lambda s: {keep.format('s.d')}), lambda s: ml[s.f + 1 : s.f + s.n])), ',') as ml
  from (select p.read_id, any_value(ml) as ml, list({{d: descriptor, v: skips, f: first, n: n}} order by i) as l from placed p join reads r on p.read_id = r.read_id group by p.read_id)"""  # noqa: E731
_NUMBERED = f"select motif, mod_type, mod_position, row_number() over () as i, list_product(list_transform(string_split(motif, ''), lambda c: length({_CASE(_BASE_SETS, 'c')}))) as e from motifs"
_HOLDS = lambda p, c: f"""{p}.mod_type = {c}.mod_type and {c}.mod_position >= {p}.mod_position and {c}.mod_position - {p}.mod_position + length({p}.motif) <= length({c}.motif)
  and regexp_full_match(substr({c}.motif, {c}.mod_position - {p}.mod_position + 1, length({p}.motif)), array_to_string({_LIST(p + ".motif", _CASE(_CLASSES, "c"))}, ''))"""  # noqa: E731
_SORTED = {v: k for k, v in _BASE_SETS.items()}

_ASKED = f"(select unnest([{', '.join(repr(x) for x in REQUEST)}]) as q)"
_SHOWN_COLUMNS = {"contig": "q as contig", "start": "ref_start as start", "end": 'ref_end as "end"', "fraction_modified": "case when not isnan(fraction_modified) then fraction_modified end as fraction_modified"}

ORACLE = {
    "contig_median": _DEGREE.format(value=_MEDIAN),
    "contig_weighted_mean": _DEGREE.format(value=_WMEAN),
    "contig_raw": f"with {_POS}, {_METH}, {_OBS} select * from obs",
    "contig_verify_from_raw": f"with {_POS}, {_METH}, {_OBS} select contig, motif, mod_type, mod_position, {_MEDIAN} as median, {_WMEAN} as weighted_mean, avg(n_valid_cov) as mean_read_cov, count(*) as n_motif_obs from obs where n_valid_cov > 0 group by all",
    "motif_positions": f"with {_POS} select contig, strand, position, motif, mod_type, mod_position from pos",
    "motif_occurrences": f"with {_POS} select contig, strand, motif, mod_type, mod_position, count(*) as n_occurrences from pos group by all",
    "pileup_filtered": f"select row_id from pileup where {_PASS}",
    "pileup_netted": f"select row_id, n_modified, n_valid_cov - n_other_mod as n_valid_cov, case when n_valid_cov = n_other_mod then null else n_modified / (n_valid_cov - n_other_mod) end as fraction from pileup where {_PASS} and n_modified <= n_valid_cov",
    "pileup_dedupe_last": f"with {_METH} select * from meth",
    "pileup_query_contigs": f"""select {', '.join(_SHOWN_COLUMNS.get(c, c) for c in pileup.COLUMNS)}, coalesce(isnan(fraction_modified), false) as fraction_is_nan
      from pileup join {_ASKED} on {sql_stripped("contig")} = q""",
    "pileup_projection": f"select q as contig, ref_start as start, score from pileup join {_ASKED} on {sql_stripped('contig')} = q",
    "pileup_list_contigs": f"select distinct {sql_stripped('contig')} as contig from pileup",
    "pileup_first_seen": f"select {sql_stripped('contig')} as contig, min(row_id) as first_seen from pileup group by 1",
    "pileup_missing_in_assembly": f"with {_ASM} select distinct {sql_stripped('contig')} as contig from pileup where contig is not null and {sql_stripped('contig')} not in (select contig from asm)",
    "assembly_missing_in_pileup": f"with {_ASM} select contig from asm where contig not in (select {sql_stripped('contig')} from pileup where contig is not null)",
    "assembly_missing_in_filtered": f"with {_ASM}, {_METH} select contig from asm where contig not in (select contig from meth where contig is not null)",
    "pileup_netted_strict": f"select row_id, n_valid_cov - n_other_mod as n_valid_cov from pileup where {_PASS} and n_modified <= n_valid_cov",
    "sequence_revcomp": f"with {_ASM} select contig, {_RC('sequence')} as revcomp from asm",
    "motif_revcomp": f"select {_RC('motif')} as motif, mod_type, length(motif) - mod_position - 1 as mod_position from motifs",
    "motif_regex": f"select motif, mod_type, mod_position, array_to_string({_LIST('motif', _CASE(_SHOWN, 'c'))}, '') as regex from motifs",
    "motif_expansions": f"""with recursive g as (
      select motif, mod_type, mod_position, '' as dna from motifs
      union all select motif, mod_type, mod_position, dna || b from (select *, unnest(string_split({_CASE(_BASE_SETS, "substr(motif, length(dna) + 1, 1)")}, '')) as b from g where length(dna) < length(motif)))
      select motif, mod_type, mod_position, dna from g where length(dna) = length(motif)""",
    "motif_parent_child": f"select a.motif as parent, b.motif as child, a.mod_type, a.mod_position as parent_position, b.mod_position as child_position from motifs a join motifs b on (a.motif <> b.motif or a.mod_position <> b.mod_position) and {_HOLDS('a', 'b')}",
    "motif_collapse": f"""with m as materialized ({_NUMBERED}),
      v as (select unnest([case when length(a.motif) > length(b.motif) or (length(a.motif) = length(b.motif) and a.e <= b.e) then a else b end]) as x from m a join m b on a.i < b.i and (({_HOLDS("a", "b")}) or ({_HOLDS("b", "a")})))
      select motif, mod_type, mod_position from m where (motif, mod_type, mod_position) not in (select (x.motif, x.mod_type, x.mod_position) from v)""",
    "motif_union": f"""with l as (select mod_type, mod_position, length(motif) as length, unnest(string_split(motif, '')) as c, generate_subscripts(string_split(motif, ''), 1) as i from motifs),
      u as (select mod_type, mod_position, length, i, string_agg(distinct b, '' order by b) as s from (select *, unnest(string_split({_CASE(_BASE_SETS, "c")}, '')) as b from l) group by all)
      select mod_type, mod_position, length, string_agg({_CASE(_SORTED, "s")}, '' order by i) as motif from u group by all""",
    "mm_parse": f"with {_READS}, {_SEGS} select read_id, descriptor, skips, cast(first as int) as first from placed",
    "mm_calls": f"with {_READS}, {_CALLS} select read_id, position, mod_type, quality from calls",
    "read_fastq_pattern": f"""with {_HITS} select h.read_id, h.position as start, length(r.sequence) as read_length, h.motif as motif_seq, h.mod_type, h.mod_position as mod_pos, coalesce(c.quality, 0) as quality
      from hits h join reads r on h.read_id = r.read_id left join calls c on h.read_id = c.read_id and h.position = c.position""",
    "read_bam_pattern": _BAM,
    "read_mapping_status": f"select mapping_status, reference_has_motif, count(*) as n from ({_BAM}) group by all",
    "read_id_filter": f"with {_READS} select read_id, length(sequence) as read_length from reads where contig in (select {sql_stripped('contig')} from pileup)",
    "cigar_positions": f"with {_READS}, {_OPS} select * from blocks",
    "tag_descriptors": f"with {_READS}, {_SEGS} select distinct descriptor from segs",
    "tag_rename": f"with {_READS} select read_id, replace(mm, 'C+21839.,', 'C+h.,') as mm from reads",
    "tag_remove": f"with {_READS}, {_SEGS} {_KEPT(chr(123) + chr(125) + ' <> ' + chr(39) + 'C+m.' + chr(39))}",
    "tag_overlap": f"with {_READS}, {_SEGS} select distinct descriptor from segs where descriptor = 'A+a.' and read_id in (select read_id from reads where strand = '-')",
    "tag_merge": f"""with {_READS}, {_SEGS}, a as ({_KEPT("{} = 'A+a.'")}), b as ({_KEPT("{} <> 'A+a.'")})
      select a.read_id, a.mm || case when strand = '-' then b.mm else '' end as mm, a.ml || case when strand = '-' then ',' || b.ml else '' end as ml from a join b on a.read_id = b.read_id join reads r on r.read_id = a.read_id""",
    "result_ordering": "select motif, mod_type, mod_position, translate(motif, 'ACGTRYSWKMBDHVN', 'ABCDEFGHIJKLMNO') as sequence_key, case mod_type when 'a' then 0 when 'm' then 1 else 2 end as mod_rank from motifs",
}
