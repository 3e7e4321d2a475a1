"""Queries of the general data-quality operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.text import sql_stripped, stripped
from strandlake.operators.heavy_keys import balanced_key_stats, heavy_keys
from strandlake.operators.orphans import References, orphan_references, orphan_report, parent_lifetimes
from strandlake.operators.rejects import FIELDS, INTEGERS, Loaded, load_pileup_lines
from strandlake.plans.tables import table


def _loaded(spark: SparkSession, d: str) -> Loaded:
    return load_pileup_lines(table(spark, d, "pileup_lines"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d).rejects.select("line_id")


def p1_rejects(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d).rejects.select("line_id", "reason")


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d).records


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    tables = [
        References("pileup", table(spark, d, "pileup"), F.col("row_id"), F.col("contig"), F.col("loaded_at")),
        References("mappings", table(spark, d, "mappings"), F.col("mapping_id"), F.col("contig_id"), F.col("loaded_at")),
    ]
    return orphan_references(tables, parent_lifetimes([table(spark, d, "contigs"), table(spark, d, "control_contigs")]))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "row_key")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


def _key_stats(spark: SparkSession, d: str) -> DataFrame:
    pileup = table(spark, d, "pileup").select(F.lit("pileup").alias("t"), stripped(F.col("contig")).alias("k"), F.col("ref_start").alias("p"), F.col("n_valid_cov").alias("c"), F.col("n_modified").alias("v"), F.col("row_id").alias("i"))
    placed = F.when(F.col("start_contig") >= 0, F.col("start_contig").cast("long"))
    mappings = table(spark, d, "mappings").select(F.lit("mappings").alias("t"), stripped(F.col("contig_id")).alias("k"), placed.alias("p"), F.col("read_length").alias("c"), F.col("basecall_quality").cast("long").alias("v"), F.col("mapping_id").alias("i"))
    c = F.col
    return balanced_key_stats(pileup.unionByName(mappings), {"src_table": c("t"), "contig_key": c("k")}, c("p"), c("c"), c("v"), tie=c("i"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(_key_stats(spark, d), ["src_table"], "contig_key", parts=50).select("src_table", "contig_key")


def p5_contig_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per table and stripped contig: counts, sums and coverage of positions (pileup: ``ref_start``; mappings: ``start_contig``)."""
    return _key_stats(spark, d)


QUERIES = {f.__name__: f for f in (p1_found, p1_rejects, p1_records, p3_found, p3_report, p5_found, p5_contig_stats)}

_QUOTED = r'"(?:[^"]|"")*"'
_FIELD = rf'(?:{_QUOTED}|[^"\t]*)'
_TRIMMED = r"trim(line, ' ' || chr(9) || chr(10) || chr(13))"
_LINES = f"select line_id, {_TRIMMED} as l from pileup_lines"
_MEANT = "l <> '' and not starts_with(l, '#') and not starts_with(l, 'track') and not starts_with(l, 'browser')"
_SPLIT = f"""
  select line_id, l, regexp_full_match(l, '(?s){_FIELD}(?:\t{_FIELD})*') as quoted_well,
    list_transform(regexp_extract_all(l, '(?s)(?:^|\t)({_FIELD})', 1), lambda x: case when starts_with(x, '"') then replace(substr(x, 2, length(x) - 2), '""', '"') else x end) as f
  from ({_LINES}) where {_MEANT}
"""
_INT_AT = [FIELDS.index(f) + 1 for f in INTEGERS]
_UINT = "regexp_full_match(f[{i}], '0*[0-9]{{1,10}}') and coalesce(try_cast(f[{i}] as hugeint), 5000000000) <= 4294967295"
_BAD = " or ".join(f"not ({_UINT.format(i=i)})" for i in _INT_AT)
_AT = {f: f"f[{i + 1}]" for i, f in enumerate(FIELDS)}
_REASON = f"""case when not quoted_well then 'quoting' when len(f) <> 18 then 'columns' when {_AT["contig"]} = '' then 'contig'
  when {_AT["mod_type"]} not in ('a', 'm', '21839') then 'mod_type' when {_AT["strand"]} not in ('+', '-') then 'strand'
  when not regexp_full_match({_AT["fraction_modified"]}, '[0-9]+([.][0-9]+)?') or try_cast({_AT["fraction_modified"]} as decimal(38, 20)) > 100 then 'fraction'
  when {_BAD} then 'integer' when cast({_AT["n_modified"]} as hugeint) > cast({_AT["n_valid_cov"]} as hugeint) then 'modified_over_coverage' end"""
_JUDGED = f"select line_id, f, {_REASON} as reason from ({_SPLIT})"

_PARENTS = f"select {sql_stripped('id')} as id, loaded_at, removed_at from contigs union all select {sql_stripped('id')}, loaded_at, removed_at from control_contigs"
_REFS = f"""
  select 'pileup' as src_table, row_id as row_key, {sql_stripped("contig")} as k, loaded_at as t from pileup
  union all select 'mappings', mapping_id, {sql_stripped("contig_id")}, loaded_at from mappings
"""
_DEAD = f"""
  with p as ({_PARENTS}), r as ({_REFS})
  select r.*, not exists (select 1 from p where p.id = r.k) as missing, t < (select min(loaded_at) from p where p.id = r.k) as early
  from r where k <> '' and not exists (select 1 from p where p.id = r.k and p.loaded_at <= r.t and (p.removed_at is null or r.t < p.removed_at))
"""
_KEYED = f"""
  select 'pileup' as src_table, {sql_stripped("contig")} as contig_key, ref_start as p, n_valid_cov as c, n_modified as v from pileup
  union all select 'mappings', {sql_stripped("contig_id")}, case when start_contig >= 0 then start_contig end, read_length, basecall_quality from mappings
"""

ORACLE = {
    "p1_found": f"select line_id from ({_JUDGED}) where reason is not null",
    "p1_rejects": f"select line_id, reason from ({_JUDGED}) where reason is not null",
    "p1_records": f"select line_id, {', '.join(f'cast({_AT[f]} as bigint) as {f}' if f in INTEGERS else f'cast({_AT[f]} as double) as {f}' if f == 'fraction_modified' else f'{_AT[f]} as {f}' for f in FIELDS)} from ({_JUDGED}) where reason is null",
    "p3_found": f"select src_table, row_key from ({_DEAD})",
    "p3_report": f"select src_table, strftime(t, '%Y-%m') as month, case when missing then 'missing' when early then 'loaded_later' else 'removed' end as reason, count(*) as n_orphans, count(distinct k) as n_keys from ({_DEAD}) group by all",
    "p5_found": f"""
      with k as ({_KEYED}), n as (select src_table, count(*) as total from k group by all)
      select src_table, contig_key from k join n using (src_table) where contig_key <> '' group by src_table, contig_key, total having count(*) * 50 >= total""",
    "p5_contig_stats": f"""
      with k as ({_KEYED}),
      a as (select src_table, contig_key, count(*) as n_rows, cast(sum(coalesce(c, 0)) as bigint) as sum_cov, cast(sum(coalesce(v, 0)) as bigint) as sum_value, max(c) as max_cov from k group by all),
      q as (select src_table, contig_key, p, p - lag(p) over (partition by src_table, contig_key order by p) as step from (select distinct src_table, contig_key, p from k where p is not null)),
      b as (select src_table, contig_key, count(*) as n_positions, count(*) filter (where step is null or step > 1) as n_islands, coalesce(max(step - 1), 0) as max_gap, min(p) as first_pos, max(p) as last_pos from q group by all)
      select a.*, coalesce(n_positions, 0) as n_positions, coalesce(n_islands, 0) as n_islands, coalesce(max_gap, 0) as max_gap, first_pos, last_pos
      from a left join b on a.src_table = b.src_table and a.contig_key is not distinct from b.contig_key""",
}
