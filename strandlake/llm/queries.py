"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.text import sql_stripped, stripped
from strandlake.llm import mixing, packing, percentiles, reading, split
from strandlake.llm.tokens import n_tokens
from strandlake.session import spread


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Tokenizing and scoring cost far more than moving the texts, so a table in few pieces is spread over all cores."""
    return spread(_table(spark, folder, "documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split.split_long(_table(spark, d, "contigs"), "contig_row", "sequence", with_text=False)
    return pieces.select("contig_row", F.explode("stretch_starts").alias("stretch_start"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_long(_table(spark, d, "contigs"), "contig_row", "sequence")


GROUPS = ["src_table", "group_key", "mod_type"]
PERCENTS = [1, 50, 90, 99]
MAX_UINT = 4294967295


def _states(spark: SparkSession, d: str, by_day: bool) -> list[DataFrame]:
    pileup, medians = _table(spark, d, "pileup"), _table(spark, d, "motif_medians")
    day = (lambda c: F.to_date(c)) if by_day else (lambda c: None)
    return [
        percentiles.frequencies(
            pileup, {"src_table": F.lit("pileup"), "group_key": stripped(F.col("contig")), "mod_type": F.col("mod_type")},
            {"fraction_modified": percentiles.Measure(F.col("fraction_modified"), 0, 100), "n_valid_cov": percentiles.Measure(F.col("n_valid_cov"), 0, MAX_UINT)}, day(F.col("called_at")),
        ),
        percentiles.frequencies(
            medians, {"src_table": F.lit("motif_medians"), "group_key": F.col("motif"), "mod_type": F.col("mod_type")},
            {"median": percentiles.Measure(F.col("median"), 0, 1)}, day(F.col("computed_on")),
        ),
    ]


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    a, b = _states(spark, d, by_day=False)
    return percentiles.percentiles(a.unionByName(b), GROUPS, PERCENTS)


def p4_from_days(spark: SparkSession, d: str) -> DataFrame:
    """The same from states of single days, computed apart and merged."""
    return percentiles.percentiles(percentiles.merge(_states(spark, d, by_day=True), GROUPS), GROUPS, PERCENTS)


def _packed(spark: SparkSession, d: str, numbered: bool = False) -> DataFrame:
    return packing.pack(_documents(spark, d), "doc_id", n_tokens(F.col("text")), numbered=numbered)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose pieces lie in more than one container."""
    per = _packed(spark, d, numbered=True).groupBy("item_no").agg(F.max("doc_id").alias("doc_id"), F.min("container_id").alias("a"), F.max("container_id").alias("b"))
    return per.where("a < b").select("doc_id")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


def _mixed(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.mix(_documents(spark, d), _table(spark, d, "mix_targets"), "doc_id", "source", "lang", n_tokens(F.col("text")))


def p6_violations(spark: SparkSession, d: str) -> DataFrame:
    """What must not be: containers over their capacity, documents whose pieces don't add up to their tokens, containers left empty between others."""
    packed = _packed(spark, d, numbered=True)
    per = packed.groupBy("container_id").agg(F.sum("piece_size").alias("s")).where(F.col("s") > packing.CAPACITY)
    over = per.select(F.lit("over capacity").alias("problem"), F.col("container_id").alias("id"), F.col("s").alias("size"))
    whole = packed.groupBy("doc_id").agg(F.sum("piece_size").alias("s"))
    sizes = _documents(spark, d).select(F.col("doc_id").alias("_id"), n_tokens(F.col("text")).alias("n")).groupBy("_id").agg(F.sum("n").alias("n"))
    lost = whole.join(sizes, F.col("doc_id").eqNullSafe(F.col("_id")), "full").where(~F.col("s").eqNullSafe(F.col("n"))).select(F.lit("not whole"), F.coalesce("doc_id", "_id"), F.coalesce("s", F.lit(-1)))
    unused = packed.agg(F.count_distinct("container_id").alias("n"), F.coalesce(F.max("container_id") + 1, F.lit(0)).alias("m")).where("n <> m").select(F.lit("unused containers"), F.col("m"), F.col("n"))
    return over.union(lost).union(unused)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).shares.where("not reachable").select("source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).shares


def p7_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Budget and taken size of each source in each language."""
    return _mixed(spark, d).leaves


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).uses


def p7_violations(spark: SparkSession, d: str) -> DataFrame:
    """What must not be: documents used too often or more than once listed, uses of no target's document, leaves over their limit or far from their budget."""
    mixed, docs = _mixed(spark, d), _table(spark, d, "documents")
    own = docs.select(F.col("doc_id").alias("_id"), F.lower(stripped(F.col("source"))).alias("_own"), F.length("text").alias("_most"))
    limits = F.broadcast(_table(spark, d, "mix_targets").select(F.col("source").alias("_target"), "max_uses"))
    used = mixed.uses.join(own, F.col("doc_id") == F.col("_id"), "left").join(limits, F.col("source") == F.col("_target"), "left")
    wrong = used.where("_id is null or _target is null or source <> _own or n_uses > max_uses or n_uses < 1 or size > 4 * _most").select(F.lit("use").alias("problem"), F.col("doc_id").cast("string").alias("id"))
    twice = mixed.uses.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("listed twice"), F.col("doc_id").cast("string"))
    # a prefix ends at the document nearest to the budget, so it is off by half a document at most
    longest = _documents(spark, d).select(F.lower(stripped(F.col("source"))).alias("_s"), n_tokens(F.col("text")).alias("n")).groupBy("_s").agg(F.max("n").alias("longest"))
    leaf = mixed.leaves.join(longest, F.col("source") == F.col("_s"), "left").where("taken > most or 2 * abs(taken - budget) > coalesce(longest, 0) + 2").select(F.lit("leaf"), F.concat_ws("/", *mixing.LEAF))
    return wrong.union(twice).union(leaf)


def _levels(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    model = reading.fit_tables(_table(spark, d, "documents"), _table(spark, d, "reading_labels"), _table(spark, d, "level_anchors"))
    return reading.reading_levels(docs, "doc_id", "text", model)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).where("reading_level >= 4").select("doc_id")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d)


def p8_violations(spark: SparkSession, d: str) -> DataFrame:
    """What must not be: documents without a row or with two, levels outside the scale or missing where there are words, words that a text can't have."""
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("_id"), F.coalesce(F.length("text"), F.lit(0)).alias("_most"))
    both = _levels(spark, d).join(docs, F.col("doc_id") == F.col("_id"), "full")
    good = F.col("_id").isNotNull() & F.col("doc_id").isNotNull() & (F.col("n_words") <= F.col("_most")) & (F.col("n_sentences") <= F.col("n_words"))
    good &= (F.col("reading_level").isNull() == (F.col("n_words") == 0)) & F.coalesce(F.col("reading_level").between(1, 5) & F.col("difficulty").between(1, 5), F.col("n_words") == 0)
    return both.where(~F.coalesce(good, F.lit(False))).select(F.coalesce("doc_id", "_id").alias("doc_id"))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_pieces, p4_percentiles, p4_from_days, p6_found, p6_containers, p6_fill, p6_violations, p7_found, p7_shares, p7_leaves, p7_mix, p7_violations, p8_found, p8_levels, p8_violations,
    )
}

_BASES = r"select contig_row, regexp_replace(sequence, '\s', '', 'g') as b from contigs"
_END = "coalesce(list_max(list_filter(ends, lambda x: x > {at} and x <= {at} + 10000)), {at} + 10000)"
_P4 = f"""
  with v as (
    select 'pileup' as src_table, {sql_stripped("contig")} as group_key, mod_type, 'fraction_modified' as measure, fraction_modified as v from pileup where not isnan(fraction_modified) and fraction_modified between 0 and 100
    union all select 'pileup', {sql_stripped("contig")}, mod_type, 'n_valid_cov', n_valid_cov from pileup where n_valid_cov between 0 and {MAX_UINT}
    union all select 'motif_medians', motif, mod_type, 'median', median from motif_medians where not isnan(median) and median between 0 and 1
  ),
  r as (select *, row_number() over (partition by src_table, group_key, mod_type, measure order by v) as i, count(*) over (partition by src_table, group_key, mod_type, measure) as n from v)
  select src_table, group_key, mod_type, measure, max(n) as n_values, {", ".join(f"max(v) filter (where i = (n * {p} + 99) // 100) as p{p:02d}" for p in PERCENTS)}
  from r group by src_table, group_key, mod_type, measure
"""

ORACLE = {
    "p2_found": f"""
      with s as (select contig_row, string_split_regex(b, '[Nn-]{{20,}}') as parts, regexp_extract_all(b, '[Nn-]{{20,}}') as gaps from ({_BASES}) where length(b) > 10000),
      t as (select contig_row, list_transform(parts, lambda x: length(x)) as a, list_transform(gaps, lambda x: length(x)) as g, unnest(generate_series(1, len(parts))) as i from s)
      select contig_row, cast(coalesce(list_sum(a[1 : i - 1]), 0) + coalesce(list_sum(g[1 : i - 1]), 0) as bigint) as stretch_start from t where a[i] > 0""",
    # stretches as lists of starts and ends; a piece ends at the last end within the limit, else at the limit, and the next steps back by the overlap
    "p2_pieces": f"""
      with recursive s as materialized (select contig_row, b, string_split_regex(b, '[Nn-]{{20,}}') as parts, regexp_extract_all(b, '[Nn-]{{20,}}') as gaps from ({_BASES}) where length(b) > 10000),
      t as (select contig_row, list_transform(parts, lambda x: length(x)) as a, list_transform(gaps, lambda x: length(x)) as g, unnest(generate_series(1, len(parts))) as i from s),
      e as (select contig_row, cast(coalesce(list_sum(a[1 : i - 1]), 0) + coalesce(list_sum(g[1 : i - 1]), 0) as bigint) as x, a[i] as n from t where a[i] > 0),
      l as materialized (select contig_row, list(x order by x) as starts, list(x + n order by x) as ends from e group by contig_row),
      p as (
        select contig_row, 0 as piece_no, starts[1] as piece_start, {_END.format(at="starts[1]")} as piece_end, starts, ends from l
        union all
        select contig_row, piece_no + 1, next, {_END.format(at="next")}, starts, ends from (
          select *, case when list_contains(ends, piece_end) then list_min(list_filter(starts, lambda x: x > piece_start and x >= piece_end)) else piece_end - 200 end as next from p) where next is not null)
      select p.contig_row, cast(piece_no as int) as piece_no, piece_start, piece_end, list_filter(starts, lambda x: x >= piece_start and x < piece_end and (piece_no = 0 or x > prev or prev is null)) as stretch_starts,
        substr(b, piece_start + 1, piece_end - piece_start) as bases
      from (select *, lag(piece_end) over (partition by contig_row order by piece_no) - 1 as prev from p) p join s on p.contig_row = s.contig_row""",
    "p4_percentiles": _P4,
    "p4_from_days": _P4,
    # of these the operators may leave none
    "p6_violations": "select cast(null as varchar) as problem, cast(null as bigint) as id, cast(null as bigint) as size where false",
    "p7_violations": "select cast(null as varchar) as problem, cast(null as varchar) as id where false",
    "p8_violations": "select cast(null as bigint) as doc_id where false",
}
