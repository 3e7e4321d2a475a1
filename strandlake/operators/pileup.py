"""Pileup rows: filters, netting, last-wins, queries by contig, checks against the assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.iupac import MOD_TYPES
from strandlake.functions.text import WHITESPACE, stripped

#: The columns of a pileup, in order.
COLUMNS = (
    "contig", "start", "end", "mod_type", "score", "strand", "start_pos", "end_pos", "color", "n_valid_cov",
    "fraction_modified", "n_modified", "n_canonical", "n_other_mod", "n_delete", "n_fail", "n_diff", "n_no_call",
)
_TEXT = ("contig", "mod_type", "strand", "color")
SCHEMA = ", ".join(f"`{c}` {'string' if c in _TEXT else 'double' if c == 'fraction_modified' else 'bigint'}" for c in COLUMNS)
KEY = ("contig", "start", "strand", "mod_type")


class PileupError(ValueError):
    """Pileup and assembly don't fit each other, or a request can't be met."""


def mean_filters(min_coverage: int, min_fraction: float) -> Column:
    """Rows that count: enough coverage, no other modification in the lead, not mostly differences.

    The coverage is the one before netting. The difference fraction is compared
    in single precision, and 0 of 0 is kept.
    """
    valid, diff = F.col("n_valid_cov"), F.col("n_diff")
    share = F.try_divide(valid.cast("float"), (diff + valid).cast("float")).cast("float")
    return (valid >= min_coverage) & (F.col("n_other_mod") <= F.col("n_modified")) & F.coalesce(share >= F.lit(float(min_fraction)).cast("float"), (diff + valid) == 0)


def filter_pileup(pileup: DataFrame, min_coverage: int = 3, min_fraction: float = 0.8) -> DataFrame:
    """Rows passing ``mean_filters``; rows with null counts don't pass."""
    return pileup.where(mean_filters(min_coverage, min_fraction))


def net_coverage(pileup: DataFrame, on_error: str = "raise") -> DataFrame:
    """Subtract other modifications from the valid coverage.

    A row with more modified than valid reads is an error: ``raise`` fails the
    query, ``drop`` leaves the row out.
    """
    bad = F.col("n_modified") > F.col("n_valid_cov")
    if on_error == "drop":
        pileup = pileup.where(~bad)
        valid = F.col("n_valid_cov")
    else:
        text = F.concat(F.lit("Invalid coverage: n_valid_cov ("), F.col("n_valid_cov"), F.lit(") cannot be less than n_modified ("), F.col("n_modified"), F.lit(")"))
        valid = F.when(bad, F.raise_error(text).cast("bigint")).otherwise(F.col("n_valid_cov"))
    return pileup.withColumn("n_valid_cov", valid - F.col("n_other_mod"))


def check_mod_types(pileup: DataFrame) -> DataFrame:
    """Fail the query on an unknown modification code."""
    text = F.concat(F.lit("Unsupported mod type: "), F.coalesce("mod_type", F.lit("null")))
    return pileup.withColumn("mod_type", F.when(F.col("mod_type").isin(*MOD_TYPES), F.col("mod_type")).otherwise(F.raise_error(text).cast("string")))


def methylation(pileup: DataFrame, min_coverage: int = 3, min_fraction: float = 0.8, on_error: str = "raise", order: str | None = None, filtered: bool = True) -> DataFrame:
    """Netted positions: ``contig, start, strand, mod_type, n_modified, n_valid_cov, n_diff, n_fail`` and ``order`` if given; without ``filtered`` of all rows."""
    kept = net_coverage(filter_pileup(pileup, min_coverage, min_fraction) if filtered else pileup, on_error)
    return kept.select(stripped(F.col("contig")).alias("contig"), "start", "strand", "mod_type", "n_modified", "n_valid_cov", "n_diff", "n_fail", *([F.col(order).alias("_order")] if order else []))


def last_wins(rows: DataFrame, key: list[str] | tuple[str, ...], order: str = "_order") -> DataFrame:
    """Of rows with one key, the one with the greatest ``order``."""
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))
    return rows.withColumn("_newest", newest).where("_newest = 1").drop("_newest", order)


def fraction(modified: Column, valid: Column) -> Column:
    """Share of modified reads; null without reads."""
    return F.try_divide(modified.cast("double"), valid.cast("double"))


def _name(column: str, exact: bool) -> Column:
    return F.col(column) if exact else stripped(F.col(column))


def list_contigs(pileup: DataFrame, exact: bool = False, order: str | None = None) -> DataFrame:
    """Distinct stripped contigs; with ``exact`` the names as they stand. With ``order``, the column of the file order, as first seen: ``contig, first_seen``."""
    named = pileup.select(_name("contig", exact).alias("contig"), *([F.col(order).alias("_at")] if order else []))
    return named.groupBy("contig").agg(F.min("_at").alias("first_seen")).orderBy("first_seen") if order else named.distinct()


def query_contigs(pileup: DataFrame, contigs: list[str], columns: list[str] | None = None, order: str | None = None, exact: bool = False) -> DataFrame:
    """Rows of the requested contigs, in the order of the request.

    Contigs are stripped on both sides; with ``exact`` only rows whose raw
    name is the requested one are found. A contig requested twice gives its
    rows twice; an unknown one is an error. Only the requested columns are
    read. ``order``: column of the file order.
    """
    wanted = list(columns or COLUMNS)
    unknown = [c for c in wanted if c not in COLUMNS]
    if unknown:
        raise PileupError(f"unknown pileup columns: {unknown}")
    if not exact:
        contigs = [c.strip(WHITESPACE) for c in contigs]
    asked = sorted(set(contigs))
    rows = (pileup if exact else pileup.withColumn("contig", stripped(F.col("contig")))).where(F.col("contig").isin(asked))
    if asked:
        missing = set(asked) - {r[0] for r in rows.select("contig").distinct().collect()}
        if missing:
            raise PileupError(f"contigs not in the pileup: {sorted(missing)}")
    order_col = F.col(order) if order else F.monotonically_increasing_id()
    at = pileup.sparkSession.createDataFrame([(c, i) for i, c in enumerate(contigs)], "_contig string, _request int")
    found = rows.withColumn("_file", order_col).join(F.broadcast(at), F.col("contig") == F.col("_contig"))
    return found.orderBy("_request", "_file").select(*wanted)


def not_in(left: DataFrame, right: DataFrame, key: str = "contig", other: str = "contig", exact: bool = False) -> DataFrame:
    """Distinct stripped keys of ``left`` that ``right`` doesn't have; with ``exact`` both are compared as they stand."""
    return left.select(_name(key, exact).alias(key)).where(F.col(key).isNotNull()).distinct().join(right.select(_name(other, exact).alias(key)).distinct(), key, "left_anti")


def beyond_end(pileup: DataFrame, assembly: DataFrame) -> DataFrame:
    """``contig, length, last_start`` of contigs with a row that starts at or behind the end of their sequence; of each only the greatest start moves."""
    lengths = assembly.select(stripped(F.col("contig")).alias("contig"), F.coalesce(F.length("sequence"), F.lit(0)).alias("length"))
    last = pileup.groupBy(stripped(F.col("contig")).alias("contig")).agg(F.max("start").alias("last_start"))
    return last.join(lengths, "contig").where("last_start >= length").select("contig", "length", "last_start")


def check_contigs(pileup: DataFrame, assembly: DataFrame, kind: str, allow_mismatch: bool) -> None:
    """The check that each kind of input calls for, unless a mismatch is allowed.

    ``indexed`` inputs need every assembly contig, ``sequential`` ones allow no
    contig outside the assembly, ``frame`` ones are joined as they are.
    """
    if allow_mismatch or kind == "frame":
        return
    missing = not_in(assembly, pileup) if kind == "indexed" else not_in(pileup, assembly)
    some = [r[0] for r in missing.limit(10).collect()]
    if some:
        raise PileupError(f"contigs in the {'assembly' if kind == 'indexed' else 'pileup'} but not in the {'pileup' if kind == 'indexed' else 'assembly'}: {some}")


def check_bounds(pileup: DataFrame, assembly: DataFrame) -> None:
    """Rows beyond the end of their contig are an error."""
    some = [tuple(r) for r in beyond_end(pileup, assembly).limit(10).collect()]
    if some:
        raise PileupError(f"rows beyond the end of their contig (contig, length, start): {some}")


def pileup_lines(pileup: DataFrame) -> DataFrame:
    """Rows as tab-separated lines, column ``line``."""
    from strandlake.sources.formats import number_text

    cols = [number_text(F.col(f"`{c}`")) if c == "fraction_modified" else F.col(f"`{c}`").cast("string") for c in COLUMNS]
    return pileup.select(F.concat_ws("\t", *cols).alias("line"))
