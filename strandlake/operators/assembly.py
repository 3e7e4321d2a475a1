"""Assemblies from tables of contig loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.text import stripped
from strandlake.session import wide


def clean_sequence(sequence: Column) -> Column:
    """Upper-case letters without white space; '-' is an unknown base."""
    return F.translate(F.upper(F.regexp_replace(sequence, r"\s+", "")), "-", "N")


def latest_loads(loads: DataFrame, id_col: str = "id", sequence: str = "sequence", at: str = "loaded_at", row: str = "contig_row") -> DataFrame:
    """``contig, sequence``: the last load of each stripped id, as the last record of a repeated id counts.

    The sequences move once, to the partition of their contig, where scans read
    them. Loads without an id are left out; a null sequence stays null. Of loads
    with one time and row the longest counts, and of these any one, but the same
    in each run.
    """
    named = loads.select(stripped(F.col(id_col)).alias("contig"), F.col(at).alias("_at"), F.col(row).alias("_row"), F.col(sequence).alias("_seq")).where("contig <> ''")
    newest = F.struct("_at", "_row", F.length("_seq"), F.xxhash64("_seq"))
    last = named.repartition(wide(loads.sparkSession), "contig").groupBy("contig").agg(F.max_by("_seq", newest).alias("_seq"))
    return last.select("contig", clean_sequence(F.col("_seq")).alias("sequence"))
