"""Methylation of motifs per contig: raw positions, medians and weighted means."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import iupac
from strandlake.functions.motif import Motif
from strandlake.operators.pileup import fraction, last_wins
from strandlake.operators.scan import block_of, motif_blocks, motif_table, occurrences, offset_of
from strandlake.session import materialize

RAW_COLUMNS = ("contig", "start", "strand", "motif", "mod_type", "mod_position", "n_modified", "n_valid_cov", "n_diff", "n_fail")
DEGREE_COLUMNS = ("contig", "motif", "mod_type", "mod_position", "methylation_value", "mean_read_cov", "n_motif_obs", "motif_occurences_total")


class Output(str, Enum):
    """Kind of result."""

    RAW = "raw"
    MEDIAN = "median"
    WEIGHTED_MEAN = "weighted_mean"

    @classmethod
    def parse(cls, text: str) -> Output:
        try:
            return cls(text.lower().replace("-", "_"))
        except ValueError:
            raise ValueError(f"unknown output type '{text}': use raw, median or weighted_mean") from None


def observations(blocks: DataFrame, meth: DataFrame, motifs: list[Motif]) -> DataFrame:
    """Counts at hits: rows of ``meth`` at a hit's contig, position, strand and modification.

    ``meth``: see ``pileup.methylation``. The join is on blocks of positions,
    which spreads a large contig; the offset is looked up in the block's list.
    With a column ``_order`` the last of repeated keys wins, within the join's
    own partitioning.
    """
    table = blocks.sparkSession.createDataFrame(motif_table(motifs), "motif_id int, motif string, mod_type string, mod_position int")
    hits = blocks.join(F.broadcast(table), "motif_id")
    placed = meth.withColumn("block", block_of(F.col("start"))).withColumn("_offset", offset_of(F.col("start")))
    joined = placed.join(hits, ["contig", "strand", "mod_type", "block"]).where(F.array_contains("offsets", F.col("_offset"))).drop("offsets", "_offset")
    if "_order" in meth.columns:
        joined = last_wins(joined, ["contig", "strand", "mod_type", "block", "start", "motif_id"])
    return joined.drop("block")


def raw(contigs: DataFrame, meth: DataFrame, motifs: list[Motif]) -> DataFrame:
    """Counts at every observed hit (RAW_COLUMNS)."""
    return observations(motif_blocks(contigs, motifs), meth, motifs).select(*RAW_COLUMNS)


def _degrees(contigs: DataFrame, meth: DataFrame, motifs: list[Motif], value: Column) -> DataFrame:
    blocks = materialize(motif_blocks(contigs, motifs), "motif-blocks")  # one scan for the observations and the totals
    seen = observations(blocks, meth, motifs).where("n_valid_cov > 0")
    per = seen.groupBy("contig", "motif_id", "motif", "mod_type", "mod_position").agg(value.alias("methylation_value"), F.avg("n_valid_cov").alias("mean_read_cov"), F.count("*").alias("n_motif_obs"))
    total = occurrences(blocks, by_strand=False).withColumnRenamed("n_occurrences", "motif_occurences_total")
    return per.join(total, ["contig", "motif_id"]).select(*DEGREE_COLUMNS)


def median(contigs: DataFrame, meth: DataFrame, motifs: list[Motif]) -> DataFrame:
    """Exact median of the modified share per contig and motif (DEGREE_COLUMNS); groups without observations have no row.

    Positions whose netted coverage is 0 have no share and aren't observations.
    """
    return _degrees(contigs, meth, motifs, F.median(fraction(F.col("n_modified"), F.col("n_valid_cov"))))


def weighted_mean(contigs: DataFrame, meth: DataFrame, motifs: list[Motif]) -> DataFrame:
    """Mean of the modified share weighted by coverage (DEGREE_COLUMNS)."""
    return _degrees(contigs, meth, motifs, fraction(F.sum("n_modified"), F.sum("n_valid_cov")))


def degrees_from_raw(raw_rows: DataFrame) -> DataFrame:
    """Median and weighted mean from raw rows, without the occurrence totals."""
    keys = ["contig", "motif", "mod_type", "mod_position"]
    seen = raw_rows.where("n_valid_cov > 0")
    return seen.groupBy(*keys).agg(
        F.median(fraction(F.col("n_modified"), F.col("n_valid_cov"))).alias("median"),
        fraction(F.sum("n_modified"), F.sum("n_valid_cov")).alias("weighted_mean"),
        F.avg("n_valid_cov").alias("mean_read_cov"), F.count("*").alias("n_motif_obs"),
    )


def order_of(rows: DataFrame) -> list[Column]:
    """Sort key of results: contig, motif by alphabet order, type rank, position; raw rows by position and strand last."""
    key = [F.col("contig"), iupac.sequence_key(F.col("motif")), iupac.mod_rank(F.col("mod_type")), F.col("mod_position")]
    if "start" in rows.columns:
        key += [F.col("start"), iupac.strand_rank(F.col("strand"))]
    else:
        key += [F.col("methylation_value"), F.col("mean_read_cov"), F.col("n_motif_obs"), F.col("motif_occurences_total")]
    return key


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*order_of(rows))


def numbered(rows: DataFrame) -> DataFrame:
    """The rows in result order with their number from 1, ``row_no``; no task sees all of them."""
    placed = ordered(rows).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_in"))
    placed = materialize(placed, "ordered")  # numbers within partitions hold for the one sort that was written
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    return placed.join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_before") + F.col("_in") + 1).alias("row_no"))
