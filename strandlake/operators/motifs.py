"""Motif lists as tables: reverse complements, expansions, parents and children, collapsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import iupac
from strandlake.functions.motif import Motif

SCHEMA = "motif string, mod_type string, mod_position int"


def motif_frame(spark, motifs: list[Motif]) -> DataFrame:
    return spark.createDataFrame([(m.sequence, m.mod_type, m.mod_position) for m in motifs], SCHEMA)


def reverse_complements(motifs: DataFrame) -> DataFrame:
    """The motif table on the other strand."""
    return motifs.select(iupac.reverse_complement(F.col("motif")).alias("motif"), "mod_type", (F.length("motif") - F.col("mod_position") - 1).alias("mod_position"))


def expansions(motifs: DataFrame) -> DataFrame:
    """Every plain sequence of every motif: ``motif, mod_type, mod_position, dna``."""
    start = F.array(F.lit(""))
    grown = F.aggregate(iupac.letters_of(F.col("motif")), start, lambda acc, x: F.flatten(F.transform(acc, lambda a: F.transform(iupac.bases_of(x), lambda b: F.concat(a, b)))))
    return motifs.select("motif", "mod_type", "mod_position", F.explode(grown).alias("dna"))


def _masks(sequence: Column) -> Column:
    return F.transform(iupac.letters_of(sequence), iupac.mask)


def holds(parent: str, child: str) -> Column:
    """Whether the motif at alias ``child`` holds the one at alias ``parent``."""
    p, c = (lambda n: F.col(f"{parent}.{n}")), (lambda n: F.col(f"{child}.{n}"))
    at = c("mod_position") - p("mod_position")
    fits = (p("mod_type") == c("mod_type")) & (at >= 0) & (at + F.length(p("motif")) <= F.length(c("motif")))
    window = F.slice(c("masks"), F.greatest(at, F.lit(0)) + 1, F.length(p("motif")))
    return fits & F.forall(F.zip_with(p("masks"), window, lambda a, b: a.bitwiseAND(b)), lambda x: x != 0)


def _numbered(motifs: DataFrame, order: str | None) -> DataFrame:
    n = F.aggregate(_masks(F.col("motif")), F.lit(1).cast("long"), lambda acc, m: acc * F.bit_count(m))
    return motifs.select("motif", "mod_type", "mod_position", (F.col(order) if order else F.monotonically_increasing_id()).alias("i"), _masks(F.col("motif")).alias("masks"), n.alias("n_exp"))


def parent_child(motifs: DataFrame) -> DataFrame:
    """Pairs (parent, child) of different rows of a motif list; motif lists are small, so one side is broadcast."""
    m = motifs.select("motif", "mod_type", "mod_position", _masks(F.col("motif")).alias("masks"))
    a, b = m.alias("a"), m.alias("b")
    differ = (F.col("a.motif") != F.col("b.motif")) | (F.col("a.mod_position") != F.col("b.mod_position"))
    return a.join(b, holds("a", "b") & differ).select(F.col("a.motif").alias("parent"), F.col("b.motif").alias("child"), F.col("a.mod_type").alias("mod_type"), F.col("a.mod_position").alias("parent_position"), F.col("b.mod_position").alias("child_position"))


def collapse(motifs: DataFrame, order: str | None = None) -> DataFrame:
    """Keep of every parent and child the shorter one, in the list's order.

    Of equal lengths the one with fewer expansions goes, else the first. Rows
    go by value, so all copies of a repeated motif go.
    """
    m = _numbered(motifs, order)
    a, b = m.alias("a"), m.alias("b")
    pairs = a.join(b, (F.col("a.i") < F.col("b.i")) & (F.col("a.mod_type") == F.col("b.mod_type")) & (holds("a", "b") | holds("b", "a")))
    la, lb = F.length("a.motif"), F.length("b.motif")
    first = (la > lb) | ((la == lb) & (F.col("a.n_exp") <= F.col("b.n_exp")))
    pick = lambda n: F.when(first, F.col(f"a.{n}")).otherwise(F.col(f"b.{n}")).alias(n)
    victims = pairs.select(pick("motif"), pick("mod_type"), pick("mod_position")).distinct()
    return m.join(victims, ["motif", "mod_type", "mod_position"], "left_anti").orderBy("i").select("motif", "mod_type", "mod_position")


def union(motifs: DataFrame, by: list[str]) -> DataFrame:
    """Per group of ``by`` and length, the motif whose letters stand for all bases at each position."""
    letters = motifs.select(*by, "motif", F.length("motif").alias("length"), F.posexplode(_masks(F.col("motif"))).alias("at", "mask"))
    merged = letters.groupBy(*by, "length", "at").agg(F.bit_or("mask").alias("mask"))
    rows = merged.groupBy(*by, "length").agg(F.sort_array(F.collect_list(F.struct("at", iupac.letter_of_mask(F.col("mask")).alias("x")))).alias("l"))
    return rows.select(*by, "length", F.array_join(F.transform("l", lambda s: s["x"]), "").alias("motif"))
