"""Merging base-modification tags of one set of reads into another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import modtags
from strandlake.functions.modtags import Descriptor, TagError


def rename_tags(reads: DataFrame, renames: list[tuple[Descriptor, Descriptor]]) -> DataFrame:
    mm = F.col("mm")
    for old, new in renames:
        mm = modtags.rename(mm, str(old), str(new))
    return reads.withColumn("mm", mm)


def remove_tags(reads: DataFrame, drop: list[Descriptor]) -> DataFrame:
    if not drop:
        return reads
    mm, ml = modtags.remove(F.col("mm"), F.col("ml"), [str(d) for d in drop])
    return reads.withColumns({"mm": mm, "ml": ml})


def tag_descriptors(reads: DataFrame) -> DataFrame:
    """Distinct descriptors of all reads."""
    return reads.select(F.explode(modtags.descriptors(F.col("mm"))).alias("descriptor")).distinct()


def overlapping_tags(source: DataFrame, target: DataFrame, ignore: list[Descriptor] | None = None) -> DataFrame:
    """Descriptors that both sets have, but for the ignored ones of the source."""
    own = tag_descriptors(source).where(~F.col("descriptor").isin(*map(str, ignore))) if ignore else tag_descriptors(source)
    return own.intersect(tag_descriptors(target))


def merge_tags(source: DataFrame, target: DataFrame, rename_source: list | None = None, rename_target: list | None = None, ignore: list[Descriptor] | None = None, order: str | None = None, check: bool = True) -> DataFrame:
    """``target`` with the tags of ``source`` put behind its own.

    Both have ``read_id, mm, ml``; ``target`` may have more columns, which stay.
    Of a read repeated in the source the last by ``order`` counts (by content
    without an order). Empty tags count as missing. A descriptor that both
    would have is an error unless ``check`` is off.
    """
    empty = lambda r: r.withColumns({"mm": F.when(F.col("mm") != "", F.col("mm")), "ml": F.when(F.size("ml") > 0, F.col("ml"))})
    src = empty(source)
    renamed_target = rename_tags(empty(target), rename_target or [])
    if check:
        renamed = rename_tags(src, rename_source or [])
        both = [r[0] for r in overlapping_tags(renamed, renamed_target, ignore).limit(10).collect()]
        if both:
            raise TagError(f"both sides have tags of the same kind; rename or ignore one of them: {both}")
    src = rename_tags(remove_tags(src, ignore or []), rename_source or [])
    rank = F.struct(F.col(order) if order else F.lit(0), F.coalesce("mm", F.lit("")), F.coalesce("ml", F.array().cast("array<int>")))
    last = src.groupBy("read_id").agg(F.max_by(F.struct("mm", F.col("ml").cast("array<int>").alias("ml")), rank).alias("_t"))
    joined = renamed_target.join(last, "read_id", "left")
    mm, ml = modtags.append(F.col("mm"), F.col("ml").cast("array<int>"), F.col("_t.mm"), F.col("_t.ml"))
    return joined.withColumns({"_mm": modtags.checked(mm, ml), "_ml": ml}).drop("_t", "mm", "ml").withColumnsRenamed({"_mm": "mm", "_ml": "ml"}).select(*target.columns)
