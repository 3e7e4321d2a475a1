"""Alignments as blocks, with column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cigar_blocks(reads: DataFrame) -> DataFrame:
    """Aligned blocks: ``read_id, read_from, ref_from, length``. ``reads``: ``read_id, cigar, start``.

    Offsets are prefix sums over the operations: M, = and X take both sides, I
    and S the read's, D and N the reference's, H and P none.
    """
    ops = F.transform(F.regexp_extract_all("cigar", F.lit(r"([0-9]+[MIDNSHP=X])"), F.lit(1)), lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))
    none = F.array().cast("array<struct<read_from:int,ref_from:int,length:int>>")

    def add(acc: Column, o: Column) -> Column:
        both, read, ref = o["op"].isin("M", "=", "X"), o["op"].isin("I", "S"), o["op"].isin("D", "N")
        block = F.struct(acc["r"].alias("read_from"), acc["g"].alias("ref_from"), o["n"].alias("length"))
        return F.struct(
            F.when(both, F.concat(acc["out"], F.array(block))).otherwise(acc["out"]).alias("out"),
            (acc["r"] + F.when(both | read, o["n"]).otherwise(0)).alias("r"),
            (acc["g"] + F.when(both | ref, o["n"]).otherwise(0)).alias("g"),
        )

    start = F.struct(none.alias("out"), F.lit(0).alias("r"), F.col("start").cast("int").alias("g"))
    return reads.select("read_id", F.inline(F.aggregate(ops, start, add, lambda acc: acc["out"])))
