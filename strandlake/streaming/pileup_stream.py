"""Pileups that arrive as files: valid rows are appended, rejects kept apart, and counts per contig and window of calling time made.

Each micro-batch runs the same operators as a batch query. Rejects need an
anti-join per batch and windows take rows of any lateness, so results are
written by ``foreachBatch``; a batch that is run again replaces its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.functions.text import stripped
from strandlake.operators.rejects import load_pileup_lines


def load_stream(lines: DataFrame, records: str, rejects: str, checkpoint: str, line: str = "line", offsets: tuple[str, ...] = ("line_id",), available_now: bool = True) -> StreamingQuery:
    """Write valid records and rejects of a stream of raw lines to two folders, one subfolder per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            out = load_pileup_lines(batch, line, offsets)
            out.records.write.mode("overwrite").parquet(f"{records}/batch={batch_id}")
            out.rejects.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        finally:
            batch.unpersist()

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def coverage_windows(rows: DataFrame, *, width: str = "1 day") -> DataFrame:
    """Rows and coverage per stripped contig and window of ``called_at``, of all rows of a frame however late they are.

    Rows without a time come under a null window. On a stream use
    ``coverage_stream``, which doesn't hold the windows as state.
    """
    at = F.coalesce("called_at", F.lit(0).cast("timestamp").cast(rows.schema["called_at"].dataType))  # F.window leaves out rows without a time
    grouped = rows.groupBy(F.window(at, width).alias("w"), F.col("called_at").isNotNull().alias("_timed"), stripped(F.col("contig")).alias("contig")).agg(F.count("*").alias("n_rows"), F.sum("n_valid_cov").alias("sum_cov"))
    return grouped.select(F.when(F.col("_timed"), F.col("w.start")).alias("window_start"), "contig", "n_rows", "sum_cov")


def coverage_stream(rows: DataFrame, sums: str, checkpoint: str, width: str = "1 day", available_now: bool = True) -> StreamingQuery:
    """Write each batch's ``coverage_windows`` to a subfolder of ``sums``; ``merged_windows`` adds them up.

    Counts and sums of batches add up, so there is no watermark and no row is
    too late: one of a window long past is a further part of its sum.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        coverage_windows(batch, width=width).write.mode("overwrite").parquet(f"{sums}/batch={batch_id}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def merged_windows(spark: SparkSession, sums: str) -> DataFrame:
    """The windows of all batches that ``coverage_stream`` has written so far, in the columns of ``coverage_windows``."""
    return spark.read.parquet(sums).groupBy("window_start", "contig").agg(F.sum("n_rows").alias("n_rows"), F.sum("sum_cov").alias("sum_cov"))
