"""Coverage windows on a real stream, with rows that come very late."""

from pyspark.sql import functions as F

from strandlake.streaming.pileup_stream import coverage_stream, coverage_windows, merged_windows

SCHEMA = "contig string, called_at timestamp, n_valid_cov long"


def _batches(spark, folder):
    """Three files, one per micro-batch; the second and third have rows 40 days behind the first, and one without a time."""
    for i, rows in enumerate((
        "(' c ', timestamp'2024-03-01 05:00:00', 3L), ('c', timestamp'2024-01-20 05:00:00', 1L)",
        "('c', timestamp'2024-01-21 01:00:00', 10L), ('c', timestamp'2024-01-20 06:00:00', 2L), ('c', timestamp'2024-03-01 06:00:00', null)",
        "('c', timestamp'2024-01-20 07:00:00', 5L), ('d', null, 7L)",
    )):
        spark.sql(f"select * from values {rows} as t(contig, called_at, n_valid_cov)").coalesce(1).write.mode("append").parquet(f"{folder}/{i}")


def test_late_rows_of_a_stream_count(spark, tmp_path):
    _batches(spark, tmp_path / "in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = coverage_stream(stream, str(tmp_path / "sums"), str(tmp_path / "cp"))
    assert query.awaitTermination(120) and query.exception() is None
    assert len(list((tmp_path / "sums").glob("batch=*"))) == 3
    got = merged_windows(spark, str(tmp_path / "sums"))
    want = coverage_windows(spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "in")))
    assert got.columns == want.columns
    rows = sorted((str(r.window_start)[:10], r.contig, r.n_rows, r.sum_cov) for r in got.collect())
    assert rows == [("2024-01-20", "c", 3, 8), ("2024-01-21", "c", 1, 10), ("2024-03-01", "c", 2, 3), ("None", "d", 1, 7)]
    assert rows == sorted((str(r.window_start)[:10], r.contig, r.n_rows, r.sum_cov) for r in want.collect())


def test_batch_run_again_counts_once(spark, tmp_path):
    """Without its commit a batch runs again and replaces its own sums."""
    _batches(spark, tmp_path / "in")
    for _ in range(2):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        assert coverage_stream(stream, str(tmp_path / "sums"), str(tmp_path / "cp")).awaitTermination(120)
        last = tmp_path / "cp" / "commits" / "2"
        assert last.exists()
        last.unlink()
        (last.parent / ".2.crc").unlink(missing_ok=True)
    assert merged_windows(spark, str(tmp_path / "sums")).agg(F.sum("n_rows")).first()[0] == 7
