"""Session helpers: the shared scratch folder and tables written to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_SETTING = "spark.checkpoint.dir"
_temporary: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as named by ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it then gets a temporary
    folder. On a cluster a machine-local folder would lose data with its
    executor, so a missing setting is an error there.
    """
    given = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        app = spark.sparkContext.applicationId
        if app not in _temporary:  # Spark takes no such setting while it runs
            _temporary[app] = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        return _temporary[app]
    raise ValueError(f"set {_SETTING} to a folder that all executors share")


_roots: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of written tables, if the session still runs."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes at the application's end, or at that of a ``released`` block.

    The folder it lies in is made, as only Spark's own writers make it themselves.
    """
    root = f"{shared_dir(spark)}/strandlake/{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_remove, spark, root)
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    for paths in _open:
        paths.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table survives the loss of executors and keeps an expensive
    stage from running once per consumer.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_open: list[list[str]] = []


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized within the block are deleted at its end.

    For long sessions: results that were made within the block must be used
    within it, as they read these tables.
    """
    paths: list[str] = []
    _open.append(paths)
    try:
        yield
    finally:
        _open.remove(paths)
        for path in paths:
            _remove(spark, path)


def spread(scan: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores, for work that costs far more than moving them.

    For plans without a shuffle only, as the number of partitions is asked for.
    A table in many files stays as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(2 * cores)


def wide(spark: SparkSession) -> int:
    """Partitions for work that costs far more than moving its rows: twice the cores, or the session's shuffle partitions if these are more."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as part of the plan itself, so that no Python worker has to send them."""
    names = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, names)], names=names.names))
