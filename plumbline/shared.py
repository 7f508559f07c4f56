"""Places for intermediate tables: one folder for each application, which driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_folders: set[str] = set()
_kept: dict[tuple, str] = {}
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)
_tables: dict[str, list[str]] = {}

#: Rows of a bucket of a kept table, about.
BUCKET_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir.

    Where that is unset a local master (tests) uses the warehouse; a cluster is refused, since its machines would each
    write to a disk of their own. The folder goes when Python ends; `clear` removes it earlier.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    folder = f"{base.rstrip('/')}/plumbline-{context.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_end, spark, folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder, or in the scratch folder of the `settled` table that is being built."""
    return f"{_scratch.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage, survives lost executors, and its size is
    known, so that Spark broadcasts it only below its own limit (spark.sql.autoBroadcastJoinThreshold)."""
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(spark: SparkSession, df: DataFrame, name: str, column: str) -> DataFrame:
    """df written as `written` does, in as many buckets of a column as a shuffle has partitions: where df was grouped by that
    column a bucket is one file, and joins on it move only the other side."""
    table = f"{name}_{uuid.uuid4().hex}"
    _tables.setdefault(_scratch.get() or shared_dir(spark), []).append(table)
    df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).option("path", shared_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """build() as a written table. What was written to build it goes then, so that it takes no disk beside later steps."""
    path, folder = shared_path(spark, name), shared_path(spark, "scratch")
    token = _scratch.set(folder)
    try:
        df = build()
        df.write.parquet(path)
    finally:
        _scratch.reset(token)
        for table in _tables.pop(folder, []):
            spark.sql(f"drop table if exists {table}")
        _delete(spark, folder)
    return spark.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, key: tuple, build: Callable[[], DataFrame], bucket: str) -> DataFrame:
    """A table that the application builds once and keeps in its folder, bucketed by a column: groupings by that column
    and others, and joins on it alone, need no exchange. `key` says what the table was made from. The number of rows says
    how many buckets there are, so that a bucket is bounded however many rows come."""
    own = (spark.sparkContext.applicationId, *key)
    if own not in _kept:
        rows = build()
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BUCKET_ROWS))
        name = f"kept_{uuid.uuid4().hex}"
        rows = rows.repartition(parts, bucket)  # one file a bucket
        rows.write.format("parquet").bucketBy(parts, bucket).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
        _kept[own] = name
    return spark.table(_kept[own])


def clear(spark: SparkSession, folder: str | None = None) -> None:
    """Removes what this application wrote to the shared folder; tables read from it are gone then."""
    for own in [k for k in _kept if k[0] == spark.sparkContext.applicationId]:
        del _kept[own]
    _delete(spark, folder or shared_dir(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _end(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:
        with contextlib.suppress(Py4JError):  # the JVM may have gone first
            clear(spark, folder)
