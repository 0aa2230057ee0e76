"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "geoseries", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Where that is unset, a folder inside the warehouse, which all executors share too. On a cluster a warehouse in a folder of
    the driver's machine is refused.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not context.master.startswith("local") and warehouse.startswith("file:"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    folder = f"{warehouse.rstrip('/')}/_shared"
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/geoseries/{name}-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """Fix a result that must not change between two uses of it (reliable checkpoint)."""
    folder = shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that begins in here go as soon as it has ended, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """As `stable`, for large results: a table in the shared folder takes less room and gives only the columns asked for."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def temporary(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """As `written`, for the length of a block: what is read from the table has to be written or collected inside of it."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    try:
        yield df.sparkSession.read.parquet(path)
    finally:
        _removed(df.sparkSession, path)


@contextmanager
def bucketed(df: DataFrame, name: str, keys: Sequence[str], total: int, rows: int = 400_000) -> Iterator[DataFrame]:
    """As `temporary`, in files by the hash of `keys`, of about `rows` of the `total` rows each: joins by all of these keys move
    only the other side. The table has a name in the catalog inside of the block.
    """
    spark = df.sparkSession
    path, table = scratch_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // rows))
    with shuffles_removed(spark):
        dealt = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("compression", "zstd")
        dealt.option("path", path).format("parquet").saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")
        _removed(spark, path)


def spread(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read back in as many tasks as its size asks for.

    For rows that are read in many passes: those of a file of one row group would be read by one task in every pass.
    """
    return written(df.hint("rebalance"), name)
