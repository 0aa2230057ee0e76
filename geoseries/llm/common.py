"""Reading, staging and small text helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoseries.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Hand texts to Python in batches of few rows: Spark's default holds 10,000 long texts at once on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str):
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def rows_of(batches, wanted: int = 256):
    """Cut Arrow batches into slices of few rows, so that Python never holds many long texts at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, wanted):
            yield batch.slice(start, wanted)


def learnable(key: str, folds: int, held: int):
    """True where crc32 of the id as text, modulo `folds`, is not the held-out remainder (null ids are held out)."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % folds != held, F.lit(False))


def with_place(df: DataFrame) -> tuple[DataFrame, Column]:
    """The table with one more column, and that column: it tells rows apart, the same each time the table is read.

    Rows of files have their file and place in it; any other table is written once with a number for each row.
    """
    name = f"row_{uuid.uuid4().hex}"
    try:
        return df.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))), F.col(name)
    except AnalysisException:  # no scan of files
        return staged(df.withColumn(name, F.monotonically_increasing_id()), "rows"), F.col(name)
