"""Gridded tables partitioned by product and calendar month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoseries.operators.clean import nulls_for_nan


def write_grid(
    df: DataFrame,
    path: str,
    time: str = "time",
    partition_by: Sequence[str] = (),
    cell: Sequence[str] = ("lat_i", "lon_i"),
    files_per_month: int = 8,
) -> None:
    """Grid rows in `<keys>/year=/month=` folders; a month is split over a few files by cell."""
    parts = [*partition_by, "year", "month"]
    keyed = df.withColumns({"year": F.year(time), "month": F.month(time)})
    keyed.repartition(*parts, F.pmod(F.xxhash64(*cell), F.lit(files_per_month))).write.mode("overwrite").partitionBy(
        *parts
    ).parquet(path)


def read_grid(
    spark: SparkSession,
    path: str,
    years: Sequence[int] | None = None,
    months: Sequence[int] | None = None,
    skip_unreadable: bool = False,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Only the files of the wanted years and months are read; NaN is read as null.

    Give the `schema` where files may be unreadable, so that none is opened to infer it.
    """
    reader = spark.read.option("ignoreCorruptFiles", str(skip_unreadable).lower()).option(
        "ignoreMissingFiles", str(skip_unreadable).lower()
    )
    df = (reader.schema(schema) if schema is not None else reader).parquet(path)
    if years is not None:
        df = df.where(F.col("year").isin(list(years)))
    if months is not None:
        df = df.where(F.col("month").isin(list(months)))
    return nulls_for_nan(df)
