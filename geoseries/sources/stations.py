"""Station tables: file-per-station scans, name fields, result tables, run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoseries.operators.clean import nulls_for_nan
from geoseries.schema import STATION_DAILY

# Fixed value: station files are named <station>_group_<group>.<extension>.
STATION_FILE = r"(\d+)_group_(\d+)\.[A-Za-z0-9]+$"


def read_stations(
    spark: SparkSession,
    path: str,
    layer: str | None = None,
    schema: T.StructType = STATION_DAILY,
    fmt: str = "csv",
    skip_unreadable: bool = False,
    file: str | None = None,
) -> DataFrame:
    """All stations below `path/<layer>`; station and group come from the file name, NaN is read as null.

    Files the reader cannot open are passed over only when asked. `file` names a column for the path of a row's file.
    """
    reader = (
        spark.read.format(fmt)
        .schema(schema)
        .option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", str(skip_unreadable).lower())
        .option("ignoreMissingFiles", str(skip_unreadable).lower())
    )
    if fmt == "csv":
        reader = reader.option("header", "true")
    df = reader.load(f"{path.rstrip('/')}/{layer}" if layer else path)
    source = F.col("_metadata.file_path")
    return nulls_for_nan(df).select(
        *name_fields(source),
        *[f.name for f in schema.fields],
        *([source.alias(file)] if file else []),
    )


def name_fields(path: Column) -> list[Column]:
    """`station_id`, `group_id` and `layer` of a station file's path."""
    return [
        F.nullif(F.regexp_extract(path, STATION_FILE, 1), F.lit("")).cast("long").alias("station_id"),
        F.nullif(F.regexp_extract(path, STATION_FILE, 2), F.lit("")).cast("int").alias("group_id"),
        F.element_at(F.split(path, "/"), -2).alias("layer"),
    ]


def skipped_files(spark: SparkSession, path: str, rows: DataFrame, file: str) -> DataFrame:
    """`station_id`, `group_id`, `layer`, `path` of the files below `path` that gave no row of `rows`, unreadable or empty.

    The files are listed without being opened and compared with the paths that the rows bear in `file`.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    name = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/").alias("path")  # noqa: E731 - file:/x and file:///x are one path
    missing = listed.select(name(F.col("path"))).join(rows.select(name(F.col(file))).distinct(), "path", "left_anti")
    return missing.select(*name_fields(F.col("path")), "path")


def read_station_table(spark: SparkSession, path: str, layers: Sequence[str] | None = None) -> DataFrame:
    """Station rows kept in `layer=` folders; only the wanted layers are read."""
    df = nulls_for_nan(spark.read.parquet(path))
    return df if layers is None else df.where(F.col("layer").isin(list(layers)))


def path_fields(df: DataFrame, path: str | Column, pattern: str, names: Sequence[str]) -> DataFrame:
    """Groups of a pattern found in a file path, as string columns (null where it does not match)."""
    source = F.col(path) if isinstance(path, str) else path
    found = {n: F.nullif(F.regexp_extract(source, pattern, i + 1), F.lit("")) for i, n in enumerate(names)}
    return df.withColumns(found)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Adds run records without rewriting the earlier ones."""
    df.write.mode("append").parquet(path)
