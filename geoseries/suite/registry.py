"""Registry of queries and of the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoseries.suite.bindings import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


# Means of hundredths often lie exactly half-way between two rounded values, where the two
# engines round differently; this share of the last digit moves both sides off the tie.
OFF_TIE = 0.2718281828


def _same_types(df: DataFrame, floats: list[str], dates: list[str], digits: int) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.name in floats:
            c = F.round(c.cast("double") + F.lit(OFF_TIE * 10.0**-digits), digits)
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)  # no negative zero
        elif field.name in dates:
            c = c.cast("string")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def query(name: str, body: str | None = None, floats: str = "", ints: str = "", dates: str = "", digits: int = 6):
    """Register a query. On both sides `floats` are rounded, `ints` made BIGINT, `dates` written as YYYY-MM-DD."""
    float_names, int_names, date_names = floats.split(), ints.split(), dates.split()

    def register(build):
        QUERIES[name] = lambda spark, sf: _same_types(build(spark, sf), float_names, date_names, digits)
        if body is not None:
            rounded = [(c, f"round(CAST({c} AS DOUBLE) + {OFF_TIE * 10.0**-digits!r}, {digits})") for c in map(_quoted, float_names)]
            replaced = [f"CASE WHEN {r} = 0 THEN 0e0 ELSE {r} END AS {c}" for c, r in rounded]
            replaced += [f"CAST({c} AS BIGINT) AS {c}" for c in map(_quoted, int_names)]
            replaced += [f"CAST({c} AS VARCHAR) AS {c}" for c in map(_quoted, date_names)]
            text = sql(body)
            ORACLE[name] = f"SELECT * REPLACE ({', '.join(replaced)}) FROM ({text})" if replaced else text
        return build

    return register


def _quoted(name: str) -> str:
    return f'"{name}"'
