"""Calendar means that merge: sums and counts by month, from which months, years and long-term means follow.

A mean over days cannot be brought up to date; its sum and count can. The state of a month is written to a partition of its
own, so a new or corrected month touches nothing else, and every mean is a merge of states, which are smaller than the days
by a factor of thirty.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def month_states(df: DataFrame, time: str, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """`by`, `year`, `month` and for each column its sum `sum_<c>` and number of values `n_<c>`."""
    parts = [state for c in cols for state in (F.sum(c).alias(f"sum_{c}"), F.count(c).alias(f"n_{c}"))]
    return df.groupBy(*by, F.year(time).alias("year"), F.month(time).alias("month")).agg(*parts)


def write_states(states: DataFrame, path: str) -> None:
    """Replace the months that `states` holds and leave the others; writing the same months again changes nothing."""
    writer = states.repartition("year", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("year", "month").parquet(path)


def read_states(spark: SparkSession, path: str, years: tuple[int, int] | None = None) -> DataFrame:
    """Written states, of some years only if asked for; other partitions are not read."""
    states = spark.read.parquet(path)
    return states if years is None else states.where(F.col("year").between(*years))


def mean_of(c: str, where: Column | None = None) -> Column:
    """Mean of a column from its states, an aggregate; null without values."""
    total, n = (F.sum(F.col(p + c) if where is None else F.when(where, F.col(p + c))) for p in ("sum_", "n_"))
    return total / F.nullif(n.cast("double"), F.lit(0.0))


def merged_means(states: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Means by any of the states' keys: with `month` or `year` among them calendar means, without long-term ones."""
    return states.groupBy(*by).agg(*[mean_of(c).alias(c) for c in cols])


def layered_means(
    states: DataFrame, part: str, picks: Mapping[str, Mapping[str, tuple[str, float]]], own: Sequence[str], on: Sequence[str], layer: str = "layer"
) -> DataFrame:
    """One row for each layer, cell and `part` (`month` or `year`) with the means that `picks` names, in one aggregate.

    `picks[layer][name]` is the column and the factor of a mean; columns in `own` are averaged over the rows of that layer, the
    others over all rows of the cell. Layers without any value are left out.
    """
    needed = dict.fromkeys((c, name if c in own else None) for name, pick in picks.items() for c, _ in pick.values())
    label = {key: f"_m{i}" for i, key in enumerate(needed)}
    means = [mean_of(c, None if name is None else F.col(layer) == name).alias(label[c, name]) for c, name in needed]
    wide = states.groupBy(*on, part).agg(*means)
    columns = list(dict.fromkeys(n for pick in picks.values() for n in pick))

    def value(name: str, column: str) -> Column:
        if column not in picks[name]:
            return F.lit(None).cast("double").alias(column)
        c, factor = picks[name][column]
        return (F.col(label[c, name if c in own else None]) * F.lit(float(factor))).alias(column)

    rows = [F.struct(F.lit(name).alias(layer), *[value(name, c) for c in columns]) for name in picks]
    return wide.select(*on, part, F.inline(F.array(*rows))).where(F.coalesce(*columns).isNotNull())
