"""Exact percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoseries.operators.ranking import chunk_offsets
from geoseries.session import stable

#: Relative rank error of the sketch is one over this; groups of up to `WHOLE` times as many rows are sorted whole.
ACCURACY, WHOLE = 1000, 4
#: Groups up to which the sketches go to all tasks; a join by the group would bring each group into one task.
FEW_GROUPS = 100_000


def _bracketed(values: DataFrame, by: list[str], probs: Sequence[float], spread: float, accuracy: int) -> DataFrame:
    """`by`, `_chunk`, `_v`, `_c`: values inside the brackets with their counts, one row with a null value for each gap.

    A bracket reaches from the sketched quantile of p - spread to that of p + spread. Chunks follow the values: those of
    brackets are odd, those of gaps even. Gaps are summed up before anything is shuffled.
    """
    ends = [min(max(p + d, 0.0), 1.0) for d in (-spread, spread) for p in probs]
    sketch = values.groupBy(*by).agg(F.percentile_approx("_v", ends, accuracy).alias("_q"), F.count(F.lit(1)).alias("_n"))
    if by:
        sketch = stable(sketch)
        joined = values.join(F.broadcast(sketch) if sketch.count() <= FEW_GROUPS else sketch, by)
    else:
        joined = values.withColumn("_s", sketch.select(F.struct("*")).scalar()).select("_v", "_s.*")
    whole = F.col("_n") <= WHOLE * accuracy
    low, high = ([F.col("_q")[k + i] for i in range(len(probs))] for k in (0, len(probs)))
    inside = whole
    below = F.lit(0)
    for a, z in zip(low, high):
        inside = inside | ((F.col("_v") >= a) & (F.col("_v") <= z))
        below = below + (F.col("_v") > z).cast("int")
    placed = joined.select(*by, "_v", inside.alias("_in"), F.when(whole, F.lit(0)).otherwise(below).alias("_below"))
    chunk = (2 * F.col("_below") + F.col("_in").cast("int")).alias("_chunk")
    return placed.groupBy(*by, chunk, F.when(F.col("_in"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))


def exact_percentiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], name: str = "percentiles", alpha: float = 1.0,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Interpolated percentiles per group as one array, nulls ignored.

    `alpha` sets the plotting position: 1.0 is plain linear interpolation, 0.4 the
    approximately quantile-unbiased one.

    A small mergeable sketch per group brackets each wanted position; one aggregate counts what lies below each bracket, and
    only the values inside brackets are shuffled and sorted. Should a bracket miss its position, all are widened. The bracketed
    values are fixed by a checkpoint, so every use sees the same ones; the answer is exact wherever the brackets lie.
    """
    by = list(by)
    values = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))

    def place(p: float) -> Column:
        raw = F.col("_n") * F.lit(float(p)) + F.lit(alpha + p * (1 - 2 * alpha) - 1)
        return F.greatest(F.least(raw, (F.col("_n") - 1).cast("double")), F.lit(0.0))

    positions = F.array_distinct(F.array(*[edge(place(p)).cast("long") for p in probs for edge in (F.floor, F.ceil)]))
    held = lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("_size"))
    spread = 3.0 / accuracy
    while True:
        placed = stable(_bracketed(values, by, probs, min(spread, 1.0), accuracy))
        sizes = placed.groupBy(*by, "_chunk").agg(F.sum("_c").alias("_size"))
        offsets = sizes.withColumn("_n", F.sum("_size").over(Window.partitionBy(*by))).join(chunk_offsets(sizes, by), [*by, "_chunk"])
        wanted = offsets.withColumn("_pos", F.filter(positions, held)).where(F.size("_pos") > 0)
        if spread >= 1 or wanted.where(F.col("_chunk") % 2 == 0).isEmpty():
            break
        spread *= 8
    inside = Window.partitionBy(*by, "_chunk").orderBy("_v")
    running = (
        placed.join(wanted.select(*by, "_chunk", "_before", "_pos", "_n"), [*by, "_chunk"])
        .withColumn("_to", F.col("_before") + F.sum("_c").over(inside))
        .withColumn("_from", F.col("_to") - F.col("_c"))
    )
    found = running.select(
        *by,
        "_n",
        "_v",
        F.explode(F.filter("_pos", lambda k: (k >= F.col("_from")) & (k < F.col("_to")))).alias("_k"),
    )
    at = found.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_at"), F.max("_n").alias("_n")
    )

    def interpolated(p: float) -> Column:
        low = F.element_at("_at", F.floor(place(p)).cast("long"))
        high = F.element_at("_at", F.ceil(place(p)).cast("long"))
        return low + (high - low) * (place(p) - F.floor(place(p)))

    return at.select(*by, F.array(*[interpolated(p) for p in probs]).alias(name))
