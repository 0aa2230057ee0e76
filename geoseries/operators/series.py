"""Station and cell time series: daily means, rolling sums, gap filling, windows.

Long series are worked on in time chunks. Rows near a chunk edge are copied to the
neighbouring chunk, or a one-row summary per chunk carries values across the edge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoseries.functions.calendar import day_number

CHUNK_DAYS = 366


def resample_daily(
    df: DataFrame,
    by: Sequence[str],
    time: str,
    cols: Sequence[str],
    closed: str = "left",
    drop_empty: bool = True,
    name: str = "date_time",
) -> DataFrame:
    """Daily means. `closed="right"` counts midnight to the day that ends there."""
    if closed not in ("left", "right"):
        raise ValueError("closed must be 'left' or 'right'")
    stamp = F.col(time) if closed == "left" else F.col(time) - F.expr("INTERVAL 1 MICROSECOND")
    daily = df.groupBy(*by, F.to_date(stamp).alias(name)).agg(*[F.avg(c).alias(c) for c in cols])
    return daily.na.drop("any", subset=list(cols)) if drop_empty else daily


def rolling_sum(
    df: DataFrame, by: Sequence[str], time: str, col: str, days: int, name: str | None = None, chunk_days: int = CHUNK_DAYS
) -> DataFrame:
    """Trailing sum over `days` calendar days, null until the window holds `days` values."""
    name = name or f"{col}_sum{days}"
    width = max(chunk_days, days)
    day = day_number(F.col(time))
    own = F.floor(day / F.lit(width))
    reaches_next = F.pmod(day, F.lit(width)) >= width - (days - 1)
    spread = df.withColumn("_day", day).withColumn("_own", own).withColumn(
        "_chunk", F.explode(F.when(reaches_next, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    window = Window.partitionBy(*by, "_chunk").orderBy("_day").rangeBetween(-(days - 1), 0)
    full = F.count(col).over(window) == days
    return (
        spread.withColumn(name, F.when(full, F.sum(col).over(window)))
        .where(F.col("_chunk") == F.col("_own"))
        .drop("_day", "_own", "_chunk")
    )


def verify_rolling(
    origin: DataFrame, stored: DataFrame, by: Sequence[str], time: str, col: str, stored_col: str, days: int, tol: float = 0.5
) -> DataFrame:
    """Stored rolling sums beside recomputed ones; `ok` is null where the window is not full."""
    again = rolling_sum(origin.select(*by, time, col), by, time, col, days, "recomputed")
    keys = [*by, time]
    joined = stored.select(*keys, stored_col).join(again.select(*keys, "recomputed"), keys, "left")
    return joined.withColumn("ok", F.abs(F.col("recomputed") - F.col(stored_col)) < tol)


def _with_next(df: DataFrame, by: Sequence[str], day: str, cols: Sequence[str], chunk_days: int) -> DataFrame:
    """Adds `_next`, the following row of the series as a struct (day first)."""
    here = F.struct(F.col(day).alias("day"), *[F.col(c) for c in cols])
    keyed = df.withColumn("_chunk", F.floor(F.col(day) / F.lit(chunk_days))).withColumn("_here", here)
    firsts = keyed.groupBy(*by, "_chunk").agg(F.min_by("_here", day).alias("_first"))
    across = firsts.select(
        *by, "_chunk", F.lead("_first").over(Window.partitionBy(*by).orderBy("_chunk")).alias("_across")
    )
    inside = Window.partitionBy(*by, "_chunk").orderBy(day)
    return (
        keyed.withColumn("_next", F.lead("_here").over(inside))
        .join(across, [*by, "_chunk"])
        .withColumn("_next", F.coalesce("_next", "_across"))
        .drop("_chunk", "_here", "_across")
    )


def fill_days(
    df: DataFrame, by: Sequence[str], time: str, cols: Sequence[str], chunk_days: int = CHUNK_DAYS
) -> DataFrame:
    """Every day from the first to the last of each series; `Is_valid` is 0 where a value is missing.

    One row per day and series is expected. Each row spans the days up to the next one,
    so nothing is joined against a calendar.
    """
    keyed = df.select(*by, day_number(F.col(time)).alias("_day"), *cols)
    spans = _with_next(keyed, by, "_day", [], chunk_days)
    last = F.coalesce(F.col("_next.day") - 1, F.col("_day"))
    days = spans.withColumn("_d", F.explode(F.sequence(F.col("_day"), last)))
    real = F.col("_d") == F.col("_day")
    complete = real
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    return days.select(
        *by,
        F.date_add(F.lit("1970-01-01").cast("date"), F.col("_d")).alias(time),
        *[F.when(real, F.col(c)).alias(c) for c in cols],
        complete.cast("int").alias("Is_valid"),
    )


def interpolate_linear(
    df: DataFrame, by: Sequence[str], position: Column, cols: Sequence[str], chunk: int = CHUNK_DAYS
) -> DataFrame:
    """Linear in `position` inside gaps; trailing nulls take the last value, leading ones stay."""
    keyed = df.withColumn("_p", position).withColumn("_chunk", F.floor(F.col("_p") / F.lit(chunk)))
    point = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_p").alias("p"), F.col(c).alias("v"))) for c in cols}
    edges = keyed.groupBy(*by, "_chunk").agg(
        *[F.max_by(point[c], F.when(F.col(c).isNotNull(), F.col("_p"))).alias(f"_l_{c}") for c in cols],
        *[F.min_by(point[c], F.when(F.col(c).isNotNull(), F.col("_p"))).alias(f"_f_{c}") for c in cols],
    )
    chunks = Window.partitionBy(*by).orderBy("_chunk")
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    after = chunks.rowsBetween(1, Window.unboundedFollowing)
    carried = edges.select(
        *by,
        "_chunk",
        *[F.last(f"_l_{c}", ignorenulls=True).over(before).alias(f"_b_{c}") for c in cols],
        *[F.first(f"_f_{c}", ignorenulls=True).over(after).alias(f"_a_{c}") for c in cols],
    )
    rows = Window.partitionBy(*by, "_chunk").orderBy("_p")
    back = rows.rowsBetween(Window.unboundedPreceding, 0)
    ahead = rows.rowsBetween(0, Window.unboundedFollowing)
    near = keyed.withColumns(
        {f"_l_{c}": F.last(point[c], ignorenulls=True).over(back) for c in cols}
        | {f"_f_{c}": F.first(point[c], ignorenulls=True).over(ahead) for c in cols}
    ).join(carried, [*by, "_chunk"])

    def value(c: str) -> Column:
        left = F.coalesce(f"_l_{c}", f"_b_{c}")
        right = F.coalesce(f"_f_{c}", f"_a_{c}")
        share = (F.col("_p") - left["p"]) / F.nullif(right["p"] - left["p"], F.lit(0))
        between = left["v"] + (right["v"] - left["v"]) * share
        return F.coalesce(F.col(c), F.when(right.isNull(), left["v"]).otherwise(between)).alias(c)

    return near.select(*[value(c) if c in cols else F.col(c) for c in df.columns])


def upsample_daily(
    df: DataFrame, by: Sequence[str], time: str, cols: Sequence[str], chunk_days: int = CHUNK_DAYS
) -> DataFrame:
    """Sparse composites to daily values, linear between neighbours, first to last date.

    Rows must carry no nulls. `Is_valid` marks the days that were observed.
    """
    keyed = df.select(*by, day_number(F.col(time)).alias("_day"), *cols)
    spans = _with_next(keyed, by, "_day", cols, chunk_days)
    last = F.coalesce(F.col("_next.day") - 1, F.col("_day"))
    days = spans.withColumn("_d", F.explode(F.sequence(F.col("_day"), last)))
    share = (F.col("_d") - F.col("_day")) / F.nullif(F.col("_next.day") - F.col("_day"), F.lit(0))
    return days.select(
        *by,
        F.date_add(F.lit("1970-01-01").cast("date"), F.col("_d")).alias(time),
        *[
            F.when(F.col("_d") == F.col("_day"), F.col(c))
            .otherwise(F.col(c) + (F.col(f"_next.{c}") - F.col(c)) * share)
            .alias(c)
            for c in cols
        ],
        (F.col("_d") == F.col("_day")).cast("int").alias("Is_valid"),
    )


def sequence_windows(
    df: DataFrame, by: Sequence[str], position: Column, cols: Sequence[str], length: int, chunk: int = 4096
) -> DataFrame:
    """All stride-1 windows of `length` rows inside a series: n - length + 1 of them, or none.

    `position` numbers the rows of a series without gaps (a day number after `fill_days`,
    or a rank). Output: keys, `start` position, `steps` array in order.
    """
    width = max(chunk, length)
    own = F.floor(F.col("_p") / F.lit(width))
    reaches_back = F.pmod(F.col("_p"), F.lit(width)) < length - 1
    keyed = df.withColumn("_p", position).withColumn("_own", own).withColumn(
        "_chunk", F.explode(F.when(reaches_back, F.array(own - 1, own)).otherwise(F.array(own)))
    )
    window = Window.partitionBy(*by, "_chunk").orderBy("_p").rowsBetween(0, length - 1)
    return (
        keyed.withColumn("steps", F.collect_list(F.struct(*cols)).over(window))
        .where((F.col("_chunk") == F.col("_own")) & (F.size("steps") == length))
        .select(*by, F.col("_p").alias("start"), "steps")
    )


def check_daily(df: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """Series whose days do not run without a gap: last - first + 1 differs from the row count."""
    spans = df.groupBy(*by).agg(
        F.min(time).alias("first_day"), F.max(time).alias("last_day"), F.count(F.lit(1)).alias("n_rows")
    )
    return spans.withColumn(
        "expected", (F.datediff("last_day", "first_day") + 1).cast("long")
    ).where(F.col("expected") != F.col("n_rows"))


def truncate_at_gap(df: DataFrame, required: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """Rows of each month before the first day on which `required` has no data for the series."""
    keys = [*by, "_month"]
    months = df.select(*by, F.trunc(time, "month").alias("_month")).distinct()
    present = required.select(*by, F.to_date(time).alias("_have")).distinct()
    expected = months.select(
        *keys, F.explode(F.sequence("_month", F.last_day("_month"))).alias("_have")
    )
    first_missing = (
        expected.join(present, [*by, "_have"], "left_anti").groupBy(*keys).agg(F.min("_have").alias("_stop"))
    )
    return (
        df.withColumn("_month", F.trunc(time, "month"))
        .join(first_missing, keys, "left")
        .where(F.col("_stop").isNull() | (F.to_date(time) < F.col("_stop")))
        .drop("_month", "_stop")
    )
