"""Exact ranks that never sort a whole group in one task.

A group is cut into chunks that follow the sort order, of about the same number of rows
whatever the keys are like. Each chunk is sorted on its own; chunk sizes, one small row per
chunk, give the offset. A station that holds a third of all rows is therefore spread over as
many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoseries.functions.calendar import day_number

#: Rows of a chunk, about, and sampled rows for each cut between two chunks.
CHUNK_ROWS, SAMPLES = 100_000, 16


def time_chunk(time: Column, days: int = 1) -> Column:
    """Chunk number of a date or timestamp for series of one row per day; chunks follow time."""
    return F.floor(day_number(time) / F.lit(days))


def row_hash(seed: object, *columns: str | Column) -> Column:
    """Seeded md5 of the key columns: a reproducible shuffle order."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def balanced_cuts(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], rows: int = CHUNK_ROWS) -> DataFrame:
    """`by`, `_cuts`: sorted order keys that cut each group into chunks of about `rows` rows; groups of one chunk are left out.

    Cuts are order keys of rows drawn by a hash of these keys, the same whenever the table is read. A busy moment is cut by
    the columns that break ties; only rows equal in all order columns stay together.
    """
    rate = max(1, rows // SAMPLES)
    keys = [c.alias(f"_{i}") for i, c in enumerate(_columns(order))]
    drawn = df.where(F.pmod(F.xxhash64(*_columns(order)), F.lit(rate)) == 0).select(*by, F.struct(*keys).alias("_key"))
    along = F.row_number().over(Window.partitionBy(*by).orderBy("_key"))
    every = drawn.withColumn("_k", along).where(F.col("_k") % max(1, rows // rate) == 0)
    return every.groupBy(*by).agg(F.array_sort(F.collect_list("_key")).alias("_cuts"))


def with_balanced_chunks(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], rows: int = CHUNK_ROWS) -> DataFrame:
    """`df` with `_chunk`, the number of cuts of the row's group at or below its order key, found by halving.

    The cuts go to all tasks, one key for about `rows` rows: a join by the group would bring each group into one task.
    """
    cuts = balanced_cuts(df, by, order, rows)
    top = F.floor(F.log2(F.size("_cuts"))).cast("int")
    cuts = cuts.withColumn("_steps", F.transform(F.sequence(F.lit(0), top), lambda i: F.pow(F.lit(2), top - i).cast("int")))
    if by:
        joined = df.join(F.broadcast(cuts), list(by), "left")
    else:
        joined = df.withColumn("_all", cuts.select(F.struct("_cuts", "_steps")).scalar()).select(*df.columns, "_all.*")
    key = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(_columns(order))])
    further = lambda at, step: at + F.when(F.get("_cuts", at + step - 1) <= key, step).otherwise(0)
    chunk = F.coalesce(F.aggregate("_steps", F.lit(0), further), F.lit(0))
    return joined.select(*df.columns, chunk.alias("_chunk"))


def chunk_offsets(sizes: DataFrame, by: Sequence[str], total: str | None = None) -> DataFrame:
    """Rows before each chunk, from one row per chunk (`by`, `_chunk`, `_size`)."""
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    columns = [*by, "_chunk", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")]
    if total:
        columns.append(F.sum("_size").over(whole).alias(total))
    return sizes.select(*columns)


def chunked_rank(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    chunk: Column | None = None,
    name: str = "rn",
    total: str | None = None,
    rows: int = CHUNK_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """row_number over (`by` order by `order`), plus the group size if `total` is named.

    Without a `chunk`, groups are cut into balanced chunks of about `rows` rows. A given `chunk` must not decrease along
    `order`; key columns and `chunk` must not be null. Where the chunks are counted already, `sizes` has `by`, `_chunk`, `_size`.
    """
    keyed = with_balanced_chunks(df, by, order, rows) if chunk is None else df.withColumn("_chunk", chunk)
    if sizes is None:
        sizes = keyed.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    offsets = chunk_offsets(sizes, by, total)
    inside = Window.partitionBy(*by, "_chunk").orderBy(*order)
    ranked = keyed.withColumn(name, F.row_number().over(inside)).join(offsets, [*by, "_chunk"])
    kept = [c for c in df.columns if c != name]
    extra = [F.col(total)] if total else []
    return ranked.select(*kept, (F.col(name) + F.col("_before")).alias(name), *extra)


def hash_rank(
    df: DataFrame,
    by: Sequence[str],
    seed: object,
    keys: Sequence[str | Column],
    name: str = "rn",
    total: str | None = None,
    ties: Sequence[str] = (),
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Position of each row in a seeded shuffle of its group."""
    hashed = df.withColumn("_hash", row_hash(seed, *keys))
    return chunked_rank(hashed, by, ["_hash", *ties], None, name, total, rows).drop("_hash")
