"""Exact deduplication by two passes over Bloom filters.

Pass one puts a 64-bit prefix of every text's SHA-256 into a filter cut into segments: each task sends the
bit positions it met (coded as gaps of a few bits), each segment keeps the positions that were met more than
once. Pass two looks every row up in that second filter: rows it does not hold are certainly unique and pass
straight through; the others shuffle by their full digest, so the result is exact whatever the filter says.

The second filter is broadcast. Its size is `bits`: about sixteen per row, never above `max_bits` (32 MB by
default). Past that bound more unique rows shuffle their digest and id; nothing is dropped.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoseries.llm.common import staged, text_or_empty

BITS_PER_ROW = 16
MAX_BITS = 1 << 28
SEGMENT_BITS = 1 << 20
MERGE_SALTS = 64


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    """Power of two of at least sixteen bits per row, within [2**16, max_bits]."""
    bits = 1 << 16
    while bits < rows * BITS_PER_ROW and bits < max_bits:
        bits *= 2
    return bits


def _positions(prefixes, bits: int) -> np.ndarray:
    return (np.asarray(prefixes, dtype=np.int64).view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)


def _gaps(at: np.ndarray) -> bytes:
    return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes(), 1)


def _from_gaps(coded: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(coded), "<u4").astype(np.int64))


def repeated_positions(prefixes: DataFrame, bits: int) -> bytes:
    """Bitmap of the filter positions that two or more rows of `prefixes` (column `prefix` long) fall on."""
    width = min(SEGMENT_BITS, bits)
    part_schema = "segment long, salt long, once binary, again binary"

    def local(batches):
        held = [_positions(b.column(0).to_numpy(zero_copy_only=False), bits) for b in batches]
        if not held:
            return
        met, counts = np.unique(np.concatenate(held), return_counts=True)
        starts = np.searchsorted(met, np.arange(0, bits + 1, width))
        salt = TaskContext.get().partitionId() % MERGE_SALTS
        for segment in np.flatnonzero(np.diff(starts)):
            part = slice(starts[segment], starts[segment + 1])
            at = met[part] - segment * width
            yield _part(segment, salt, at, at[counts[part] > 1])

    def _part(segment, salt, once, again):
        columns = [pa.array([int(segment)]), pa.array([int(salt)]), pa.array([_gaps(once)], pa.binary()), pa.array([_gaps(again)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["segment", "salt", "once", "again"])

    def merge(key, parts):
        once, again = np.zeros(width, bool), np.zeros(width, bool)
        for met, more in zip(parts.column("once"), parts.column("again")):
            at = _from_gaps(met.as_py())
            again[at[once[at]]] = True
            once[at] = True
            again[_from_gaps(more.as_py())] = True
        return pa.Table.from_batches([_part(key[0].as_py(), 0, np.flatnonzero(once), np.flatnonzero(again))])

    partial = prefixes.select("prefix").mapInArrow(local, part_schema)
    # Two steps, so that no task gets the parts of all tasks for a segment.
    salted = partial.groupBy("segment", "salt").applyInArrow(merge, part_schema)
    merged = salted.groupBy("segment").applyInArrow(merge, part_schema)
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in merged.select("segment", "again").collect():  # at most bits / 8 bytes of bits in all
        held = np.zeros(width, bool)
        held[_from_gaps(row["again"])] = True
        bitmap[row["segment"] * width // 8 : (row["segment"] + 1) * width // 8] = np.packbits(held)
    return bitmap.tobytes()


def with_possible_repeats(rows: DataFrame, bitmap: bytes, bits: int, prefix: str = "prefix", flag: str = "possible") -> DataFrame:
    """Rows with a boolean: does the filter hold their prefix?"""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)  # bits / 8 bytes

    @F.pandas_udf("boolean")
    def holds(prefixes):
        held = np.frombuffer(shared.value, np.uint8)
        at = _positions(prefixes.to_numpy(), bits)
        return pd.Series((held[at >> 3] >> (7 - (at & 7))) & 1 == 1)

    return rows.withColumn(flag, holds(F.col(prefix)))


def _prefix(digest):
    return F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("long")


def copy_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, `keep_id` (largest id among equal texts), `group_size`, `kept`, `text_sha256`.

    Null text counts as empty and equals it. A null id sorts below all others: it stays only when every id of
    its group is null. Rows repeated with the same id: one of them is kept. An empty table gives an empty one.
    Other columns of `docs` are not read.
    """
    digests = staged(
        docs.select(
            F.col(f"`{key}`").alias("id"),
            F.monotonically_increasing_id().alias("uid"),
            F.unhex(F.sha2(text_or_empty(text), 256)).alias("digest"),
        ),
        "digests",
    ).withColumn("prefix", _prefix(F.col("digest")))
    bits = filter_bits(digests.count(), max_bits)
    bitmap = repeated_positions(digests, bits)
    flagged = with_possible_repeats(digests, bitmap, bits)

    unique = flagged.filter(~F.col("possible")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    possible = flagged.filter("possible").drop("possible", "prefix")
    # Staged, so that both sides of the join are plain exchanges and a hot group can be split.
    groups = staged(
        possible.groupBy("digest").agg(F.max(F.struct("id", "uid")).alias("best"), F.count(F.lit(1)).alias("group_size")), "groups"
    )
    repeated = possible.join(groups, "digest").select(
        "id", F.col("best.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "digest"
    )
    return unique.union(repeated).select(
        F.col("id").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """`docs` with all its columns, one row of each group of equal texts (that with the largest id).

    Only rows the filter marks as possibly repeated shuffle, after each task has kept one of each group.
    Nulls, ties and empty tables as in `copy_groups`.
    """
    bits = filter_bits(docs.count(), max_bits)
    inner = [f"c{i}" for i in range(len(docs.columns))]  # free of clashes with columns of the input
    renamed = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, inner)],
        F.unhex(F.sha2(text_or_empty(text), 256)).alias("digest"),
    ).withColumn("prefix", _prefix(F.col("digest")))
    flagged = with_possible_repeats(renamed, repeated_positions(renamed, bits), bits)
    best = (
        flagged.filter("possible")
        .groupBy("digest")
        .agg(F.max_by(F.struct(*inner), F.struct(inner[docs.columns.index(key)])).alias("row"))
        .select("row.*")
    )
    return flagged.filter(~F.col("possible")).select(*inner).union(best).toDF(*docs.columns)
