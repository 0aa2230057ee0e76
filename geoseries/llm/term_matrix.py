"""Sparse document-term matrix of a corpus in compressed sparse rows (CSR), one shard per row of a table.

Words are first numbered inside a shard, which bounds what leaves it: one row for each distinct word, whatever its number of
occurrences. These rows meet at their word once, where each word of all shards gets its number of the global dictionary; the
numbers go back to the shards, which rewrite their columns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from geoseries.llm.common import rows_of, staged, text_or_empty

#: A shard ends with the document that reaches either; a longer document is a shard of its own.
SHARD_BYTES, SHARD_ROWS = 8 << 20, 8192
#: Columns of shards: little-endian numbers of `starts`, `columns` and `counts`, as `pack` leaves them.
LOCAL, GLOBAL = "<i4", "<i8"


def pack(values: np.ndarray, kind: str) -> bytes:
    """Whole numbers as compressed differences between neighbours."""
    return zstandard.ZstdCompressor(1).compress(np.diff(values.astype(kind), prepend=np.zeros(1, kind)).tobytes())


def unpack(raw: bytes, kind: str) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind), dtype=np.int64)


class _Shard:
    """Rows of one shard with columns numbered by first occurrence."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.columns: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.marks: list[int] = []
        self.kept: list[pa.Array] = []
        self.bytes = 0

    def add(self, raw: bytes, mark: int) -> None:
        found = Counter(raw.split())  # bytes are split at \x20 and \x09-\x0D, nothing else
        known = self.words
        self.columns.append(np.fromiter((known.setdefault(w, len(known)) for w in found), np.int32, len(found)))
        self.counts.append(np.fromiter(found.values(), np.int32, len(found)))
        self.marks.append(mark)
        self.bytes += len(raw)

    def batch(self, number: int, names: list[str]) -> pa.RecordBatch:
        sizes = np.array([len(c) for c in self.columns])
        columns, counts = np.concatenate(self.columns), np.concatenate(self.counts)
        order = np.lexsort((columns, np.repeat(np.arange(len(sizes)), sizes)))
        parts = [np.array(self.marks, np.uint8).tobytes(), pack(np.append(0, np.cumsum(sizes)), LOCAL), pack(columns[order], LOCAL), pack(counts[order], LOCAL)]
        words = pa.array(list(self.words), pa.binary()).cast(pa.string())
        arrays = [pa.array([number], pa.int64()), _list_of(pa.concat_arrays(self.kept)), *[pa.array([p], pa.binary()) for p in parts], _list_of(words)]
        return pa.RecordBatch.from_arrays(arrays, names)


def _list_of(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def local_shards(
    docs: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    marks: Callable[[bytes], int] | None = None,
    most: tuple[int, int] = (SHARD_BYTES, SHARD_ROWS),
) -> DataFrame:
    """Shards with columns numbered inside each: `shard`, `kept` (structs of the `keep` columns, a row's at its place), `marks`,
    `starts`, `columns`, `counts` (packed) and `words`, the shard's own dictionary.

    `marks` may take up to eight yes/no properties from a text's UTF-8 bytes in the same pass. `most` bounds a shard's bytes of
    text and its rows. Null texts are empty rows.
    """
    source = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]).alias("kept"), text_or_empty(text).alias("text"))
    kind = source.schema["kept"].dataType
    names = ["shard", "kept", "marks", "starts", "columns", "counts", "words"]

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        shard = _Shard()
        for batch in rows_of(batches):
            kept, first = batch.column("kept"), 0
            for k, raw in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                shard.add(raw, marks(raw) if marks else 0)
                if shard.bytes >= most[0] or len(shard.marks) >= most[1]:
                    shard.kept.append(kept.slice(first, k + 1 - first))
                    yield shard.batch(number, names)
                    number, shard, first = number + 1, _Shard(), k + 1
            if first < batch.num_rows:
                shard.kept.append(kept.slice(first))
        if shard.marks:
            yield shard.batch(number, names)

    result = T.StructType(
        [T.StructField("shard", T.LongType()), T.StructField("kept", T.ArrayType(kind))]
        + [T.StructField(c, T.BinaryType()) for c in names[2:6]]
        + [T.StructField("words", T.ArrayType(T.StringType()))]
    )
    return source.mapInArrow(run, result)


def numbered(shards: DataFrame, parts: int | None = None) -> DataFrame:
    """`word`, `id`, `shard`, `place`: the dictionary number of each word at its place in each shard.

    A word's number is parts * k + p if it is the k-th word of task p of `parts`, so numbers are unique and dense but for the
    unevenness of the tasks. It is the place of the word in the sorted task, the same whenever the task is run again.
    """
    parts = parts or int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = shards.select(F.posexplode("words").alias("place", "word"), "shard").select("word", "shard", "place")

    def run(batches):
        part, last, before = TaskContext.get().partitionId(), None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("word")
            fresh = np.ones(batch.num_rows, np.int64)
            fresh[1:] = pa.compute.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
            fresh[0] = words[0].as_py() != last
            numbers = before + np.cumsum(fresh)
            last, before = words[-1].as_py(), int(numbers[-1])
            yield pa.RecordBatch.from_arrays([words, pa.array(numbers * parts + part), batch.column("shard"), batch.column("place")], ["word", "id", "shard", "place"])

    return rows.repartition(parts, "word").sortWithinPartitions("word").mapInArrow(run, "word string, id long, shard long, place int")


def dictionary(numbers: DataFrame) -> DataFrame:
    """`word`, `id`: every distinct word."""
    return numbers.select("word", "id").distinct()


def encode(shards: DataFrame, numbers: DataFrame) -> DataFrame:
    """The matrix: `shards` with `columns` in the numbers of the dictionary, ascending in a row (packed as `GLOBAL`)."""
    own = numbers.select(F.col("shard").alias("of"), "place", "id")
    rows = shards.drop("words")

    def renamed(shard: pa.Table, numbers: pa.Table) -> pa.Table:
        of = np.zeros(len(numbers), np.int64)
        of[numbers.column("place").to_numpy()] = numbers.column("id").to_numpy()
        starts, local, counts = (unpack(shard.column(c)[0].as_py(), LOCAL) for c in ("starts", "columns", "counts"))
        order = np.lexsort((of[local], np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
        for name, raw in (("columns", pack(of[local][order], GLOBAL)), ("counts", pack(counts[order], LOCAL))):
            shard = shard.set_column(shard.schema.get_field_index(name), name, pa.array([raw], pa.binary()))
        return shard

    return rows.groupBy("shard").cogroup(own.groupBy("of")).applyInArrow(renamed, rows.schema)


def term_matrix(
    docs: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    marks: Callable[[bytes], int] | None = None,
    most: tuple[int, int] = (SHARD_BYTES, SHARD_ROWS),
) -> tuple[DataFrame, DataFrame]:
    """(matrix, dictionary) of all documents. Words are maximal runs without \\x20 and \\x09-\\x0D, as written."""
    shards = staged(local_shards(docs, text, keep, marks, most), "shards")
    numbers = numbered(shards)
    return encode(shards, numbers), dictionary(numbers)


def row_totals(matrix: DataFrame) -> DataFrame:
    """Per document: its kept columns, `marks`, `n_words` (row sum) and `n_distinct` (nonzero entries)."""
    kind = matrix.schema["kept"].dataType.elementType
    own = T.StructType([T.StructField("marks", T.IntegerType()), T.StructField("n_words", T.LongType()), T.StructField("n_distinct", T.LongType())])
    wanted = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in [*kind.fields, *own.fields]])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                starts, counts = (unpack(batch.column(c)[k].as_py(), LOCAL) for c in ("starts", "counts"))
                sums = np.append(0, np.cumsum(counts))[starts]
                marks = np.frombuffer(batch.column("marks")[k].as_py(), np.uint8).astype(np.int32)
                totals = [pa.array(marks), pa.array(np.diff(sums)), pa.array(np.diff(starts))]
                yield pa.RecordBatch.from_arrays([*batch.column("kept")[k].values.flatten(), *totals], schema=wanted)

    return matrix.select("kept", "marks", "starts", "counts").mapInArrow(run, T.StructType(kind.fields + own.fields))
