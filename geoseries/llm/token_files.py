"""Token ids in Arrow stream files of equal-length sequences.

Documents are range-partitioned and sorted by id; each task tokenises its documents, strings their ids together
(an end id after each) and writes three Arrow IPC streams into the shared folder:

* `<part>.tokens.arrow`: batches of `ids` and `mask`, fixed-size lists of `length` unsigned ids (16 bits wide where the
  vocabulary fits, else 32) and of as many booleans. Every batch but the last holds `BATCH_ROWS` sequences, so sequence i lies at a computable place of the
  memory-mapped file and is read without a copy. The last sequence is padded; its mask is 0 there.
* `<part>.docs.arrow`: `doc_id`, `start` (place of the document's first id in the part), `n_tokens`.

A task writes under a name of its own and renames at the end, so a repeated task replaces whole files by equal ones.
The folder may be any URI that pyarrow's file systems open.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoseries.llm.common import rows_of, text_or_empty
from geoseries.llm.pretokens import PieceCache

BATCH_ROWS = 64
SEQUENCE = 2048
TOKENS, DOCS = ".tokens.arrow", ".docs.arrow"
DOC_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])



class Encoder:
    """Ids of texts. With `added`, the tokenizer file's added tokens are found in a text, as the library does by default;
    a text that holds one goes to the library whole. Without, its special tokens are ordinary text."""

    def __init__(self, path: str, pattern: str, added: bool):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        contents = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.found = re.compile("|".join(map(re.escape, contents))).search if added and contents else None
        self.pieces = PieceCache(pattern, self._library)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        whole = {i for i, t in enumerate(texts) if self.found(t)} if self.found else set()
        if not whole:
            return self.pieces.encode_many(texts)
        rest = iter(self.pieces.encode_many([t for i, t in enumerate(texts) if i not in whole]))
        return [np.array(self._library([t])[0], np.uint32) if i in whole else next(rest) for i, t in enumerate(texts)]


_ENCODERS: dict[tuple[str, str, bool], Encoder] = {}


def encoder(path: str, pattern: str, added: bool = False) -> Encoder:
    """One tokenizer per worker, file and way to take added tokens."""
    if (path, pattern, added) not in _ENCODERS:
        _ENCODERS[path, pattern, added] = Encoder(path, pattern, added)
    return _ENCODERS[path, pattern, added]


def id_type(path: str, end_id: int) -> str:
    """The narrowest type that holds every id of the vocabulary and the end id."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def token_schema(length: int, kind: str) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(np.dtype(kind)), length)), ("mask", pa.list_(pa.bool_(), length))])


class _Writer:
    """Packs id arrays into fixed-size lists and writes full batches as they fill."""

    def __init__(self, sink, length: int, kind: str):
        self.length, self.kind, self.held, self.size, self.total = length, kind, [], 0, 0
        self.stream = pa.ipc.new_stream(sink, token_schema(length, kind))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= BATCH_ROWS * self.length:
            self._flush(self.size - self.size % (BATCH_ROWS * self.length))

    def _flush(self, count: int) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        for start in range(0, count, BATCH_ROWS * self.length):
            self._batch(flat[start : min(start + BATCH_ROWS * self.length, count)])
        self.held, self.size = [flat[count:].copy()], len(flat) - count

    def _batch(self, ids: np.ndarray) -> None:
        padding = -len(ids) % self.length
        mask = np.repeat([True, False], [len(ids), padding])
        columns = [np.concatenate([ids, np.zeros(padding, self.kind)]), mask]
        schema = token_schema(self.length, self.kind)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(c), self.length) for c in columns]
        self.stream.write_batch(pa.RecordBatch.from_arrays(lists, schema=schema))

    def close(self) -> None:
        self._flush(self.size)
        self.stream.close()


def write_token_files(
    docs: DataFrame, uri: str, path: str, pattern: str, end_id: int, parts: int, key: str = "doc_id", text: str = "text",
    length: int = SEQUENCE, added: bool = False,
) -> list[tuple[str, int, int]]:
    """Write the files; returns (part name, documents, ids) of every part in order, one small row per file.

    Null text counts as empty: the document is its end id alone. Rows without an id come first. Rows that
    repeat an id lie side by side in order of their text. An empty table gives no files. `added`: see `Encoder`.
    """
    source = (
        docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )

    kind = id_type(path, end_id)

    def write(batches):
        part = f"part-{TaskContext.get().partitionId():06d}"
        store, folder = fs.FileSystem.from_uri(uri)
        own = {end: f"{folder}/.{part}-{uuid.uuid4().hex}{end}" for end in (TOKENS, DOCS)}
        encode, count, opened = encoder(path, pattern, added).encode_many, 0, None
        for batch in rows_of(batches, 64):
            if not batch.num_rows:
                continue
            if opened is None:
                store.create_dir(folder)
                opened = [store.open_output_stream(own[end]) for end in (TOKENS, DOCS)]
                tokens, index = _Writer(opened[0], length, kind), pa.ipc.new_stream(opened[1], DOC_SCHEMA)
            starts, sizes = [], []
            for ids in encode(batch.column("text").to_pylist()):
                starts.append(tokens.total)
                tokens.add(np.append(ids, np.uint32(end_id)))
                sizes.append(tokens.total - starts[-1])
            index.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts), pa.array(sizes)], schema=DOC_SCHEMA))
            count += batch.num_rows
        if opened is None:
            return
        tokens.close()
        index.close()
        for sink in opened:
            sink.close()
        for end in (TOKENS, DOCS):
            store.move(own[end], f"{folder}/{part}{end}")
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [count], "ids": [tokens.total]})

    done = source.mapInArrow(write, "part string, docs long, ids long").collect()  # one row per file
    return sorted((r["part"], r["docs"], r["ids"]) for r in done)


class TokenFile:
    """Random access to the sequences and ids of one part, over a memory map where the file is local."""

    def __init__(self, uri: str, part: str):
        store, folder = fs.FileSystem.from_uri(uri)
        name = f"{folder}/{part}{TOKENS}"
        source = pa.memory_map(name) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(name)
        self.batches = list(pa.ipc.open_stream(source))
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 0

    def sequence(self, row: int, column: str = "ids") -> np.ndarray:
        """One sequence of ids (a view of the file), or its mask (bits, so a copy)."""
        flat = self.batches[row // BATCH_ROWS].column(column).flatten()
        return flat.slice(row % BATCH_ROWS * self.length, self.length).to_numpy(zero_copy_only=column == "ids")

    def ids(self, start: int, count: int):
        """The ids from place `start` on, as views of at most one batch each."""
        width = BATCH_ROWS * self.length
        while count:
            flat = self.batches[start // width].column("ids").flatten().to_numpy()
            piece = flat[start % width : start % width + count]
            yield piece
            start, count = start + len(piece), count - len(piece)


def read_documents(spark: SparkSession, uri: str, parts: list[tuple[str, int, int]]) -> DataFrame:
    """Per document from the files: `doc_id`, `start` (ids of all documents before it), `n_tokens`, `ids_crc32`."""
    before, rows = 0, []
    for part, _, ids in parts:
        rows.append((part, before))
        before += ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)

    def read(batches):
        store, folder = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for part, offset in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist()):
                tokens = TokenFile(uri, part)
                with store.open_input_file(f"{folder}/{part}{DOCS}") as source:
                    for index in pa.ipc.open_stream(source):
                        sums = []
                        for start, count in zip(index.column("start").to_pylist(), index.column("n_tokens").to_pylist()):
                            crc = 0
                            for piece in tokens.ids(start, count):
                                crc = zlib.crc32(piece.astype("<u4"), crc)
                            sums.append(crc)
                        starts = pa.array(index.column("start").to_numpy() + offset)
                        yield pa.RecordBatch.from_arrays(
                            [index.column("doc_id"), starts, index.column("n_tokens"), pa.array(sums, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    files = spark.createDataFrame(rows, "part string, before long").repartition(len(rows), "part")
    return files.mapInArrow(read, schema)
