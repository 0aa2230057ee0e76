"""Byte-level BPE through a sentencepiece model serialised directly from a rank file.

Every vocabulary entry becomes a piece: its bytes mapped to printable characters, scored by minus its rank,
with the identity normaliser. Merging the best-scored neighbours first is then merging by rank. Texts are cut
by the vocabulary's pattern, each piece is encoded on its own, and ids go back to bytes by the inverse map.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoseries.llm.common import rows_of, text_or_empty
from geoseries.llm.pretokens import PieceCache

#: Name of the unknown piece: U+2047 is no byte's character, so no text contains it.
UNKNOWN = "⁇"


def byte_characters() -> list[str]:
    """The usual printable character of each byte: itself where Latin-1 prints it, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(value: int) -> bytes:
    out = bytearray()
    value &= (1 << 64) - 1
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _bytes_field(number: int, content: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(content)) + content


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto (wire format): piece i + 1 is the entry of rank i, piece 0 the unknown one."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    shown = byte_characters()
    # message SentencePiece: piece = 1, score = 2 (float), type = 3 (UNKNOWN = 2, NORMAL = 1)
    out = [_bytes_field(1, _bytes_field(1, UNKNOWN.encode()) + b"\x15" + struct.pack("<f", 0.0) + _int_field(3, 2))]
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        piece = "".join(shown[b] for b in token).encode()
        out.append(_bytes_field(1, _bytes_field(1, piece) + b"\x15" + struct.pack("<f", -float(rank)) + _int_field(3, 1)))
    # TrainerSpec: model_type = 3 (BPE = 2), vocab_size = 4, unk_piece = 45
    out.append(_bytes_field(2, _int_field(3, 2) + _int_field(4, len(ranks) + 1) + _bytes_field(45, UNKNOWN.encode())))
    # NormalizerSpec: name = 1, add_dummy_prefix = 3, remove_extra_whitespaces = 4, escape_whitespaces = 5
    out.append(_bytes_field(3, _bytes_field(1, b"identity") + _int_field(3, 0) + _int_field(4, 0) + _int_field(5, 0)))
    return b"".join(out)


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        from sentencepiece import SentencePieceProcessor

        ranks = read_ranks(path)
        shown = byte_characters()
        self.model = SentencePieceProcessor(model_proto=serialised_model(ranks))
        self.to_shown = {i: c for i, c in enumerate(shown)}
        to_byte = {c: b for b, c in enumerate(shown)}
        pieces = (self.model.id_to_piece(i + 1) for i in range(len(ranks)))
        self.tokens = [bytes(to_byte[c] for c in piece) for piece in pieces]
        self.cache = PieceCache(pattern, self._pieces)

    def _pieces(self, pieces: list[str]) -> list[list[int]]:
        # Bytes read as Latin-1 are code points 0 to 255, which translate() maps.
        mapped = [p.encode().decode("latin-1").translate(self.to_shown) for p in pieces]
        return [[i - 1 for i in ids] for ids in self.model.encode(mapped, num_threads=1)]

    def encode(self, text: str) -> np.ndarray:
        return self.cache.encode(text)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker and vocabulary."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _mapped(docs: DataFrame, key: str, text: str, schema: str, make) -> DataFrame:
    source = docs.select(docs[f"`{key}`"].cast("long").alias("doc_id"), text_or_empty(text).alias("text"))

    def run(batches):
        for batch in rows_of(batches, 64):
            yield make(batch.column("doc_id"), batch.column("text").to_pylist())

    return source.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `ids` (array of int) of every whole text; null counts as empty, which has no ids."""

    def make(keys, texts):
        found = [ids.astype(np.int32) for ids in codec(path, pattern).cache.encode_many(texts)]
        return pa.RecordBatch.from_arrays([keys, pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _mapped(docs, key, text, "doc_id long, ids array<int>", make)


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """`doc_id`, `content` (binary): the bytes of each id list; null counts as empty."""
    source = encoded.select(encoded[f"`{key}`"].cast("long").alias("doc_id"), encoded[f"`{ids}`"].alias("ids"))

    def run(batches):
        for batch in rows_of(batches):
            content = [codec(path, pattern).decode(i or ()) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(content, pa.binary())], ["doc_id", "content"])

    return source.mapInArrow(run, "doc_id long, content binary")


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of encoding and decoding every whole text in one pass.

    `doc_id`, `n_tokens`, `ids_sha256` (decimal ids joined by one space), `decoded_sha256` (bytes decoded from
    the ids). Null text counts as empty; repeated rows give repeated rows; other columns are not read.
    """

    def make(keys, texts):
        counts, of_ids, of_bytes = [], [], []
        own = codec(path, pattern)
        for ids in own.cache.encode_many(texts):
            ids = ids.tolist()
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return _mapped(docs, key, text, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
