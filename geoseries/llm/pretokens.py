"""Cached encoding of the pieces that a byte-level vocabulary's pattern cuts a text into.

Merges never cross a piece, so a text's ids are those of its pieces in a row. Many texts are cut at once with array
operations, pieces are found again by 64-bit hashes and compared, and only pieces a worker has not met before are encoded.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import public_tokenizers

#: Unicode white space, which the pattern's \s means in both tokenizer libraries (Python's \s holds more).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
END, LETTER, NUMBER, BLANK, OTHER = range(5)
#: Stands between two texts; no character has this number.
BETWEEN = 0x110000
FACTOR = 0xD6E8FEB86659FD93


def _kinds() -> np.ndarray:
    """Kind of each code point, by its Unicode category."""
    of = {"L": LETTER, "N": NUMBER}
    kinds = np.array([of.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)] + [END], np.uint8)
    kinds[WHITE] = BLANK
    return kinds


_TABLE: list[np.ndarray] = []


def cut(points: np.ndarray) -> np.ndarray:
    """First places of the pieces of code points in which `BETWEEN` ends every text; the marks are pieces too.

    States public_tokenizers.PATTERN in array form: runs of letters, numbers or other characters take one blank in front;
    of a run of white space all but the last character form a piece, or all where the text ends; an apostrophe that
    starts a piece takes s, t, re, ve, m, ll or d with it.
    """
    if not _TABLE:
        _TABLE.append(_kinds())
    kind = _TABLE[0][points]
    run = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == END)]))
    first = np.zeros(len(points), bool)
    first[run] = True
    spaces = run[kind[run] == BLANK]
    after = run[np.searchsorted(run, spaces, side="right")]  # a mark follows every text, so there is a next run
    first[(after - 1)[kind[after] != END]] = True
    words = run[(kind[run] != BLANK) & (kind[run] != END) & (run > 0)]
    first[words[points[words - 1] == 0x20]] = False

    quote = np.flatnonzero((points == 0x27) & first)
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        one, two = points[quote + 1], points[np.minimum(quote + 2, len(points) - 1)]
        width = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for pair in ("re", "ve", "ll"):
            width[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
        quote, width = quote[width > 0], width[width > 0]
        first[quote + 1] = False
        rest = quote + 1 + width
        first[rest[kind[rest] == LETTER]] = True
    return np.flatnonzero(first)


#: Code points of a piece that are compared as two 64-bit words, and those above which a piece is not cached at all.
PACKED, LONGEST = 16, 64
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def packed(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 code points of pieces, all below 256, as two numbers of a byte each."""
    low = np.zeros(len(points) + PACKED + 8, np.uint8)
    low[: len(points)] = points  # larger ones belong to no piece that is asked for
    two = low[:-1] | (low[1:].astype(np.uint16) << 8)
    four = two[:-2] | (two[2:].astype(np.uint32) << 16)
    eight = four[:-4] | (four[4:].astype(np.uint64) << np.uint64(32))
    return eight[starts] & MASKS[np.minimum(sizes, 8)], eight[starts + 8] & MASKS[np.clip(sizes - 8, 0, 8)]


def hashes(first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where to look for pieces, from their code points and length."""
    mixed = (first * np.uint64(FACTOR)) ^ ((second + sizes.astype(np.uint64)) * np.uint64(0xA24BAED4963EE407))
    return mixed ^ (mixed >> np.uint64(29))


class _Column:
    """A growing array of whole numbers."""

    def __init__(self, kind, size: int = 1 << 12):
        self.held, self.used = np.zeros(size, kind), 0

    def append(self, values: np.ndarray) -> None:
        if self.used + len(values) > len(self.held):
            self.held = np.concatenate([self.held[: self.used], np.zeros(self.used + len(values), self.held.dtype)])
        self.held[self.used : self.used + len(values)] = values
        self.used += len(values)


class PieceCache:
    """Ids of texts by way of their pieces; `encode_pieces` gets new pieces and returns their id lists.

    A hash only says where to look. Pieces of up to `PACKED` code points below 256 are compared, code point by code point, with
    the cached ones as two numbers; one that differs is encoded by itself. Others up to `LONGEST` are looked up by their
    code points, longer ones are never cached.
    """

    def __init__(self, pattern: str, encode_pieces: Callable[[list[str]], list[list[int]]], limit: int = 300_000):
        if pattern != public_tokenizers.PATTERN:
            raise ValueError("only the pattern of the public byte-level vocabularies is known")
        self.encode_pieces, self.limit = encode_pieces, limit
        self._clear()

    def _clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes, and where their piece stands
        self.place, self.count, self.size = (_Column(np.int64) for _ in range(3))
        self.first, self.second = (_Column(np.uint64) for _ in range(2))
        self.ids = _Column(np.uint32, 1 << 16)
        self.others: dict[bytes, list[int]] = {}

    def _learn(self, keys: np.ndarray, first: np.ndarray, second: np.ndarray, pieces: list[str]) -> None:
        found = self.encode_pieces(pieces)
        count = np.array([len(f) for f in found], np.int64)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, at, keys), np.insert(self.rows, at, np.arange(self.place.used, self.place.used + len(keys)))
        self.place.append(self.ids.used + np.cumsum(count) - count)
        self.ids.append(np.fromiter((i for f in found for i in f), np.uint32, int(count.sum())))
        for column, values in ((self.count, count), (self.size, [len(p) for p in pieces]), (self.first, first), (self.second, second)):
            column.append(np.asarray(values))

    def _find(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, count) of the ids of pieces of up to `PACKED` code points below 256, and whether these are their own."""
        first, second = packed(points, starts, sizes)
        keys = hashes(first, second, sizes)
        mine, one, which = np.unique(keys, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, mine), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != mine) if len(self.keys) else np.arange(len(mine))
        if len(self.keys) and len(self.keys) + len(new) > self.limit:  # bounded memory: start over
            self._clear()
            new = np.arange(len(mine))
        if len(new):
            some = one[new]
            low = points.astype(np.uint8).tobytes()
            pieces = [low[a : a + n].decode("latin-1") for a, n in zip(starts[some].tolist(), sizes[some].tolist())]
            self._learn(mine[new], first[some], second[some], pieces)
            at = np.searchsorted(self.keys, mine)
        row = self.rows[at][which] if len(mine) else np.zeros(0, np.int32)
        own = (self.first.held[row] == first) & (self.second.held[row] == second) & (self.size.held[row] == sizes)
        return self.place.held[row], self.count.held[row], own

    def _others(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
        """Ids of pieces that are told by their code points alone."""
        if len(self.others) > self.limit // 4:
            self.others.clear()
        names = [points[a : a + n].tobytes() for a, n in zip(starts, sizes)]
        new = list({k: None for k in names if k not in self.others})
        found = dict(zip(new, self.encode_pieces([k.decode("utf-32-le", "surrogatepass") for k in new]) if new else []))
        self.others.update((k, ids) for k, ids in found.items() if len(k) <= 4 * LONGEST)
        return [found[k] if k in found else self.others[k] for k in names]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (unsigned 32-bit) of each text."""
        if not texts:
            return []
        joined = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        mark = np.array([BETWEEN], np.uint32)
        points = np.concatenate([p for t in joined for p in (t, mark)])
        starts = cut(points)
        sizes = np.diff(starts, append=len(points))
        marks = points[starts] == BETWEEN
        short = (sizes <= PACKED) & ~marks
        wide = np.flatnonzero(points > 0xFF)
        if len(wide) > len(texts):
            short[np.searchsorted(starts, wide, side="right") - 1] = False
        at = np.flatnonzero(short)
        place, count = np.zeros((2, len(starts)), np.int64)
        place[at], count[at], own = self._find(points, starts[at], sizes[at])
        odd = np.union1d(np.flatnonzero(~short & ~marks), at[~own])
        ids = self.ids.held
        if len(odd):
            found = self._others(points, starts[odd], sizes[odd])
            count[odd] = [len(f) for f in found]
            place[odd] = self.ids.used + np.cumsum(count[odd]) - count[odd]
            ids = np.concatenate([ids[: self.ids.used], np.fromiter((i for f in found for i in f), np.uint32, int(count[odd].sum()))])
        total = np.cumsum(count)
        ids = ids[np.repeat(place - (total - count), count) + np.arange(total[-1])]
        return np.split(ids, total[np.flatnonzero(marks)][:-1])

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]
