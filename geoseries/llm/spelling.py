"""Spelling variants: words one edit apart, found as close letter counts, and the more frequent form of each.

Two words that differ by one inserted, deleted or replaced letter agree outside of the third of the shorter word in which they
first differ, and their letter counts are at a squared distance of 2 at most. So words are blocked by length, third and what
surrounds it, shorter words of a block against one another and against those one letter longer; the Gram matrix of the letter
counts of a block gives all squared distances at once, and only pairs at most 2 apart are verified letter by letter. A pair is
counted in the block of its first difference only. Blocks of many words are cut again by thirds of the third, down to a single
letter, where the alphabet bounds them.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoseries.llm.common import rows_of, staged

#: Letters A-Z, a-z and U+00C0 to U+00FF as Latin-1 bytes, A-Z lowered; all else is a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Place of each letter in a count vector.
PLACES = np.array([c - 97 if 97 <= c <= 122 else c - 0xC0 + 26 if c >= 0xC0 else 0 for c in range(256)])
WIDTH = 26 + 64
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
#: Words of a block beyond which it is cut again, rows of a task, rows and letters of one Gram matrix.
SPLIT, TASK_ROWS, TILE_ROWS, TILE_LETTERS = 4096, 8192, 256, 1 << 22
BLOCK = ["size", "low", "high", "around"]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 97, letters: int = 5, times: int = 3) -> DataFrame:
    """`word`, `n`: runs of letters of at least `letters` code points that occur `times` times or more, A-Z lowered.

    Where `every` divides the crc32 of `<id>:<run>`, the run lacks its letter at that crc32 modulo its length. A null id is
    written as nothing, a null text has no runs.
    """

    def run(batches):
        tally: dict[bytes, int] = {}

        def flushed():
            words = pa.array([w.decode("latin-1") for w in tally], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(tally.values()), pa.int64())], ["word", "n"])

        for batch in rows_of(batches):
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                seed = zlib.crc32(f"{'' if i is None else i}:".encode())
                found = Counter(t.encode("latin-1", "replace").translate(LETTERS).split())
                for word, n in found.items():
                    if len(word) < letters:
                        continue
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < letters:
                            continue
                    tally[word] = tally.get(word, 0) + n
            if len(tally) > HELD:
                yield flushed()
                tally.clear()
        yield flushed()

    source = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).filter("text IS NOT NULL")
    counts = source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= times)


def _cut(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """Rows of blocks by thirds of [low, high) of the shorter length `size`; `longer` words have one letter more."""
    edges = [low + F.floor((high - low) * i / 3).cast("int") for i in range(4)]
    thirds = F.array(*[F.struct(a.alias("low"), b.alias("high")) for a, b in zip(edges, edges[1:])])
    rows = rows.select("word", "n", "longer", "size", F.explode(thirds).alias("third")).select("word", "n", "longer", "size", "third.*")
    after = F.col("high") + 1 + F.col("longer").cast("int")
    around = F.xxhash64(F.substring("word", F.lit(1), F.col("low")), F.col("word").substr(after, F.length("word")))
    return rows.filter("low < high").withColumn("around", around)


def _blocks(words: DataFrame, split: int) -> DataFrame:
    """`word`, `n`, `longer` and the block's columns; every pair one edit apart shares the block of its first difference."""
    size = F.length("word")
    sides = F.array(F.struct(F.lit(False).alias("longer"), size.alias("size")), F.struct(F.lit(True).alias("longer"), (size - 1).alias("size")))
    sides = words.select("word", "n", F.explode(sides).alias("side")).select("word", "n", "side.*")
    rows, done = staged(_cut(sides, F.lit(0), F.col("size")), "blocks"), []
    while True:
        large = rows.groupBy(*BLOCK).count().filter((F.col("count") > split) & (F.col("high") - F.col("low") > 1))
        large = staged(large.select(BLOCK), "large-blocks")
        if large.isEmpty():
            break
        done.append(rows.join(large, BLOCK, "left_anti").select(rows.columns))
        rows = staged(_cut(rows.join(large, BLOCK).select(rows.columns), F.col("low"), F.col("high")), "blocks")
    for part in done:
        rows = rows.unionByName(part)
    return rows


def _edits(short: np.ndarray, other: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Place of the first difference of rows of letters that are one edit apart, -1 where they are not.

    Rows end in zeros and have a spare one; `longer` rows of `other` have a letter more than those of `short`.
    """
    differ = short != other
    place = np.where(differ.any(1), differ.argmax(1), differ.shape[1])
    shifted = np.zeros_like(other)
    shifted[:, :-1] = other[:, 1:]
    inserted = ((short == shifted) | (np.arange(short.shape[1]) < place[:, None])).all(1)
    return np.where(np.where(longer, inserted, differ.sum(1) == 1), place, -1)


def _close(letters: list[bytes], longer: np.ndarray, block: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray):
    """Pairs (shorter, other) of rows, sorted by block, that are one edit apart with the first difference in the block's part."""
    lengths = np.array([len(w) for w in letters])

    def counts(rows: slice) -> np.ndarray:
        flat = np.frombuffer(b"".join(letters[rows]), np.uint8)
        owner = np.repeat(np.arange(len(lengths[rows])), lengths[rows])
        found = np.bincount(owner * WIDTH + PLACES[flat], minlength=len(lengths[rows]) * WIDTH).reshape(-1, WIDTH)
        return found.astype(np.float32 if lengths[rows].max() < 2048 else np.float64)  # whole squares stay exact

    def padded(rows: np.ndarray, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(letters[r].ljust(width, b"\0") for r in rows), np.uint8).reshape(-1, width)

    def compare(one: slice, two: slice):
        x, y = counts(one), counts(two)
        squared = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
        near = (squared <= 2) & (block[one][:, None] == block[two][None, :])
        a, b = np.nonzero(near)
        a, b = a + one.start, b + two.start
        # Every pair once, from its shorter word; longer ones do not meet one another here.
        a, b = np.where(longer[a], b, a), np.where(longer[a], a, b)
        keep = ~longer[a] & (longer[b] | (a < b))
        a, b = a[keep], b[keep]
        if one.start == two.start:  # the matrix is symmetric: a pair with a longer word shows twice
            a, b = np.divmod(np.unique(a * len(lengths) + b), len(lengths))
        width = int(lengths[b].max(initial=0)) + 1
        step = max(1, TILE_LETTERS // width)
        place = np.concatenate([np.zeros(0, np.int64)] + [_edits(padded(a[k : k + step], width), padded(b[k : k + step], width), longer[b[k : k + step]]) for k in range(0, len(a), step)])
        inside = (place >= low[a]) & ((place < high[a]) | ((place == size[a]) & (high[a] == size[a])))
        return a[inside], b[inside]

    found = []
    edges = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
    start = 0
    for end, following in zip(edges[1:], np.append(edges[2:], -1)):
        rows = max(16, min(TILE_ROWS, TILE_LETTERS // int(lengths[start:end].max())))
        if following >= 0 and following - start <= rows:
            continue  # small blocks share a matrix
        tiles = [slice(a, min(a + rows, end)) for a in range(start, end, rows)] if end - start > rows else [slice(start, end)]
        found += [compare(tiles[i], tiles[j]) for i in range(len(tiles)) for j in range(i, len(tiles))]
        start = end
    return [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1)]


def near_words(words: DataFrame, split: int = SPLIT) -> DataFrame:
    """`word`, `n_near` and `best` (`n`, `word` of the most frequent near word, ties to the smallest) of words with near words."""
    rows = _blocks(words, split)
    tasks = max(1, -(-rows.count() // TASK_ROWS))
    rows = rows.withColumn("task", F.pmod(F.xxhash64(*BLOCK), F.lit(tasks)).cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in BLOCK])
        size, low, high, around, longer, n = (table.column(c).to_numpy(zero_copy_only=False) for c in ("size", "low", "high", "around", "longer", "n"))
        words = table.column("word").to_pylist()
        fresh = np.append(True, np.any([c[1:] != c[:-1] for c in (size, low, high, around)], axis=0))
        a, b = _close([w.encode("latin-1") for w in words], longer.astype(bool), np.cumsum(fresh), low, high, size)
        one, two = np.concatenate([a, b]), np.concatenate([b, a])
        rank = np.zeros(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((rank[two], -n[two], one))
        one, two = one[order], two[order]
        first = np.flatnonzero(np.append(True, one[1:] != one[:-1])) if len(one) else np.zeros(0, np.int64)
        near, best = [words[k] for k in one[first]], two[first]
        columns = [pa.array(near, pa.string()), pa.array(np.diff(np.append(first, len(one)))), pa.array(n[best], pa.int64()), pa.array([words[k] for k in best], pa.string())]
        return pa.Table.from_arrays(columns, ["word", "n_near", "best_n", "best"])

    found = rows.groupBy("task").applyInArrow(compare, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.struct((-F.col("best.less")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """`word`, `root`: the last form that following `form` reaches; every round doubles the steps taken."""
    tops = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = tops.join(tops.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        tops = staged(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if tops.filter("moved").isEmpty():
            return tops.select("word", "root")
        tops = tops.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 97, letters: int = 5, times: int = 3, split: int = SPLIT) -> DataFrame:
    """`word`, `n`, `n_near`, `form`, `form_n`, `root` for each word of `word_counts`.

    The form is the most frequent word one edit away (ties: the smallest in code-point order), if it is at least twice as
    frequent, else null; the root is where following forms ends, the word itself without a form. `n_near` counts words one edit
    away. Each hop at least doubles the frequency, so forms make no circle.
    """
    words = staged(word_counts(docs, key, text, every, letters, times), "words")
    near = words.join(near_words(words, split), "word", "left")
    has = F.col("best.n") >= 2 * F.col("n")
    formed = staged(
        near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, F.col("best.n")).alias("form_n")),
        "forms",
    )
    rooted = formed.join(_roots(formed.filter("form IS NOT NULL")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
