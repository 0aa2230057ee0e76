"""Benchmark decontamination with one Aho-Corasick automaton over the windows of all test items.

Texts are normalised (A-Z lowered, words joined by one blank); the automaton's patterns are windows of ten words with
a blank on either side, so one pass over a document finds every window, overlaps included. Places in the normalised
text map to word numbers and through them to offsets in the original.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoseries.llm.common import rows_of, text_or_empty

WINDOW = 10
#: Characters of the distinct windows that one automaton may hold; more are dealt to further ones, scanned in turn.
MAX_CHARACTERS = 4 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def windows(found: list[str], size: int = WINDOW) -> set[str]:
    """Windows of `size` consecutive words; a shorter text is one window."""
    return {" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


def window_table(benchmark: DataFrame, key: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct `pattern` and the sorted `items` (ids as strings) it comes from. Null texts have none; a null id is ''."""

    def cut(batches):
        for batch in rows_of(batches):
            pairs = [(i or "", w) for i, t in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()) for w in windows(words(t), size)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["item", "pattern"])

    source = benchmark.select(F.col(f"`{key}`").cast("string").alias("item"), text_or_empty(text).alias("text"))
    pairs = source.mapInArrow(cut, "item string, pattern string")
    return pairs.groupBy("pattern").agg(F.array_sort(F.collect_set("item")).alias("items"))


_AUTOMATA: dict = {}


def _automaton(shared):
    """One automaton per broadcast and worker; at most two are kept."""
    import ahocorasick

    name, patterns = shared.value
    if name not in _AUTOMATA:
        if len(_AUTOMATA) > 1:
            _AUTOMATA.clear()
        made = ahocorasick.Automaton()
        for pattern, items in patterns:
            made.add_word(f" {pattern} ", (len(pattern) + 2, pattern.count(" ") + 1, items))
        if len(made):
            made.make_automaton()
        _AUTOMATA[name] = made
    return _AUTOMATA[name]


def scan(text: str, automaton) -> tuple[list[re.Match], np.ndarray, set[str]]:
    """Word matches of the text, a boolean per word that a window covers it, and the items found."""
    found = list(WORD.finditer(text.translate(LOWER)))
    joined = f" {' '.join(m.group() for m in found)} "
    hit, items, starts = np.zeros(len(found), bool), set(), None
    if found and len(automaton):
        for end, (length, count, of) in automaton.iter(joined):
            if starts is None:  # place of the blank before each word
                starts = np.cumsum([0, *(len(m.group()) + 1 for m in found)])
            first = int(np.searchsorted(starts, end - length + 1))
            hit[first : first + count] = True
            items.update(of)
    return found, hit, items


def _spans(found: list[re.Match], hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of covered words as [start, end) in code points of the original text."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [(found[a].start(), found[b - 1].end()) for a, b in zip(edges[::2], edges[1::2])]


def pattern_blocks(patterns: DataFrame, max_characters: int = MAX_CHARACTERS) -> list[list[tuple[str, list[str]]]]:
    """The windows in blocks of about `max_characters` at most; the size is asked first, blocks are then read one by one."""
    total = patterns.agg(F.sum(F.length("pattern") + F.size("items"))).first()[0] or 0
    count = -(-total // max_characters) or 1
    of = F.pmod(F.xxhash64("pattern"), F.lit(count))
    return [[(r["pattern"], list(r["items"])) for r in patterns.filter(of == k).collect()] for k in range(count)]


def flag_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    max_characters: int = MAX_CHARACTERS,
    keep: bool = False,
) -> DataFrame:
    """Per document: `doc_id`, `n_words`, `n_hit`, `items` (sorted ids as strings), `spans` (array of start and end offsets
    in the text), by a narrow pass over the documents for each block of windows (one block unless the benchmark is huge).

    With `keep`, the documents without a hit, with all their columns. Null and empty texts have no words; repeated rows
    give repeated rows; an empty benchmark hits nothing.
    """
    context = docs.sparkSession.sparkContext
    patterns = window_table(benchmark, item_key, item_text, size)
    blocks = [context.broadcast((uuid.uuid4().hex, b)) for b in pattern_blocks(patterns, max_characters)]  # each of a checked size
    inner = [f"c{i}" for i in range(len(docs.columns))]
    state = "n_words long, covered array<int>, items array<string>, spans array<struct<start:int,end:int>>"
    held = [pa.field("n_words", pa.int64()), pa.field("covered", pa.list_(pa.int32())), pa.field("items", pa.list_(pa.string()))]
    held.append(pa.field("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
    if keep:
        rows = docs.toDF(*inner)
        content = f"c{docs.columns.index(text)}"
    else:
        rows, content = docs.select(F.col(f"`{key}`").alias("c0"), F.col(f"`{text}`").cast("string").alias("c1")), "c1"
    carried = rows.columns

    def step(shared, first):
        def run(batches):
            for batch in rows_of(batches):
                automaton = _automaton(shared)
                before = [None] * batch.num_rows if first else list(zip(batch.column("covered").to_pylist(), batch.column("items").to_pylist()))
                out = []
                for t, had in zip(batch.column(content).to_pylist(), before):
                    found, hit, items = scan(t or "", automaton)
                    if had:
                        hit[had[0]] = True
                        items.update(had[1])
                    spans = [{"start": a, "end": b} for a, b in _spans(found, hit)] if items else []
                    out.append((len(found), np.flatnonzero(hit).astype(np.int32), sorted(items), spans))
                columns = [pa.array([o[i] for o in out], f.type) for i, f in enumerate(held)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + columns, [*carried, *(f.name for f in held)])

        return run

    for k, shared in enumerate(blocks):
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in carried)
        rows = rows.mapInArrow(step(shared, k == 0), f"{schema}, {state}")
    if keep:
        return rows.filter(F.size("covered") == 0).select(*inner).toDF(*docs.columns)
    return rows.select(F.col("c0").alias("doc_id"), "n_words", F.size("covered").cast("long").alias("n_hit"), "items", "spans")


def digest_columns(flagged: DataFrame) -> DataFrame:
    return flagged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
