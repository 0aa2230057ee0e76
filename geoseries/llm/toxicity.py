"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = logistic(w . x - threshold_k): one weight vector is shared by all thresholds, which are kept in order. The
result is the expected grade, sum over k of P(grade > k).

`labels.toxic` says only whether a text is toxic. Grades are made from the learning rows alone: 0 for clean texts; 1, 2 or
3 for toxic ones, by thirds of the share of their words that mark toxic texts (words and word beginnings much more frequent
in toxic texts than in clean ones).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoseries.llm.common import rows_of, text_or_empty
from geoseries.llm.quality import place

#: Labelled rows of each kind that a fit sees, drawn by hash of the id.
TOXIC_ROWS, CLEAN_ROWS = 4_000, 8_000
SLOTS = 1 << 18
#: Word beginnings of these lengths are features of their own.
PREFIXES = (5, 7)
#: A feature is used from so many toxic rows on (a number, and a share of them), and from this ratio of its shares of toxic
#: and clean rows on.
LEAST_ROWS, LEAST_SHARE, LEAST_RATIO = 3, 0.02, 6.0
GRADES = 3
WORD = re.compile(r"[^\W\d_]+")


def _slot(word: str, known: dict[str, int]) -> int:
    if word not in known:
        if len(known) > 500_000:  # bounded memory: start over
            known.clear()
        known[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % SLOTS
    return known[word]


def counts_of(text: str, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct feature slots of the words and word beginnings of a text, their counts, and the number of words."""
    words = Counter(WORD.findall(text.lower()))
    found: dict[int, int] = {}
    for word, n in words.items():
        for feature in (word, *(f"^{word[:p]}" for p in PREFIXES if len(word) > p)):
            slot = _slot(feature, known)
            found[slot] = found.get(slot, 0) + n
    slots = np.fromiter(found, np.int32, len(found))
    order = np.argsort(slots)
    return slots[order], np.fromiter(found.values(), np.int32, len(found))[order], sum(words.values())


class OrdinalModel:
    """Shared weights over the marking features, and ordered thresholds."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.slots, self.weights, self.thresholds = slots, weights, thresholds

    def vector(self, slots: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Sparse feature vector: logarithms of the counts, then three features of all marks together."""
        at = np.searchsorted(self.slots, slots)
        at[at == len(self.slots)] = 0
        hit = self.slots[at] == slots if len(self.slots) else np.zeros(len(slots), bool)
        marks = int(counts[hit].sum())
        dense = [np.log1p(marks), 20.0 * marks / max(words, 1), np.log1p(words) / 10]
        places = np.concatenate([at[hit], len(self.slots) + np.arange(3)])
        return places, np.concatenate([np.log1p(counts[hit]), dense])

    def above(self, vectors) -> np.ndarray:
        """P(grade > k) of each vector, one column per threshold."""
        score = np.array([self.weights[at] @ value for at, value in vectors]).reshape(-1, 1)
        return 1 / (1 + np.exp(-np.clip(score - self.thresholds[None, :], -30, 30)))


def _grades(rows, marked: np.ndarray) -> np.ndarray:
    share = np.array([counts[np.isin(slots, marked)].sum() / max(words, 1) for slots, counts, words, _ in rows])
    toxic = np.array([y for *_, y in rows], bool)
    cuts = np.quantile(share[toxic], [k / GRADES for k in range(1, GRADES)]) if toxic.any() else np.zeros(GRADES - 1)
    return np.where(toxic, 1 + (share[:, None] > cuts[None, :]).sum(1), 0)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int, int]], toxic_weight: float = 1.0, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> OrdinalModel:
    """Fit to (slots, counts, words, toxic) rows; `toxic_weight` undoes unequal shares of the two kinds in the sample."""
    toxic = [r for r in rows if r[3]]
    clean = [r for r in rows if not r[3]]
    if not toxic or not clean:  # nothing to tell apart
        return OrdinalModel(np.zeros(0, np.int32), np.zeros(3), np.full(GRADES, 30.0))
    in_toxic = np.bincount(np.concatenate([r[0] for r in toxic]), minlength=SLOTS)
    in_clean = np.bincount(np.concatenate([r[0] for r in clean]), minlength=SLOTS)
    ratio = ((in_toxic + 0.5) / (len(toxic) + 1)) / ((in_clean + 0.5) / (len(clean) + 1))
    marked = np.flatnonzero((in_toxic >= max(LEAST_ROWS, LEAST_SHARE * len(toxic))) & (ratio >= LEAST_RATIO)).astype(np.int32)
    grade = _grades(rows, marked)
    model = OrdinalModel(marked, np.zeros(len(marked) + 3), np.arange(GRADES, dtype=float))
    vectors = [model.vector(*r[:3]) for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(v[0]) for v in vectors])
    at, value = np.concatenate([v[0] for v in vectors]), np.concatenate([v[1] for v in vectors])
    weight = np.where(grade > 0, toxic_weight, 1.0)
    weight = weight / weight.sum()
    over = grade[:, None] > np.arange(GRADES)[None, :]
    # Thresholds are a first value and positive steps, so they stay in order.
    w = np.concatenate([model.weights, [1.0], np.zeros(GRADES - 1)])
    first, second = np.zeros_like(w), np.zeros_like(w)
    n = len(model.weights)
    for step in range(1, steps + 1):
        gaps = np.exp(w[n + 1 :])
        thresholds = w[n] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(owner, w[at] * value, len(rows))
        # Probability of the grade met: difference of neighbouring cumulative values.
        cumulative = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds[None, :], -30, 30)))
        ends = np.concatenate([np.ones((len(rows), 1)), cumulative, np.zeros((len(rows), 1))], 1)
        here = np.take_along_axis(ends, grade[:, None], 1) - np.take_along_axis(ends, grade[:, None] + 1, 1)
        slope = cumulative * (1 - cumulative) / np.maximum(here, 1e-9)
        lower, upper = over & (np.arange(GRADES)[None, :] == grade[:, None] - 1), np.arange(GRADES)[None, :] == grade[:, None]
        by_threshold = weight[:, None] * slope * (upper.astype(float) - lower.astype(float))  # of the loss, in score - threshold
        gradient = np.zeros_like(w)
        gradient[:n] = np.bincount(at, value * by_threshold.sum(1)[owner], n) + decay * w[:n]
        of_thresholds = -by_threshold.sum(0)
        gradient[n] = of_thresholds.sum()
        gradient[n + 1 :] = gaps * np.cumsum(of_thresholds[::-1])[::-1][1:]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model.weights = w[:n]
    model.thresholds = w[n] + np.concatenate([[0.0], np.cumsum(np.exp(w[n + 1 :]))])
    return model


def train(docs: DataFrame, labels: DataFrame, learn, key: str = "doc_id", text: str = "text", label: str = "toxic") -> OrdinalModel:
    """Fit on labelled rows for which `learn` (a condition on the id) holds; a bounded number of each kind is read."""
    marked = labels.filter(learn).select(F.col(f"`{key}`").alias("id"), (F.col(f"`{label}`") != 0).cast("int").alias("toxic"))
    marked = marked.filter("id IS NOT NULL AND toxic IS NOT NULL")
    sizes = marked.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean")).first()
    shares = min(1.0, TOXIC_ROWS / max(1, sizes["toxic"])), min(1.0, CLEAN_ROWS / max(1, sizes["clean"]))
    drawn = marked.filter(place(F.col("id")) < F.when(F.col("toxic") == 1, shares[0]).otherwise(shares[1]))
    drawn = drawn.groupBy("id").agg(F.max("toxic").alias("toxic"))  # about TOXIC_ROWS + CLEAN_ROWS rows
    source = docs.select(F.col(f"`{key}`").alias("id"), text_or_empty(text).alias("text")).join(F.broadcast(drawn), "id").select("text", "toxic")

    def run(batches):
        known: dict[str, int] = {}
        for batch in rows_of(batches):
            made = [counts_of(t, known) for t in batch.column("text").to_pylist()]
            columns = [pa.array([m[0].tobytes() for m in made], pa.binary()), pa.array([m[1].tobytes() for m in made], pa.binary()), pa.array([m[2] for m in made], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("toxic")], ["slots", "counts", "words", "toxic"])

    held = source.mapInArrow(run, "slots binary, counts binary, words long, toxic int").collect()
    rows = [(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["counts"], np.int32), r["words"], r["toxic"]) for r in held]
    return fit(rows, shares[1] / shares[0])


def severity(docs: DataFrame, model: OrdinalModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `severity` (expected grade, 0 to 3), `grade` (the likeliest), `score` (P(grade > 0)), `predicted` (1 where the
    score is at least one half) of every whole text.

    Null text counts as empty; repeated rows give repeated rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights of the marking features, at most SLOTS

    def run(batches):
        known: dict[str, int] = {}
        for batch in rows_of(batches):
            above = shared.value.above([shared.value.vector(*counts_of(t, known)) for t in batch.column("text").to_pylist()])
            ends = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], 1)
            grade = (ends[:, :-1] - ends[:, 1:]).argmax(1)
            columns = [above.sum(1), grade.astype(np.int32), above[:, 0], (above[:, 0] >= 0.5).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], ["doc_id", "severity", "grade", "score", "predicted"])

    source = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, severity double, grade int, score double, predicted int")
