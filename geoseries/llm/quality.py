"""Quality scores by positive-unlabelled learning.

A linear model is fitted to trusted positives (label 1) and unlabelled web text by minimising the non-negative unbiased
risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)), logistic loss; where the bracket is
negative, the step goes up its slope instead. The class prior is estimated from how often reviewers gave label 1.

The fit sees bounded samples (`positives`, `unlabelled` rows, drawn by hash of the id); every whole text is scored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoseries.llm.common import rows_of, text_or_empty

POSITIVES = 6_000
UNLABELLED = 12_000
PAIRS = 256
SHAPES = 13
WIDTH = PAIRS + SHAPES
#: Used where no row is labelled.
DEFAULT_PRIOR = 0.5


def features(text: str) -> np.ndarray:
    """Shares of hashed byte pairs (square roots) and of word and character shapes."""
    out = np.zeros(WIDTH, np.float32)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return out
    pairs = raw[:-1].astype(np.uint32) * 256 + raw[1:]
    counts = np.bincount((pairs * np.uint32(2654435761)) >> np.uint32(24), minlength=PAIRS)[:PAIRS]
    out[:PAIRS] = np.sqrt(counts / max(1, len(pairs)))
    kinds = np.bincount(raw, minlength=256) / len(raw)
    words = text.split()
    n = max(1, len(words))
    met = Counter(words)
    same = sum(a == b for a, b in zip(words, words[1:]))
    frequent = met.most_common(1)[0][1] if met else 0
    out[PAIRS:] = (
        kinds[65:91].sum(),
        kinds[97:123].sum(),
        kinds[48:58].sum(),
        kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum(),
        kinds[10],
        kinds[128:].sum(),
        same / n,
        np.sqrt(same / n),
        len(met) / n,
        len(met) / n**0.8,
        frequent / n,
        min(30.0, sum(map(len, met)) / max(1, len(met))) / 10,
        np.log1p(n) / 10,
    )
    return out


class LinearModel:
    """Standardised linear score; `probability` is its logistic value."""

    def __init__(self, mean, scale, weights, bias):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    def probability(self, rows: np.ndarray) -> np.ndarray:
        score = np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.03, decay: float = 4.0) -> LinearModel:
    """Non-negative PU fit by Adam over the whole sample; `decay` over the number of positives shrinks the weights."""
    if not len(positive) or not len(unlabelled):  # nothing to learn: the prior for every text
        odds = np.log(prior / (1 - prior)) if 0 < prior < 1 else (30.0 if prior else -30.0)
        return LinearModel(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), odds)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = (np.clip((rows - mean) / scale, -8, 8).astype(np.float64) for rows in (positive, unlabelled))
    w = np.zeros(WIDTH + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)

    def chance(rows):
        return 1 / (1 + np.exp(-np.clip(rows @ w[:-1] + w[-1], -30, 30)))

    def slope(rows, gap):  # of the mean loss, from its slope in the score
        return np.append(rows.T @ gap, gap.sum()) / len(rows)

    for step in range(1, steps + 1):
        at_p, at_u = chance(p), chance(u)
        negative = -np.log1p(-np.minimum(at_u, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(at_p, 1 - 1e-12)).mean()
        plus = prior * slope(p, at_p - 1)
        minus = slope(u, at_u) - prior * slope(p, at_p)
        gradient = plus + minus if negative >= 0 else -minus
        gradient[:-1] += decay / len(p) * w[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return LinearModel(mean, scale, w[:-1], w[-1])


def _vectors(rows: DataFrame, text: str, group: str) -> DataFrame:
    """`group`, `vector` (binary) of each row."""

    def run(batches):
        for batch in rows_of(batches):
            made = [features(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["group", "vector"])

    return rows.select(F.col(group).cast("int").alias("group"), text_or_empty(text).alias("text")).mapInArrow(run, "group int, vector binary")


def _matrix(rows) -> np.ndarray:
    return np.array([np.frombuffer(r["vector"], np.float32) for r in rows]).reshape(-1, WIDTH)


def place(key):
    """A number in [0, 1) from the hash of an id."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit("place")), F.lit(1 << 30)) / (1 << 30)


def train(docs: DataFrame, labels: DataFrame, learn, key: str = "doc_id", text: str = "text", label: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> LinearModel:
    """Fit on rows for which `learn` (a condition on the id) holds.

    Reads the sizes first, then as large a share of hashes as gives `positives` and `unlabelled` rows; only their feature
    vectors come to the driver. Null labels and labels of unknown documents do not count.
    """
    marked = labels.filter(learn).select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label")).filter("label IS NOT NULL")
    sizes = marked.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("good")).first()
    prior = sizes["good"] / sizes["n"] if sizes["n"] else DEFAULT_PRIOR
    trusted = marked.filter((F.col("label") == 1) & (place(F.col("id")) < min(1.0, positives / max(1, sizes["good"])))).select("id").distinct()
    known = docs.filter(learn)
    good = known.join(F.broadcast(trusted), known[f"`{key}`"] == trusted["id"], "left_semi")  # about `positives` ids
    count = known.count()
    web = known.filter(place(F.col(f"`{key}`")) < min(1.0, unlabelled / max(1, count)))
    both = good.select(F.lit(1).alias("g"), F.col(f"`{text}`").alias("t")).union(web.select(F.lit(0), F.col(f"`{text}`")))
    rows = _vectors(both, "t", "g").collect()
    return fit(_matrix([r for r in rows if r["group"]]), _matrix([r for r in rows if not r["group"]]), prior)


def score(docs: DataFrame, model: LinearModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `score` (0 to 1), `predicted` (1 where the score is at least one half) of every whole text.

    Null text counts as empty, which has a score too; repeated rows give repeated rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in rows_of(batches):
            rows = np.array([features(t) for t in batch.column(1).to_pylist()]).reshape(-1, WIDTH)
            found = shared.value.probability(rows)
            columns = [pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "score", "predicted"])

    source = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: LinearModel, text: str = "text") -> DataFrame:
    """Rows of `docs`, all columns, whose score is at least one half."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        rows = np.array([features(t) for t in texts]).reshape(-1, WIDTH)
        return pd.Series(shared.value.probability(rows) >= 0.5)

    return docs.filter(good(text_or_empty(text)))
