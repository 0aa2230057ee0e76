"""Many logistic regressions on one table: every step of all of them is one pass over the rows.

Iteratively reweighted least squares needs, for each model, the gradient and the Hessian of its likelihood. A block of rows meets
all models that learn from it in a few matrix products, in its own task; the blocks' sums of all models are one aggregate, and only
the small systems of equations are solved on the driver. So the seeds and folds of a sweep cost as many passes as one fit, and no
row is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoseries.session import scratch_path

#: Passes at most, largest change of a coefficient at the end, and the largest one taken at once (of standardised features).
STEPS, TOLERANCE, REACH = 25, 1e-9, 8.0
#: Rows times groups of a block, about: few enough for a processor's cache.
BLOCK = 1 << 13


@dataclass(frozen=True)
class LogisticFits:
    """Coefficients (models x features, the intercept first) on standardised features."""

    features: Sequence[str]
    means: np.ndarray
    scales: np.ndarray
    coefficients: np.ndarray

    def inputs(self) -> list[Column]:
        scaled = [(F.col(f).cast("double") - F.lit(float(m))) / F.lit(float(s)) for f, m, s in zip(self.features, self.means, self.scales)]
        return [F.lit(1.0), *scaled]

    def margin(self, model: Column, inputs: Sequence[Column]) -> Column:
        """Log odds of a row under the model of a number."""
        rows = ", ".join(f"array({', '.join(f'{float(c)!r}D' for c in row)})" for row in self.coefficients)
        own = F.get(F.expr(f"array({rows})"), model)
        return sum((own[i] * x for i, x in enumerate(inputs)), F.lit(0.0))


def _standard(rows: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations; a missing covariate ends the job."""
    values = [F.col(f).cast("double") for f in features]
    missing = sum((F.count(F.when(v.isNull() | F.isnan(v), 1)) for v in values), F.lit(0))
    one = rows.agg(missing, *[F.avg(v) for v in values], *[F.stddev_pop(v) for v in values]).first()
    if one[0]:
        raise ValueError(f"{one[0]} covariates are missing")
    means, scales = (np.array([x or 0.0 for x in part], float) for part in (one[1 : 1 + len(features)], one[1 + len(features) :]))
    return means, np.where(scales > 0, scales, 1.0)


def _arrays(batch, features: Sequence[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First group, features, labels and folds of a batch, for the rows of each first group."""
    x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features], 1)
    of = batch.column("_of").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    first = batch.column("_first").to_numpy(zero_copy_only=False)
    for number in np.unique(first):
        rows = first == number
        for part in np.array_split(np.flatnonzero(rows), max(1, rows.sum() * of.shape[1] // BLOCK)):
            yield int(number), x[part], of[part] & 1, of[part] >> 1


def _summed(rows: DataFrame, fits: LogisticFits, k: int, width: int, sums) -> list:
    """(model, rows, sums) of each model: `sums` adds up a block of rows in its task, the blocks' sums are one aggregate."""
    features, means, scales, coefficients = list(fits.features), fits.means, fits.scales, fits.coefficients
    names = [f"_s{i}" for i in range(width)]

    def block_sums(batches):
        total = np.zeros((len(coefficients), width))
        for batch in batches:
            if batch.num_rows:
                for first, x, y, fold in _arrays(batch, features):
                    own = slice(first * k, (first + y.shape[1]) * k)
                    inputs = np.column_stack([np.ones(len(x)), (x - means) / scales])
                    with np.errstate(over="ignore"):
                        total[own] += sums(inputs, inputs @ coefficients[own].T, y, fold)
        seen = np.flatnonzero(total[:, 0])
        columns = [pa.array(seen.astype(np.int32)), *(pa.array(c) for c in total[seen].T)]
        yield pa.RecordBatch.from_arrays(columns, names=["model", *names])

    kind = "model int, " + ", ".join(f"{n} double" for n in names)
    return rows.mapInArrow(block_sums, kind).groupBy("model").agg(*[F.sum(n) for n in names]).collect()  # a row for each model


def _learn(rows: DataFrame, features: Sequence[str], groups: int, k: int, scales: tuple[np.ndarray, np.ndarray]) -> LogisticFits:
    """`groups` x `k` regressions: a row is learned from by the models of its groups, but for that of its own fold."""
    size = len(features) + 1
    fits = LogisticFits(list(features), *scales, np.zeros((groups * k, size)))
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    left, right = ([p[side] for p in pairs] for side in (0, 1))

    def sums(x, margin, y, fold):
        learned = fold[:, :, None] != np.arange(k, dtype=fold.dtype)
        p = (1.0 / (1.0 + np.exp(-margin))).reshape(learned.shape)
        rest = (y[:, :, None] - p) * learned
        p *= learned  # p (1 - p) of the rows learned from, 0 of the others
        flat = lambda a: a.reshape(len(x), -1).T
        return np.column_stack([np.count_nonzero(flat(learned), 1), flat(rest) @ x, flat(p * (1 - p)) @ (x[:, left] * x[:, right])])

    for _ in range(STEPS):
        steps = np.zeros_like(fits.coefficients)
        for row in _summed(rows, fits, k, 1 + size + len(pairs), sums):
            slope, curve = np.array(row[2 : 2 + size]), np.zeros((size, size))
            for (i, j), value in zip(pairs, row[2 + size :]):
                curve[i, j] = curve[j, i] = value
            step = np.linalg.solve(curve + np.eye(size) * 1e-10 * (1 + row[1]), slope)
            steps[row[0]] = step * min(1.0, REACH / max(np.abs(step).max(), 1e-300))
        fits = replace(fits, coefficients=fits.coefficients + steps)
        if np.abs(steps).max(initial=0.0) < TOLERANCE or np.abs(fits.coefficients).max(initial=0.0) > 4 * REACH:
            break
    return fits


def _coded(y: Column, fold: Column) -> Column:
    """Label and fold of a row in one small number."""
    return (fold.cast("int") * 2 + y.cast("int")).cast("smallint")


def fit_logistic(rows: DataFrame, features: Sequence[str], models: int, scales: tuple[np.ndarray, np.ndarray] | None = None) -> LogisticFits:
    """`models` regressions of `y` (0 or 1) on the features; a row of `rows` is learned from by the model whose number is in `model`.

    `rows` are read once for each step, `STEPS` at most, and once more for the `scales` (means and deviations) if these are not
    given. Where the classes can be separated, the coefficients stop growing there; predicted classes do not change any more.
    """
    own = F.array(_coded(F.col("y"), F.lit(-1))).alias("_of")
    coded = rows.select(*[F.col(f).cast("double") for f in features], F.col("model").cast("int").alias("_first"), own)
    return _learn(coded, features, models, 1, scales or _standard(rows, features))


def cross_accuracy(
    rows: DataFrame, features: Sequence[str], labels: Column, folds: Column, groups: int, k: int, first: Column | None = None
) -> list[tuple[int, int, float]]:
    """(group, fold, accuracy out of fold) for `groups` labellings of rows, `k` folds each, all fitted together.

    `labels` and `folds` are arrays with a number for each labelling of a row, of which the first is that of group `first` (0).
    """
    features = list(dict.fromkeys(features))
    number = F.lit(0) if first is None else first
    values = [F.col(f).cast("double").alias(f) for f in features]
    rows = rows.select(*values, number.cast("int").alias("_first"), F.zip_with(labels, folds, _coded).alias("_of"))
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "fits")
    rows.where(F.col("_first").isNotNull()).write.parquet(path)  # read in each step, in as many tasks as its size asks for
    rows = spark.read.parquet(path)
    fits = _learn(rows, features, groups, k, _standard(rows, features))

    def sums(x, margin, y, fold):
        held = (fold[:, :, None] == np.arange(k, dtype=fold.dtype)).reshape(margin.shape)
        right = held & ((margin > 0) == np.repeat(y, k, 1))
        return np.column_stack([held.sum(0), right.sum(0)])

    found = _summed(rows, fits, k, 2, sums)
    return sorted((model // k, model % k, right / n) for model, n, right in found)
