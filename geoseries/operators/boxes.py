"""Exact Shapley values of tree models from the boxes of their leaves.

A leaf holds the rows that satisfy one interval for each feature on its path. With some features of a row and the rest of
another row, a mixed row is in the leaf if each feature's own source satisfies its interval. So all that matters of a row is
which intervals it satisfies, a pattern of bits for each leaf; how often the whole table shows each pattern is counted once,
and a row's values are sums of one table entry for each leaf. Nothing is drawn, and no two rows are brought together.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Rows that meet all leaves at a time.
BLOCK = 1024


def leaf_boxes(scorer) -> list[tuple[float, dict[str, tuple[float, float]]]]:
    """(value, {feature: (low, high]}) of every leaf of a decision tree, forest or boosted trees of Spark ML."""
    model = scorer.model
    trees = list(getattr(model, "trees", [model]))
    kind = type(model).__name__
    weights = list(model.treeWeights) if kind.startswith("GBT") else [1.0 / len(trees)] * len(trees)
    found = []

    def walk(node, weight: float, box: dict[str, tuple[float, float]]) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            found.append((weight * node.prediction(), box))
            return
        split = node.split()
        feature, at = scorer.features[split.featureIndex()], split.threshold()
        low, high = box.get(feature, (-math.inf, math.inf))
        walk(node.leftChild(), weight, {**box, feature: (low, min(high, at))})
        walk(node.rightChild(), weight, {**box, feature: (max(low, at), high)})

    for tree, weight in zip(trees, weights):
        walk(tree._call_java("rootNode"), weight, {})
    return found


def has_boxes(scorer) -> bool:
    kind = type(getattr(scorer, "model", None)).__name__
    return kind in ("DecisionTreeRegressionModel", "RandomForestRegressionModel", "GBTRegressionModel")


def leaf_shares(value: float, size: int, chance: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf's intervals for a row of each pattern (2^size x size), others showing patterns by `chance`.

    Of the intervals that decide, a are satisfied by the row only and b by the other row only; a mixed row is in the leaf if it
    takes the former from the row and the latter from the other. One that neither satisfies keeps every mixed row out.
    """
    patterns = np.arange(1 << size)
    own, other = patterns[:, None], patterns[None, :]
    bits = lambda m: ((m[..., None] >> np.arange(size)) & 1).astype(float)
    only_own, only_other = bits(own & ~other), bits(~own & other & ((1 << size) - 1))
    a, b = only_own.sum(-1), only_other.sum(-1)
    possible = (own | other) == (1 << size) - 1
    fact = np.array([math.factorial(k) for k in range(2 * size + 1)], float)
    whole = fact[(a + b).astype(int)]
    plus = np.where(a > 0, fact[np.maximum(a - 1, 0).astype(int)] * fact[b.astype(int)] / whole, 0)
    minus = np.where(b > 0, fact[a.astype(int)] * fact[np.maximum(b - 1, 0).astype(int)] / whole, 0)
    per = only_own * plus[..., None] - only_other * minus[..., None]
    return value * (per * (possible * chance[None, :])[..., None]).sum(1)


class Leaves:
    """The boxes of a model's leaves as arrays: blocks of rows meet all of them at once, in their own task."""

    def __init__(self, scorer) -> None:
        self.features = list(scorer.features)
        boxes = leaf_boxes(scorer)
        self.constant = sum(v for v, box in boxes if not box)  # trees without a split
        self.boxes = [(v, box) for v, box in boxes if box]
        self.values = np.array([v for v, _ in self.boxes], float)
        self.starts = np.concatenate([[0], np.cumsum([1 << len(box) for _, box in self.boxes])]).astype(np.int32)
        small = np.min_scalar_type((1 << max((len(box) for _, box in self.boxes), default=0)) - 1)  # most of a block's time is reading patterns
        self.full = np.array([(1 << len(box)) - 1 for _, box in self.boxes], small)
        self.bits = [np.array([1 << list(box).index(f) if f in box else 0 for _, box in self.boxes], small) for f in self.features]
        self.edges, self.codes = [], []
        for i, f in enumerate(self.features):
            ends = [box.get(f, (-math.inf, math.inf)) for _, box in self.boxes]
            edges = np.array(sorted({e for pair in ends for e in pair if math.isfinite(e)}))
            bins = np.arange(len(edges) + 1)[:, None]
            low = np.array([np.searchsorted(edges, a) if a > -math.inf else -1 for a, _ in ends], int)
            high = np.array([np.searchsorted(edges, z) if z < math.inf else len(edges) for _, z in ends], int)
            inside = np.where((bins > low) & (bins <= high), self.bits[i], 0)
            self.edges.append(edges)
            self.codes.append(np.vstack([inside, np.zeros((1, len(self.boxes)))]).astype(small))  # missing: in no interval

    def columns(self) -> list:
        return [F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(self.features)]

    def satisfied(self, i: int, x: np.ndarray) -> np.ndarray:
        """Bit of feature `i` at each leaf whose interval holds x (values x leaves)."""
        at = np.searchsorted(self.edges[i], x, side="left")
        return self.codes[i][np.where(np.isnan(x), len(self.edges[i]) + 1, at)]

    def blocks(self, batch, missing: bool):
        """(first row, patterns) of blocks of a batch; missing values end the job unless they are allowed."""
        x = [batch.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(self.features))]
        if not missing and any(np.isnan(v).any() for v in x):
            raise ValueError("covariates are missing")
        for first in range(0, batch.num_rows, BLOCK):
            yield first, sum(self.satisfied(i, v[first : first + BLOCK]) for i, v in enumerate(x))

    def counts(self, df: DataFrame, missing: bool = True) -> np.ndarray:
        """How often the table shows each pattern of each leaf: one pass, a small table for each task."""

        def counted(batches):
            total = np.zeros(self.starts[-1], np.int64)
            for batch in batches:
                for _, codes in self.blocks(batch, missing):
                    total += np.bincount((codes + self.starts[:-1]).ravel(), minlength=len(total))
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["_code", "_n"])

        found = np.zeros(self.starts[-1])
        for code, n in df.select(*self.columns()).mapInArrow(counted, "_code int, _n long").groupBy("_code").agg(F.sum("_n")).collect():
            found[code] = n  # a row for each entry
        return found

    def effect(self, i: int, x: np.ndarray) -> np.ndarray:
        """Value that each leaf adds where feature `i` has each value of x, if the other features satisfy theirs (leaves x values)."""
        return (self.values[:, None]) * (self.satisfied(i, x).T == self.bits[i][:, None])


#: Words with one bit give their bit's number, shuffled, in the top six bits of their product with this number.
ONE_BIT = np.uint64(0x03F79D71B4CB0A89)


class Reached:
    """A word for each tree: the leaves that a row can still be in. Words of all features have the row's own leaf in common.

    For trees of up to 64 leaves. A value of a feature costs one lookup for all trees, and another value of one feature one more.
    """

    def __init__(self, leaves: Leaves, sizes: Sequence[int]) -> None:
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
        tree = np.repeat(np.arange(len(sizes)), sizes)
        bits = np.uint64(1) << (np.arange(len(tree)) - starts[tree]).astype(np.uint64)
        self.leaves = leaves
        self.masks = [np.bitwise_or.reduceat(np.where(codes == own, bits, np.uint64(0)), starts, axis=1) for codes, own in zip(leaves.codes, leaves.bits)]
        self.table = np.zeros(64 * len(sizes))
        self.table[64 * tree + ((bits * ONE_BIT) >> np.uint64(58)).astype(int)] = leaves.values
        self.using = [np.unique(tree[np.flatnonzero(own)]) for own in leaves.bits]

    @staticmethod
    def of(scorer, leaves: Leaves) -> Reached | None:
        """None where a tree has more leaves than a word has bits, or no tree has a split."""
        sizes = [(tree.numNodes + 1) // 2 for tree in getattr(scorer.model, "trees", [scorer.model]) if tree.numNodes > 1]
        return Reached(leaves, sizes) if sizes and max(sizes) <= 64 else None

    def words(self, i: int, x: np.ndarray) -> np.ndarray:
        """Leaves whose interval of feature `i` holds x (values x trees)."""
        edges = self.leaves.edges[i]
        return self.masks[i][np.where(np.isnan(x), len(edges) + 1, np.searchsorted(edges, x, side="left"))]

    def others(self, own: Sequence[np.ndarray]) -> list[np.ndarray]:
        """For each feature, what the words of all other features have in common."""
        every = np.full_like(own[0], ~np.uint64(0))
        before, after = [every], [every]
        for i in range(len(own) - 1):
            before.append(before[-1] & own[i])
            after.append(after[-1] & own[-1 - i])
        return [a & z for a, z in zip(before, after[::-1])]

    def values(self, words: np.ndarray, trees: np.ndarray) -> np.ndarray:
        """Sum of the values of the leaves that words of `trees` are left with."""
        return self.table[((words * ONE_BIT) >> np.uint64(58)).astype(np.int32) + 64 * trees.astype(np.int32)].sum(1)


def _known(batch, name: str, n: int) -> list[np.ndarray]:
    """Columns `name`0 to n - 1; missing values end the job."""
    x = [batch.column(f"{name}{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(n)]
    if any(np.isnan(v).any() for v in x):
        raise ValueError("covariates are missing")
    return x


def tree_shapley(scorer, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`keys`, `feature`, `phi`: exact values against the whole table, for each row of it.

    Two passes: one counts patterns, one adds up the entries of each row. The leaves and their 2^features entries come from the
    model and do not grow with the data; each row meets all leaves, and is summed up, in its own task. The values of a row add up
    to its prediction less the mean prediction.
    """
    leaves, names = Leaves(scorer), list(dict.fromkeys(keys))
    features, starts = leaves.features, leaves.starts
    counts = leaves.counts(df)
    table = np.zeros((len(features), len(counts)))
    for start, end, (value, box) in zip(starts, starts[1:], leaves.boxes):
        shares = leaf_shares(value, len(box), counts[start:end] / max(counts[start:end].sum(), 1))
        for i, f in enumerate(box):
            table[features.index(f), start:end] += shares[:, i]
    using = [np.flatnonzero(bits) for bits in leaves.bits]

    def summed(batches):
        for batch in batches:
            phi = np.zeros((len(features), batch.num_rows))
            for first, codes in leaves.blocks(batch, True):
                codes = codes + starts[:-1]
                for i, own in enumerate(using):
                    phi[i, first : first + len(codes)] = table[i][codes[:, own]].sum(1)
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, phi)], names=[*names, *[f"_s{i}" for i in range(len(features))]])

    rows = df.select(*names, *leaves.columns())
    kind = StructType([*rows.select(*names).schema.fields, *[StructField(f"_s{i}", DoubleType()) for i in range(len(features))]])
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_s{i}").alias("phi")) for i, f in enumerate(features)])
    return rows.mapInArrow(summed, kind).select(*names, F.inline(each))


def tree_dependence(scorer, df: DataFrame, grids: Mapping[str, Sequence[float]]) -> dict[str, list[float]]:
    """Mean prediction over all rows with a feature set to each value of its grid.

    A leaf counts, at the values inside its interval, as often as rows satisfy its other intervals: sums of its patterns' counts.
    """
    leaves = Leaves(scorer)
    counts = leaves.counts(df, missing=False)
    if not leaves.boxes:
        return {f: [leaves.constant] * len(grid) for f, grid in grids.items()}
    patterns = [np.arange(1 << len(box)) for _, box in leaves.boxes]
    own = [counts[a:z] for a, z in zip(leaves.starts, leaves.starts[1:])]
    n = own[0].sum()
    found = {}
    for f, grid in grids.items():
        i = leaves.features.index(f)
        chance = np.array([c[(p | bit) == full].sum() for c, p, bit, full in zip(own, patterns, leaves.bits[i], leaves.full)]) / n
        found[f] = [float(v) for v in leaves.constant + chance @ leaves.effect(i, np.array(grid, float))]
    return found


def tree_curves(scorer, df: DataFrame, keys: Sequence[str], grids: Mapping[str, Sequence[float]]) -> DataFrame:
    """`keys` and, for each grid in turn, `_c<number>`: changes of a row's prediction from the first value of the grid to each value."""
    leaves, names = Leaves(scorer), list(dict.fromkeys(keys))
    reached = Reached.of(scorer, leaves)
    steps, places = [], []
    for f, grid in grids.items():
        i = leaves.features.index(f)
        places.append((i, *np.unique(np.searchsorted(leaves.edges[i], np.array(grid, float), side="left"), return_inverse=True)))
    for f, grid in grids.items():
        i = leaves.features.index(f)
        used = np.flatnonzero(leaves.bits[i])
        effect = leaves.effect(i, np.array(grid, float))[used]
        steps.append((used, leaves.bits[i][used], leaves.full[used], effect - effect[:, :1]))

    def single(batch, kept):
        """Curves change only where the grid crosses an edge of the trees that use the feature."""
        x = _known(batch, "_x", len(leaves.features))
        for first in range(0, batch.num_rows, BLOCK):
            own = [reached.words(i, v[first : first + BLOCK]) for i, v in enumerate(x)]
            rest, lists = reached.others(own), []
            for i, bins, back in places:
                trees = reached.using[i]
                levels = [reached.values(rest[i][:, trees] & reached.masks[i][b][trees], trees) for b in bins]
                found = np.array(levels)[back]
                lists.append(pa.ListArray.from_arrays(np.arange(len(own[0]) + 1, dtype=np.int32) * len(back), np.ascontiguousarray((found - found[:1]).T).ravel()))
            yield pa.RecordBatch.from_arrays([*[c.slice(first, len(own[0])) for c in kept], *lists], names=[*names, *[f"_c{j}" for j in range(len(lists))]])

    def curves(batches):
        for batch in batches:
            if reached:
                yield from single(batch, [batch.column(n) for n in names])
                continue
            for first, codes in leaves.blocks(batch, False):
                kept = [batch.column(n).slice(first, len(codes)) for n in names]
                found = [((codes[:, used] | bit) == full).astype(float) @ effect for used, bit, full, effect in steps]
                lists = [pa.ListArray.from_arrays(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1], c.ravel()) for c in found]
                yield pa.RecordBatch.from_arrays([*kept, *lists], names=[*names, *[f"_c{j}" for j in range(len(lists))]])

    rows = df.select(*names, *leaves.columns())
    kind = StructType([*rows.select(*names).schema.fields, *[StructField(f"_c{j}", ArrayType(DoubleType())) for j in range(len(steps))]])
    return rows.mapInArrow(curves, kind)


def tree_effects(scorer, df: DataFrame, edges: Mapping[str, Sequence[float]]) -> list[tuple[str, int, float, int]]:
    """(feature, bin, mean change of the prediction from the bin's lower to its upper edge, rows) of every bin that holds rows.

    One pass: each task counts, for each bin and leaf, the rows of the bin that satisfy the leaf's other intervals. What a leaf
    adds at the two edges of a bin is the same for all its rows.
    """
    leaves = Leaves(scorer)
    bounds = {f: np.array(e, float) for f, e in edges.items()}
    place = {f: leaves.features.index(f) for f in bounds}
    using = {f: np.flatnonzero(leaves.bits[place[f]]) for f in bounds}
    shapes = {f: (len(e) - 1, len(using[f]) + 1) for f, e in bounds.items()}  # the last column counts rows
    starts = np.concatenate([[0], np.cumsum([a * b for a, b in shapes.values()])]).astype(int)

    def counted(batches):
        total = np.zeros(starts[-1])
        for batch in batches:
            x = {f: batch.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(float) for f, i in place.items()}
            for first, codes in leaves.blocks(batch, False):
                size = min(BLOCK, batch.num_rows - first)
                for start, (f, (bins, width)) in zip(starts, shapes.items()):
                    used, bit = using[f], leaves.bits[place[f]][using[f]]
                    own = np.maximum(np.searchsorted(bounds[f], x[f][first : first + size], side="left"), 1) - 1
                    met = np.ones((size, width), np.float32)  # sums of a block are whole numbers
                    if len(used):
                        met[:, :-1] = (codes[:, used] | bit) == leaves.full[used]
                    inside = (np.arange(bins)[:, None] == own).astype(np.float32)
                    total[start : start + bins * width] += (inside @ met).ravel()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen].astype(np.int64))], names=["_code", "_n"])

    sums = np.zeros(starts[-1])
    for code, n in df.select(*leaves.columns()).mapInArrow(counted, "_code int, _n long").groupBy("_code").agg(F.sum("_n")).collect():
        sums[code] = n  # a row for each entry
    found = []
    for start, (f, (bins, width)) in zip(starts, shapes.items()):
        table = sums[start : start + bins * width].reshape(bins, width)
        steps = np.diff(leaves.effect(place[f], bounds[f])[using[f]], axis=1) if len(using[f]) else np.zeros((0, bins))
        for b in np.flatnonzero(table[:, -1]):
            found.append((f, int(b) + 1, float(table[b, :-1] @ steps[:, b] / table[b, -1]), int(table[b, -1])))
    return found


def tree_swapped(scorer, df: DataFrame, keep: Sequence[str], donors: Sequence[str], out: Sequence[str]) -> DataFrame:
    """`keep` and, for each feature, the prediction of the row with that feature's value from its column of `donors`.

    A block of rows meets all leaves once; a swapped feature changes only its own word, or, of trees with many leaves, its own bit
    at the leaves that use it.
    """
    leaves, names = Leaves(scorer), list(dict.fromkeys(keep))
    reached = Reached.of(scorer, leaves)
    parts = [(np.flatnonzero(bits), np.flatnonzero(bits == 0)) for bits in leaves.bits]

    def by_words(x, other, first):
        rows = slice(first, first + BLOCK)
        rest, trees = reached.others([reached.words(i, v[rows]) for i, v in enumerate(x)]), np.arange(len(reached.table) // 64)
        return [reached.values(words & reached.words(i, v[rows]), trees) for i, (words, v) in enumerate(zip(rest, other))]

    def by_bits(x, other, first):
        rows, found = slice(first, first + BLOCK), []
        codes = sum(leaves.satisfied(i, v[rows]) for i, v in enumerate(x))
        for i, (used, rest) in enumerate(parts):
            pred = (codes[:, rest] == leaves.full[rest]) @ leaves.values[rest]
            moved = codes[:, used] - leaves.satisfied(i, x[i][rows])[:, used] + leaves.satisfied(i, other[i][rows])[:, used]
            found.append(pred + (moved == leaves.full[used]) @ leaves.values[used])
        return found

    def swapped(batches):
        for batch in batches:
            other, x = _known(batch, "_d", len(donors)), _known(batch, "_x", len(donors))
            pred = np.full((len(donors), batch.num_rows), leaves.constant, float)
            for first in range(0, batch.num_rows, BLOCK):
                for i, found in enumerate((by_words if reached else by_bits)(x, other, first)):
                    pred[i, first : first + BLOCK] += found
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, pred)], names=[*names, *out])

    rows = df.select(*names, *leaves.columns(), *[F.col(d).cast("double").alias(f"_d{i}") for i, d in enumerate(donors)])
    kind = StructType([*rows.select(*names).schema.fields, *[StructField(o, DoubleType()) for o in out]])
    return rows.mapInArrow(swapped, kind)
