import math

import numpy as np
import pytest

from geoseries.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>, label int, id long, vec string, ids string"


def plain(rows, every, k):
    """Every query against every row. rows: (id, vector)."""
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    fine = sorted({(i, tuple(v)) for i, v in fine})
    out = {}
    for q in sorted({i for i, _ in fine if i % every == 0}):
        asks = min(v for i, v in fine if i == q)
        found = sorted({(-math.fsum(a * b for a, b in zip(asks, v)), i) for i, v in fine if i != q})
        out[q] = [(i, -s) for s, i in found[:k]]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 7, "x", "y") for i, v in rows], SCHEMA).repartition(3)


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def normal(seed, count, dim, lengths=(1.0, 1.0)):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(count, dim))
    v *= (rng.uniform(*lengths, size=count) / np.linalg.norm(v, axis=1))[:, None]
    return [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]


EXACT = {
    "empty": [],
    "no vector to use": [(20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (None, [1.0, 2.0]), (120, [])],
    "one row": [(20, [1.0, 2.0])],
    "fewer than k": [(i, [float(i), 1.0]) for i in range(15, 25)],
    "ties": [(i, [1.0, float(i % 2)]) for i in range(0, 30)] + [(i, [-0.0 if i % 2 else 0.0, 2.0]) for i in range(30, 60)],
    "repeats": [(20, [1.0, 2.0])] * 3 + [(20, [2.0, 1.0]), (21, [1.0, 2.0]), (21, [1.0, 2.0]), (21, [3.0, 2.0]), (-40, [1.0, 1.0])],
    "lengths": [(20, [1.0, 2.0, 3.0]), (21, [1.0]), (22, [0.0, 0.0, 5.0]), (40, [2.0, 2.0])],
    "large numbers": [(20, [1e300, 1.0]), (21, [1e-300, 1.0]), (22, [-1e300, 0.0]), (40, [1.0, 1.0])],
}


@pytest.mark.parametrize("name", EXACT)
def test_small_tables_are_exact(spark, name):
    rows = EXACT[name]
    found, want = got(neighbours.nearest(table(spark, rows), every=20, k=20)), plain(rows, 20, 20)
    assert found == {q: near for q, near in want.items() if near}


@pytest.mark.parametrize("rows,sample", [(normal(1, 3000, 24), 16_384), (normal(2, 3000, 12, (0.2, 3.0)), 600)])
def test_recall_and_scores(spark, rows, sample):
    found, want = got(neighbours.nearest(table(spark, rows), every=20, k=20, sample_rows=sample)), plain(rows, 20, 20)
    assert set(found) == set(want) and all(len(f) == 20 for f in found.values())
    of = dict(rows)
    for q, near in found.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(s == math.fsum(a * b for a, b in zip(of[q], of[i])) for i, s in near)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_copies_take_no_space(spark):
    """A third of all rows holds one vector: its smallest ids are found, and recall elsewhere stays."""
    rows = normal(3, 1200, 16)
    rows = [(i, rows[7][1] if i % 3 == 1 else v) for i, v in rows]
    found, want = got(neighbours.nearest(table(spark, rows), every=20, k=20)), plain(rows, 20, 20)
    copies = [q for q in want if q % 3 == 1]
    assert all([i for i, _ in found[q]] == [i for i in range(1, 100, 3) if i != q][:20] for q in copies)
    assert sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_queue_hands_out_cells_by_distance():
    """Cells come in the order of the squared distances beyond the splits on their way, over all trees."""
    sample = np.random.default_rng(5).normal(size=(600, 8))
    forest = neighbours.Forest(sample)
    sizes = np.bincount(forest.cells(sample).ravel(), minlength=forest.trees * forest.leaves)
    point = forest.queries(sample[:1])[0]
    beyond = {}
    for t, (directions, cuts) in enumerate(forest.splits):
        for leaf in range(forest.leaves):
            node, total = leaf + forest.leaves - 1, 0.0
            while node:
                above = (node - 1) // 2
                m = directions[above] @ point - cuts[above]
                total += m * m if (m >= 0) != (node % 2 == 0) else 0.0
                node = above
            beyond[t * forest.leaves + leaf] = total
    order = next(forest.search(sample[:1], sizes, len(sizes), 0))
    assert sorted(order) == list(range(len(sizes)))
    assert [beyond[c] for c in order] == pytest.approx(sorted(beyond.values()))
    assert set(next(forest.search(sample[:1], sizes, 5, 0))) == set(order[:5])


def test_large_cells_are_split():
    first, bins = neighbours._packed(np.array([5, 5, 30, 1, 1, 9, 9, 2]), 10, 4)
    assert bins.tolist() == [1, 1, 3, 1, 1, 1, 1, 1]
    assert first.tolist() == [0, 0, 1, 4, 5, 5, 6, 7]
