import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoseries.llm import quality, suite

GOOD = "There were a few people in the town who still knew how the old bridge had been built, and they told it well."
JUNK = "BUY!! NOW!! BUY!! NOW!! BUY!! NOW!! ### $$$"


def test_features_are_finite_for_any_text():
    for text in ["", " ", "\n", "a", "é", "😀" * 9, "x" * 100_000, JUNK * 500]:
        found = quality.features(text)
        assert found.shape == (quality.WIDTH,) and np.isfinite(found).all()


def test_risk_stays_unbiased_by_the_prior():
    """With a third of junk hidden among the unlabelled rows, junk is told apart without a single junk label."""
    rng = np.random.default_rng(1)
    words = GOOD.split()
    good = np.array([quality.features(" ".join(rng.permutation(words))) for _ in range(300)])
    junk = np.array([quality.features(" ".join(rng.permutation(JUNK.split()))) for _ in range(100)])
    model = quality.fit(good[:100], np.concatenate([good[100:], junk]), 2 / 3)
    assert (model.probability(good) >= 0.5).mean() > 0.98 and (model.probability(junk) < 0.5).mean() > 0.98


def test_nothing_to_learn(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = docs([(1, None), (1, None), (None, GOOD)])
    model = quality.train(rows, labels, F.lit(True))
    got = quality.score(rows, model).collect()
    assert [(r.doc_id, r.score, r.predicted) for r in got] == [(1, 0.5, 1), (1, 0.5, 1), (None, 0.5, 1)]
    assert quality.keep_good(rows, model).schema == rows.schema
    assert quality.score(docs([]), model).collect() == []


def test_odd_labels(spark, docs):
    rows = docs([(i, GOOD if i % 3 else JUNK) for i in range(90)] + [(3, JUNK), (None, GOOD)])
    labels = spark.createDataFrame([(i, None if i % 7 == 0 else int(i % 3 > 0), 0) for i in range(90)] + [(1, 1, 0), (999, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(rows, labels, F.lit(True))
    got = {r.doc_id: r.predicted for r in quality.score(rows, model).collect()}
    assert all(got[i] == int(i % 3 > 0) for i in range(90))
    assert {r.text for r in quality.keep_good(rows, model).collect()} == {GOOD}


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf_dir):
    got = {r.doc_id: r for r in suite.QUERIES["op7_quality"](spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert np.mean([a == 0 for a, b in held if b == 0]) > 0.85


def plain_features(text):
    """The same features byte by byte and word by word."""
    raw = list(text.encode())
    if not raw:
        return [0.0] * quality.WIDTH
    pairs = [0] * quality.PAIRS
    for a, b in zip(raw, raw[1:]):
        pairs[((a * 256 + b) * 2654435761 % 2**32) >> 24] += 1
    share = lambda fits: sum(map(fits, raw)) / len(raw)
    words = text.split()
    n, same = max(1, len(words)), sum(a == b for a, b in zip(words, words[1:]))
    distinct = set(words)
    shapes = [
        share(lambda b: 65 <= b <= 90), share(lambda b: 97 <= b <= 122), share(lambda b: 48 <= b <= 57),
        share(lambda b: 33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127), share(lambda b: b == 10), share(lambda b: b > 127),
        same / n, math.sqrt(same / n), len(distinct) / n, len(distinct) / n**0.8, max([words.count(w) for w in distinct], default=0) / n,
        min(30, sum(map(len, distinct)) / max(1, len(distinct))) / 10, math.log1p(n) / 10,
    ]
    return [math.sqrt(c / max(1, len(raw) - 1)) for c in pairs] + shapes


def test_scores_equal_the_definition():
    texts = ["", "a", "One two two THREE 4 5!", "é ß\n\n日本 x_y {z}", "same " * 50, "the quick brown fox, again and again.\nNext line 77"]
    rows = np.stack([quality.features(t) for t in texts])
    for text, row in zip(texts, rows):
        assert row.tolist() == pytest.approx(plain_features(text), rel=1e-5, abs=1e-7)
    rng = np.random.default_rng(8)
    model = quality.fit(rng.normal(1, 1, (300, quality.WIDTH)).astype(np.float32), rng.normal(0, 1, (500, quality.WIDTH)).astype(np.float32), 0.4)
    for row, got in zip(rows, model.probability(rows), strict=True):
        score = model.bias + sum(w * max(-8, min(8, (x - m) / s)) for w, x, m, s in zip(model.weights, row, model.mean, model.scale))
        assert got == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, score)))), rel=1e-4)
