import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoseries.llm import suite, toxicity

CALM = "there were some people in the town who knew how the old bridge had been built".split()


def make(rng, rude):
    words = [*rng.choice(CALM, 60), *["scoundrel"] * rude]
    rng.shuffle(words)
    return " ".join(words)


def sample(seed, n=240):
    rng = np.random.default_rng(seed)
    rude = [(0, 0, 0, 1, 3, 8)[k % 6] for k in range(n)]
    return rude, [make(rng, r) for r in rude]


def test_severity_grows_with_the_marks():
    known = {}
    rude, texts = sample(1)
    model = toxicity.fit([(*toxicity.counts_of(t, known), int(r > 0)) for r, t in zip(rude, texts)])
    assert (np.diff(model.thresholds) > 0).all()
    rude, texts = sample(2)
    above = model.above([model.vector(*toxicity.counts_of(t, known)) for t in texts])
    assert (np.diff(above, axis=1) <= 0).all()  # P(grade > k) falls with k, as the weights are shared
    means = [above.sum(1)[np.array(rude) == r].mean() for r in (0, 1, 3, 8)]
    assert means == sorted(means) and means[0] < 0.2 and means[3] > 2.3
    assert ((above[:, 0] >= 0.5) == (np.array(rude) > 0)).mean() > 0.99


def test_gradient_by_differences():
    """The fitted point is a minimum of the penalised likelihood computed directly."""
    known = {}
    rude, texts = sample(3, 120)
    rows = [(*toxicity.counts_of(t, known), int(r > 0)) for r, t in zip(rude, texts)]
    model = toxicity.fit(rows, steps=4000, rate=0.02, decay=0.05)
    grade = toxicity._grades(rows, model.slots)
    vectors = [model.vector(*r[:3]) for r in rows]

    def loss(weights, thresholds):
        above = toxicity.OrdinalModel(model.slots, weights, thresholds).above(vectors)
        ends = np.concatenate([np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))], 1)
        here = ends[np.arange(len(rows)), grade] - ends[np.arange(len(rows)), grade + 1]
        return -np.log(here).mean() + 0.025 * (weights**2).sum()

    best = loss(model.weights, model.thresholds)
    for k in range(len(model.weights)):
        for shift in (-0.05, 0.05):
            assert loss(model.weights + shift * (np.arange(len(model.weights)) == k), model.thresholds) > best - 1e-5
    for k in range(toxicity.GRADES):
        for shift in (-0.05, 0.05):
            assert loss(model.weights, model.thresholds + shift * (np.arange(toxicity.GRADES) == k)) > best - 1e-5


def test_odd_rows(spark, docs):
    rude, texts = sample(4, 120)
    rows = [*enumerate(texts), (500, None), (501, ""), (502, ""), (502, ""), (None, "scoundrel " * 3), (503, "scoundrel " * 100_000)]
    labels = [(i, 1, None if i % 10 == 9 else int(r > 0)) for i, r in enumerate(rude)] + [(None, 1, 1), (999, 1, 1), (1, 1, int(rude[1] > 0))]
    model = toxicity.train(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
    got = toxicity.severity(docs(rows), model).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r for r in got}
    assert all(of[i].predicted == int(r > 0) for i, r in enumerate(rude))
    assert of[None].predicted == of[503].predicted == 1 and of[500].severity == of[501].severity < 0.5
    assert toxicity.severity(docs([]), model).collect() == []
    none = toxicity.train(docs(rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"), F.lit(True))
    assert all(r.predicted == 0 for r in toxicity.severity(docs(rows), none).collect())


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.1"])
def test_held_out(spark, sf_dir):
    got = {r.doc_id: r for r in suite.QUERIES["op3_toxicity"](spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.severity <= 3 for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([p for p, y in held if y]) > 0.85 and np.mean([p for p, y in held if not y]) < 0.01


def plain_above(model, text):
    """P(grade > k) by the definition, word by word."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    counts = {}
    for word in words:
        for feature in [word] + ["^" + word[:n] for n in (5, 7) if len(word) > n]:
            slot = zlib.crc32(feature.encode()) % toxicity.SLOTS
            counts[slot] = counts.get(slot, 0) + 1
    known = model.slots.tolist()
    marks = sum(counts.get(s, 0) for s in known)
    score = sum(model.weights[i] * math.log1p(counts[s]) for i, s in enumerate(known) if s in counts)
    score += model.weights[-3] * math.log1p(marks) + model.weights[-2] * 20 * marks / max(len(words), 1) + model.weights[-1] * math.log1p(len(words)) / 10
    return [1 / (1 + math.exp(-max(-30, min(30, score - t)))) for t in model.thresholds]


def test_scores_equal_the_definition():
    known = {}
    rude, texts = sample(3)
    model = toxicity.fit([(*toxicity.counts_of(t, known), int(r > 0)) for r, t in zip(rude, texts)])
    texts = texts[:40] + ["", "1 2 3", "SCOUNDREL!", "Scoundrels, scoundrel-like; ärger", "bridge " * 300 + "scoundrel"]
    above = model.above([model.vector(*toxicity.counts_of(t, {})) for t in texts])
    for text, got in zip(texts, above, strict=True):
        assert got.tolist() == pytest.approx(plain_above(model, text))
