import hashlib

import pytest
import tiktoken

import corpus_pipeline
import public_tokenizers
from geoseries.llm import byte_bpe, decontamination, quality
from geoseries.llm.common import learnable, staged, table
from tests.llm.test_near_dedup import plain_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage."""
    docs = table(spark, SF, "documents")
    extra = [(9000, None, "en", None, None), (9001, "", None, "s", 0), (9002, "word and so on " * 20_000, "en", "s", 1), (None, "No id, but a few words of text.", "en", "s", 1)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).union(docs.limit(5))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], SF), "test"))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_quality(spark, stages):
    model = quality.train(stages[0], table(spark, SF, "labels"), learnable("doc_id", 3, 1))
    want = [(i, t) for i, t in rows(stages[0]) if model.probability(quality.features(t or "")[None])[0] >= 0.5]
    assert sorted(rows(stages[1]), key=str) == sorted(want, key=str)
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {i for i, _ in rows(stages[1])}
    assert sum(i in kept for i, q in labels.items() if q == 1) / sum(q == 1 for q in labels.values()) > 0.9


def test_copies(stages):
    best = {}
    for i, t in rows(stages[1]):
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    assert sorted((-1 if i is None else i, t or "") for i, t in rows(stages[2])) == sorted((i, t) for t, i in best.items())


def test_near_copies(stages):
    before = rows(stages[2])
    kept = [i for i, _, _, k in plain_groups(before, 5, 80) if k]
    assert sorted(str(i) for i, _ in rows(stages[3])) == sorted(kept)


def test_benchmark(spark, stages):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    windows = {w for _, t in items for w in decontamination.windows(decontamination.words(t))}
    clean = [i for i, t in rows(stages[3]) if not any(f" {w} " in f" {' '.join(decontamination.words(t))} " for w in windows)]
    assert sorted(map(str, clean)) == sorted(str(i) for i, _ in rows(stages[4]))


def test_tokens(stages):
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((str(i), len(plain.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows(stages[4]))
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in stages[5].collect()) == want


def test_run(spark):
    assert 0 < corpus_pipeline.run(spark, SF).count() < 200
