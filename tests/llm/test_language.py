import math
import random
import zlib

import numpy as np
import pytest

from geoseries.llm import language, suite

TEXTS = {
    "en": ["the quick brown fox jumps over the lazy dog and then the other things that were there"] * 3,
    "de": ["der schnelle braune fuchs springt über den faulen hund und dann noch eine straße weiter"] * 3,
    "el": ["η γρήγορη αλεπού πηδάει πάνω από το τεμπέλικο σκυλί"],
}


def plain_phrases(sample: list[int], text: list[int]) -> int:
    """Longest matches found by trying every substring."""
    parts = {tuple(sample[i:j]) for i in range(len(sample)) for j in range(i + 1, len(sample) + 1)}
    at, count = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and tuple(text[at : at + size + 1]) in parts:
            size += 1
        at, count = at + size, count + 1
    return count


def test_phrases_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(40):
        sample = rng.integers(0, 4, 25).tolist()
        texts = [rng.integers(0, 5, n).astype(np.uint8) for n in sorted(rng.integers(0, 30, 6).tolist(), reverse=True)]
        sizes = np.array([len(t) for t in texts])
        pieces = np.zeros((max(sizes.max(), 1), len(texts)), np.uint8)
        for k, t in enumerate(texts):
            pieces[: len(t), k] = t
        got = language.CrossParser(sample, 5).phrases(pieces, sizes)
        assert got.tolist() == [plain_phrases(sample, t.tolist()) for t in texts]


def test_predictions():
    model = language.Model(TEXTS)
    texts = ["THE FOX and the dog", "über die Straße", "το σκυλί", "", "123 ... !", "the brown dog " * 20_000]
    assert [p[0] for p in model.predict(texts)] == ["en", "de", "el", "und", "und", "en"]
    assert all(0 <= p[1] <= 1 for p in model.predict(texts))
    assert language.Model({}).predict(["abc"]) == [("und", 0.0)]


def plain_symbols(text):
    """Letters as they are, one blank for every run of other characters between letters."""
    return list(" ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()))


def plain_predict(samples, text):
    """The definition: phrases found by searching substrings, bits per character, the smallest wins."""
    own = plain_symbols(text)
    if not own:
        return "und", 0.0
    bits = {}
    for name in sorted(samples):
        sample = [c for t in samples[name] for c in [*plain_symbols(t), " "]]
        joined, at, phrases = "".join(sample), 0, 0
        while at < len(own):
            size = 1
            while at + size < len(own) and "".join(own[at : at + size + 1]) in joined:
                size += 1
            at, phrases = at + size, phrases + 1
        bits[name] = phrases * math.log2(max(len(sample), 2)) / len(own)
    best = min(sorted(bits), key=bits.get)
    return best, 1 / sum(2 ** (-language.SHARPNESS * (b - bits[best])) for b in bits.values())


def test_predictions_equal_the_definition():
    rng = random.Random(6)
    words = [w for texts in TEXTS.values() for t in texts for w in t.split()] + ["zzz", "日本", "42", "don't", "Æ"]
    samples = {"en": TEXTS["en"][:1], "de": TEXTS["de"][:1], "el": TEXTS["el"], "none": [""]}
    model = language.Model(samples)
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(120)] + ["", " 1 ", "ß", "the" * 200]
    for text, (name, score) in zip(texts, model.predict(texts), strict=True):
        want, share = plain_predict(samples, text)
        assert name == want and score == pytest.approx(share)


def test_tables(spark, docs):
    rows = [(1, None), (None, "the dog"), (2, "the dog"), (2, "the dog"), (3, "")]
    got = language.identify(docs(rows), TEXTS).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "en"), (1, "und"), (2, "en"), (2, "en"), (3, "und")]
    assert language.identify(docs([]), TEXTS).collect() == []
    assert language.draw_samples(language.learned_rows(docs([]))) == {}
    assert language.draw_samples(language.learned_rows(docs(rows)))["en"] == ["the dog"] * 3


def test_every_language_is_learned(spark):
    """Languages of long texts only, and any number of languages."""
    rows = [(i, f"w{i % 300} " * 30, f"l{i % 300}") for i in range(600)] + [(1000 + i, "lang und weit " * 10_000, "long") for i in range(3)]
    drawn = language.draw_samples(spark.createDataFrame(rows, "id long, text string, lang string"), 5_000)
    assert len(drawn) == 301 and 5_000 <= sum(map(len, drawn["long"])) <= 10_000


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf_dir):
    got = suite.QUERIES["op9_language"](spark, sf_dir).collect()
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r.lang_pred == truth[r.doc_id][0] for r in got if r.held_out and len(truth[r.doc_id][1]) > 30]
    assert sum(held) / len(held) > 0.97
