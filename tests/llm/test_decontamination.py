import hashlib
import random

import pytest

from geoseries.llm import decontamination as dec

ITEMS = [
    (10, "One two three four five six seven eight nine ten eleven."),
    (9, "what is it"),
    (8, "Zwölf ÄPFEL 日本"),
    (7, None),
    (6, "?!"),
    (5, "one two three four five six seven eight nine ten eleven"),
    (4, "a a a a a a a a a a a a"),
    (3, "two"),
]
TEXTS = [
    "", None, "... !", "ONE two, three four five six seven eight nine ten eleven twelve", "say: What Is\nit? two",
    "a " * 25, "zwölf äpfel 日本", "zwölf ÄPFEL 日本 x", "one two three four five six seven eight nine", "whatisit is it", "word " * 100_000 + "what is it",
]
rng = random.Random(3)
TEXTS += [" ".join(rng.choice("one two three a what is it nine ten".split()) for _ in range(60)) for _ in range(60)]


def brute(text, items, size=dec.WINDOW):
    found = dec.words(text)
    hit, of = set(), set()
    for i, t in items:
        w = dec.words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            window = w[k : k + size]
            for at in range(len(found) - len(window) + 1):
                if found[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    of.add(str(i))
    return len(found), len(hit), sorted(of)


@pytest.fixture
def benchmark(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("limit", [dec.MAX_CHARACTERS, 100])
def test_against_brute_force(docs, benchmark, limit):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "two")]
    flagged = dec.flag_documents(docs(rows).repartition(3), benchmark(ITEMS), max_characters=limit)
    got = sorted(flagged.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    for (i, t), r in zip(sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)), got, strict=True):
        assert (r.doc_id, r.n_words, r.n_hit, list(r.items)) == (i, *brute(t, ITEMS))
        assert sum(len(dec.words(t[s.start : s.end])) for s in r.spans) == r.n_hit
    digest = dec.digest_columns(flagged).filter("doc_id = 3").first()
    assert digest.items_sha256 == hashlib.sha256(b"10,3,5").hexdigest() and digest.n_items == 3 and digest.contaminated


def test_keeps_clean_rows_whole(docs, benchmark):
    rows = list(enumerate(TEXTS))
    table = docs(rows)
    kept = dec.flag_documents(table, benchmark(ITEMS), keep=True)
    assert kept.schema.names == table.schema.names
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in rows if not brute(t, ITEMS)[1]]
    assert kept.filter("kept = 'x'").count() == kept.count()


def test_empty_tables(docs, benchmark):
    assert dec.flag_documents(docs([]), benchmark(ITEMS)).collect() == []
    got = dec.flag_documents(docs([(1, "two words")]), benchmark([])).collect()
    assert [(r.n_words, r.n_hit, r.items) for r in got] == [(2, 0, [])]
