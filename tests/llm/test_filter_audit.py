import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from geoseries.llm import filter_audit, term_matrix

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(250))


def plain_audit(rows, labels):
    """Definition, document by document and order by order. rows: (doc_id, text, source)."""
    docs = []
    for i, text, source in rows:
        text = text or ""
        words = WORDS.findall(text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        good = any(j == i and q == 1 for j, q, _ in labels) and i is not None
        toxic = any(j == i and x == 1 for j, _, x in labels) and i is not None
        docs.append((source or "", fails, good, toxic))
    out = []
    for part in {d[0] for d in docs}:
        mine, shapley = [d for d in docs if d[0] == part], Counter()
        found = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shapley[f] += len(gone)
                earlier = order[: step - 1]
                redundant = sum(d[1][f] and any(d[1][e] for e in earlier) for d in mine)
                only = sum(d[1][f] and sum(d[1].values()) == 1 for d in mine)
                lost = [sum(d[k] for d in gone) for k in (2, 3)]
                found.append((part, "".join(order), step, len(left), len(gone), redundant, only, *lost))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


CASES = {
    "empty": ([], []),
    "odd": (
        [(1, None, "a"), (2, "", "a"), (3, " \t\n\x0b", None), (4, None, ""), (None, None, "a"), (None, "A$", "b"), (5, LONG, "b"), (5, LONG, "b"), (6, LONG, "b")],
        [(1, 1, 0), (1, 0, 1), (5, None, 1), (6, 1, None), (None, 1, 1), (99, 1, 1)],
    ),
    "limits": (
        [
            (10, " ".join(["a"] * 100 + [f"x{i}" for i in range(100)]), "s"),
            (11, " ".join(["a"] * 102 + [f"x{i}" for i in range(98)]), "s"),
            (12, " ".join(f"x{i}" for i in range(199)), "s"),
            (13, "A" * 2 + "é" * 98, "s"),
            (14, "A" * 2 + "é" * 97, "s"),
            (15, "one\x85two\xa0three " * 120, "s"),
            (16, "ein Wort | mehr " * 30_000, "s"),
            (17, "The the THE", None),
        ],
        [(i, i % 2, i % 3 == 0) for i in range(10, 18)],
    ),
    "copies": ([(1000 - i, "same text", "hot") for i in range(300)] + [(i, f"own {i} " * 150, f"s{i % 3}") for i in range(50)], [(i, 1, 0) for i in range(600, 900)]),
}


@pytest.mark.parametrize("name", CASES)
def test_against_definition(spark, name):
    rows, labels = CASES[name]
    table = spark.createDataFrame(
        [(i, t, s, 1, "x", "y") for i, t, s in rows], "doc_id long, text string, source string, failed int, part string, shard string"
    ).repartition(3)
    marks = spark.createDataFrame([(i, q, None if x is None else int(x), "z") for i, q, x in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(table, marks).collect()
    assert sorted(tuple(r) for r in got) == plain_audit(rows, labels)


def test_matrix_holds_every_word_once(docs):
    rows = [(i, " ".join(f"w{(i * k) % 7}" for k in range(i))) for i in range(10)] + [(10, None), (11, "ü w1 W1")]
    matrix, words = term_matrix.term_matrix(docs(rows).repartition(2), most=(1 << 20, 3))
    of = {r.id: r.word for r in words.collect()}
    assert len(set(of.values())) == len(of)
    found = {}
    for shard in matrix.collect():
        starts, columns, counts = (term_matrix.unpack(shard[c], t) for c, t in (("starts", "<i4"), ("columns", "<i8"), ("counts", "<i4")))
        assert len(shard.kept) <= 3
        for k, row in enumerate(shard.kept):
            mine = columns[starts[k] : starts[k + 1]]
            assert (np.diff(mine) > 0).all()
            found[row.doc_id] = {of[c]: n for c, n in zip(mine, counts[starts[k] : starts[k + 1]])}
    assert found == {i: dict(Counter(WORDS.findall(t or ""))) for i, t in rows}
