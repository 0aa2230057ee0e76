import hashlib
from collections import defaultdict

import pytest

from geoseries.llm.exact_dedup import copy_groups, drop_copies, filter_bits

CASES = {
    "empty table": [],
    "nulls equal empty": [(1, None), (2, ""), (3, "a"), (None, "a")],
    "null ids only": [(None, "a"), (None, "a"), (4, "b")],
    "repeated rows": [(5, "x"), (5, "x"), (4, "x"), (6, "y"), (6, "y")],
    "no change of case or space": [(1, "A"), (2, "a"), (3, "a "), (4, "a")],
    "long text": [(1, "word " * 200_000), (2, "word " * 200_000), (3, "word " * 200_000 + "x")],
    "large group": [(i, "same") for i in range(3000)] + [(3000 + i, f"own {i}") for i in range(500)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("max_bits", [1 << 16, 1 << 28])
def test_groups_by_brute_force(docs, name, max_bits):
    rows = CASES[name]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    low = lambda i: -1 if i is None else i
    got = copy_groups(docs(rows).repartition(4), max_bits=max_bits).collect()
    assert len(got) == len(rows)
    want = sorted((low(i), low(max(groups[t or ""], key=low)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((low(r.doc_id), low(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("name", CASES)
def test_one_whole_row_of_each_group_stays(docs, name):
    rows = CASES[name]
    table = docs(rows).repartition(4)
    kept = drop_copies(table)
    assert kept.columns == table.columns
    got = [(r.doc_id, r.text or "") for r in kept.collect()]
    best = {}
    for i, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    assert sorted((-1 if i is None else i, t) for i, t in got) == sorted((i, t) for t, i in best.items())


def test_filter_size_is_bounded():
    assert filter_bits(0) == 1 << 16
    assert filter_bits(100_000) == 1 << 21
    assert filter_bits(10**12) == 1 << 28
