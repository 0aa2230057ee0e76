import random
import re

import numpy as np
import pytest

from geoseries.llm import near_dedup as near

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def plain_groups(rows, size, percent):
    sets = [plain_set(t, size) for _, t in rows]
    top = list(range(len(rows)))

    def head(k):
        while top[k] != k:
            k = top[k]
        return k

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * both >= percent * len(sets[x] | sets[y]):
                top[head(x)] = head(y)
    low = {}
    for k, (i, _) in enumerate(rows):
        h = head(k)
        low[h] = i if low.get(h) is None else low[h] if i is None else min(i, low[h])
    return sorted((str(i), len(sets[k]), str(low[head(k)]), i == low[head(k)]) for k, (i, _) in enumerate(rows))


def thue_morse(length):
    """Two words without a common shingle that every polynomial hash modulo 2**64 confuses."""
    bits = [bin(i).count("1") % 2 for i in range(length)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def edited(rng, words, share):
    return [w if rng.random() > share else f"x{rng.randrange(10**9)}" for w in words]


def family(seed, count, length, shares):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(length)]
    return [" ".join(edited(rng, base, rng.choice(shares))) for _ in range(count)]


CASES = {
    "empty": [],
    "odd texts": [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE\x0btwo"), (8, "one\xa0two"), (9, "Ä b c"), (10, "ä b c")],
    "null and repeated ids": [(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "p q r s"), (None, "p q r s")],
    "copies": [(1000 - i, "the same words in every row") for i in range(400)] + [(i, f"own words {i} of row {i}") for i in range(50)],
    "long": [(1, "word and more " * 30_000), (2, "word and more " * 30_000 + "end"), (3, " ".join(map(str, range(40_000)))), (4, " ".join(map(str, range(39_000))))],
    "words of one polynomial hash": [(k, w) for n in (1024, 2048) for k, w in enumerate(thue_morse(n), n)],
    "families": list(enumerate([t for s in range(25) for t in family(s, 12, 120, [0.005, 0.02, 0.05])])),
    "large family": list(enumerate(family(7, 500, 100, [0.01, 0.03, 0.06, 0.1]))),
}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
@pytest.mark.parametrize("name", CASES)
def test_against_brute_force(docs, name, size, percent):
    rows = CASES[name]
    if percent == 80 and name not in ("odd texts", "families"):
        pytest.skip("one setting is enough")
    got = near.near_groups(docs(rows).repartition(3), size=size, percent=percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == plain_groups(rows, size, percent)


def test_one_of_each_group_stays_whole(docs):
    rows = CASES["odd texts"] + [(100 + i, t) for i, t in enumerate(family(3, 20, 100, [0.01]))]
    table = docs(rows)
    kept = near.drop_near_copies(table)
    assert kept.columns == table.columns
    want = [int(i) for i, _, _, k in plain_groups(rows, 5, 80) if k]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_rows_are_told_by_place(spark, docs, tmp_path):
    """Ids that repeat or are null: of each group one row stays, and no other row goes."""
    drop = near.drop_near_copies
    alike = family(11, 6, 120, [0.005])
    clean = [f"{w} own words of no other row here" for w in "abc"]
    rows = [(3, alike[0]), (4, alike[1]), (4, clean[0]), (None, alike[2]), (3, alike[3]), (None, clean[1]), (3, alike[0]), (3, clean[2]), (9, None), (9, "")]
    for table in (docs(rows).repartition(3), spark.read.parquet(write(docs(rows), tmp_path))):
        kept = drop(table)
        assert kept.columns == table.columns
        got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
        assert len(got) == 6 and [g for g in got if g[1] in clean] == sorted([("4", clean[0]), ("None", clean[1]), ("3", clean[2])])
        assert [g[0] for g in got if g[1] in alike] == ["3"] and sum(g == ("9", "") for g in got) == 2


def write(df, folder):
    df.repartition(2).write.parquet(f"{folder}/docs")
    return f"{folder}/docs"


@pytest.mark.parametrize("percent", [5, 20, 50, 80, 85, 95, 100])
def test_bands_follow_the_threshold(percent):
    bands, rows = near.banding(percent)
    assert (1 - (percent / 100) ** rows) ** bands <= near.MISS
    assert bands * rows <= near.REGISTERS or rows == 1
    with pytest.raises(ValueError):
        near.banding(0)


def test_low_threshold_finds_its_links(docs):
    """Links of 50 to 60 % are all found."""
    rng = random.Random(5)
    rows = []
    for k in range(60):
        base = [f"w{k}x{i}" for i in range(100)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: 67 + rng.randrange(3)] + [f"v{k}x{i}" for i in range(33)]))]
    got = near.near_groups(docs(rows), size=1, percent=50).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == plain_groups(rows, 1, 50)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 1 << 63, 6000, dtype=np.uint64))
    for share in (0.2, 0.5, 0.85, 1.0):
        errors = []
        for _ in range(30):
            rng.shuffle(pool)
            both = int(2000 * share)
            a, b = np.sort(pool[:2000]), np.sort(np.concatenate([pool[:both], pool[2000 : 4000 - both]]))
            assert (np.maximum(near.sketch(a), near.sketch(b)) == near.sketch(np.union1d(a, b))).all()
            true = both / (4000 - both)
            got = near.estimate(near.sketch(a)[None], near.sketch(b)[None], np.array([2000.0]), np.array([2000.0]))[0]
            errors.append(got - true)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_hashes_tell_words_apart():
    assert len(np.unique(near.word_hashes(" ".join(map(str, range(100_000)))))) == 100_000
    assert near.word_hashes("A é b").tolist() == near.word_hashes("a\té\x0bb").tolist()
