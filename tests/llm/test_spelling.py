import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from geoseries.llm import spelling

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows):
    n = plain_words(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def invented(seed, count, letters="abcé", sizes=(4, 9)):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(*sizes))) for _ in range(count)]
    return [(i, " ".join(rng.choices(words, k=rng.randint(0, 200)))) for i in range(120)]


TEXT = "people people people poeple peopl peoples people people Peoplé peopl peopl peoples peoples"
CASES = {
    "empty": [],
    "odd texts": [(1, None), (2, ""), (3, "a b c"), (None, "hello hello hello hallo hallo hallo"), (4, "hello×hello÷hello naïve NAÏVE naïve nAïve 数hello数helloß"), (4, "hello")],
    "chains": [(1, f"{'aaaaab ' * 3}{'aaaaaa ' * 6}{'aaaaac ' * 6}{'aaaaaac ' * 12}{'aaaaaacd ' * 24}{'aaaaacd ' * 48}")],
    "repeats": [(7, TEXT)] * 5 + [(i, TEXT) for i in range(100)],
    "short words": invented(1, 400, "ab"),
    "letters": invented(2, 900),
    "long words": [(1, " ".join([w] * 3)) for w in ("ab" * 6000, "ab" * 6000 + "a", "ab" * 3000 + "c" + "ab" * 2999 + "b", "ba" * 6000, "xyzzy")],
    "long text": [(1, "wordy worde wordes " * 40_000)],
}


@pytest.mark.parametrize("split", [spelling.SPLIT, 3])
@pytest.mark.parametrize("name", CASES)
def test_against_brute_force(spark, docs, name, split):
    if split == 3 and name not in ("short words", "letters", "chains"):
        pytest.skip("no large block")
    got = spelling.variants(docs(CASES[name]).repartition(3), split=split).collect()
    assert sorted(tuple(r) for r in got) == plain_variants(CASES[name])
    assert name not in ("chains", "short words", "letters", "long words") or any(r.n_near for r in got)


@pytest.mark.parametrize("count", [700, 40])
def test_large_block_in_tiles(count):
    """One block, several tiles: every pair one edit apart, once."""
    rng = random.Random(3)
    words = sorted({"pre" + "".join(rng.choice("abc") for _ in range(rng.choice([6, 7]))) + "post" for _ in range(count * 3)})
    longer = np.array([len(w) == 14 for w in words])
    full = np.full(len(words), 1)
    a, b = spelling._close([w.encode("latin-1") for w in words], longer, full, 0 * full, 13 * full, 13 * full)
    got = sorted(tuple(sorted((words[x], words[y]))) for x, y in zip(a, b))
    want = sorted((v, w) for k, w in enumerate(words) for v in words[:k] if one_edit(v, w) and not (len(v) == len(w) == 14))
    assert got == want
