import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from geoseries.llm import pretokens

# The tokenizer libraries' \s is Unicode white space; Python's holds more.
SPACE = "".join(map(chr, pretokens.WHITE))
OWN = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
FIND = regex.compile(OWN).findall


def pieces(texts):
    points = np.concatenate([np.append(np.frombuffer(t.encode("utf-32-le"), "<u4"), np.uint32(pretokens.BETWEEN)) for t in texts])
    starts = pretokens.cut(points)
    spans = [points[a:b] for a, b in zip(starts, np.append(starts[1:], len(points)))]
    return [None if s[0] == pretokens.BETWEEN else s.tobytes().decode("utf-32-le") for s in spans]


ODD = st.text(st.one_of(st.sampled_from("''''stremvldSLx1½² \n\t　\xa0.,é"), st.characters(codec="utf-8", exclude_categories=["Cn"])), max_size=25)


@settings(max_examples=1500, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=4))
def test_cuts_as_the_pattern(texts):
    assert pieces(texts) == [p for t in texts for p in [*FIND(t), None]]


@pytest.mark.parametrize("text", ["", "'", "'s", "''s", "x'll 'lla're'", " 's", "a's't", "\n's", "  'd", "r'e", "'r", "'l", "a  b", " ", "  \n"])
def test_apostrophes_and_ends(text):
    assert pieces([text]) == [*FIND(text), None]


def test_cache_is_bounded():
    cache = pretokens.PieceCache(public_tokenizers.PATTERN, lambda ps: [[ord(c) for c in p] for p in ps], limit=50)
    rng = np.random.default_rng(2)
    for _ in range(60):
        texts = ["".join(rng.choice(list("abc 1.'\n"), 12)) for _ in range(5)] + [""]
        assert [x.tolist() for x in cache.encode_many(texts)] == [[ord(c) for c in t] for t in texts]
        assert len(cache.keys) <= 50 + 80
    assert cache.encode_many([]) == []


def twins(length):
    """Two words of a and b that every polynomial hash modulo 2**64 confuses from 1,024 letters on: Thue-Morse and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(length)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("length", [1024, 2048, 4096])
@pytest.mark.parametrize("order", [1, -1])
def test_pieces_of_one_hash(length, order):
    own = pretokens.PieceCache(public_tokenizers.PATTERN, lambda ps: [[ord(c) for c in p] for p in ps])
    pair = list(twins(length))[::order]
    for texts in (pair, [pair[1]], [f"{pair[0]} {pair[1]} and {pair[0]}"]):
        assert [x.tolist() for x in own.encode_many(texts)] == [[ord(c) for c in t] for t in texts]


def test_short_pieces_of_one_hash(monkeypatch):
    """With a hash that tells nothing but lengths apart, every piece has its own ids all the same."""
    monkeypatch.setattr(pretokens, "hashes", lambda first, second, sizes: sizes.astype(np.uint64) // np.uint64(2))
    own = pretokens.PieceCache(public_tokenizers.PATTERN, lambda ps: [[ord(c) for c in p] for p in ps], limit=20)
    rng = np.random.default_rng(4)
    for _ in range(40):
        texts = ["".join(rng.choice(list("abc 1.'\nö日"), 40)) for _ in range(5)] + ["", "a\x00", "a", "a" * 16, "a" * 17, "a" * 15 + "\x00"]
        assert [x.tolist() for x in own.encode_many(texts)] == [[ord(c) for c in t] for t in texts]
