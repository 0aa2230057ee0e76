import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from geoseries.llm import byte_bpe
from tests.llm.test_pretokens import twins

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PLAIN = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})
CODEC = byte_bpe.Codec(PATH, PATTERN)
TEXTS = [
    "", " ", "  \n\n x", "it's we'll 'super' don't''s I'D", "a\x1cb\x1f c\x85d\xa0e", "日本語 　テスト 😀👩‍👩‍👧", "x" * 3000,
    "<|endoftext|> <unk> <s> ⁇ ▁", "tab\tnew\r\nline   ", "½²Ⅷ 123 ٣٤", "\x00\x01\x7f", "Ünïcödé ßöü", "end \n", " \t \n  q",
]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_as_by_ranks(text):
    ids = CODEC.encode(text).tolist()
    assert ids == PLAIN.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("'stremld \n\t.,")), max_size=60))
def test_any_text(text):
    ids = CODEC.encode(text).tolist()
    assert ids == PLAIN.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@pytest.mark.parametrize("length", [1024, 2048, 4096])
def test_words_of_one_hash(length):
    for texts in (twins(length), twins(length)[::-1]):
        own = byte_bpe.Codec(PATH, PATTERN)
        for text, ids in zip(texts, own.cache.encode_many(list(texts))):
            assert ids.tolist() == PLAIN.encode_ordinary(text) and own.decode(ids.tolist()) == text.encode()


def test_cache_starts_over():
    small = byte_bpe.Codec(PATH, PATTERN)
    small.cache.limit = 2
    for text in TEXTS * 2:
        assert small.encode(text).tolist() == PLAIN.encode_ordinary(text)


def test_tables(spark, docs):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 50_000)]
    got = byte_bpe.round_trip(docs(rows), PATH, PATTERN).collect()
    assert len(got) == len(rows)
    for (i, t), r in zip(rows, got):
        ids = PLAIN.encode_ordinary(t or "")
        assert (r.doc_id, r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.round_trip(docs([]), PATH, PATTERN).collect() == []
    encoded = byte_bpe.encode(docs(rows), PATH, PATTERN)
    back = byte_bpe.decode(encoded, PATH, PATTERN).collect()
    assert [bytes(r.content) for r in back] == [(t or "").encode() for _, t in rows]
