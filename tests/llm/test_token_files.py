import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from geoseries.llm import suite, token_files
from geoseries.session import scratch_path
from tests.llm.test_pretokens import twins

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
WHOLE.encode_special_tokens = True
CASES = {
    "mixed": [(7, "b c"), (3, None), (5, ""), (3, "twice"), (3, "twice"), (None, "no id"), (9, "it's <|endoftext|> é 日本 \x1c x")],
    "long": [(1, "word and more " * 60_000), (2, "short"), (3, "x" * 5000)],
    "many": [(i * 7 % 501, f"text number {i} " * (i % 9)) for i in range(501)],
    "words of one hash": [(k, w) for n in (1024, 2048, 4096) for k, w in enumerate([*twins(n), *twins(n)[::-1]], n)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("length", [16, 2048])
def test_files_hold_whole_texts_in_order(spark, docs, name, length):
    uri = scratch_path(spark, "tokens")
    rows = CASES[name]
    parts = token_files.write_token_files(docs(rows).repartition(3), uri, PATH, public_tokenizers.PATTERN, 2, parts=4, length=length)
    got = sorted(token_files.read_documents(spark, uri, parts).collect(), key=lambda r: r.start)
    start, stream = 0, []
    for (i, t), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), got, strict=True):
        ids = np.array([*WHOLE.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        stream.append(ids)
    flat = []
    for part, _, total in parts:
        file = token_files.TokenFile(uri, part)
        n = sum(b.num_rows for b in file.batches)
        assert n == -(-total // length) and all(b.num_rows == token_files.BATCH_ROWS for b in file.batches[:-1])
        masks = np.concatenate([file.sequence(k, "mask") for k in range(n)])
        assert masks.sum() == total and (np.diff(masks.astype(int)) <= 0).all()
        flat.append(np.concatenate([file.sequence(k) for k in range(n)])[masks == 1])
    if rows:
        assert (np.concatenate(flat) == np.concatenate(stream)).all()


def test_sequences_are_views(spark, docs):
    uri = scratch_path(spark, "tokens")
    parts = token_files.write_token_files(docs(CASES["long"]), uri, PATH, public_tokenizers.PATTERN, 2, parts=1, length=128)
    file = token_files.TokenFile(uri, parts[0][0])
    assert not file.sequence(100).flags.owndata and len(file.sequence(100)) == 128


def test_query_encodes_as_the_unmodified_library(spark, tmp_path):
    texts = [None, "a <|endoftext|> b", "it's\n <|endoftext|><|endoftext|>  x <|endoftext", "plain words", "<|endoftext|>"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    start, plain = 0, Tokenizer.from_file(PATH)
    for r in sorted(suite.QUERIES["op2_token_files"](spark, str(tmp_path)).collect(), key=lambda r: r.doc_id):
        ids = np.array([*plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
