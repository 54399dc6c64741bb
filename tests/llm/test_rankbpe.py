"""Byte-level BPE by ranks against the library on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from veldspar.llm.queries import QUERIES
from veldspar.llm.rankbpe import Ranks, decode_ranks, encode_ranks, parts

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
AWKWARD = [
    "", " ", "\n\n  \t x", "a" * 3000, " " * 3000 + "x", "'s 't''ll can't-won't 'S", "<|endoftext|> </s>", "x y　z   ​ a", "é ́ á b",
    "中文。文字" * 300, "١٢ 12² ½", "\x00\x1c \x1d\x85 x", "\U0001f600\U0001f3fd ‍" * 40, "tab\tand\r\nline " * 200, "1,2;3 a.b(c)d!e" * 100, "'" * 99 + "s",
]


@pytest.fixture(scope="module")
def ranks():
    return Ranks(PATH, PATTERN)


def test_parts_change_nothing(ranks):
    rng = random.Random(5)
    texts = [*AWKWARD, *("".join(rng.choice(" \n\t'sat,.!1é中。 ́€") for _ in range(400)) for _ in range(300))]
    for text in texts:
        for size in (1, 7, 64):
            cut = list(parts(text, size))
            assert "".join(cut) == text
            assert ranks.encode(text, size).tolist() == ranks.encoding.encode_ordinary(text)


def test_a_text_without_a_safe_place_is_one_part():
    assert list(parts("a" * 99, 10)) == ["a" * 99] and list(parts(" " * 99, 10)) == [" " * 99]


def test_rows(spark, ranks):
    rows = [(1, t, 7) for t in AWKWARD] + [(None, None, 8), (2, "same", 1), (2, "same", 1), (3, "word, " * 40_000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")  # a column named as one of the result's
    got = encode_ranks(df, PATH, PATTERN, decode=True, part=512)
    want = sorted((i if i is not None else -1, len(x := ranks.encoding.encode_ordinary(t or "")), np.array(x, "<u4").tobytes(), (t or "").encode()) for i, t, _ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in got.collect()) == want
    back = decode_ranks(got.drop("decoded"), PATH, PATTERN)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted(x[3] for x in want)
    none = spark.createDataFrame([("x", None)], "doc_id string, ids binary")
    assert [(r.doc_id, bytes(r.decoded)) for r in decode_ranks(none, PATH, PATTERN).collect()] == [("x", b"")]
    assert encode_ranks(df.limit(0), PATH, PATTERN).count() == 0


def test_ids_cut_inside_a_character(spark, ranks):
    ids = ranks.encode("\U0001f9ff")
    assert len(ids) > 1
    df = spark.createDataFrame([(1, bytearray(ids[:1].tobytes()))], "doc_id long, ids binary")
    assert bytes(decode_ranks(df, PATH, PATTERN).first().decoded) == ranks.encoding.decode_bytes(ids[:1].tolist())


def test_op13(spark, ranks):
    docs = {r["doc_id"]: r["text"] or "" for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    rows = {r.doc_id: r for r in QUERIES["op13_tiktoken"](spark, "/root/testdata/sf0.001").collect()}
    assert set(rows) == set(docs)
    for i, text in docs.items():
        ids = ranks.encoding.encode_ordinary(text)
        assert rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
