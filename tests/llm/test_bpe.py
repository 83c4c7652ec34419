import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import bpe

PATH, PATTERN = bpe.default_ranks()
TEXTS = ["", None, "Hello world's end", "a" * 60_000, "x1y2 " * 9000, "  \n\n\t tab  ", "é ß 漢字 🙂" * 5000, "<|endoftext|> it's", "don't'll 'ves"]


def reference_ids(text):
    return bpe.encoding(PATH, public_tokenizers.PATTERN).encode_ordinary(text or "")


@given(st.text(alphabet="ab1 \n\t'se.漢🙂", max_size=300), st.integers(1, 40))
@settings(max_examples=300, deadline=None)
def test_pieces_keep_ids(text, size):
    cut = bpe.pieces(text, size)
    assert "".join(cut) == text
    assert [i for p in cut for i in reference_ids(p)] == reference_ids(text)


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_long_texts(text):
    assert bpe.encode(text, PATH, PATTERN) == reference_ids(text)


def test_round_trip(spark, docs_of):
    rows = [*enumerate(TEXTS), (1, TEXTS[2]), (None, "no id")]
    got = bpe.round_trip(docs_of(rows), keep_ids=True).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.ids_sha256) for r in got}
    for i, t in rows:
        ids = reference_ids(t)
        assert (i, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) in by
    assert all(r.lossless and r.n_tokens == len(r.ids) for r in got)
    assert {r.decoded_sha256 for r in got} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}


def test_encode_decode_frames(spark, docs_of):
    decoded = bpe.decode_ids(bpe.encode_texts(docs_of([(1, "é🙂 x"), (2, None)])))
    assert {r.doc_id: bytes(r.decoded) for r in decoded.collect()} == {1: "é🙂 x".encode(), 2: b""}


def test_empty(docs_of):
    assert bpe.round_trip(docs_of([])).count() == 0


def test_bytes_that_are_not_utf8_and_other_patterns(spark):
    docs = spark.createDataFrame([(1, bytearray(b"one \xff two"))], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text")
    r = bpe.round_trip(docs, keep_ids=True).first()
    path, pattern = bpe.default_ranks()
    assert not r.lossless and bpe.decode(r.ids, path, pattern) == "one \ufffd two".encode()
    assert bpe.encode_texts(docs).first().ids == r.ids
    other, text = r"[a-z]+[ \d]*|.|\s", "ab 12 cd " * 6000
    assert bpe.encode(text, path, other) == bpe.encoding(path, other).encode_ordinary(text)
