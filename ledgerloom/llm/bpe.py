"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_map, id_and_text, table, text_of, utf8

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Texts of more characters are cut into pieces of about this many before the tokenizer sees them.
PIECE_CHARS = 16_384
#: Ids are ordinary text's only: no special token is ever recognised.
IDS = T.ArrayType(T.IntegerType(), False)

#: No match of the default pattern goes over these places, whatever stands around them: white space follows something else, or
#: a letter and a digit meet. Each of its alternatives takes white space only at its start, and never letters and digits together.
#: That need not hold for other patterns, by which texts are encoded whole.
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


def default_ranks() -> tuple[str, str]:
    """Path of the rank file and pattern of the public tokenizer package."""
    import public_tokenizers

    return public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def encoding(rank_path: str, pattern: str):
    """The encoder of a rank file; one in a Python worker serves all its tasks."""
    import tiktoken

    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Cut a text at safe places, each the first at or after size characters; a run without any stays whole."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size and (m := SAFE.search(text, start + size)) and m.start() < len(text):
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def encode(text: str, rank_path: str, pattern: str) -> list[int]:
    """Token ids of a text, as the tiktoken library gives them for the whole text at once; only by the default pattern is it cut."""
    enc = encoding(rank_path, pattern)
    if len(text) <= PIECE_CHARS or pattern != default_ranks()[1]:
        return enc.encode_ordinary(text)
    return [i for piece in pieces(text) for i in enc.encode_ordinary(piece)]


def decode(ids: list[int], rank_path: str, pattern: str) -> bytes:
    """Raw bytes of ids; they needn't be valid UTF-8 where a text was cut between tokens."""
    return encoding(rank_path, pattern).decode_bytes(ids)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Rows (id_col, ids) for every row of docs. A null text has no ids, as an empty one. Rows are mapped where they lie: no shuffle."""
    path, pat = (rank_path, pattern) if rank_path and pattern else default_ranks()
    source = id_and_text(docs, id_col, text_col)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [encode(text_of(x), path, pat) for x in utf8(batch.column(1))]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = pa.array((i for x in ids for i in x), pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=[id_col, "ids"])

        return step

    return arrow_map(source, make, T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField("ids", IDS)]))


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", rank_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Rows (id_col, decoded binary) from ids; null ids give null."""
    path, pat = (rank_path, pattern) if rank_path and pattern else default_ranks()
    source = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [None if x is None else decode(x, path, pat) for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

        return step

    return arrow_map(source, make, T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, rank_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode every whole text and decode its ids in one pass over the rows: id_col, n_tokens, ids_sha256, decoded_sha256, lossless
    (the decoded bytes are the text's), and with keep_ids the ids.

    Null and empty texts have no tokens and the digests of nothing. Long texts are cut at safe places only, so their ids are
    those of the whole text. Bytes that aren't UTF-8 are encoded as U+FFFD, so such a text isn't lossless. Repeated rows give repeated results; other columns of docs aren't read.
    """
    path, pat = (rank_path, pattern) if rank_path and pattern else default_ranks()
    source = id_and_text(docs, id_col, text_col)
    fields = [
        T.StructField(id_col, source.schema["id"].dataType),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("lossless", T.BooleanType()),
        *([T.StructField("ids", IDS)] if keep_ids else []),
    ]

    def make():
        enc = encoding(path, pat)
        names = [str(i) for i in range(enc.n_vocab)]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, of_ids, of_bytes, same, kept = [], [], [], [], []
            for raw in utf8(batch.column(1)):
                ids = encode(text_of(raw), path, pat)
                back = enc.decode_bytes(ids)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(back).hexdigest())
                same.append(back == raw)
                if keep_ids:
                    kept.append(np.array(ids, dtype=np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string()), pa.array(same, pa.bool_())]
            if keep_ids:
                ends = np.cumsum([0, *counts], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept), pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

        return step

    return arrow_map(source, make, T.StructType(fields))


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless")
