"""Secret scans: fixed patterns, and a token-efficiency test for random strings."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import default_ranks, encoding
from .common import arrow_map, id_and_text, table, text_of, utf8

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")

#: What any match of ASSIGN holds, in lower case.
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"api")
#: Maximal runs in which keys, digests and random strings stand whole.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Lower-case hex of these lengths is a known kind of digest; of other forms, UUIDs are identifiers.
DIGEST_CHARS = frozenset({32, 40, 56, 64, 96, 128})
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z")
#: Runs joined by dots, of which none needs to be that long.
DOTTED = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)+")
#: Identifiers: parts that are numbers, very short, or words of one case or in camel case with a short number at the end.
JOIN = re.compile(r"[+/_=-]+")
PART = re.compile(r"(?:\d*|[A-Za-z0-9]{1,3}|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*\d{0,4}|[A-Z]+\d{0,4})\Z")
#: A word of one case; of RUN_CHARS letters or more it has to pass the token test, as camel case needn't.
ONE_CASE = re.compile(r"([A-Z]?[a-z]+|[A-Z]+)\d{0,4}\Z")
#: Least length of a run, and of a stretch inside one.
RUN_CHARS = 16
#: A run with fewer characters to a token than this is taken for random; long words of one case, and groups of three to five characters
#: that are joined, at lower figures, as rare words and abbreviations come near the first.
CHARS_PER_TOKEN = 2.1
ONE_CASE_LESS, GROUPS_LESS = 0.1, 0.3
#: Least and greatest length of a group, and characters of all groups of a run.
GROUP, GROUP_CHARS = (3, 5), 12


def base_spans(text: str, raw: bytes) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) of base findings in code points, and the maximal runs of key characters."""
    found = []
    low = raw.lower()
    if any(hint in low for hint in ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    runs = [m.span() for m in RUN.finditer(text)]
    for a, b in runs:  # both patterns' characters belong to a run's, so their matches never leave one
        found += [("access", *m.span()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= ACCESS_CHARS]
        if b - a >= HEX_CHARS:
            found += [("hex", *m.span()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= HEX_CHARS]
    return found, runs


def is_long_word(part: str) -> bool:
    """A word of one case that is so long that the token test decides."""
    m = ONE_CASE.match(part)
    return bool(m) and len(m[1]) >= RUN_CHARS


def is_random(x: str, enc, least: float) -> bool:
    """Too few characters a token for words."""
    return len(x) < (least - ONE_CASE_LESS * is_long_word(x)) * len(enc.encode_ordinary(x))


def is_id(run: str) -> bool:
    """Digests and UUIDs."""
    return bool(DIGEST.match(run) and len(run) in DIGEST_CHARS or UUID.match(run))


def is_known(run: str, enc, least: float) -> bool:
    """Digests, UUIDs, numbers and identifiers made of words."""
    return is_id(run) or all(PART.match(x) and not (is_long_word(x) and is_random(x, enc, least)) for x in JOIN.split(run))


def is_grouped(run: str, enc, least: float) -> bool:
    """An identifier by its parts, of which those of three to five characters aren't words: such as a serial key."""
    groups = [x for x in JOIN.split(run) if GROUP[0] <= len(x) <= GROUP[1] and not x.isdigit()]
    size = sum(map(len, groups))
    return size >= GROUP_CHARS and 2 * size >= len(run) and size < (least - GROUPS_LESS) * sum(len(enc.encode_ordinary(x)) for x in groups)


def stretches(run: str, enc, least: float) -> list[tuple[int, int]]:
    """Maximal stretches of a run between its known parts of more than three characters, without joining characters around."""
    out, parts = [], [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9]+", run)]
    at = None
    for a, b in parts:
        if b - a > 3 and is_known(run[a:b], enc, least):
            at = None
        elif at is None:
            at = a
            out.append((a, b))
        else:
            out[-1] = (at, b)
    return [(a, b) for a, b in out if b - a >= RUN_CHARS]


def dense_spans(run: str, enc, least: float) -> list[tuple[int, int]]:
    """A run's stretches and, where one isn't low in characters a token as a whole, its parts and its tokens' densest stretch."""
    out = []
    low = lambda x: len(x) >= RUN_CHARS and not is_known(x, enc, least) and is_random(x, enc, least)
    for a, b in stretches(run, enc, least):
        if low(run[a:b]):
            out.append((a, b))
            continue
        parts = [(a + m.start(), a + m.end()) for m in re.finditer(r"[A-Za-z0-9]+", run[a:b])]
        found = [(x, y) for x, y in parts if low(run[x:y])]
        if not found:
            total, start, at, best, top = 0.0, a, a, None, 0.0
            for size in map(len, enc.decode_tokens_bytes(enc.encode_ordinary(run[a:b]))):
                if total <= 0:
                    total, start = 0.0, at
                total, at = total + least - size, at + size
                if total > top:
                    top, best = total, (start, at)
            found = [best] if best and low(run[best[0] : best[1]]) else []
        out += found
    return out


def random_spans(text: str, runs: list[tuple[int, int]], taken: list[tuple[str, int, int]], enc, least: float = CHARS_PER_TOKEN) -> list[tuple[str, int, int]]:
    """Runs of few characters a token, or else such stretches inside them or across dots, that no base finding overlaps."""
    out = []
    free = lambda x, y: not any(s < y and x < e for _, s, e in taken)
    for a, b in runs:
        run = text[a:b]
        if is_known(run, enc, least):
            if free(a, b) and not is_id(run) and is_grouped(run, enc, least):
                out.append(("random", a, b))
        elif free(a, b) and is_random(run, enc, least):
            out.append(("random", a, b))
        else:
            out += [("random", a + x, a + y) for x, y in dense_spans(run, enc, least) if free(a + x, a + y)]
    found = set(out)
    for m in DOTTED.finditer(text):
        if m.end() - m.start() >= RUN_CHARS:
            parts = [p.span() for p in re.finditer(r"[^.]+", m[0]) if p.end() - p.start() > 3 and not is_known(p[0], enc, least)]
            size = sum(y - x for x, y in parts)
            if len(parts) > 1 and size >= RUN_CHARS and size < least * sum(len(enc.encode_ordinary(m[0][x:y])) for x, y in parts):
                a, b = m.start() + parts[0][0], m.start() + parts[-1][1]
                if free(a, b) and not any(s < b and a < e for _, s, e in found):
                    out.append(("random", a, b))
    return out


def scan(raw: bytes, enc, least: float = CHARS_PER_TOKEN) -> list[tuple[str, int, int]]:
    """All findings of a UTF-8 text by start, then kind as listed in KINDS."""
    text = text_of(raw)
    found, runs = base_spans(text, raw)
    found += random_spans(text, runs, found, enc, least)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    chars_per_token: float = CHARS_PER_TOKEN,
    rank_path: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Rows (id_col, found) for every row of docs; found: kind, start and end in code points of each finding in the whole text.

    Null and empty texts have none; bytes that aren't UTF-8 count as one character each, U+FFFD. A run is at most as long as its
    text, and all runs but known ones are encoded. Rows are mapped where they lie, so repeated rows give repeated results; other
    columns aren't read.
    """
    path, pat = (rank_path, pattern) if rank_path and pattern else default_ranks()
    source = id_and_text(docs, id_col, text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        enc = encoding(path, pat)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(x, enc, chars_per_token)] for x in utf8(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[id_col, "found"])

        return step

    return arrow_map(source, make, T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField("found", FOUND)]))


def listed(found):
    """Findings as kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"] != "random")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed("found").alias("spans"), count("random"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
