"""Line dedup by a tree of log templates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table, utf8, written

#: Leading tokens that, with the token count, name a leaf of the tree; they are never generalised, but for digits.
DEPTH = 2
#: Least part of a template's tokens that are fixed: in lines with masked fields, and where one more field is left open.
FIXED, FIXED_OPEN = 0.5, 0.8
#: Templates in at least so many documents recur.
LEAST_DOCS = 3
#: Lines of fewer tokens are words and headings that may recur by chance: they need more documents.
SHORT_TOKENS, SHORT_DOCS = 3, 10
#: Lines of more tokens are passages that don't recur by chance: with all tokens equal, two documents are enough.
LONG_TOKENS, LONG_DOCS = 50, 2
FIELD = b"<*>"
DIGIT = re.compile(rb"[0-9]")


def parsed(line: bytes) -> tuple[list[bytes], int] | None:
    """A line's tokens with fields masked, and how many are fixed; None for lines without tokens or with too many fields.

    Tokens stand between ASCII white space; those that hold a digit are fields.
    """
    tokens = line.split()
    if DIGIT.search(line):
        tokens = [FIELD if DIGIT.search(t) else t for t in tokens]
    fixed = len(tokens) - tokens.count(FIELD)
    return (tokens, fixed) if tokens and fixed >= FIXED * len(tokens) else None


def written_out(tokens: list[bytes]) -> bytes:
    return b"%d %s" % (len(tokens), b" ".join(tokens))


def place_hash(place: int, token: bytes) -> int:
    return xxhash.xxh3_128_intdigest(token, seed=place)


def digest(n: int, total: int) -> bytes:
    return ((total + n) % (1 << 128)).to_bytes(16, "little")


def template_key(tokens: list[bytes]) -> bytes:
    """128-bit key of a template; of one with fields it is a sum over places, so that opening one more place costs two hashes."""
    if FIELD not in tokens:
        return xxhash.xxh3_128_digest(written_out(tokens))
    return digest(len(tokens), sum(map(place_hash, range(len(tokens)), tokens)))


def may_open(n: int, fixed: int) -> bool:
    """Whether one more token of a template may be left open."""
    return fixed - 1 >= FIXED_OPEN * n


def halves(n: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """Token ranges of the two halves of what follows a leaf's leading tokens."""
    mid = DEPTH + (n - DEPTH) // 2
    return (DEPTH, mid), (mid, n)


def opened_keys(tokens: list[bytes], start: int, end: int) -> Iterator[bytes]:
    """Keys of the templates in which one fixed token from start to end is open."""
    n, total = len(tokens), sum(map(place_hash, range(len(tokens)), tokens))
    for i in range(start, end):
        if tokens[i] != FIELD:
            yield digest(n, total - place_hash(i, tokens[i]) + place_hash(i, FIELD))


def templates(line: bytes) -> list[bytes]:
    """All templates of a line: its own, and those with one more open token after the first DEPTH."""
    if (got := parsed(line)) is None:
        return []
    tokens, fixed = got
    places = range(DEPTH, len(tokens)) if may_open(len(tokens), fixed) else ()
    return [written_out(tokens), *(written_out([*tokens[:i], FIELD, *tokens[i + 1 :]]) for i in places if tokens[i] != FIELD)]


def least_of(n: int, least_docs: int = LEAST_DOCS) -> int:
    """Documents that make a template of n tokens, none of them opened, recur."""
    return SHORT_DOCS if n < SHORT_TOKENS else LONG_DOCS if n > LONG_TOKENS else least_docs


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def own_templates(raw: bytes, least_docs: int) -> list[tuple]:
    """(line number, key, first in this text, documents needed, bytes with the line's end, key of all but either half) of each line."""
    out, seen = [], set()
    for number, line in enumerate(raw.split(b"\n")):
        if (got := parsed(line)) is None:
            continue
        tokens, fixed = got
        n = len(tokens)
        key = template_key(tokens)
        rest = (None, None)
        if may_open(n, fixed):
            rest = tuple(_signed(xxhash.xxh3_64_intdigest(written_out([*tokens[:a], *tokens[b:]]), seed=2 * n + side)) for side, (a, b) in enumerate(halves(n)))
        out.append((number, key, key not in seen, least_of(n, least_docs), len(line) + 1, *rest))
        seen.add(key)
    return out


def open_templates(raw: bytes, asked: list[tuple[int, int]], least_docs: int) -> list[tuple]:
    """The same (without the last two) of the templates with an open token in the asked (line, half)."""
    lines = [parsed(line) for line in raw.split(b"\n")]
    seen = {template_key(x[0]) for x in lines if x is not None and FIELD in x[0]}
    out, sizes = [], [len(x) + 1 for x in raw.split(b"\n")]
    for number, half in sorted(asked):
        tokens = lines[number][0]
        for key in opened_keys(tokens, *halves(len(tokens))[half]):
            out.append((number, key, key not in seen, least_docs, sizes[number]))
            seen.add(key)
    return out


def _batch(ids: pa.Array, hashes: pa.Array, totals: list[int], found: list[list[tuple]], names: list[str]) -> pa.RecordBatch:
    rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
    cells = list(zip(*(x for f in found for x in f), strict=True)) or [()] * (len(names) - 4)
    keys = np.frombuffer(b"".join(cells[1]), dtype="<i8").reshape(-1, 2)
    at = pa.array(rows)
    kinds = (pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    columns = [ids.take(at), hashes.take(at), pa.array(np.array(totals, dtype=np.int32)[rows]), pa.array(cells[0], pa.int32())]
    columns += [pa.array(np.ascontiguousarray(keys[:, k])) for k in (0, 1)]
    columns += [pa.array(c, kind) for c, kind in zip(cells[2:], kinds, strict=False)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def template_rows(docs: DataFrame, id_col: str, text_col: str, least_docs: int) -> DataFrame:
    """Rows (id, text_hash, total, line, k1, k2, first, least, size) of all templates that more than one distinct line may have.

    Each line has one row for its own template. Templates with an open token are written for a line only if another distinct
    line of its leaf has all tokens but those of one half, as only then can two lines differ in just one token there. So long
    lines cost two keys each, not one a token, and none of their templates is left out.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    source = docs.select(docs[id_col].alias("id"), text.alias("text")).select("id", "text", F.xxhash64("text").alias("text_hash"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, text_hash long, total int, line int, k1 long, k2 long, first boolean, least int, size int"
    names = [x.split()[0] for x in schema.split(", ")]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = utf8(batch.column(1))
                found = [own_templates(x, least_docs) for x in texts]
                yield _batch(batch.column(0), batch.column(2), [len(x) + 1 for x in texts], found, [*names, "rest0", "rest1"])

    keyed = written(source.mapInArrow(own, schema + ", rest0 long, rest1 long"), "line-templates")
    sides = F.inline(F.array(*(F.struct(F.lit(h).alias("half"), F.col(f"rest{h}").alias("rest")) for h in (0, 1))))
    known = keyed.where("rest0 is not null")
    met = known.select("k1", F.col("first").cast("long").alias("n"), sides).groupBy("rest").agg(F.min("k1").alias("x"), F.max("k1").alias("y"), F.sum("n").alias("n"))
    met = cut(met.where((F.col("x") != F.col("y")) & (F.col("n") >= least_docs)).select("rest"))
    asked = known.select("id", "text_hash", "line", sides).join(met, "rest", "left_semi")
    asked = asked.groupBy("id", "text_hash").agg(F.collect_set(F.struct("line", "half")).alias("asked"))
    asked = cut(asked.select(F.col("id").alias("own_id"), F.col("text_hash").alias("own_hash"), "asked"))
    again = source.join(asked, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash"))).select("id", "text", "text_hash", "asked")

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                texts = utf8(batch.column(1))
                wanted = [[(a["line"], a["half"]) for a in x] for x in batch.column(3).to_pylist()]
                found = [open_templates(x, a, least_docs) for x, a in zip(texts, wanted, strict=True)]
                yield _batch(batch.column(0), batch.column(2), [len(x) + 1 for x in texts], found, names)

    return keyed.select(*names).union(written(again.mapInArrow(more, schema), "open-templates"))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, spare: float | None = None) -> DataFrame:
    """Rows (id, text_hash, drop: sorted line numbers from 0) of documents with lines to drop.

    A template recurs if enough rows of docs have it: least_docs, SHORT_DOCS for lines of fewer than SHORT_TOKENS tokens, LONG_DOCS
    for those of more than LONG_TOKENS with no opened token. Its first line, by id (null first), text hash and place, stays; all
    others go. A line goes if it does under any of its templates. Only 16-byte keys, ids and line numbers are shuffled, and the
    texts in which templates may have open tokens; counts are taken before the shuffle, and the join with the recurring templates
    reads tables on both sides, so that adaptive execution splits a template that a large part of all lines has. No template's
    lines are gathered in a task.

    spare: texts that are copies lose nothing. A text is a copy if lines of at least this part of it, and of the other one, are
    lines of the text that holds the first line of its rarest recurring template.
    """
    rows = template_rows(docs, id_col, text_col, least_docs)
    place = F.struct("id", "text_hash", "line", "total")
    counted = rows.groupBy("k1", "k2").agg(F.sum(F.col("first").cast("long")).alias("n_docs"), F.min("least").alias("least"), F.min(place).alias("keeper"))
    recurring = cut(counted.where("n_docs >= least").select("k1", "k2", "n_docs", "keeper"))
    gone = rows.join(recurring, ["k1", "k2"]).where(~place.eqNullSafe(F.col("keeper")))
    dropped = gone.groupBy("id", "text_hash")
    if spare is None:
        return dropped.agg(F.array_sort(F.collect_set("line")).alias("drop"))
    rarest = F.struct("n_docs", (-F.col("size")).alias("size"), "keeper")
    drops = cut(dropped.agg(F.array_sort(F.collect_set("line")).alias("drop"), F.first("total").alias("total"), F.min(rarest)["keeper"].alias("keeper")))
    larger = F.greatest("total", "keeper.total")
    pairs = drops.where(F.least("total", "keeper.total") >= F.lit(spare) * larger).select("id", "text_hash", "keeper", larger.alias("larger"))
    pairs = pairs.where(~(F.col("id").eqNullSafe(F.col("keeper.id")) & (F.col("text_hash") == F.col("keeper.text_hash"))))
    mine = _of_text(pairs.select("id", "text_hash", F.col("keeper.id").alias("other_id"), F.col("keeper.text_hash").alias("other_hash"), "larger"), rows)
    theirs = rows.select(F.col("id").alias("their_id"), F.col("text_hash").alias("their_hash"), "k1", "k2").distinct()
    same = mine.join(theirs, ["k1", "k2"]).where(F.col("their_id").eqNullSafe(F.col("other_id")) & (F.col("their_hash") == F.col("other_hash")))
    shared = same.select("id", "text_hash", "larger", "line", "size").distinct().groupBy("id", "text_hash", "larger").agg(F.sum("size").alias("shared"))
    copies = cut(shared.where(F.col("shared") >= F.lit(spare) * F.col("larger")).select(F.col("id").alias("copy_id"), F.col("text_hash").alias("copy_hash")))
    is_copy = F.col("id").eqNullSafe(F.col("copy_id")) & (F.col("text_hash") == F.col("copy_hash"))
    return drops.select("id", "text_hash", "drop").join(copies, is_copy, "left_anti")


def _of_text(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """texts with the templates, lines and line sizes of each."""
    own = rows.select(F.col("id").alias("own_id"), F.col("text_hash").alias("own_hash"), "k1", "k2", "line", "size")
    return texts.join(own, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash"))).drop("own_id", "own_hash")


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, spare: float | None = None, details: str | None = None) -> DataFrame:
    """docs with their recurring lines dropped from text_col; all rows and other columns stay as they are.

    spare: see recurring_lines. details: name of a further column, struct(n_lines, dropped line numbers). Null texts stay null and
    empty ones empty. Rows with equal ids and texts are counted each and lose the same lines.
    """
    gone = recurring_lines(docs, id_col, text_col, least_docs, spare).select(F.col("id").alias("__ll_id"), F.col("text_hash").alias("__ll_hash"), F.col("drop").alias("__ll_drop"))
    text = docs[text_col].cast("string")
    same = docs[id_col].eqNullSafe(F.col("__ll_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("__ll_hash"))
    joined = docs.join(gone, same, "left")
    # lines and kept places are bound once each, not evaluated again where they are used
    split = F.split(text, "\n", -1)
    bound = F.array(F.struct(split.alias("l"), F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__ll_drop")).alias("k")))
    left = F.transform(bound, lambda s: F.array_join(F.transform(s["k"], lambda i: s["l"][i]), "\n"))[0]
    kept = F.when(F.col("__ll_drop").isNotNull(), left).otherwise(text)
    out = [kept.alias(c) if c == text_col else joined[c] for c in docs.columns]
    if details:
        none = F.array().cast("array<int>")
        out.append(F.struct(F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("n_lines"), F.coalesce("__ll_drop", none).alias("dropped")).alias(details))
    return joined.select(*out)


def op1_lines(spark, sf_dir: str) -> DataFrame:
    out = drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"), details="found")
    return out.select(
        "doc_id",
        F.col("found.n_lines").cast("long").alias("n_lines"),
        F.size("found.dropped").cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS txt FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
tokens AS (
  SELECT doc_id, line, list_transform(list_filter(regexp_split_to_array(txt, '[ \t\n\r\f\v]+'), lambda x: x <> ''),
         lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM lines),
sized AS (SELECT *, len(t) AS n, len(list_filter(t, lambda x: x <> '<*>')) AS fixed FROM tokens),
usable AS (SELECT * FROM sized WHERE n > 0 AND fixed >= 0.5 * n),
keys AS (
  SELECT doc_id, line, md5(array_to_string(t, ' ')) AS k, n, CASE WHEN n < 3 THEN 10 WHEN n > 50 THEN 2 ELSE 3 END AS least FROM usable
  UNION ALL
  SELECT doc_id, line, md5(array_to_string(t[: i - 1] || ['<*>'] || t[i + 1 :], ' ')), n, 3
  FROM (SELECT *, unnest(range(3, n + 1)) AS i FROM usable WHERE fixed - 1 >= 0.8 * n) WHERE t[i] <> '<*>'),
recurring AS (
  SELECT k, n, min((doc_id, line)) AS keeper FROM keys GROUP BY k, n HAVING count(DISTINCT doc_id) >= min(least)),
gone AS (SELECT DISTINCT doc_id, line FROM keys JOIN recurring USING (k, n) WHERE (doc_id, line) <> keeper)
SELECT doc_id, count(*) AS n_lines, count(g.line) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN g.line IS NULL THEN txt END, chr(10) ORDER BY l.line), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g USING (doc_id, line) GROUP BY doc_id
"""
