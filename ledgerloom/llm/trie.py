"""Prefix trie of conversations, whose subtree totals are gathered by peeling leaves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table
from .scans import placed, running_sums

#: Words of a text are maximal runs of other characters than space and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: A conversation of the query takes its first turns, 0 to SHARED - 1 of them, from the one at the start of its block of BLOCK ids.
BLOCK, SHARED = 20, 4
#: Hashes that make up the key of a prefix, 64 bits each.
LANES = 2
EMPTY = hashlib.sha256(b"").hexdigest()


def number_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (c, idx, item, words): every turn's place in its conversation from 1, a digest of its role and text, and its text's words.

    Turns are ordered by turn, null first, and turns that share one by role, then text; null roles and texts are empty. Rows without
    a conversation are left out; repeated rows are turns of their own. Texts are moved once, to be sorted; digests go on.
    """
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(conversations[conv_col].cast("long").alias("c"), conversations[turn_col].alias("turn"), role.alias("role"), text.alias("text")).where("c is not null")
    order = [F.asc("c"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    item = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = running_sums(cut(sorted_rows.select("c", item.alias("item"), words.alias("words"), F.lit(1).cast("long").alias("one"))), "c", ["one"])
    return numbered.select("c", F.col("run_one").alias("idx"), "item", "words")


def share_openings(turns: DataFrame, block: int = BLOCK, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(rebuilt, convs): rows (c, pos, item, words), in which conversation c has the first h turns of c - c % block (all if it has
    fewer) and then its own after its first h, h being crc32 of c's decimal form modulo shared (a remainder has c's sign, as in SQL); and rows (c) of all conversations."""
    h = lambda c: F.crc32(F.encode(F.col(c).cast("string"), "UTF-8")) % shared
    convs = cut(turns.groupBy("c").agg(F.count(F.lit(1)).alias("n")).withColumn("h", h("c")).withColumn("b", F.col("c") - F.col("c") % block))
    # a block has that many conversations at most, and an opening fewer turns than shared
    heads = turns.where((F.col("c") % block == 0) & (F.col("idx") < shared)).select(F.col("c").alias("b"), F.col("idx").alias("pos"), "item", "words")
    opened = convs.where("h > 0").join(heads, "b").where("pos <= h").select("c", "pos", "item", "words")
    sizes = convs.select(F.col("c").alias("b"), F.col("n").alias("in_b"))
    short = convs.join(sizes, "b", "left").select("c", (F.col("h") - F.coalesce("in_b", F.lit(0))).alias("gap")).where("gap > 0")
    own = turns.where(F.col("idx") > h("c")).join(short, "c", "left").select("c", (F.col("idx") - F.coalesce("gap", F.lit(0))).alias("pos"), "item", "words")
    return opened.unionByName(own), convs.select("c")


def _hash_members(ends: DataFrame, key: list[str]) -> DataFrame:
    """Rows (*key, ends_sha256): SHA-256 of the key's c in order, comma-joined. A digest reads its bytes in turn, so a key's ids go
    through one task, as a stream of which it holds a batch."""
    out = T.StructType([*(ends.schema[k] for k in key), T.StructField("ends_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, done = list(zip(*(batch.column(k).to_pylist() for k in key))), []
            ids = [str(x).encode() for x in batch.column("c").to_pylist()]
            cuts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if keys[a] == now:
                    sha.update(b",")
                else:
                    done += [(*now, sha.hexdigest())] if now is not None else []
                    now, sha = keys[a], hashlib.sha256()
                sha.update(b",".join(ids[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done) if done else [[]] * len(out), types)], names=out.names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, sha.hexdigest()), types)], names=out.names)

    types = [*[pa.int64()] * len(key), pa.string()]
    return ends.select(*key, "c").repartition(*key).sortWithinPartitions(*key, "c").mapInArrow(run, out)


def build_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node of the trie: its least and leading member, depth, parent, members, children, words of its last text and the
    digest of the conversations that end there.

    A prefix is known by the sums of its turns' hashes with their places (LANES of 64 bits), which are running sums over the sorted
    turns, so no conversation has to fit into a task. A node's leader is the member of least hashed id. Leaders of nodes below one
    are members of it too, so nodes of one leader are a path downwards, and a conversation meets about ln(n) paths among n.
    """
    lanes, keys, up = ([f"{x}{i}" for i in range(LANES)] for x in "lkp")
    hashed = turns.select("c", "pos", "words", *[F.xxhash64(F.lit(i), "pos", "item").alias(x) for i, x in enumerate(lanes)])
    run = running_sums(placed(hashed, "c", "pos"), "c", lanes, before=True)
    run = run.select("c", F.col("pos").alias("depth"), "words", *[F.col(f"run_{x}").alias(k) for x, k in zip(lanes, keys)], *[F.col(f"before_{x}").alias(p) for x, p in zip(lanes, up)])
    none = F.lit(0).cast("long")
    roots = convs.select("c", none.alias("depth"), none.alias("words"), *[none.alias(k) for k in keys], *[F.lit(None).cast("long").alias(p) for p in up])
    run = cut(run.unionByName(roots))
    key = ["depth", *keys]
    nodes = run.groupBy(*key).agg(
        F.min("c").alias("conv_id"), F.min(F.struct(F.xxhash64("c"), "c"))["c"].alias("lead"), F.count(F.lit(1)).alias("n_convs"),
        F.min("words").alias("words"), *[F.min(p).alias(p) for p in up],
    )
    nodes = cut(nodes)
    last = run.groupBy("c").agg(F.max(F.struct(*key)).alias("end")).select("c", "end.*")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(p).alias(k) for p, k in zip(up, keys)]).agg(F.count(F.lit(1)).alias("n_children"))
    full = cut(nodes.join(children, key, "left").join(_hash_members(last, key), key, "left"))
    parents = full.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(p) for k, p in zip(keys, up)], F.col("conv_id").alias("parent_conv_id"), F.col("lead").alias("parent_lead"))
    joined = full.join(parents, ["depth", *up], "left")
    return cut(joined.select("conv_id", "lead", "depth", "parent_conv_id", "parent_lead", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), ((F.col("n_convs") - 1) * F.col("words")).alias("own")))


def peel(nodes: DataFrame) -> DataFrame:
    """Rows (lead, depth, saved, leaves): what the paths that hang from each node hold in all, by message passing from the leaves.

    A path of nodes with one leader acts as one node. It holds a counter of the paths that hang from it and haven't reported; at zero
    it sends its totals to the path it hangs from and is done. Rounds end when only the root is left, and with it everything is done;
    there are about as many as the logarithm of the number of conversations, however deep the trie is. Messages are summed before
    they are joined, and each round's state is checkpointed.
    """
    paths = nodes.groupBy("lead").agg(F.sum("own").alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"), F.min(F.struct("depth", F.col("parent_lead").alias("up"))).alias("top"))
    paths = paths.select("lead", "saved", "leaves", "top.up", (F.col("top.depth") - 1).alias("up_depth"))
    counts = paths.where("up is not null").groupBy(F.col("up").alias("lead")).agg(F.count(F.lit(1)).alias("n"))
    state = cut(paths.join(counts, "lead", "left").withColumn("waiting", F.coalesce("n", F.lit(0)).cast("long")).drop("n"))
    done = []
    while True:
        ready = state.where("waiting = 0")
        done.append(ready.where("up is not null").select(F.col("up").alias("lead"), F.col("up_depth").alias("depth"), "saved", "leaves"))
        rest = state.where("waiting > 0")
        if not rest.limit(1).count():
            break
        sent = ready.groupBy(F.col("up").alias("lead")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"), F.count(F.lit(1)).alias("n"))
        got = lambda x: F.coalesce(x, F.lit(0))
        state = cut(rest.join(sent, "lead", "left").select("lead", (F.col("saved") + got("more_saved")).alias("saved"), (F.col("leaves") + got("more_leaves")).alias("leaves"), "up", "up_depth", (F.col("waiting") - got("n")).alias("waiting")))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.groupBy("lead", "depth").agg(F.sum("saved").alias("hung_saved"), F.sum("leaves").alias("hung_leaves"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes with the leaves and saved tokens of their subtrees, their own included.

    turns: rows (c, pos, item, words) with places from 1 without gaps; convs: rows (c), those without turns included. Without any
    conversation there is no node. Within a path totals are running sums from its end upwards.
    """
    nodes = build_nodes(turns, convs)
    got = lambda x: F.coalesce(x, F.lit(0))
    both = nodes.join(peel(nodes), ["lead", "depth"], "left").withColumn("from_end", -F.col("depth"))
    both = both.withColumn("saved", F.col("own") + got("hung_saved")).withColumn("leaves", (F.col("n_children") == 0).cast("long") + got("hung_leaves"))
    totals = running_sums(placed(both.drop("own", "parent_lead", "hung_saved", "hung_leaves"), "lead", "from_end"), "lead", ["saved", "leaves"])
    return totals.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("run_leaves").alias("n_leaves"), F.col("run_saved").alias("saved_tokens"), "ends_sha256")


def op11_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(*share_openings(number_turns(table(spark, sf_dir, "conversations"))))


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS idx
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, count(*) AS n, c - c % 20 AS b, xor(list_reduce(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ord((c::VARCHAR)[i])::BIGINT),
    lambda a, x: list_reduce(range(8), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END, xor(a, x)), 4294967295::BIGINT), 4294967295::BIGINT) % 4 AS h
  FROM t GROUP BY c
), took AS (SELECT x.c, x.b, x.h, least(x.h, coalesce(y.n, 0)) AS got FROM convs x LEFT JOIN convs y ON y.c = x.b),
r AS (
  SELECT k.c, t.idx AS d, role, text FROM took k JOIN t ON t.c = k.b AND t.idx <= k.h
  UNION ALL SELECT k.c, t.idx - k.h + k.got, role, text FROM took k JOIN t ON t.c = k.c AND t.idx > k.h
), p AS (
  SELECT c, d, sha256(string_agg(md5(concat(length(role), ':', role, text)), ',' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS k,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r
  UNION ALL SELECT c, 0, 'root', 0 FROM convs
), ends AS (SELECT c, max(d) AS d FROM p GROUP BY c),
nodes AS (
  SELECT p.d, p.k, min(p.c) AS conv_id, count(*) AS n_convs, min(words) AS words,
    sha256(coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (WHERE ends.d = p.d), '')) AS ends_sha256
  FROM p JOIN ends USING (c) GROUP BY p.d, p.k
), linked AS (SELECT n.*, u.k AS up_k, q.conv_id AS parent_conv_id FROM nodes n LEFT JOIN p u ON u.c = n.conv_id AND u.d = n.d - 1 LEFT JOIN nodes q ON q.d = n.d - 1 AND q.k = u.k),
kids AS (SELECT d - 1 AS d, up_k AS k, count(*) AS n FROM linked WHERE d > 0 GROUP BY 1, 2),
whole AS (SELECT l.*, coalesce(kids.n, 0) AS n_children FROM linked l LEFT JOIN kids ON kids.d = l.d AND kids.k = l.k),
below AS (
  SELECT a.d, a.k, sum((w.n_children = 0)::INT) AS n_leaves, sum((w.n_convs - 1) * w.words) AS saved
  FROM whole w JOIN p a ON a.c = w.conv_id AND a.d <= w.d GROUP BY 1, 2
)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256
FROM whole JOIN below USING (d, k)
"""
