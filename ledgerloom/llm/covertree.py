"""Embedding near-dedup: cover trees over cells, dual traversal, exact threshold links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, connected_components, cut, merge_labels, table

THRESHOLD = 0.95
#: Vectors are dealt into cells by the nearest centre; there are as many cells as hold CELL_ROWS distinct vectors each, MOST_CELLS at
#: most. Centres come from a sample of SAMPLE distinct vectors.
CELL_ROWS = 4096
MOST_CELLS = 512
SAMPLE = 4096
#: Vectors of a cell that one task compares with as many others.
PIECE_ROWS = 8192
#: Centres or points whose distances are computed by one matrix product.
BLOCK = 512
#: Points tried as centres of a net at a time. A net that after the first GIVE_UP of them has more centres than ALONE of the points it
#: has dealt with gathers nothing: to go on would compute the distances of all pairs, and then the traversal would again.
TRIED, GIVE_UP, ALONE = 256, 512, 0.7
#: How far single precision may be off in a cosine: pairs so near the threshold are computed again in double precision.
SINGLE_SLACK = 1e-4
#: Added to every bound, so that rounding can only lead to a pair's comparison, not to its loss.
SLACK = 1e-6


def net(x: np.ndarray, points: np.ndarray, radius: float) -> tuple[list[np.ndarray], np.ndarray]:
    """(groups, loose): each group's points lie within radius of its first one, and first points of groups further than that from
    each other; loose points are those of a net that was given up, and then its groups of one point too."""
    least, out, rest, dealt = 1 - radius * radius / 2, [], points, 0
    while len(rest):
        if dealt >= GIVE_UP and len(out) > ALONE * (len(points) - len(rest)):
            return [g for g in out if len(g) > 1], np.concatenate([*(g for g in out if len(g) == 1), rest])
        tried = rest[:TRIED]
        dealt += len(tried)
        near = x[tried] @ x[tried].T >= least
        free, chosen = np.ones(len(tried), dtype=bool), []
        for i in range(len(tried)):
            if free[i]:
                chosen.append(i)
                free &= ~near[i]
                free[i] = False
        cosine = x[rest] @ x[tried[chosen]].T
        own = cosine.argmax(axis=1)
        within = cosine[np.arange(len(rest)), own] >= least
        own[chosen], within[: len(tried)] = np.arange(len(chosen)), True
        order = np.argsort(own[within], kind="stable")
        ends = np.cumsum(np.bincount(own[within], minlength=len(chosen)))[:-1]
        for c, members in zip(tried[chosen], np.split(rest[within][order], ends), strict=True):
            out.append(np.concatenate([[c], members[members != c]]))
        rest = rest[~within]
    return out, rest


class Tree:
    """Cover tree: the children of a node of level R are a net of its points of radius R / 2, the first of them at its own centre.

    Levels go down from 2, the sphere's diameter, until a node is a single point or its level is below a quarter of a link. Points
    of a net that gathers nothing are one child without children, whose points are compared by matrix products. The covering
    radius of every node is measured over all points below it, not assumed. Nodes are rows of flat arrays.
    """

    def __init__(self, x: np.ndarray, points: np.ndarray, far: float):
        self.centre: list[int] = []
        self.points: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.parent: list[int] = []
        level, todo = 2.0, [self.add(points, -1)]
        while todo and level >= far / 4:
            level /= 2
            todo = [child for node in todo if len(self.points[node]) > 1 for child in self.divide(x, node, level)]
        self.centre, self.parent = np.array(self.centre), np.array(self.parent)
        self.size = np.array([len(p) for p in self.points])
        self.radius = np.zeros(len(self.size))
        for k in np.flatnonzero(self.size > 1):
            self.radius[k] = np.sqrt(max(2 - 2 * float((x[self.points[k]] @ x[self.centre[k]]).min()), 0))

    def add(self, points: np.ndarray, parent: int) -> int:
        self.centre.append(points[0])
        self.points.append(points)
        self.children.append([])
        self.parent.append(parent)
        return len(self.centre) - 1

    def divide(self, x: np.ndarray, node: int, radius: float) -> list[int]:
        groups, loose = net(x, self.points[node], radius)
        if len(loose) == len(self.points[node]):
            return []
        divided = [self.add(p, node) for p in groups]
        self.children[node] = [*divided, *([self.add(loose, node)] if len(loose) else [])]
        return divided

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """The nodes' children; those without any stay."""
        return np.array([c for k in nodes.tolist() for c in self.children[k] or (k,)], dtype=np.int64)


class Links:
    """Counts and components found so far; dense pairs of nodes are counted without listing their pairs."""

    def __init__(self, x: np.ndarray, weight: np.ndarray):
        self.x32 = x.astype(np.float32)
        self.weight = weight
        self.count = np.zeros(len(weight), dtype=np.int64)
        self.compared = 0  # distances computed, of centres and of points
        self.parent = np.arange(len(weight))

    def all_of(self, a: np.ndarray, b: np.ndarray | None) -> None:
        """Every point of a links with every other of b; without b, all of a with each other."""
        if b is None:
            self.count[a] += self.weight[a].sum() - self.weight[a]
            b = a
        else:
            self.count[a] += self.weight[b].sum()
            self.count[b] += self.weight[a].sum()
        both = np.concatenate([a, b])
        self.parent = merge_labels(self.parent, both[1:], np.full(len(both) - 1, both[0]))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """a[i] links with b[i]; a pair is listed once."""
        np.add.at(self.count, a, self.weight[b])
        np.add.at(self.count, b, self.weight[a])
        self.parent = merge_labels(self.parent, a, b)


def compare(x: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, links: Links) -> None:
    """Exact comparison of two blocks; a is b for one block with itself. Single precision leaves out what is far from the threshold."""
    same = a is b
    left, right = links.x32[a], links.x32[b]
    for i in range(0, len(a), BLOCK):
        for j in range(i if same else 0, len(b), BLOCK):
            near = left[i : i + BLOCK] @ right[j : j + BLOCK].T >= threshold - SINGLE_SLACK
            links.compared += near.size
            if not near.any():
                continue
            p, q = np.nonzero(np.triu(near, 1) if same and i == j else near)
            for k in range(0, len(p), 65_536):
                u, v = a[i + p[k : k + 65_536]], b[j + q[k : k + 65_536]]
                hit = np.einsum("ij,ij->i", x[u], x[v]) >= threshold
                if hit.any():
                    links.pairs(u[hit], v[hit])


def dual(x: np.ndarray, left: Tree, right: Tree, threshold: float, links: Links) -> None:
    """All links between the points of two trees, or of one with itself.

    Each step takes a node of the left tree with the nodes of the right one that it may link with, and puts their children in
    their place. Of a pair of nodes that are apart by their covering radii no points can link, and it is pruned; of one that lies
    so close together that all must link, all links are counted without listing them. Pairs of points are decided where they
    meet. Distances of all children of a step come from matrix products of BLOCK rows.
    """
    far, same = float(np.sqrt(2 - 2 * threshold)), left is right
    stack = [(0, np.zeros(1, dtype=np.int64))]
    while stack:
        node, others = stack.pop()
        if same and 2 * left.radius[node] <= far - SLACK and node in others:
            links.all_of(left.points[node], None)
            others = others[others != node]
        mine = np.array(left.children[node] or [node], dtype=np.int64)
        yours = right.below(others)
        if not len(yours):
            continue
        if len(mine) == 1 and mine[0] == node and len(yours) == len(others) and (yours == others).all():  # nothing is left to divide
            if same and node in yours:
                compare(x, left.points[node], left.points[node], threshold, links)
                yours = yours[yours != node]
            if len(yours):
                compare(x, left.points[node], np.concatenate([right.points[k] for k in yours.tolist()]), threshold, links)
            continue
        for i in range(0, len(mine), BLOCK):
            m = mine[i : i + BLOCK]
            kept: list[list[np.ndarray]] = [[] for _ in m]
            for j in range(0, len(yours), BLOCK):
                y = yours[j : j + BLOCK]
                links.compared += len(m) * len(y)
                cosine = x[left.centre[m]] @ x[right.centre[y]].T
                # apart by more than both radii and a link: by cosines, so that most pairs need one comparison
                reach = np.minimum(left.radius[m][:, None] + right.radius[y][None, :] + far + SLACK, 2)
                open_ = cosine >= 1 - reach * reach / 2
                if same:  # of two children of one node each pair is taken once
                    twins = (right.parent[y] == node)[None, :] & (left.parent[m] == node)[:, None] & (y[None, :] < m[:, None])
                    open_ &= ~twins
                at = np.nonzero(open_)
                if not len(at[0]):
                    continue
                a, b = m[at[0]], y[at[1]]
                single = (left.size[a] == 1) & (right.size[b] == 1)
                hit = single & (cosine[at] >= threshold) & ((a != b) if same else True)
                if hit.any():
                    links.pairs(left.centre[a[hit]], right.centre[b[hit]])
                a, b, row = a[~single], b[~single], at[0][~single]
                d = np.sqrt(np.maximum(2 - 2 * cosine[at][~single], 0))
                inside = (d + left.radius[a] + right.radius[b] <= far - SLACK) & ((a != b) if same else True)
                for p, q in zip(a[inside].tolist(), b[inside].tolist(), strict=True):
                    links.all_of(left.points[p], right.points[q])
                for k in np.unique(row[~inside]).tolist():
                    kept[k].append(b[~inside & (row == k)])
            stack += [(int(m[k]), np.concatenate(nodes)) for k, nodes in enumerate(kept) if nodes]


def search(x: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float) -> Links:
    """Links inside left, or between left and right."""
    links, far = Links(x, weight), float(np.sqrt(2 - 2 * threshold))
    a = Tree(x, left, far)
    dual(x, a, a if right is None else Tree(x, right, far), threshold, links)
    return links


def centres_of(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centres by spherical k-means, begun at far-apart points; a fixed function of the sample."""
    chosen = [0]
    best = sample @ sample[0]
    while len(chosen) < min(cells, len(sample)):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, sample @ sample[chosen[-1]])
    c = sample[chosen]
    for _ in range(rounds):
        own = (sample @ c.T).argmax(axis=1)
        sums = np.array([sample[own == k].sum(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
        norm = np.linalg.norm(sums, axis=1)
        c = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], c)
    return c


def cell_visits(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each unit vector's cell (the nearest centre), and the later cells that may hold a vector that links with it.

    A vector y of cell b is nearer to centre b than to any other, so it lies on b's side of the plane half-way between the
    centres. A link is at most `far` long, so x visits b only if it lies within `far` of that plane.
    """
    far = float(np.sqrt(2 - 2 * threshold))
    d2 = np.maximum(2 - 2 * (x @ centres.T), 0)
    cell = d2.argmin(axis=1)
    apart = np.sqrt(np.maximum(((centres[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2), 0))
    beyond = (d2 - d2[np.arange(len(x)), cell][:, None]) / np.maximum(2 * apart[cell], 1e-12)
    visits = (beyond <= far + SLACK) & (np.arange(len(centres))[None, :] > cell[:, None])
    return cell, [np.flatnonzero(v) for v in visits]


def node_of(raw: np.ndarray) -> bytes:
    return hashlib.md5(raw.tobytes(), usedforsecurity=False).digest()


def centres_by_length(sample: list[np.ndarray], cells: int) -> dict[int, np.ndarray]:
    """Centres for each length of vectors in the sample, shared out by how many of it have that length."""
    by: dict[int, list[np.ndarray]] = {}
    for v in sample:
        by.setdefault(len(v), []).append(v / np.linalg.norm(v))
    return {n: centres_of(np.array(v), max(1, round(cells * len(v) / len(sample)))) for n, v in sorted(by.items())}


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, cells: int | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Rows (id_col, n_links, component_id, kept) for every row of vectors: all pairs with cosine >= threshold are links.

    Equal vectors are one class, so copies cost one vector. Vectors are compared with those of their own length. Cells (by default
    as many as the distinct vectors need) come from a bounded sample; every vector is dealt to its cell and visits each later
    cell that may hold a partner, so every pair meets exactly once, in the later one's cell; lengths that the sample lacks are a
    cell each. Cells of more than piece_rows vectors are cut into pieces by hash and each pair of pieces is a task of bounded
    size; inside, cover trees are walked in pairs. Null vectors, and those that are zero or hold null or non-finite components,
    link with nothing: no links, their own id as component. A row with a null id counts as a partner but names no component.
    Rows with equal ids and vectors are each other's links like any copies.
    """
    spark = vectors.sparkSession
    source = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    keyed_schema = T.StructType([source.schema["id"], T.StructField("node", T.BinaryType()), T.StructField("v", T.BinaryType())])

    def key():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, kept = [], []
            for v in batch.column(1).to_pylist():
                raw = None
                if v and None not in v:
                    x = np.array(v, dtype=np.float64) + 0.0
                    big = np.abs(x).max()
                    if np.isfinite(x).all() and big > 0:
                        raw = x / big if not 1e-100 < big < 1e100 else x
                nodes.append(None if raw is None else node_of(raw))
                kept.append(None if raw is None else raw.tobytes())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(kept, pa.binary())], names=keyed_schema.names)

        return step

    keyed = arrow_map(source, key, keyed_schema)
    # what joins need is kept without the vectors, which go to the classes only
    classes = cut(keyed.where("node is not null").groupBy("node").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.min("v").alias("v")))
    if cells is None:
        cells = min(MOST_CELLS, max(1, classes.count() // CELL_ROWS))
    sample = [np.frombuffer(r["v"]) for r in classes.select("v", "node").orderBy("node").limit(SAMPLE).toLocalIterator()]
    sent = spark.sparkContext.broadcast(centres_by_length(sample, cells))  # at most a centre for each vector of the sample

    def place():
        centres = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            vectors = [np.frombuffer(b) for b in batch.column(2).to_pylist()]
            sizes = np.array([len(v) for v in vectors])
            places: list[list[dict]] = [[{"cell": 0, "guest": False}] for _ in vectors]
            for n in set(sizes.tolist()) & centres.keys():
                at = np.flatnonzero(sizes == n)
                x = np.array([vectors[k] for k in at])
                cell, visits = cell_visits(x / np.linalg.norm(x, axis=1)[:, None], centres[n], threshold)
                for k, c, v in zip(at.tolist(), cell.tolist(), visits, strict=True):
                    places[k] = [{"cell": c, "guest": False}, *({"cell": i, "guest": True} for i in v.tolist())]
            arrays = [*batch.columns, pa.array(sizes, pa.int32()), pa.array(places, pa.list_(pa.struct([("cell", pa.int32()), ("guest", pa.bool_())])))]
            return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "size", "places"])

        return step

    placed_schema = "node binary, copies long, v binary, size int, places array<struct<cell int, guest boolean>>"
    placed = classes.select("node", "copies", "v").mapInArrow(_run(place), placed_schema).select("node", "copies", "v", "size", F.inline("places"))
    placed = cut(placed)
    counts = placed.groupBy("size", "cell").agg(F.count_if(~F.col("guest")).alias("hosts"), F.count_if("guest").alias("guests"))  # a row a cell
    pieces = lambda n: F.greatest(F.ceil(F.col(n) / piece_rows), F.lit(1)).cast("int")
    rows = placed.join(counts, ["size", "cell"]).withColumn("h", pieces("hosts")).withColumn("g", pieces("guests"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("guest"), F.col("g")).otherwise(F.col("h"))).cast("int"))
    # a task (size, cell, kind, i, j): pieces i <= j of the hosts, or piece i of the guests with piece j of the hosts
    task = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    own = F.col("own")
    hosts = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda k: task(0, F.least(own, k), F.greatest(own, k)))
    asked = F.when(F.col("guests") > 0, F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda k: task(1, k, own))).otherwise(F.array().cast("array<struct<kind:int,i:int,j:int>>"))
    guests = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda k: task(1, own, k))
    rows = rows.select("size", "cell", "guest", "own", "node", "copies", "v", F.inline(F.when(F.col("guest"), guests).otherwise(F.concat(hosts, asked))))

    def compare_task(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        nodes = group.column("node").to_pylist()
        order = np.array(sorted(range(len(nodes)), key=nodes.__getitem__))
        nodes = [nodes[i] for i in order]
        x = np.array([np.frombuffer(b) for b in group.column("v").to_pylist()])[order]
        x /= np.linalg.norm(x, axis=1)[:, None]
        weight = group.column("copies").to_numpy()[order]
        guest = group.column("guest").to_numpy(zero_copy_only=False)[order]
        mine = group.column("own").to_numpy()[order]
        kind, i, j = (group.column(c)[0].as_py() for c in ("kind", "i", "j"))
        if kind == 0 and i == j:
            left, right = np.arange(len(x)), None
        elif kind == 0:
            left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        else:
            left, right = np.flatnonzero(guest), np.flatnonzero(~guest)
        if not len(left) or right is not None and not len(right):
            return pa.table({"node": pa.array([], pa.binary()), "root": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        found = search(x, weight, left, right, threshold)
        at = np.flatnonzero(found.count)
        return pa.table({"node": pa.array([nodes[k] for k in at], pa.binary()), "root": pa.array([nodes[found.parent[k]] for k in at], pa.binary()), "n": pa.array(found.count[at], pa.int64())})

    found = cut(rows.groupBy("size", "cell", "kind", "i", "j").applyInArrow(compare_task, "node binary, root binary, n long"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    partners = found.groupBy("node").agg(F.sum("n").alias("n"))
    classed = cut(classes.select("node", "least_id", "copies").join(partners, "node", "left").join(roots, "node", "left").select(
        "node", "least_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"),
    ))
    named = cut(classed.groupBy("root").agg(F.min("least_id").alias("component_id")))
    classed = cut(classed.join(named, "root").select("node", "n_links", "component_id"))
    out = keyed.select("id", "node").join(classed, "node", "left")
    linked = F.col("n_links").isNotNull()
    component = F.when(linked, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.when(linked, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _run(make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return run


def op6_covertree(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN comp USING (vec_id) LEFT JOIN n USING (vec_id)
"""
