"""Exact top-k by integer inner product: dual-tree search over cover trees of queries and data."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

K, LEAF = 20, 8


class Node:
    """A ball of a cover tree: rows of the points below it (in a leaf), their number, centre, covering radius, children and their
    centres, sizes, radii and norms side by side. bottom: a child is a leaf."""

    __slots__ = ("bottom", "centre", "centres", "children", "norm", "norms", "radii", "radius", "rows", "size", "sizes")

    def __init__(self, points: np.ndarray, rows: np.ndarray, at: int, far: np.ndarray):
        self.rows, self.size, self.centre, self.children, self.bottom = rows, len(rows), points[at], [], False
        self.norm, self.radius = float(np.sqrt(self.centre @ self.centre)), float(far.max())

    def close(self) -> None:
        """Once the tree stands: what the children look like from here."""
        if self.children:
            self.rows, self.bottom = None, any(not c.children for c in self.children)
            self.centres, self.sizes = np.stack([c.centre for c in self.children]), np.array([c.size for c in self.children])
            self.radii, self.norms = np.array([c.radius for c in self.children]), np.array([c.norm for c in self.children])


def cover_tree(points: np.ndarray, leaf: int) -> Node:
    """A simplified cover tree (levels, covering and separation of siblings, as Izbicki and Shelton 2015), built from above: a node is
    split over a net of centres taken farthest first, its own first, until all its points lie within half its radius of one.
    So children are apart by more than they cover. A net stops at the root of the node's size (32 at least), and wide children are
    split again. Covering radii are exact. Nodes of leaf points or less are leaves, and no others but those of equal points."""

    def distances(rows: np.ndarray, at: int) -> np.ndarray:
        d = points[rows] - points[at]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    rows = np.arange(len(points))
    root = Node(points, rows, 0, distances(rows, 0))
    todo, nodes = [(root, 0)], []
    while todo:
        node, centre = todo.pop()
        nodes.append(node)
        if node.size <= leaf or node.radius == 0:
            continue
        best, fan = distances(node.rows, centre), max(32, isqrt(node.size))
        owner, centres = np.zeros(len(best), np.int64), [centre]
        while len(centres) < fan and best.max() > node.radius / 2:
            at = int(node.rows[int(best.argmax())])
            d = distances(node.rows, at)
            nearer = d < best
            owner[nearer], best[nearer] = len(centres), d[nearer]
            centres.append(at)
        for k, at in enumerate(centres):
            mine = owner == k
            if mine.any():
                child = Node(points, node.rows[mine], at, best[mine])
                node.children.append(child)
                todo.append((child, at))
    for node in nodes:
        node.close()
    return root


class Top:
    """The k best (score, vec_id) of each query so far; ties to the smaller vec_id. least: scores below it are not wanted."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None):
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.least = np.full(n, -np.inf) if least is None else least
        self.worst = self.least.copy()

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        hit = (scores >= self.worst[rows][:, None]).any(axis=1)
        if not hit.any():
            return
        rows, scores = rows[hit], scores[hit]
        if scores.shape[1] > 4 * k:  # what ties with the kth stays
            least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
            cols = np.flatnonzero((scores >= np.maximum(least, self.worst[rows])[:, None]).any(axis=0))
            scores, ids = scores[:, cols], ids[cols]
        s = np.concatenate((self.score[rows], scores), axis=1)
        i = np.concatenate((self.id[rows], np.broadcast_to(ids, scores.shape)), axis=1)
        order = np.lexsort((i, -s), axis=1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self.worst[rows] = np.maximum(self.score[rows, -1], self.least[rows])


def widened(b: np.ndarray) -> np.ndarray:
    """Bounds with room for rounding."""
    return b + 1e-9 * np.abs(b) + 1e-6


def bounds(q: Node, centres: np.ndarray, radii: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """No inner product of a point below q and one below each node is larger: <q, c> <= <q0, c0> + r|q0| + R|c0| + rR for balls
    (q0, R) and (c0, r)."""
    return widened(centres @ q.centre + radii * q.norm + q.radius * norms + q.radius * radii)


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, tree: Node, top: Top, leaf: int = 8) -> dict[str, int]:
    """Dual-tree search: queries and data are descended together, the wider ball first, and a pair of nodes is pruned when its bound
    is below the worst kth score of the queries under it. Each query first looks into a small node of
    over k points that lies best for it, so that kth scores are known before pairs are judged. Leaves of queries
    break up: each of their queries is a node of radius 0 against what is left, best pairs first; those below one node go
    side by side. Gives the numbers of
    pairs of nodes met and pruned, and of pairs of vectors scored."""
    told = {"met": 0, "pruned": 0, "scored": 0}
    if not len(queries) or not len(data):
        return told
    k = top.score.shape[1]
    norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))

    def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        s = queries[q] @ data[x].T
        s[query_ids[q][:, None] == ids[x][None, :]] = -np.inf
        told["scored"] += s.size
        return s

    def offer(q: np.ndarray, x: np.ndarray) -> None:
        top.offer(q, scores(q, x), ids[x])

    def under(node: Node) -> np.ndarray:
        """The rows below a node."""
        return node.rows if not node.children else np.concatenate([under(c) for c in node.children])

    def judged(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of single queries with nodes, and which pairs stay."""
        b = widened(queries[q] @ centres.T + norms[q][:, None] * radii)
        keep = b >= top.worst[q][:, None]
        told["met"] += keep.size
        told["pruned"] += keep.size - int(keep.sum())
        return b, keep

    def seed(q: np.ndarray, x: Node) -> None:
        """Queries go down together as long as they want the same node."""
        if x.children and (x.sizes > k).any():
            b = np.where(x.sizes > k, queries[q] @ x.centres.T + norms[q][:, None] * x.radii, -np.inf)
            to = b.argmax(axis=1)
            for j in np.unique(to).tolist():
                seed(q[to == j], x.children[j])
            return
        s = scores(q, under(x))
        if s.shape[1] >= k:
            top.least[q] = np.maximum(top.least[q], -np.partition(-s, k - 1, axis=1)[:, k - 1])
            top.worst[q] = np.maximum(top.worst[q], top.least[q])

    def walk(q: Node, frontier: list[Node]) -> None:
        """frontier: nodes of the data, none above another, that can matter to q."""
        last = [q] if not q.children else [c for c in q.children if not c.children]
        if last:
            finish(np.concatenate([c.rows for c in last]), frontier)
        for child in q.children:
            if not child.children:
                continue
            wider = []
            for x in frontier:
                wider += x.children if x.children and not x.bottom and x.radius > child.radius else [x]
            keep = bounds(child, np.stack([x.centre for x in wider]), np.array([x.radius for x in wider]), np.array([x.norm for x in wider])) >= top.worst[under(child)].min()
            told["met"] += len(wider)
            told["pruned"] += len(wider) - int(keep.sum())
            if keep.any():
                walk(child, [x for x, k in zip(wider, keep, strict=True) if k])

    def finish(rows: np.ndarray, frontier: list[Node]) -> None:
        turn, heap = count(), []

        def push(q: np.ndarray, nodes: list[Node], b: np.ndarray, keep: np.ndarray) -> None:
            for j in np.flatnonzero(keep.any(axis=0)).tolist():
                mine = keep[:, j]
                heapq.heappush(heap, (-float(b[mine, j].max()), next(turn), nodes[j], q[mine], b[mine, j]))

        push(rows, frontier, *judged(rows, np.stack([x.centre for x in frontier]), np.array([x.radius for x in frontier])))
        while heap:
            _, _, x, q, b = heapq.heappop(heap)
            alive = b >= top.worst[q]  # kth scores may have risen since
            told["pruned"] += len(q) - int(alive.sum())
            q = q[alive]
            if not len(q):
                continue
            if not x.children:
                offer(q, x.rows)
                continue
            b, keep = judged(q, x.centres, x.radii)
            last = np.array([not c.children for c in x.children])
            if last.any():
                some = keep & last
                cols = np.flatnonzero(some.any(axis=0))
                if len(cols):
                    live, parts, sizes = np.flatnonzero(some.any(axis=1)), [x.children[j].rows for j in cols.tolist()], x.sizes[cols]
                    if 4 * int((some[live][:, cols] @ sizes).sum()) >= 3 * len(live) * int(sizes.sum()):
                        offer(q[live], np.concatenate(parts))
                    else:  # queries want different leaves
                        for i in live.tolist():
                            offer(q[i : i + 1], np.concatenate([r for r, w in zip(parts, some[i, cols].tolist(), strict=True) if w]))
                keep &= ~last
            push(q, x.children, b, keep)

    root = cover_tree(queries, leaf)
    seed(np.arange(len(queries)), tree)
    walk(root, [tree])
    return told


def vectors(table_: DataFrame) -> DataFrame:
    """(vec_id, v): floor(64 * x) of each component, x as double; vectors that are null or hold null or non-finite values are left out."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return table_.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * 64)).alias("v"))


def matrices(ids: pa.Array, v: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length of vector: places in the input, ids and the matrix."""
    size = v.value_lengths().to_numpy(zero_copy_only=False)
    flat, start = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(size) - size
    own = ids.to_numpy(zero_copy_only=False)
    return {int(d): (at := np.flatnonzero(size == d), own[at], flat[(start[at][:, None] + np.arange(d)).ravel()].reshape(len(at), d)) for d in np.unique(size)}


class Cells:
    """Pivots, by length of vector, and the cells of the vectors nearest to each; once known, their shards and radii."""

    def __init__(self, ids: pa.Array, v: pa.Array, most: int):
        self.pivots, n = {}, 0
        for d, (_, _, x) in matrices(ids, v).items():
            x = x[:: max(1, -(-len(x) // most))]
            self.pivots[d] = (n, x)
            n += len(x)
        self.first, self.parts, self.radius = {}, {}, {}

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance from its pivot) of vectors of one length; a length without pivots is a cell of its own."""
        d = x.shape[1]
        if d not in self.pivots:
            return np.full(len(x), -1 - d), np.zeros(len(x))
        n, p = self.pivots[d]
        half, step = 0.5 * np.einsum("ij,ij->i", p, p), max(1, 2**22 // len(p))
        at = np.concatenate([np.argmax(x[a : a + step] @ p.T - half, axis=1) for a in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)
        diff = x - p[at]
        return n + at, np.sqrt(np.einsum("ij,ij->i", diff, diff))

    def reached(self, x: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """(rows, cell) for each cell that can hold a score of least or more for the queries x of one length."""
        d = x.shape[1]
        if d not in self.pivots:
            if -1 - d in self.first:
                yield np.arange(len(x)), -1 - d
            return
        n, p = self.pivots[d]
        there = np.array([k for k in range(len(p)) if n + k in self.first], np.int64)
        radii, norm, step = np.array([self.radius[n + k] for k in there]), np.sqrt(np.einsum("ij,ij->i", x, x)), max(1, 2**22 // len(p))
        for a in range(0, len(x) if len(there) else 0, step):
            near = widened(x[a : a + step] @ p[there].T + norm[a : a + step][:, None] * radii) >= least[a : a + step][:, None]
            for k in np.flatnonzero(near.any(axis=0)).tolist():
                yield a + np.flatnonzero(near[:, k]), n + int(there[k])


def top_k(rows: DataFrame, every: int = 20, k: int = K, shard: int = 16384, block: int = 2048, pivots: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of each query; ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by every; all other rows are candidates. Vectors lie in cells around
    pivots: as many as four a shard, but no more than the root of the number of vectors (or pivots, if that is more), so a cell's
    shards don't grow with the table. They come from a sample by hash of twice as many vectors; a cell of more than shard rows is divided by hash. Each
    shard is a cover tree in one task, and queries come to it in blocks of block rows, each a tree of its own. A query
    is searched first in its own shard, which gives it a kth score, then in those shards only whose cell can reach that
    score. A shard sends its k best a query, and the best of these are taken. Vectors of different lengths have no inner
    product and do not meet. Repeated vec_ids are candidates each, but not for a query with their own id. Components
    are exact up to 2**20 in size. Fewer candidates than k: all. No rows: none.
    """
    n = rows.count()
    pivots = min(max(pivots, isqrt(n)), max(1, 4 * n // shard))
    sample = max(4096, 2 * pivots)
    h = F.xxhash64("vec_id")
    some = rows.where(h <= int(-(2**63) + min(1.0, (2 * sample + 200) / max(1, n)) * (2**64 - 1025))).orderBy(h, "vec_id").limit(sample).toArrow()  # sample rows at most
    cells = Cells(*[pa.concat_arrays(some.column(c).chunks) if some.num_rows else pa.array([], t) for c, t in (("vec_id", pa.int64()), ("v", pa.list_(pa.int64())))], pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, far = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for at, _, x in matrices(b.column("vec_id"), b.column("v")).values():
                cell[at], far[at] = cells.of(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], ["vec_id", "v", "cell", "far"])

    placed = cut(rows.select("vec_id", "v").mapInArrow(place, "vec_id long, v array<long>, cell long, far double"))
    shards = 0
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).orderBy("cell").collect():  # a row a pivot
        cells.first[r["cell"]], cells.parts[r["cell"]], cells.radius[r["cell"]] = shards, -(-r["n"] // shard), r["far"]
        shards += cells.parts[r["cell"]]
    known = placed.sparkSession.createDataFrame([(c, cells.first[c], cells.parts[c]) for c in cells.first], "own_cell long, first int, parts int")
    home = placed.join(F.broadcast(known), F.col("cell") == F.col("own_cell"))
    home = home.select((F.col("first") + F.pmod(h, F.col("parts")).cast("int")).alias("s"), "vec_id", "v")
    data = home.select("s", F.lit(0).alias("kind"), "vec_id", "v", F.lit(float("-inf")).alias("least"))
    asked = home.where(F.col("vec_id") % every == 0)
    own = _searched(data, asked.select("s", F.lit(1).alias("kind"), "vec_id", "v", F.lit(float("-inf")).alias("least")), shards, k, block)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    best = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if shards <= 1:  # no other shard to go to
        return best(own)
    own = cut(own)
    kth = own.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("kth"))
    seeded = asked.join(kth, F.col("vec_id") == F.col("query_id"), "left").select("s", "vec_id", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("least"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                mine, least = b.column("s").to_numpy(), b.column("least").to_numpy()
                for at, _, x in matrices(b.column("vec_id"), b.column("v")).values():
                    for rows_, cell in cells.reached(x, least[at]):
                        for s in range(cells.first[cell], cells.first[cell] + cells.parts[cell]):
                            to = at[rows_]
                            to = to[mine[to] != s]
                            if len(to):
                                t = b.take(pa.array(to))
                                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), s, np.int32)), pa.array(np.ones(len(to), np.int32)), t.column("vec_id"), t.column("v"), t.column("least")], ["s", "kind", "vec_id", "v", "least"])

    routed = seeded.mapInArrow(route, "s int, kind int, vec_id long, v array<long>, least double")
    return best(own.union(_searched(data, routed, shards, k, block)))


def _searched(data: DataFrame, asked: DataFrame, shards: int, k: int, block: int) -> DataFrame:
    """(query_id, vec_id, score): of each shard, the k best of the queries asked of it, of least or more.

    Shards are dealt out by range, so that tasks hold about as many rows each, and data comes before queries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, tuple] = {}
        now, data, held = None, [], []

        def joined(part: list[pa.RecordBatch]):
            t = pa.Table.from_batches(part).combine_chunks()
            one = [pa.concat_arrays(c.chunks) for c in t.columns]
            return one[t.schema.get_field_index("least")].to_numpy(), matrices(one[t.schema.get_field_index("vec_id")], one[t.schema.get_field_index("v")])

        def plant():
            nonlocal data
            if data:
                for d, (_, ids, v) in joined(data)[1].items():
                    trees[d] = (ids, v, cover_tree(v, LEAF))
                data = []

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held:
                least, by = joined(held)
                for d, (at, ids, v) in by.items():
                    if d in trees:
                        own, x, tree = trees[d]
                        top = Top(len(ids), k, least[at])
                        search(v, ids, x, own, tree, top)
                        q, r = np.nonzero(np.isfinite(top.score))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(top.id[q, r]), pa.array(top.score[q, r].astype(np.int64))], ["query_id", "vec_id", "score"])
                held = []

        for b in batches:
            key = b.column("s").to_numpy().astype(np.int64) * 2 + b.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for a, z in zip(edges, edges[1:], strict=False):
                s, kind = divmod(int(key[a]), 2)
                if s != now:
                    yield from answer()
                    trees.clear()
                    now, data = s, []
                if not kind:
                    data.append(b.slice(a, z - a))
                    continue
                plant()
                for x in range(a, z, block):
                    held.append(b.slice(x, min(block, z - x)))
                    if sum(h.num_rows for h in held) >= block:
                        yield from answer()
        yield from answer()

    return data.union(asked).repartitionByRange(max(1, shards), "s").sortWithinPartitions("s", "kind").mapInArrow(run, "query_id long, vec_id long, score long")


def op3_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every twentieth vector, as top_k() gives them."""
    return top_k(vectors(table(spark, sf_dir, "embeddings")))


OP3_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v d on q.vec_id % 20 = 0 and q.vec_id <> d.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
