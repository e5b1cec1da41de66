"""Exact top-k inner products by dual-tree search over cover trees.

Queries lie in blocks of bounded size. Tasks build a cover tree of each block once and
write it to the shared folder; then, in one job over all rows, each task builds trees of
batches of its rows and walks each block's tree together with them. A pair of nodes is
skipped when no inner product between them can reach the worst kth score of the query
node: for centres a, b and covering radii r, s it is at most a.b + r|b| + s|a| + r s,
and at most the product of the largest norms. A block's tree is first walked with
itself, so every query begins with the kth best score among its block's other queries,
below which nothing counts. Each batch hands on at most k rows a query; the best k of
those are the result.

A tree is levelled: a node of level l holds points within 2^l of its centre, its
children's centres are points of it, more than 2^(l-1) apart from each other, and each
of its points lies within 2^(l-1) of its child's centre. Levels without a choice are
left out. A node is a leaf when it has few points, or when more than SOME and one in SPREAD of
its points would be a centre: such points lie too far apart for their radii to tell.
Equal vectors of a batch are held once, with the k + 1 smallest ids: more can never be
among the k best of a query, its own id taken out.

Components are whole numbers, so scores are exact: 64-bit floating point while no partial
sum can pass 2^53, else 64-bit integers; vectors whose scores might pass 2^63 raise an
error. Ties go to the smaller id. Vectors that are NULL, empty or hold NULL or non-finite
components take no part, neither do those of another dimension than the query's, nor NULL
ids. Rows with the query's id are its own. Of query rows with one id one is used, the
smallest vector. Without rows, or without queries, the result is empty. Only the id and
the vector are read, so other columns cannot clash.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.storage import stage

EXACT = float(1 << 53)
LOWEST = np.iinfo(np.int64).min
SPREAD = 8
SOME = 256
#: Scores worked out at once.
SCORES = 1 << 22


@dataclass
class Node:
    center: np.ndarray
    level: int
    radius: float  # of the points below, at most 2^level
    norm: float  # of the centre
    largest: float  # norm of any point below
    points: np.ndarray  # row numbers of all points below
    children: list[Node] | None = None


def cover_tree(x: np.ndarray, leaf_size: int = 4) -> Node | None:
    """A tree over the rows of x (float64)."""
    if not len(x):
        return None
    norms = np.sqrt((x * x).sum(1))

    def far(rows: np.ndarray, center: int) -> np.ndarray:
        return np.sqrt(((x[rows] - x[center]) ** 2).sum(1))

    def node(rows: np.ndarray, center: int, d: np.ndarray) -> Node:
        radius = float(d.max())
        return Node(x[center], int(np.ceil(np.log2(radius))) if radius else 0, radius, float(norms[center]), float(norms[rows].max()), rows)

    every = np.arange(len(x))
    root = node(every, 0, far(every, 0))
    work = [(root, 0, far(every, 0))]
    while work:
        top, center, d = work.pop()
        rows = top.points
        if len(rows) <= leaf_size or top.radius == 0:
            continue
        apart, centers, owner = 2.0 ** (top.level - 1), [center], np.zeros(len(rows), np.int64)
        most = max(SOME, len(rows) // SPREAD)
        while d.max() > apart and len(centers) <= most:
            new = int(rows[int(d.argmax())])
            to_new = far(rows, new)
            nearer = to_new < d
            owner[nearer], d = len(centers), np.minimum(d, to_new)
            centers.append(new)
        if d.max() > apart:
            continue
        top.children = []
        for i, c in enumerate(centers):
            mine = owner == i
            child = node(rows[mine], c, d[mine])
            top.children.append(child)
            work.append((child, c, d[mine]))
    return root


class Best:
    """The k best (score, id) of each query so far; empty places have the lowest score."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.own, self.floor = ids, np.full(len(ids), LOWEST, np.int64) if floor is None else floor
        self.score = np.full((len(ids), k), LOWEST, np.int64)
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)

    def least(self) -> np.ndarray:
        """What a score must reach to count: the kth so far, or a bound known before."""
        return np.maximum(self.score[:, -1], self.floor)

    def offer(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        hit = (scores >= self.least()[queries][:, None]) & (ids[None, :] != self.own[queries][:, None])
        some = hit.any(1)
        if not some.any():
            return
        rows, hit, scores = queries[some], hit[some], scores[some]
        columns = hit.any(0)
        s = np.concatenate((self.score[rows], np.where(hit, scores, LOWEST)[:, columns]), 1)
        i = np.concatenate((self.id[rows], np.where(hit, ids[None, :], np.iinfo(np.int64).max)[:, columns]), 1)
        k = self.score.shape[1]
        order = np.lexsort((i, -np.maximum(s, LOWEST + 1)), axis=1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def exact_in(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether scores are exact in floating point; an error where 64-bit integers do not hold them."""
    bound = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1]
    if not bound < float(1 << 63):
        raise ValueError("scores beyond 64 bits")
    return bound < EXACT


def dual_search(tree: Node, q: np.ndarray, other: Node, x: np.ndarray, ids: np.ndarray, best: Best) -> int:
    """Bring best up to date with the rows of x; returns how many pairs were scored."""
    exact, scored, stack = exact_in(q, x), 0, [(tree, other)]
    while stack:
        a, b = stack.pop()
        bound = min(float(a.center @ b.center) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius, a.largest * b.largest)
        least = best.least()[a.points].min()
        if bound + abs(bound) * 1e-9 + 1e-6 < least:
            continue
        if a.children is None and b.children is None:
            step = max(1, SCORES // len(a.points))
            for i in range(0, len(b.points), step):
                some = b.points[i : i + step]
                scores = (q[a.points] @ x[some].T) if exact else q[a.points].astype(np.int64) @ x[some].astype(np.int64).T
                best.offer(a.points, ids[some], scores.astype(np.int64))
            scored += len(a.points) * len(b.points)
        elif b.children is None or (a.children is not None and (least == LOWEST or a.radius > b.radius)):
            # queries without a bound part first, so that each finds its own
            stack += [(c, b) for c in a.children]
        else:  # the most promising last, so that it is walked first
            stack += [(a, c) for c in sorted(b.children, key=lambda c: float(a.center @ c.center))]
    return scored


def distinct_vectors(x: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal vectors cut down to the keep smallest ids."""
    order = np.lexsort((ids, *x.T[::-1]))
    x, ids = x[order], ids[order]
    new = np.r_[True, (x[1:] != x[:-1]).any(1)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    few = np.arange(len(x)) - first < keep
    return x[few], ids[few]


def integer_components(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, NULL if the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(vector.isNotNull() & sound & (F.size(vector) > 0), F.transform(x, lambda v: F.when(F.abs(v * scale) < EXACT, F.floor(v * scale).cast("double")).otherwise(v * scale)))


def vectors(ids: pa.Array, values: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors by dimension."""
    sizes, starts = np.diff(values.offsets.to_numpy()), values.offsets.to_numpy()[:-1]
    flat, ids = values.values.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
    found = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        found[d] = (ids[at], flat[starts[at][:, None] + np.arange(d)])
    return found


def query_trees(queries: DataFrame, k: int, block: int) -> DataFrame:
    """dimension, tree: a block of queries (id, v) a row, pickled: ids, vectors, their tree and the score that counts for each."""
    blocks = max(1, -(-queries.count() // block))

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rows = []
        for d, (ids, q) in vectors(group.column("id").chunk(0), group.column("v").chunk(0)).items():
            order = np.argsort(ids)
            ids, q = ids[order], q[order]
            tree, best = cover_tree(q), Best(ids, k)
            dual_search(tree, q, tree, q, ids, best)
            rows.append({"dimension": d, "tree": pickle.dumps((ids, q, tree, best.score[:, -1]), protocol=5)})
        return pa.Table.from_pylist(rows, pa.schema([("dimension", pa.int32()), ("tree", pa.binary())]))

    dealt = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    return stage(dealt.groupBy("block").applyInArrow(build, "dimension int, tree binary"), "query-trees")


def top_k(rows: DataFrame, is_query: Column, k: int = 5, block: int = 8192, batch: int = 32_768, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k best among all other rows."""
    sound = rows.select(F.col(vec_id).cast("long").alias("id"), integer_components(F.col(vector), scale).alias("v"), is_query.alias("q")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    queries = stage(sound.filter("q").groupBy("id").agg(F.min("v").alias("v")), "queries")
    files = sorted(query_trees(queries, k, block).inputFiles())

    def trees() -> Iterator[tuple[int, tuple]]:
        import pyarrow.parquet as pq

        for path in files:
            system, inner = fs.FileSystem.from_uri(path)
            with system.open_input_file(inner) as f:
                for part in pq.ParquetFile(f).iter_batches(1):
                    yield part.column("dimension")[0].as_py(), pickle.loads(part.column("tree")[0].as_py())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def work() -> Iterator[pa.RecordBatch]:
            if not waiting:
                return
            table = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            own = {}
            for d, (ids, x) in vectors(table.column("id").chunk(0), table.column("v").chunk(0)).items():
                x, ids = distinct_vectors(x, ids, k + 1)
                own[d] = (ids, x, cover_tree(x))
            for d, (query_ids, q, tree, floor) in trees():
                if d in own:
                    ids, x, other = own[d]
                    best = Best(query_ids, k, floor)
                    dual_search(tree, q, other, x, ids, best)
                    full = best.id != np.iinfo(np.int64).max
                    owner = np.broadcast_to(query_ids[:, None], full.shape)[full]
                    yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(best.id[full]), pa.array(best.score[full])], ["query_id", "vec_id", "score"])

        for part in batches:
            if part.num_rows:
                waiting.append(part)
            if sum(w.num_rows for w in waiting) >= batch:
                yield from work()
        yield from work()

    found = sound.select("id", "v").mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
