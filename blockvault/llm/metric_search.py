"""Exact top-k search by inner product with M-trees.

Vectors of integers become points of a metric space: with M the largest norm of all vectors, x becomes
(x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0), so that the squared Euclidean distance is
|q|^2 + M^2 - 2 q.x and nearest means highest product.  A top page of at most ``PIVOTS`` sampled points deals all
rows to cells by their nearest pivot; a cell is one tree, or, if it has many rows, several trees of bounded size.
A node of a tree is a page: the vectors of its routing objects, their covering radii, their distances to the
node's own routing object.  A search takes pages from a heap, the least possible distance first, and computes the
distance of an entry only if the triangle inequality with the parent's distance leaves room for it.  A query goes to
the nearest cell first; what it finds there bounds the others that it goes to, by their pivots and radii.  Bounds have
some slack for rounding; scores are exact integers, so ties go to the smaller id.

Queries meet trees in blocks, each block of queries once with each tree that it needs.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Rows of a tree and of a block of queries, on average; entries of a page.
TREE_ROWS, BLOCK_ROWS = 8192, 1024
LEAF, FAN = 256, 32
#: Points of the top page, at most.
PIVOTS = 1024
#: Scores beyond 64 bits are the last that 64 bits hold.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Beyond this, products of doubles might not be exact integers.
EXACT = 1 << 53


def whole_numbers(vector: Column) -> Column:
    """floor(1024 * x) of each component, within 64 bits; null where the vector or a component is null or not finite."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(v, lambda x: F.floor(F.lit(1024.0) * x)))


def _matrix(vectors: list) -> np.ndarray:
    """Rows of integers; missing components count as 0."""
    width = max(map(len, vectors), default=0)
    if all(len(v) == width for v in vectors):
        return np.array([np.asarray(v, np.int64) for v in vectors], np.int64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _fit(x: np.ndarray, width: int) -> np.ndarray:
    """Columns cut or filled up with zeros: products do not change if the other side has no more than ``width``."""
    return x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _points(x: np.ndarray, most: float) -> np.ndarray:
    f = x.astype(np.float64)
    return np.column_stack([f, np.sqrt(np.maximum(most - (f * f).sum(axis=1), 0))])


def _slack(base: np.ndarray | float) -> np.ndarray | float:
    return 1e-7 * np.sqrt(base + 1) + 1e-6


class TopPage:
    """The pivots of the cells, and, once they are known, the cells' radii."""

    def __init__(self, pivots: list, most: float):
        self.x, self.most = _matrix(pivots), most

    def nearest(self, vectors: list) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector and its distance to the cell's pivot."""
        x = _matrix(vectors)
        width = max(x.shape[1], self.x.shape[1])
        x, pivots = (_points(_fit(y, width), self.most) for y in (x, self.x))
        cell = (-2 * x @ pivots.T + (pivots * pivots).sum(axis=1)).argmin(axis=1)
        return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))

    def reach(self, vectors: list, limits: list, radii: np.ndarray) -> np.ndarray:
        """For each query (row) and cell whether the cell may hold a row of at least the score ``limit``."""
        q = _matrix(vectors)
        width = max(q.shape[1], self.x.shape[1])
        q, pivots = _fit(q, width).astype(np.float64), _fit(self.x, width).astype(np.float64)
        base = ((q * q).sum(axis=1) + self.most)[:, None]
        distance = np.sqrt(np.maximum(base - 2 * q @ pivots.T, 0))
        least = np.array([-np.inf if x is None or x == LEAST else float(x) for x in limits])[:, None]
        return (distance - radii - 2 * _slack(base) <= np.sqrt(np.maximum(base - 2 * least, 0))) & (radii >= 0)  # empty cells have none


class MTree:
    def __init__(self, ids: np.ndarray, x: np.ndarray, most: float | None = None):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        if most is None:
            f = x.astype(np.float64)
            most = float((f * f).sum(axis=1).max(initial=0.0))
        self.most, self.largest = most, _largest(x)
        points = _points(x, most)
        # A page: (begin, end) of its rows if it is a leaf, else the rows of its routing objects; distances of its
        # entries to the page's own routing object; radii and pages of its children, if any.
        self.pages: list[tuple] = []
        self.order: list[np.ndarray] = []
        self.placed = 0
        self.root = self._build(points, np.arange(len(ids)), None)
        place = np.concatenate(self.order) if self.order else np.zeros(0, np.int64)
        lean = np.int16 if self.largest < 1 << 15 else np.int32 if self.largest < 1 << 31 else np.int64
        self.ids, self.x = ids[place], x[place].astype(lean)  # the rows of a leaf lie together
        self.pages = [(rows, x[rows].astype(lean) if children else None, *rest, children) for rows, *rest, children in self.pages]
        del self.order

    def _build(self, points: np.ndarray, members: np.ndarray, parent: np.ndarray | None) -> int:
        """Adds the page of these members, after its children's."""
        to_parent = lambda p: np.zeros(len(p)) if parent is None else np.sqrt(((p - parent) ** 2).sum(axis=1))
        if len(members) <= LEAF:
            self.order.append(members)
            self.pages.append(((self.placed, self.placed + len(members)), to_parent(points[members]), None, None))
            self.placed += len(members)
            return len(self.pages) - 1
        fan = min(FAN, math.ceil(len(members) / LEAF) + 1)
        pivots = members[np.linspace(0, len(members) - 1, fan).astype(int)]
        p = points[pivots]
        near = (-2 * points[members] @ p.T + (p * p).sum(axis=1)).argmin(axis=1)
        parts = [(k, members[near == k]) for k in range(fan)]
        if max(len(m) for _, m in parts) == len(members):  # they all are alike
            parts = list(enumerate(np.array_split(members, fan)))
        routing, radii, children = [], [], []
        for k, m in parts:
            if len(m):
                routing.append(pivots[k])
                radii.append(math.sqrt(((points[m] - points[pivots[k]]) ** 2).sum(axis=1).max()))
                children.append(self._build(points, m, points[pivots[k]]))
        self.pages.append((np.array(routing), to_parent(points[routing]), np.array(radii), children))
        return len(self.pages) - 1

    def prepare(self) -> None:
        """Doubles beside the integers, for as long as searches last."""
        self.doubles = self.x.astype(np.float64)
        self.routing = [None if r is None else r.astype(np.float64) for _, r, *_ in self.pages]

    def search(self, own: int, q: np.ndarray, k: int, limit: int | None = None, within: bool = False) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, of all rows but the query's own; with a ``limit``, rows of
        lower scores may be missing; with ``within``, scores stay within 64 bits."""
        q = _fit(q[None, :], self.x.shape[1])[0]
        f = q.astype(np.float64)
        exact = max(self.largest, 1) * _largest(q) * max(len(q), 1) < EXACT
        base = float((f * f).sum()) + self.most
        slack = _slack(base)
        reached = lambda score: math.inf if score == LEAST else math.sqrt(max(base - 2.0 * score, 0.0)) + slack
        held = (lambda x: min(max(x, LEAST), MOST)) if within else int
        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst first
        bound = start = math.inf if limit is None else reached(limit)
        heap: list[tuple[float, float, int]] = [(0.0, math.nan, self.root)]
        self.computed = 0
        while heap:
            least, from_parent, page = heapq.heappop(heap)
            if least > bound:
                break
            rows, _, to_parent, radii, children = self.pages[page]
            # |d(q, parent) - d(entry, parent)| - radius is a lower bound that needs no new distance.
            floor = np.abs(from_parent - to_parent) - (0 if children is None else radii)
            may = np.flatnonzero(~(floor > bound))
            if not len(may):
                continue
            self.computed += len(may)
            if children is None:
                begin, end = rows
                part = slice(begin, end) if 2 * len(may) > end - begin else begin + may
                scores = self.doubles[part] @ f if exact else np.array([held(sum(map(int.__mul__, r, q.tolist()))) for r in self.x[part].tolist()], object)
                others = self.ids[part] != own
                scores, ids = scores[others], self.ids[part][others]
                least = best[0][0] if len(best) == k else np.sort(scores)[-k] if len(scores) > k else -math.inf
                hit = np.flatnonzero(scores >= least)
                for score, i in zip(scores[hit].tolist(), ids[hit].tolist(), strict=True):
                    entry = (int(score), -i)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                if len(best) == k:
                    bound = min(start, reached(best[0][0]))
            else:
                distances = np.sqrt(np.maximum(base - 2 * (self.routing[page][may] @ f), 0))
                floors = np.maximum(distances - radii[may] - slack, 0)
                for j in np.flatnonzero(floors <= bound).tolist():
                    heapq.heappush(heap, (float(floors[j]), float(distances[j]), children[may[j]]))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def top_k(df: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), the neighbour's id and score: the k highest products of each query with all rows but its own.

    ``queries`` is a condition that picks the query rows of ``df``.  Vectors that are null or hold null or
    non-finite components, and rows with a null id, take no part; missing components of shorter vectors count
    as 0.  Components and scores beyond 64 bits are the least or greatest number of 64 bits; such scores are ties.
    A query whose id is repeated is asked once, with the least of its vectors; candidates that repeat an
    id are candidates each.  Ties go to the smaller id.  An empty table gives an empty result; other columns are
    not read.  Ids are integers.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.withColumn("_query", F.coalesce(queries, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), "_query", whole_numbers(F.col(vector_col)).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    sizes = rows.agg(F.count(F.lit(1)), F.sum(F.col("_query").cast("long")), F.max(norm)).first()
    n_cells, n_blocks = min(PIVOTS, max(1, math.ceil(sizes[0] / TREE_ROWS))), max(1, math.ceil((sizes[1] or 0) / BLOCK_ROWS))
    sample = rows.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id", "v").limit(n_cells).collect()  # PIVOTS rows at most
    top = TopPage([r["v"] for r in sample] or [[]], sizes[2] or 0.0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, distance = top.nearest(batch.column("v").to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(distance)], ["id", "_query", "v", "cell", "distance"])

    dealt = cut(rows.mapInArrow(deal, "id long, _query boolean, v array<long>, cell int, distance double"))
    cells = {r[0]: r for r in dealt.groupBy("cell").agg(F.count(F.lit(1)), F.max("distance")).collect()}  # a row for each pivot
    radii = np.array([cells[c][2] if c in cells else -1.0 for c in range(len(top.x))])
    number = [math.ceil(cells[c][1] / TREE_ROWS) if c in cells else 0 for c in range(len(top.x))]
    first = [sum(number[:c]) for c in range(len(number))]
    at = lambda of, cell: F.element_at(F.array(*map(F.lit, of)), cell + 1)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tree = MTree(rows["id"].to_numpy(np.int64), _matrix(rows["v"].tolist()), top.most)
        return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "page": [pickle.dumps(tree, 5)]})

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        limits = [None if pd.isna(x) else int(x) for x in rows["bound"]]
        return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "asked": [pickle.dumps((rows["id"].tolist(), _matrix(rows["v"].tolist()), limits), 5)]})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, block in zip(batch.column("page"), batch.column("asked"), strict=True):
                tree = pickle.loads(page.as_py())
                tree.prepare()
                found = [(q, i, s) for q, v, limit in zip(*pickle.loads(block.as_py()), strict=True) for s, i in tree.search(q, v, k, limit, True)]
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], ["query_id", "id", "score"])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                may = top.reach(batch.column("v").to_pylist(), batch.column("bound").to_pylist(), radii)
                may[np.arange(len(may)), batch.column("cell").to_numpy()] = False  # that is done
                others = pa.array([np.flatnonzero(m).astype(np.int32) for m in may], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), batch.column("bound"), others], ["id", "v", "bound", "cells"])

    tree = at(first, F.col("cell")) + F.pmod(F.xxhash64("id", F.lit(1)), at(number, F.col("cell"))).cast("int")
    trees = cut(dealt.withColumn("tree", tree).groupBy("tree").applyInPandas(build, "tree int, page binary"))

    def searched(asked: DataFrame) -> DataFrame:
        """What queries (id, v, cell, bound) find in all trees of a cell."""
        own = F.explode(F.sequence(at(first, F.col("cell")), at(first, F.col("cell")) + at(number, F.col("cell")) - 1))
        block = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(n_blocks))
        blocks = asked.select("id", "v", "bound", own.alias("tree")).groupBy("tree", block.alias("block")).applyInPandas(gather, "tree int, asked binary")
        return blocks.join(trees, "tree").select("page", "asked").mapInArrow(search, "query_id long, id long, score long")

    from pyspark.sql.window import Window

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    asked = dealt.filter("_query").groupBy("id").agg(F.min(F.struct("v", "cell")).alias("x")).select("id", "x.v", "x.cell")
    near = cut(best(searched(asked.withColumn("bound", F.lit(None).cast("long")))))
    known = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    others = asked.join(known, "id", "left").select("id", "v", "cell", "bound").mapInArrow(reach, "id long, v array<long>, bound long, cells array<int>")
    rest = searched(others.select("id", "v", "bound", F.explode("cells").alias("cell")))
    return best(near.drop("rank").union(rest)).select("query_id", "rank", F.col("id").alias(id_col), "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
