"""Approximate nearest neighbours from low-dimensional stable projections.

Vectors of length one are projected to few dimensions by a Gaussian matrix, under which squared distance
times a chi-square number of that many degrees is the projected one.

Index. The upper levels of a kd-tree over the projections are fitted to a bounded sample; every row goes to
the cell in which its projection lies, a cell of too many rows (equal or nearly equal vectors) is dealt to
several tasks, and the lower levels of the tree are grown in the task that holds a cell.

Search. A query first asks its own cell. With the k-th best found there it asks those other cells alone
whose box the stopping test leaves open. In a cell it walks the tree: a heap gives the nodes by their
projected distance, nearest first, and the vectors of a leaf are verified, until the chi-square test says
that a vector nearer than the k-th best so far would have been met already with the wished probability.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored

LEAF = 256  # rows of a leaf


def chi_square_quantile(p: float, degrees: int) -> float:
    """Quantile for an even number of degrees, by bisection of the closed form."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))
    lo, hi = 0.0, 1e4
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - tail(mid) < p else (lo, mid)
    return hi


class Tree:
    """A kd-tree: halved at the median of the widest dimension, down to ``depth`` levels or leaves of LEAF rows.

    Node i splits dimension dim[i] at cut[i] into the nodes left[i] (below) and right[i]; dim is -1 for a
    leaf, which has rows[i] = (from, to) in ``order`` and number leaf[i].
    """

    def __init__(self, points: np.ndarray, depth: int = 64, strict: bool = False):
        self.dim, self.cut, self.left, self.right, self.rows, self.leaf = [], [], [], [], [], []
        self.order = np.arange(len(points))
        leaves = 0
        waiting = [(0, len(points), depth, -1, False)]
        while waiting:
            lo, hi, deep, parent, is_right = waiting.pop()
            i = len(self.dim)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = i
            self.dim.append(-1), self.cut.append(0.0), self.left.append(-1), self.right.append(-1), self.rows.append((lo, hi)), self.leaf.append(-1)
            p = points[self.order[lo:hi]]
            if deep and len(p) > (1 if strict else LEAF):
                d = int(np.ptp(p, axis=0).argmax())
                half = len(p) // 2
                by = np.argpartition(p[:, d], half)
                cut = float(p[by[half], d])
                # strict: equal points stay together, so that the cut alone says where a point lies
                below = p[:, d] < cut
                if strict:
                    by, half = np.argsort(~below, kind="stable"), int(below.sum())
                if half:
                    self.order[lo:hi] = self.order[lo:hi][by]
                    self.dim[i], self.cut[i] = d, cut
                    waiting += [(lo, lo + half, deep - 1, i, False), (lo + half, hi, deep - 1, i, True)]
                    continue
            self.leaf[i] = leaves
            leaves += 1
        self.leaves = leaves

    def find(self, points: np.ndarray) -> np.ndarray:
        """The number of the leaf of each point (of a strict tree)."""
        dim, cut, left, right = (np.array(x) for x in (self.dim, self.cut, self.left, self.right))
        at = np.zeros(len(points), np.int64)
        while (inner := np.flatnonzero(dim[at] >= 0)).size:
            node = at[inner]
            at[inner] = np.where(points[inner, dim[node]] < cut[node], left[node], right[node])
        return np.array(self.leaf)[at]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def projection(size: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, dims))


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row in a fixed order, so that equal vectors have equal scores wherever they stand."""
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


class Cell:
    """The rows of a cell (or of one part of it) and the tree over them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, dims: int, confidence: float, seed: int):
        u = unit(x)
        self.project = projection(x.shape[1], dims, seed)
        p = u @ self.project
        self.tree = Tree(p)
        order = self.tree.order
        self.ids, self.x, self.u = ids[order], x[order], u[order]  # the rows of a leaf in a row
        self.low, self.high = p.min(0), p.max(0)
        self.far = chi_square_quantile(confidence, dims)

    def nearest(self, query_id: int, q: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k nearest rows of a cosine of at least ``least`` that the walk meets."""
        t, v = self.tree, unit(q[None])[0]
        r = v @ self.project
        off = np.maximum(np.maximum(self.low - r, r - self.high), 0)
        r = r.tolist()
        heap = [(float(off @ off), 0, tuple(off.tolist()))]
        some, near = np.zeros(0, np.int64), np.zeros(0)
        limit = self.far * max(0.0, 2 - 2 * least) + 1e-9
        while heap:
            bound, node, off = heappop(heap)
            if bound > limit:
                break  # chi-square test
            d = t.dim[node]
            if d < 0:
                lo, hi = t.rows[node]
                s = self.u[lo:hi] @ v
                new = lo + np.flatnonzero(s >= least - 1e-12)
                new = new[self.ids[new] != query_id]
                if len(new):
                    some, near = np.r_[some, new], np.r_[near, s[new - lo]]
                    if len(near) >= k:
                        least = max(least, float(np.partition(near, -k)[-k]))
                        limit = self.far * max(0.0, 2 - 2 * least) + 1e-9
                        keep = near >= least - 1e-12  # with all ties
                        some, near = some[keep], near[keep]
                continue
            beyond = r[d] - t.cut[node]
            close, other = (t.right[node], t.left[node]) if beyond >= 0 else (t.left[node], t.right[node])
            heappush(heap, (bound, close, off))
            more = abs(beyond)
            if more > off[d]:  # the other side is at least so far off in this dimension
                bound += more * more - off[d] * off[d]
                off = off[:d] + (more,) + off[d + 1 :]
            if bound <= limit:
                heappush(heap, (bound, other, off))
        exact = cosine(self.x[some], q)
        best = np.lexsort((self.ids[some], -exact))
        ids = self.ids[some[best]]
        _, first = np.unique(ids, return_index=True)  # an id once
        first = np.sort(first)[:k]
        return ids[first], exact[best][first]


def vectors_of(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def searcher(k: int, dims: int, confidence: float, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function over rows sorted by (size, cell, salt, part, role): a cell's rows (role 0), then queries (role 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell, held = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "cell", "salt", "part", "role")], 1)
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, batch.num_rows]
            found: list[tuple] = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                *here, role = keys[lo].tolist()
                if here != key:
                    key, cell, held = here, None, []
                some = batch.slice(lo, hi - lo)
                ids, x = some.column("vec_id").to_numpy(), vectors_of(some.column("embedding"))
                if role == 0:
                    held.append((ids, x))
                    continue
                if cell is None and held:
                    cell, held = Cell(*(np.concatenate(c) for c in zip(*held, strict=True)), dims, confidence, seed), []
                if cell is not None:
                    for q, v, least in zip(ids.tolist(), x, some.column("least").to_pylist(), strict=True):
                        found += [(q, i, s) for i, s in zip(*(c.tolist() for c in cell.nearest(q, v, k, least)), strict=True)]
            cols = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def sampled_trees(rows: DataFrame, n: int, cell_rows: int, sample_rows: int, dims: int, seed: int) -> dict[int, Tree]:
    """The upper levels of the tree for each size of vectors that a sample of at most ``sample_rows`` rows holds."""
    by = F.xxhash64(F.lit(seed), "vec_id", "embedding")
    got = rows.select("vec_id", "size", "embedding").orderBy(by, "vec_id").limit(sample_rows).collect()
    share, trees = n / max(1, len(got)), {}
    for size in {r["size"] for r in got}:
        x = np.array(sorted(r["embedding"] for r in got if r["size"] == size), np.float64)
        # no cell rests on fewer than 8 rows of the sample
        depth = min(math.ceil(math.log2(max(1.0, len(x) * share / cell_rows))), int(math.log2(max(1.0, len(x) / 8))))
        trees[size] = Tree(unit(x) @ projection(size, dims, seed), depth, strict=True)
    return trees


def in_cells(rows: DataFrame, trees: dict[int, Tree], dims: int, seed: int) -> DataFrame:
    """rows with their cell and projection (array of double); sizes without a tree have one cell."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)  # at most an eighth as many cells as sampled rows
    schema = rows.withColumns({"cell": F.lit(0), "projected": F.array(F.lit(0.0))}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sizes = b.column("size").to_numpy()
            cell, projected = np.zeros(b.num_rows, np.int32), np.zeros((b.num_rows, dims))
            for size in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == size)
                projected[mine] = unit(vectors_of(b.column("embedding").take(pa.array(mine)))) @ projection(size, dims, seed)
                if size in shared.value:
                    cell[mine] = shared.value[size].find(projected[mine])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, dims * b.num_rows + 1, dims), pa.int32()), pa.array(projected.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), flat], [*b.schema.names, "cell", "projected"])

    return rows.mapInArrow(run, schema)


def open_cells(queries: DataFrame, boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], dims: int, confidence: float) -> DataFrame:
    """(size, cell, vec_id) of the cells, other than their own, that the test leaves open to queries (vec_id, size, cell, projected, least)."""
    shared = queries.sparkSession.sparkContext.broadcast(boxes)  # a box for each cell
    far = chi_square_quantile(confidence, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[tuple[int, np.ndarray, int]] = []
            cols = (b.column(c).to_pylist() for c in ("vec_id", "size", "cell", "projected", "least"))
            for q, size, own, r, least in zip(*cols, strict=True):
                cells, low, high = shared.value[size]
                off = np.maximum(np.maximum(low - r, r - high), 0)
                able = ((off * off).sum(1) <= far * max(0.0, 2 - 2 * least) + 1e-9) & (cells != own)
                got.append((size, cells[able], q))
            n = [len(c) for _, c, _ in got]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([s for s, _, _ in got], n), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *[c for _, c, _ in got]]), pa.int32()), pa.array(np.repeat([q for _, _, q in got], n), pa.int64())], ["size", "cell", "vec_id"])

    return queries.select("vec_id", "size", "cell", "projected", "least").mapInArrow(run, "size int, cell int, vec_id long")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, dims: int = 8, confidence: float = 0.95, cell_rows: int = 8192, sample_rows: int = 20_000, part_queries: int = 8192, seed: int = 5) -> DataFrame:
    """The k nearest rows by cosine for each query row, its own id excepted.

    :param is_query: condition on vec_id; :param confidence: of the stopping test, for each neighbour.
    :param cell_rows: rows of a cell, about; cells of more than twice as many are dealt to several tasks.
    :param sample_rows: bound on the rows, gathered on the driver, to which the upper levels of the tree are
        fitted. All rows are indexed. :param part_queries: queries that meet a cell in one task, about.

    Columns read: vec_id, embedding (array of numbers). Returns query_id, rank (from 1), vec_id, score;
    nearest first, ties to the smaller vec_id; fewer than k rows where there are fewer candidates. Rows
    with a null id, and vectors that are null, empty, zero or hold null or non-finite components, take no
    part. Vectors are compared with those of their own length only. Of rows that repeat an id all are
    candidates, each id is found once, and one (the first in the order of arrays) is the query. Of equal
    vectors only those of the k + 1 smallest ids are searched: no other can be among the k nearest of any
    query. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    e = F.transform("embedding", lambda x: x.cast("double"))
    whole = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.filter(whole).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"), F.size("embedding").alias("size"))
    # equal vectors, by a hash of 128 bits: the id from which on a copy is of no use
    copy = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")]
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    last = rows.select("vec_id", *copy).distinct().withColumn("n", rank).filter(F.col("n") <= k + 1).filter(F.col("n") == k + 1).select("h1", "h2", F.col("vec_id").alias("last"))
    asks = rows.filter(is_query).groupBy("vec_id").agg(F.min_by(F.struct("embedding", "size"), "embedding").alias("q")).select("vec_id", "q.embedding", "q.size")
    told = rows.select("*", *copy).join(last, ["h1", "h2"], "left").filter("last is null or vec_id <= last").select("vec_id", "embedding", "size")
    n = rows.count()
    trees = sampled_trees(rows, n, cell_rows, sample_rows, dims, seed)
    told = stored(in_cells(told, trees, dims, seed), "ann-rows")
    asks = stored(in_cells(asks, trees, dims, seed), "ann-queries")
    # rows and boxes of the cells: at most an eighth as many as sampled rows, and one for each size beside
    edges = [f(F.col("projected")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(dims)]
    cells = told.groupBy("size", "cell").agg(F.count("*").alias("n"), *edges).collect()
    salts = spark.createDataFrame([(c["size"], c["cell"], -(-c["n"] // (2 * cell_rows))) for c in cells], "size int, cell int, salts int")
    boxes = {s: tuple(np.array(x) for x in zip(*[(c["cell"], [c[f"low{i}"] for i in range(dims)], [c[f"high{i}"] for i in range(dims)]) for c in cells if c["size"] == s], strict=True)) for s in {c["size"] for c in cells}}
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    search = searcher(k, dims, confidence, seed)
    key = ["size", "cell", "salt", "part"]

    def met(asked: DataFrame) -> DataFrame:
        """What the queries asked (size, cell, vec_id, embedding, least) find in their cells."""
        counts = stored(asked.groupBy("size", "cell").agg(F.ceil(F.count("*") / part_queries).cast("int").alias("parts")).join(F.broadcast(salts), ["size", "cell"]), "ann-asked")
        here = told.join(F.broadcast(counts), ["size", "cell"])  # a row for each cell
        left = here.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int")).withColumn("part", every("parts")).select(*key, F.lit(0).alias("role"), "vec_id", "embedding", F.lit(-2.0).alias("least"))
        there = asked.join(F.broadcast(counts), ["size", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).withColumn("salt", every("salts"))
        right = there.select(*key, F.lit(1).alias("role"), "vec_id", "embedding", "least")
        tasks = counts.agg(F.coalesce(F.sum(F.col("salts") * F.col("parts")), F.lit(0))).first()[0]
        both = left.union(right).repartition(max(partitions(spark), tasks), *key).sortWithinPartitions(*key, "role")
        return both.mapInArrow(search, "query_id long, vec_id long, score double")

    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    home = stored(best(met(asks.withColumn("least", F.lit(-2.0)))), "ann-home")
    bound = home.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    asks = asks.join(bound, "vec_id", "left").withColumn("least", F.coalesce("bound", F.lit(-2.0)))
    open_ = stored(open_cells(asks, boxes, dims, confidence), "ann-open")
    more = met(open_.join(asks.select("vec_id", "embedding", "least"), "vec_id"))
    return best(home.drop("rank").union(more))
