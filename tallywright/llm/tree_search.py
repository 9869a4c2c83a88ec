"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample and holds a bounded number of leaves; every
row is indexed: it goes down the tree to a leaf. A query goes through the tree best
bin first: a priority queue holds the nodes seen, the nearest is opened next, and
leaves come out in the order in which they are to be visited. How many are visited
is calibrated: for sampled queries the true neighbours are found among all rows,
and visits widen until the leaves visited hold the wanted part of them.

Rows are compared by cells: neighbouring small leaves share one, a large leaf is
several, so a cell's rows are bounded. A query goes once to each cell that it visits a
leaf of, with the list of those leaves.

Nearness is the inner product. Vectors get a further component that makes their
lengths equal, so that the nearest by distance is the largest inner product.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import pieces, stored, table
from tallywright.llm.vectors import (
    QUERY_BLOCK,
    ROW_BLOCK,
    best,
    block_of,
    blocks_for,
    found_batch,
    lists,
    sound,
)

TOP = 20
BRANCHES = 8
#: Rows in a leaf, about, while the tree has at most BRANCHES ** MOST_LEVELS leaves.
LEAF = 1000
LEVELS, MOST_LEVELS = 2, 4
#: Rows the tree is fitted on, and queries the visits are calibrated on, at most.
SAMPLE, CALIBRATION = 20_000, 128
#: Part of the true neighbours that the visits must reach on those queries.
RECALL = 0.96


class Tree:
    """Centres of a complete tree, level by level; node j has children j * b + i."""

    def __init__(self, centres: list[np.ndarray], branches: int):
        self.centres, self.branches = centres, branches
        self.leaves = len(centres[-1])

    @classmethod
    def fit(cls, sample: np.ndarray, branches: int, levels: int, seed: int = 11) -> Tree:
        random = np.random.default_rng(seed)
        groups, centres = [sample], []
        for _ in range(levels):
            nodes, below = [], []
            for group in groups:
                middle = _kmeans(group, branches, random) if len(group) else np.full((branches, sample.shape[1]), np.inf)
                nodes.append(middle)
                near = _nearest(group, middle) if len(group) else np.zeros(0, int)
                below += [group[near == i] for i in range(branches)]
            centres.append(np.concatenate(nodes))
            groups = below
        return cls(centres, branches)

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        for level in self.centres:
            new = np.zeros_like(node)
            for j in np.unique(node):
                mine = node == j
                part = level[j * self.branches:(j + 1) * self.branches]
                new[mine] = j * self.branches + _nearest(rows[mine], part)
            node = new
        return node

    def order(self, query: np.ndarray) -> Iterator[int]:
        """Leaves best bin first."""
        queue = [(0.0, 0, 0)]
        while queue:
            _, level, node = heapq.heappop(queue)
            if level == len(self.centres):
                yield node
                continue
            first = node * self.branches
            away = ((self.centres[level][first:first + self.branches] - query) ** 2).sum(axis=1)
            for i, d in enumerate(away.tolist()):
                if d < np.inf:
                    heapq.heappush(queue, (d, level + 1, first + i))

    def visits(self, query: np.ndarray, least: int, rows: int, held: dict[int, int]) -> list[int]:
        """The first ``least`` leaves best bin first, and further ones while those visited
        hold fewer than so many rows and one is left."""
        out, seen = [], 0
        for leaf in self.order(query):
            if len(out) >= least and seen >= rows:
                break
            out.append(leaf)
            seen += held.get(leaf, 0)
        return out


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    real = np.isfinite(centres[:, 0])
    middle = np.where(real[:, None], centres, 0.0)
    away = (middle ** 2).sum(axis=1) - 2 * rows @ middle.T
    away[:, ~real] = np.inf
    return away.argmin(axis=1)


def _kmeans(rows: np.ndarray, k: int, random, rounds: int = 12) -> np.ndarray:
    """Centres; those without rows are infinite, so that nothing goes there."""
    different = np.unique(rows, axis=0)
    centres = np.full((k, rows.shape[1]), np.inf)
    some = min(k, len(different))
    centres[:some] = different[random.choice(len(different), some, replace=False)]
    for _ in range(rounds):
        near = _nearest(rows, centres)
        for i in range(some):
            if (near == i).any():
                centres[i] = rows[near == i].mean(axis=0)
    return centres


def _lengthened(rows: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest - (rows ** 2).sum(axis=1), 0.0))
    return np.concatenate([rows, rest[:, None]], axis=1)


def _as_query(query: np.ndarray, longest: float) -> np.ndarray:
    length = np.sqrt((query ** 2).sum())
    return np.append(query * (np.sqrt(longest) / length if length else 1.0), 0.0)


def _matrix(column, width: int) -> np.ndarray:
    return lists(column)[0].astype(np.float64).reshape(-1, width)


def cells_of(held: dict[int, int], leaves: int, size: int) -> tuple[list[int], list[int]]:
    """Per leaf its first cell and its number of cells, of about ``size`` rows at most.

    Leaves that follow each other in the tree share a cell while their rows fit into it;
    an empty leaf is in whatever cell is at hand.
    """
    first, many, cell, filled = [], [], -1, size
    for leaf in range(leaves):
        n = held.get(leaf, 0)
        if filled + n > size:
            cell, filled = cell + 1, 0
        first.append(cell)
        many.append(blocks_for(n, size))
        cell += many[-1] - 1
        filled = size if many[-1] > 1 else filled + n
    return first, many


def top(ids: np.ndarray, rows: np.ndarray, keys: np.ndarray, queries: np.ndarray, k: int, visited=None):
    """Per query the ids and inner products of the k best rows but its own; with
    ``visited``, which gives a mask of the rows for a query's place, of those only.

    A matrix product narrows the rows down, with a margin for its rounding; scores
    are then computed one by one in the same order of terms, so that equal vectors
    have equal scores.
    """
    found, scores = [], []
    for at in range(0, len(keys), 256):
        block = queries[at:at + 256] @ rows.T
        for i, (key, query, line) in enumerate(zip(keys[at:at + 256].tolist(), queries[at:at + 256], block), at):
            line[ids == key] = -np.inf
            if visited:
                line[~visited(i)] = -np.inf
            if len(line) > k:
                limit = np.partition(line, len(line) - k)[len(line) - k]
                near = np.flatnonzero(line >= limit - 1e-9 * max(1.0, abs(limit))) if limit > -np.inf else np.flatnonzero(line > -np.inf)
            else:
                near = np.flatnonzero(line > -np.inf)
            exact = (rows[near] * query).sum(axis=1)
            order = np.lexsort((ids[near], -exact))[:k]
            found.append(ids[near][order]), scores.append(exact[order])
    return found, scores


def search(
    vectors: DataFrame, queries: DataFrame, k: int = TOP, recall: float = RECALL,
    row_block: int = ROW_BLOCK // 2, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the k nearest rows found.

    Both frames have ``key`` (long) and ``vector`` (doubles, finite). Zero vectors take
    no part, and neither do those of another length than the most frequent one (the
    longer if two are). Rows of the query's own key are left out. Ties go to the
    smaller id. Repeated keys are candidates of their own, queries of one key are one
    query. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    out = "query_id long, ids array<long>, scores array<double>"
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    rows = vectors.where(F.exists("vector", lambda x: x != 0)).select("key", "vector", F.size("vector").alias("width"), square.alias("square"))
    widths = rows.groupBy("width").agg(F.count("*").alias("n"), F.max("square").alias("longest")) \
        .orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    if not widths:
        return best(spark.createDataFrame([], out), k)
    width, total, longest = widths[0]
    rows = rows.where(F.col("width") == width)
    asked = queries.where(F.exists("vector", lambda x: x != 0)).where(F.size("vector") == width).dropDuplicates(["key"])
    by_hash = F.xxhash64(F.lit(5), "key")
    sample = np.array([r[0] for r in rows.orderBy(by_hash, "key").limit(SAMPLE).select("vector").collect()], np.float64)
    levels = LEVELS
    while levels < MOST_LEVELS and BRANCHES ** levels * LEAF * 2 < total:
        levels += 1
    tree = Tree.fit(_lengthened(sample, longest), BRANCHES, levels)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            leaf = tree.leaf_of(_lengthened(_matrix(batch.column(1), width), longest))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=["key", "vector", "leaf"])

    index = stored(rows.select("key", "vector").mapInArrow(place, "key long, vector array<double>, leaf int"), "tree-index")
    in_leaf = dict(index.groupBy("leaf").agg(F.count("*").alias("n")).collect())  # a row per leaf

    # calibration: true neighbours of sampled queries, and when their leaves come
    tried = asked.orderBy(by_hash, "key").limit(CALIBRATION).select("key", "vector").collect()
    if not tried:
        return best(spark.createDataFrame([], out), k)
    keys, points = np.array([r[0] for r in tried]), np.array([r[1] for r in tried], np.float64)
    orders = [list(tree.order(_as_query(p, longest))) for p in points]

    def compare_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8192):
            ids = batch.column(0).to_numpy()
            found, scores = top(ids, _matrix(batch.column(1), width), keys, points, k)
            yield from found_batch(keys.tolist(), found, scores, pa.float64()).to_batches()

    true = best(index.select("key", "vector").mapInArrow(compare_all, out), k)
    true = true.join(index.select(F.col("key").alias("vec_id"), "leaf"), "vec_id").select("query_id", "leaf").collect()
    turn = {key: {leaf: i for i, leaf in enumerate(order)} for key, order in zip(keys.tolist(), orders)}
    late = np.sort([turn[q].get(leaf, tree.leaves) for q, leaf in true])
    visits = int(late[max(0, int(np.ceil(recall * len(late))) - 1)]) + 1 if len(late) else tree.leaves

    first, many = cells_of(in_leaf, tree.leaves, row_block)
    # a query's own key is no candidate, however many rows have it
    own = index.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    query_blocks = blocks_for(asked.count(), query_block)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            points = _matrix(batch.column(1), width)
            taken, cells, leaves = [], [], []
            for i, point in enumerate(points):
                opened = defaultdict(list)
                for leaf in tree.visits(_as_query(point, longest), visits, k + own, in_leaf):
                    for part in range(many[leaf] if in_leaf.get(leaf) else 0):
                        opened[first[leaf] + part].append(leaf)
                for cell, those in opened.items():
                    taken.append(i), cells.append(cell), leaves.append(those)
            chosen = batch.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*chosen.columns, pa.array(cells, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))],
                names=["key", "vector", "q", "cell", "leaves"])

    right = asked.select("key", "vector", block_of(F.col("key"), query_blocks, 2).alias("q")) \
        .mapInArrow(visit, "key long, vector array<double>, q int, cell int, leaves array<int>")
    # an array is looked up by place, so a row's cell costs the same for any number of leaves
    part = F.pmod(F.xxhash64(F.lit(1), "key"), F.get(F.lit(many), F.col("leaf")))
    left = index.select(
        "key", "vector", "leaf", (F.get(F.lit(first), F.col("leaf")) + part).cast("int").alias("cell"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"),
    )

    def compare(of_rows: pa.Table, of_queries: pa.Table) -> pa.Table:
        if not len(of_rows) or not len(of_queries):
            return found_batch([], [], [], pa.float64())
        keys, leaf, leaves = of_queries["key"].to_numpy(), of_rows["leaf"].to_numpy(), of_queries["leaves"].to_pylist()
        found, scores = top(
            of_rows["key"].to_numpy(), _matrix(of_rows["vector"], width), keys, _matrix(of_queries["vector"], width), k,
            lambda i: np.isin(leaf, leaves[i]))
        return found_batch(keys.tolist(), found, scores, pa.float64())

    cell = ["cell", "q"]
    return best(left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(compare, out), k)


def op7_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth embedding among all others."""
    rows = stored(sound(table(spark, sf_dir, "embeddings")), "tree-rows")
    return search(rows, rows.where(F.col("key") % 20 == 0))
