"""Vector codes: product quantisation with codebooks from dual-tree Lloyd rounds.

Vectors become integers and are cut into parts. Each position of a part has a codebook,
and a vector's code is the index of the nearest entry for each of its parts.

Rows are dealt into blocks. A block has a tree over its parts, for each position: nodes
with the box around their parts, and the sum of them, made once and stored. A codebook
has a tree over its entries, made anew in each round. A round walks both trees at a time.
For a pair of nodes the boxes bound the distances between their members; an entry node
that is further from a part node than some entry is at most is left out for all parts
below. Where one entry remains, the whole node is assigned, by its stored sum. What
is uncertain in a leaf is decided by the distances themselves. All numbers are
integers, so bounds, sums and ties are exact and do not depend on how rows are dealt.

A task sends the sums of what it has assigned to each entry, Spark adds them up, and
the driver receives a table of the codebooks' size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.common import pieces, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a block, parts in a leaf of its trees, and entries in one of a codebook's.
BLOCK, LEAF, ENTRY_LEAF = 2048, 32, 4
#: Integers are smaller than this in size, so that squared distances fit 64 bits.
LARGEST = 1 << 28


def bounds_of(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin and end among ``n`` members in tree order."""
    return np.arange((1 << level) + 1) * n >> level


class Boxes:
    """A complete tree over points: their order, and a box for each node by level.

    A level has twice as many nodes as the one above; node i has the children 2i and 2i + 1.
    """

    def __init__(self, order: np.ndarray, low: list[np.ndarray], high: list[np.ndarray]):
        self.order, self.low, self.high = order, low, high
        self.depth = len(low) - 1

    @classmethod
    def over(cls, points: np.ndarray, leaf: int) -> Boxes:
        n = len(points)
        depth = max(0, (n // leaf).bit_length() - 1)
        order = np.arange(n)
        for level in range(depth):
            ends, cuts = bounds_of(n, level), bounds_of(n, level + 1)
            for a, m, b in zip(ends[:-1].tolist(), cuts[1::2].tolist(), ends[1:].tolist()):
                mine = points[order[a:b]]
                widest = (mine.max(axis=0) - mine.min(axis=0)).argmax()
                order[a:b] = order[a:b][np.argpartition(mine[:, widest], m - a, kind="introselect")]
        begins = bounds_of(n, depth)[:-1]
        low = [np.minimum.reduceat(points[order], begins)]
        high = [np.maximum.reduceat(points[order], begins)]
        for _ in range(depth):
            low.insert(0, np.minimum(low[0][::2], low[0][1::2]))
            high.insert(0, np.maximum(high[0][::2], high[0][1::2]))
        return cls(order, low, high)


def _distances(low_a, high_a, low_b, high_b) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance between members of two boxes, pair by pair."""
    gap = np.maximum(np.maximum(low_b - high_a, low_a - high_b), 0)
    far = np.maximum(high_b - low_a, high_a - low_b)
    return (gap * gap).sum(axis=1), (far * far).sum(axis=1)


def walk(parts: Boxes, points: np.ndarray, entries: np.ndarray, tree: Boxes):
    """Nearest entry of each point: ``whole``, triples (level, node, entry) of nodes
    assigned as they are, and ``single``, for the points of the other leaves (in tree
    order) pairs (places, entries).

    ``points`` are in tree order. Ties go to the entry of the lower index.
    """
    m = len(entries)
    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    at, down, alone = 0, 0, False  # levels, and whether e are entries by now
    whole: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        low, high = (entries[e],) * 2 if alone else (tree.low[down][e], tree.high[down][e])
        near, far = _distances(parts.low[at][p], parts.high[at][p], low, high)
        best = np.full(1 << at, np.iinfo(np.int64).max)
        np.minimum.at(best, p, far)
        kept = near <= best[p]  # equal ones may be ties
        p, e = p[kept], e[kept]
        if alone:
            sure = np.bincount(p, minlength=1 << at)[p] == 1
            if sure.any():
                whole.append((np.full(sure.sum(), at), p[sure], e[sure]))
                p, e = p[~sure], e[~sure]
            if not len(p) or at == parts.depth:
                break
        if at < parts.depth:
            p, e, at = np.concatenate([2 * p, 2 * p + 1]), np.concatenate([e, e]), at + 1
        if down < tree.depth:
            p, e, down = np.concatenate([p, p]), np.concatenate([2 * e, 2 * e + 1]), down + 1
        elif not alone:
            cuts = bounds_of(m, tree.depth)
            sizes = np.diff(cuts)[e]
            first = np.repeat(cuts[e] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
            p, e, alone = np.repeat(p, sizes), tree.order[first + np.arange(sizes.sum())], True
    single = []
    if len(p):
        order = np.lexsort((e, p))
        p, e = p[order], e[order]
        ends, squares = bounds_of(len(points), at), (entries * entries).sum(axis=1)
        begins = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(p)]):
            some, mine = e[a:b], np.arange(ends[p[a]], ends[p[a] + 1])
            away = squares[some] - 2 * (points[mine] @ entries[some].T)
            single.append((mine, some[away.argmin(axis=1)]))
    return whole, single


@dataclass
class Block:
    """Rows of a block and its trees, by position: points in tree order, node sums."""

    n: int
    trees: list[Boxes]
    points: list[np.ndarray]
    sums: list[list[np.ndarray]]

    @classmethod
    def over(cls, vectors: np.ndarray, parts: int, leaf: int = LEAF) -> Block:
        out = cls(len(vectors), [], [], [])
        for cut in np.split(vectors, parts, axis=1):
            tree = Boxes.over(cut, leaf)
            points = cut[tree.order]
            sums = [np.add.reduceat(points, bounds_of(len(points), level)[:-1]) for level in range(tree.depth + 1)]
            out.trees.append(tree), out.points.append(points), out.sums.append(sums)
        return out

    def flat(self) -> list[np.ndarray]:
        """Orders, points, boxes and sums, each as one array for a column."""
        join = lambda lists: np.concatenate([x.ravel() for part in lists for x in part])
        return [
            np.concatenate([t.order for t in self.trees]), np.concatenate([x.ravel() for x in self.points]),
            join([t.low for t in self.trees]), join([t.high for t in self.trees]), join(self.sums),
        ]

    @classmethod
    def of(cls, parts: int, width: int, order, points, low, high, sums) -> Block:
        n = len(order) // parts
        nodes = len(low) // (parts * width)
        cuts = [(1 << level) - 1 for level in range(1, nodes.bit_length())]
        levels = lambda x: [np.split(part, cuts[:-1]) for part in x.reshape(parts, nodes, width)]
        lows, highs = levels(low), levels(high)
        trees = [Boxes(o, a, b) for o, a, b in zip(order.reshape(parts, n), lows, highs)]
        return cls(n, trees, list(points.reshape(parts, n, width)), levels(sums))

    def collect(self, books: np.ndarray, roots: list[Boxes]) -> np.ndarray:
        """By part, entry and place the sum of what is nearest to the entry, and the count."""
        parts, entries, width = books.shape
        out = np.zeros((parts, entries, width + 1), np.int64)
        for k in range(parts):
            whole, single = walk(self.trees[k], self.points[k], books[k], roots[k])
            for level, node, entry in whole:
                level = int(level[0])
                np.add.at(out[k, :, :width], entry, self.sums[k][level][node])
                np.add.at(out[k, :, width], entry, np.diff(bounds_of(self.n, level))[node])
            for places, entry in single:
                np.add.at(out[k, :, :width], entry, self.points[k][places])
                np.add.at(out[k, :, width], entry, 1)
        return out

    def codes(self, books: np.ndarray, roots: list[Boxes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry by row and part, and squared distances by row."""
        found, error = np.zeros((self.n, len(books)), np.uint8), np.zeros(self.n, np.int64)
        for k in range(len(books)):
            nearest = np.zeros(self.n, np.int64)
            whole, single = walk(self.trees[k], self.points[k], books[k], roots[k])
            for level, node, entry in whole:
                ends = bounds_of(self.n, int(level[0]))
                for a, b, x in zip(ends[node].tolist(), ends[node + 1].tolist(), entry.tolist()):
                    nearest[a:b] = x
            for places, entry in single:
                nearest[places] = entry
            away = self.points[k] - books[k][nearest]
            found[self.trees[k].order, k] = nearest
            error[self.trees[k].order] += (away * away).sum(axis=1)
        return found, error


_NUMBERS = ("order", "points", "low", "high", "sums")


def _forest(rows: DataFrame, parts: int, block: int, leaf: int) -> DataFrame:
    """Blocks of rows: ``rows`` and the five arrays of their trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(some).combine_chunks()
            vectors = whole.column(1).chunk(0).flatten().to_numpy().reshape(whole.num_rows, -1).astype(np.int64)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            kept = one(whole.column(0).chunk(0))
            return pa.RecordBatch.from_arrays(
                [kept, *[one(pa.array(x, pa.int64())) for x in Block.over(vectors, parts, leaf).flat()]], names=["rows", *_NUMBERS])

        waiting, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block - n)
                waiting.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n == block:
                    yield made(waiting)
                    waiting, n = [], 0
        if n:
            yield made(waiting)

    numbers = T.ArrayType(T.LongType())
    kept = rows.schema["row"].dataType
    out = T.StructType([T.StructField("rows", T.ArrayType(kept)), *[T.StructField(x, numbers) for x in _NUMBERS]])
    return rows.select("row", "ints").mapInArrow(run, out)


def _blocks(batch: pa.RecordBatch, parts: int, width: int) -> Iterator[tuple[pa.Array, Block]]:
    """Rows and trees of each block; the five arrays are the last columns."""
    for i in range(batch.num_rows):
        arrays = [c[i].values.to_numpy() for c in batch.columns[-5:]]
        yield batch.column(0)[i].values if batch.num_columns > 5 else None, Block.of(parts, width, *arrays)


def _roots(books: np.ndarray) -> list[Boxes]:
    return [Boxes.over(book, ENTRY_LEAF) for book in books]


def _improved(forest: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of its parts' mean."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, roots = np.zeros((parts, entries, width + 1), np.int64), _roots(books)
        for batch in pieces(batches, 8):
            for _, block in _blocks(batch, parts, width):
                total += block.collect(books, roots)
        used = np.broadcast_to(total[:, :, width:] > 0, total.shape)
        slots = np.flatnonzero(used.ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(slots, pa.int32()), pa.array(total.ravel()[slots], pa.int64())], names=["slot", "total"])

    # one number for each place of the codebooks, however many rows there are
    found = forest.select(*_NUMBERS).mapInArrow(run, "slot int, total long").groupBy("slot").agg(F.sum("total")).collect()
    total = np.zeros(parts * entries * (width + 1), np.int64)
    for slot, n in found:
        total[slot] = n
    total = total.reshape(parts, entries, width + 1)
    count = total[:, :, width:]
    return np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), books)


def integers(vectors: DataFrame, vector: str, scale: int = SCALE) -> F.Column:
    """``floor(scale * x)`` of each component as longs."""
    return F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("long"))


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", carry: tuple[str, ...] = (),
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    block: int = BLOCK, leaf: int = LEAF,
) -> tuple[DataFrame, np.ndarray]:
    """``row, code, error`` for each vector, and the codebooks (part, entry, place).

    ``row`` is a struct of the key and the columns in ``carry``, so that no name can
    clash; others are not read. Vectors that are null or hold a null or non-finite
    component are left out. A code has two hex digits for each part; the error is the
    squared distance to what it decodes to, in units of ``1 / scale ** 2``.

    All vectors must have one length that ``parts`` divides: the most frequent one (the
    longer of two) counts. Rows of another length, empty ones too, and those with a
    component of ``LARGEST / scale`` or more in size get a null code and error. Entries
    start from the rows of the smallest keys (null is the largest, rows of one key by
    their vectors); with fewer rows there are fewer entries. Of equal entries the lower
    index is taken; entries without parts stay as they are. Repeated rows count each. An empty table
    gives an empty one, and codebooks without entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(vector).isNotNull()).where(sound) \
        .select(F.struct(key, *[c for c in carry if c != key]).alias("row"), integers(vectors, vector, scale).alias("ints"))
    small = F.forall("ints", lambda x: F.abs(x) < LARGEST) & (F.size("ints") % parts == 0) & (F.size("ints") > 0)
    rows = stored(rows.withColumn("small", small), "codes-rows")
    lengths = rows.where("small").groupBy(F.size("ints").alias("length")).agg(F.count("*").alias("n")) \
        .orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    kept = rows.schema["row"].dataType
    nothing = F.lit(None)
    if not lengths:
        return rows.select("row", nothing.cast("string").alias("code"), nothing.cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    fits = F.col("small") & (F.size("ints") == lengths[0].length)
    width = lengths[0].length // parts
    first = rows.where(fits).orderBy(F.col("row")[key].asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    books = np.array([r[0] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    forest = stored(_forest(rows.where(fits), parts, block, leaf), "codes-forest")
    for _ in range(rounds):
        books = _improved(forest, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = _roots(books)
        for batch in pieces(batches, 8):
            for own, block in _blocks(batch, parts, width):
                found, error = block.codes(books, roots)
                digits = found.tobytes().hex()
                codes = [digits[i:i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=["row", "code", "error"])

    out = T.StructType([
        T.StructField("row", kept), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    codes = forest.select("rows", *_NUMBERS).mapInArrow(run, out)
    odd = rows.where(~fits).select("row", nothing.cast("string").alias("code"), nothing.cast("long").alias("error"))
    return codes.unionByName(odd), books


def decode(codes: DataFrame, books: np.ndarray, code: str = "code", out: str = "vector", scale: int = SCALE) -> DataFrame:
    """All columns, and the vector that each code stands for as ``out``; null for null."""

    @F.pandas_udf("array<double>")
    def vector_of(series):
        def one(text):
            if text is None:
                return None
            return np.concatenate([book[i] for book, i in zip(books, bytes.fromhex(text))]) / scale

        return series.map(one)

    return codes.withColumn(out, vector_of(F.col(code)))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place, with commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every embedding, and the errors of its label together."""
    codes, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), carry=("label",))
    codes = stored(codes.select("row.vec_id", "row.label", "code", "error"), "codes")
    of_label = codes.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    return codes.join(of_label, F.col("label").eqNullSafe(F.col("same"))) \
        .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same for DuckDB: every round compares all parts with all entries. Whole
    numbers in doubles are exact here; an entry's index is the rest of distance times
    ``entries``, so that the least of them has the lower index."""
    steps = [f"""kept AS (
    SELECT vec_id, label, len(embedding) // {parts} AS w,
           [floor({scale} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), cut AS MATERIALIZED (
    SELECT vec_id, label, p, w, v[p * w + 1:p * w + w] AS x FROM kept, range({parts}) t(p)
), books0 AS MATERIALIZED (
    SELECT p, e, x AS c
    FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM cut) r WHERE e < {entries}
)"""]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
    SELECT vec_id, label, p, w, x, CAST(best % {entries} AS BIGINT) AS e, CAST(best // {entries} AS BIGINT) AS away
    FROM (SELECT vec_id, label, cut.p, w, x, CAST(min((list_dot_product(x, x) - 2 * list_dot_product(x, c)
                 + list_dot_product(c, c)) * {entries} + e) AS BIGINT) AS best
          FROM cut JOIN books{k} b ON cut.p = b.p GROUP BY ALL) m
)""")
        if k < rounds:
            steps.append(f"""books{k + 1} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(n.c, b.c) AS c
    FROM books{k} b LEFT JOIN (
        SELECT p, e, list(f ORDER BY j) AS c
        FROM (SELECT p, e, j, floor(sum(x[j]) / count(*)) AS f FROM near{k}, unnest(range(1, w + 1)) t(j) GROUP BY p, e, j) g
        GROUP BY p, e) n ON b.p = n.p AND b.e = n.e
)""")
    return "WITH " + ", ".join(steps) + f""", coded AS (
    SELECT vec_id, label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(away) AS BIGINT) AS error
    FROM near{rounds} GROUP BY vec_id, label
), book AS (
    SELECT sha256(string_agg(CAST(CAST(c[j] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256
    FROM books{rounds}, unnest(range(1, len(c) + 1)) t(j)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, book"""


OP11_SQL = _sql()
