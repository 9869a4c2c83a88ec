"""Exact top-k search by term-at-a-time accumulation.

Rows are sparse: terms with weights. A block of rows is turned into postings, for
each term the rows that have it and their weights. For a query the postings of its
terms are scattered, times the query's weight, into a dense array with a score for
each row of the block; a partition selection takes the k best of the block, and
those of all blocks are merged. Every row of every block has a score, so nothing
is left out.

Rows are dealt into blocks of bounded size by a hash of the id, and so are
queries; a task has one block of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import stored, table
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


class Postings:
    """Postings of a block's rows, which are in order of their ids."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, weights: np.ndarray, offsets: np.ndarray):
        self.ids = ids
        rows = np.repeat(np.arange(len(ids)), np.diff(offsets))
        order = np.lexsort((rows, terms))
        self.rows, self.weights = rows[order], weights[order]
        self.terms, begins = np.unique(terms[order], return_index=True)
        self.bounds = np.append(begins, len(rows))

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.ids), np.int64)
        at = np.searchsorted(self.terms, terms)
        for term, weight, k in zip(terms.tolist(), weights.tolist(), at.tolist()):
            if k < len(self.terms) and self.terms[k] == term:
                a, b = self.bounds[k], self.bounds[k + 1]
                rows = self.rows[a:b]
                if b - a == len(out) and rows[0] == 0 and rows[-1] == len(out) - 1:
                    out += weight * self.weights[a:b]  # every row has the term
                else:
                    out[rows] += weight * self.weights[a:b]
        return out


def select(scores: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores but ``own`` (ascending places to be left out),
    ties to the smaller place."""
    places = np.arange(len(scores)) if not len(own) else np.delete(np.arange(len(scores)), own)
    if len(places) > k:
        of = scores[places]
        limit = np.partition(of, len(of) - k)[len(of) - k]
        above = places[of > limit]
        places = np.concatenate([above, places[of == limit][:k - len(above)]])
    return places[np.lexsort((places, -scores[places]))]


def search(rows: DataFrame, queries: DataFrame, k: int = TOP, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the k rows of the largest
    inner product, all if there are fewer, ties to the smaller id.

    Both frames have ``key`` (long), ``terms`` (array of ints, each once in a row) and
    ``weights`` (array of longs). Rows of the query's own key are left out. Rows without
    terms have score 0. Sums are 64-bit integers. Equal rows tie. Rows of one key
    beyond the first are candidates of their own, queries of one key are one query. Empty
    tables give an empty result.
    """
    counted = rows.count(), queries.count()
    parts = [blocks_for(counted[0], row_block), blocks_for(counted[1], query_block)]
    # each block of rows meets each block of queries once: cell = row block, query block
    left = rows.select(
        "key", "terms", "weights", block_of(F.col("key"), parts[0], 1).alias("b"),
        F.explode(F.sequence(F.lit(0), F.lit(parts[1] - 1))).alias("q"))
    right = queries.dropDuplicates(["key"]).select(
        "key", "terms", "weights", block_of(F.col("key"), parts[1], 2).alias("q"),
        F.explode(F.sequence(F.lit(0), F.lit(parts[0] - 1))).alias("b"))

    def compare(of_rows: pa.Table, of_queries: pa.Table) -> pa.Table:
        of_rows = of_rows.sort_by("key")
        ids = of_rows["key"].to_numpy()
        terms, offsets = lists(of_rows["terms"])
        postings = Postings(ids, terms, lists(of_rows["weights"])[0], offsets)
        terms, offsets = lists(of_queries["terms"])
        weights = lists(of_queries["weights"])[0]
        keys, found, scores = of_queries["key"].to_pylist(), [], []
        if len(ids):
            for key, a, b in zip(keys, offsets[:-1].tolist(), offsets[1:].tolist()):
                got = postings.scores(terms[a:b], weights[a:b])
                own = np.arange(np.searchsorted(ids, key), np.searchsorted(ids, key, "right"))
                places = select(got, own, k)
                found.append(ids[places]), scores.append(got[places])
        return found_batch(keys if len(ids) else [], found, scores, pa.int64())

    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")) \
        .applyInArrow(compare, "query_id long, ids array<long>, scores array<long>")
    return best(found, k)


def as_terms(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """Dense vectors as sparse rows: each component's place, with floor(scale times
    it) as weight; zero weights are left out."""
    floors = F.transform("vector", lambda x, i: F.struct(
        i.cast("int").alias("t"), F.floor(x * F.lit(scale)).cast("long").alias("w")))
    kept = F.filter(floors, lambda e: e["w"] != 0)
    return vectors.select("key", kept.alias("e")).select("key", F.col("e.t").alias("terms"), F.col("e.w").alias("weights"))


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth embedding against all others."""
    rows = stored(as_terms(sound(table(spark, sf_dir, "embeddings"))), "exact-rows")
    return search(rows, rows.where(F.col("key") % 20 == 0))


#: The same for DuckDB. Sums of whole doubles are exact here.
OP1_SQL = """
WITH sound AS (
    SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.w, v.w) AS BIGINT) AS score
    FROM sound q JOIN sound v ON q.vec_id <> v.vec_id
    WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT query_id, vec_id, score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
    FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
