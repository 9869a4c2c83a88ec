"""Cells of the search tree's leaves, and that they decide nothing about what is found."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tallywright.llm import tree_search

VECTORS = "key long, vector array<double>"


@given(st.lists(st.integers(0, 40), min_size=1, max_size=30), st.integers(1, 25))
def test_cells_are_bounded_and_apart(counts, size):
    first, many = tree_search.cells_of({i: n for i, n in enumerate(counts) if n}, len(counts), size)
    rows, alone = {}, set()
    for n, cell, parts in zip(counts, first, many):
        if not n:
            continue  # neither rows nor queries go to an empty leaf
        assert cell >= 0
        assert parts == max(1, -(-n // size))
        if parts > 1:
            mine = set(range(cell, cell + parts))
            assert not mine & (alone | rows.keys())
            alone |= mine
        else:
            assert cell not in alone
            rows[cell] = rows.get(cell, 0) + n
    assert all(n <= size for n in rows.values())
    # no two cells that follow each other would fit into one
    small = [rows[c] for c in sorted(rows)]
    assert alone or all(a + b > size for a, b in zip(small, small[1:]))


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 6))
    points = middles[rng.integers(0, 12, 900)] + rng.normal(scale=0.2, size=(900, 6))
    points[:300] = points[0]  # a third of all rows is one vector
    return spark.createDataFrame([(i, p) for i, p in enumerate(points.tolist())], VECTORS)


def test_cells_of_any_size_find_the_same(clustered):
    asked = clustered.where("key % 20 = 0")
    found = [
        sorted(map(tuple, tree_search.search(clustered, asked, 10, row_block=size, query_block=queries).collect()))
        for size, queries in [(10_000, 10_000), (70, 10_000), (25, 16)]
    ]
    assert len(found[0]) == 45 * 10
    assert found[0] == found[1] == found[2]


def test_a_query_goes_to_the_rows_of_its_leaves_only():
    rows = np.array([[1.0], [5.0], [3.0], [4.0]])
    ids, keys, queries = np.array([10, 11, 12, 13]), np.array([0, 13]), np.array([[1.0], [1.0]])
    masks = [np.array([True, False, True, True]), np.array([False, True, False, True])]
    found, scores = tree_search.top(ids, rows, keys, queries, 2, masks.__getitem__)
    assert [f.tolist() for f in found] == [[13, 12], [11]]
    assert [s.tolist() for s in scores] == [[4.0, 3.0], [5.0]]
