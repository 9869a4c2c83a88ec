"""Vector codes against Lloyd rounds by plain loops, and against SQL."""

import random

import compare
import numpy as np
import pytest

from tallywright.llm import vector_codes as V
from tallywright.llm.queries import LLM_QUERIES, LLM_SQL

SCHEMA = "vec_id long, embedding array<double>, label int, row int, code int, ints int, small int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, 2, 3, 4) for i, v, l in rows], SCHEMA)


def lloyd(rows, parts, entries, rounds, scale):
    """``[(key, code, error)]`` in order of the rows, and the codebooks."""
    whole = [(k, [int(np.floor(scale * x)) for x in v]) for k, v in rows]
    w = len(whole[0][1]) // parts
    cut = [(k, [v[p * w:(p + 1) * w] for p in range(parts)]) for k, v in whole]
    first = sorted(cut, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[list(r[1][p]) for r in first] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min(range(len(books[p])), key=lambda e: (away(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, r in cut:
                of.setdefault(near(p, r[p]), []).append(r[p])
            for e, mine in of.items():
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for k, r in cut:
        code = [near(p, r[p]) for p in range(parts)]
        out.append((k, "".join(f"{c:02x}" for c in code), sum(away(r[p], books[p][c]) for p, c in enumerate(code))))
    return out, books


@pytest.mark.parametrize("kind", ["spread", "clusters", "ties"])
@pytest.mark.parametrize("leaf, block", [(1, 7), (32, 2048)])
def test_codes_equal_plain_loops(spark, kind, leaf, block):
    """Deep and shallow trees, one block and many."""
    r = random.Random(3)
    centres = [[r.uniform(-1, 1) for _ in range(8)] for _ in range(5)]
    value = {
        "spread": lambda i, j: r.uniform(-1, 1), "clusters": lambda i, j: centres[i % 5][j] + r.uniform(-0.02, 0.02),
        "ties": lambda i, j: float(r.choice([0, 0, 1, 2])),
    }[kind]
    rows = [(i * 3, [value(i, j) for j in range(8)]) for i in range(220)]
    want, books = lloyd(rows, 4, 20, 3, 64)
    codes, found = V.compress(frame(spark, [(k, v, 0) for k, v in rows]).repartition(3), entries=20, rounds=3, scale=64, block=block, leaf=leaf)
    assert found.tolist() == books
    assert sorted((c.row.vec_id, c.code, c.error) for c in codes.collect()) == sorted(want)


def test_pruning_decides_whole_nodes():
    """Far clusters: nodes are assigned whole, by their sums, and nothing is left single."""
    points = np.concatenate([np.arange(64).reshape(-1, 2) % 3 + 10_000 * k for k in range(8)]).astype(np.int64)
    block = V.Block.over(np.tile(points, (1, 4)), 4)
    books = np.array([[[10_000 * k] * 2 for k in range(8)]] * 4)
    whole, single = V.walk(block.trees[0], block.points[0], books[0], V._roots(books)[0])
    assert single == [] and sum(len(nodes) for _, nodes, _ in whole) == 8
    out = block.collect(books, V._roots(books))
    assert out[:, :, -1].tolist() == [[32] * 8] * 4
    again = V.Block.of(4, 2, *block.flat())
    assert (again.collect(books, V._roots(books)) == out).all() and again.n == block.n


def test_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(None, [1.0, 2.0, 3.0, 4.0]), (5, [0.5, 0.5, 0.5, 0.5]), (5, [0.5, 0.5, 0.5, 0.5]), (5, [0.25, 0.5, 0.5, 0.5]), (7, [-0.0001, 0.0, 0.0, 0.0])]
    odd = [(1, []), (2, [1.0, 2.0]), (3, [1e300, 0.0, 0.0, 0.0]), (4, [1.0] * 8)]
    gone = [(8, None), (9, [1.0, None, 2.0, 3.0]), (10, [inf, 0.0, 0.0, 0.0]), (11, [nan, 0.0, 0.0, 0.0])]
    rows = frame(spark, [(k, v, None if i % 2 else 1) for i, (k, v) in enumerate(good + odd + gone)])
    codes, books = V.compress(rows, carry=("label", "row", "code", "ints"))
    got = codes.collect()
    want, plain = lloyd(good, 4, 256, 4, 1024)
    order = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.row.vec_id, r.code, r.error) for r in got if r.code is not None], key=order) == sorted(want, key=order)
    assert books.tolist() == plain
    assert sorted(r.row.vec_id for r in got if r.code is None) == [1, 2, 3, 4]
    assert {(r.row.row, r.row.code, r.row.ints) for r in got} == {(1, 2, 3)}
    back = {r.row.vec_id: r.vector for r in V.decode(codes, books).collect()}
    assert back[2] is None and len(back[7]) == 4
    nothing, none = V.compress(rows.limit(0))
    assert nothing.count() == 0 and none.size == 0
    alone, _ = V.compress(rows.where("vec_id = 2"))
    assert [(r.code, r.error) for r in alone.collect()] == [(None, None)]


def test_decoded_vectors_are_as_far_as_the_error_says(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    codes, books = V.compress(rows)
    of = {r.vec_id: np.floor(1024 * np.array(r.embedding, np.float64)) for r in rows.collect()}
    for r in V.decode(codes, books).collect():
        assert ((of[r.row.vec_id] - 1024 * np.array(r.vector)) ** 2).sum() == r.error


def test_op11_equals_its_sql(spark, folder):
    assert compare.differences(LLM_QUERIES["op11_vector_codes"](spark, folder), compare.connect(folder), LLM_SQL["op11_vector_codes"]) == ""


def test_op11_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = V.op11_vector_codes(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
