from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

from shelfmark.llm import whitening as op

ROOT = "/root/testdata/sf0.01"


def usable(vector):
    return vector is not None and len(vector) > 0 and all(c is not None and math.isfinite(c) for c in vector)


def brute(rows):
    """n, deviations by vector, eigenvalues and eigenvectors, with Python's whole numbers and one matrix."""
    vectors = {tuple(math.floor(64 * float(c)) + 1_000_000 for c in v): None for _, v in rows if usable(v)}
    fit = list(vectors)
    n = len(fit)
    sums = [sum(column) for column in zip(*fit, strict=True)]
    deviation = {x: sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for x in fit}
    moved = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    values, axes = np.linalg.eigh(moved.T @ moved / n)
    return n, deviation, values[::-1], axes[:, ::-1], dict(zip(fit, moved, strict=True))


def collected(found):
    by_row = defaultdict(list)
    for r in found.orderBy("vec_id", "component").collect():
        by_row[r["vec_id"]].append(r)
    return by_row


def check(found, rows):
    n, deviation, values, axes, moved = brute(rows)
    width = min(16, len(values))
    by_id = defaultdict(list)
    for key, vector in rows:
        if usable(vector):
            by_id[key].append(tuple(math.floor(64 * float(c)) + 1_000_000 for c in vector))
    got = collected(found)
    assert set(got) == set(by_id)
    signs = None
    for key, xs in by_id.items():
        assert len(got[key]) == width * len(xs)
        if len(xs) > 1:
            continue
        mine = got[key]
        assert [r["component"] for r in mine] == list(range(1, width + 1))
        assert {(r["n"], r["deviation"]) for r in mine} == {(n, deviation[xs[0]])}
        expected = moved[xs[0]] @ axes[:, :width] / np.sqrt(values[:width])
        values_here = np.array([r["whitened"] for r in mine])
        if signs is None:
            signs = np.sign(values_here * expected)  # an axis may point either way, for all rows the same
        np.testing.assert_allclose(values_here * signs, expected, atol=1e-8)
        np.testing.assert_allclose([r["explained"] for r in mine], values[:width] / values.sum(), rtol=1e-9)
    errors = {r["identity_error"] for mine in got.values() for r in mine}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{ROOT}/embeddings.parquet").collect()]
    check(op.op12_embedding_whitening(spark, ROOT), rows)


def frame(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<double>, x string, number int")


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_ROWS", 7)
    rnd = np.random.default_rng(4)
    good = [(k, (rnd.normal(size=5) * [3, 2, 1, 0.5, 0.2]).tolist()) for k in range(60)]
    odd = [(100, None), (101, [0.1, None, 0.2, 0.3, 0.4]), (102, [0.1, math.nan, 0.2, 0.3, 0.4]), (103, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    others = [(104, []), (105, [1.0, 2.0])]
    again = [(200 + k, good[0][1]) for k in range(300)] + [good[3], good[3], (None, good[4][1])]
    rows = good + again
    check(op.whitened(frame(spark, rows + odd + others)), rows)


def test_empty_tables(spark):
    for rows in ([], [(1, None), (2, [])]):
        found = op.whitened(frame(spark, rows))
        assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert found.count() == 0


def test_without_variance(spark):
    got = collected(op.whitened(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])))
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got[1]] == [(1, 0, 0.0, 0.0, 0.0)] * 2
    # The second dimension follows the first, so there is one component only.
    line = collected(op.whitened(frame(spark, [(k, [float(k), 2.0 * k]) for k in range(9)])))
    for key, mine in line.items():
        first, second = mine
        assert second["whitened"] == 0.0 and second["explained"] == 0.0 and abs(first["explained"] - 1) < 1e-12
        assert abs(abs(first["whitened"]) - abs(key - 4) / math.sqrt(60 / 9)) < 1e-9
    assert line[0][0]["identity_error"] < 1e-9


def test_far_values_are_cut_off_and_stay_exact(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0]), (4, [1.0, 3.0])]
    got = collected(op.whitened(frame(spark, rows)))
    assert all(mine[0]["n"] == 4 for mine in got.values())
    # 4 * 2 ** 52, squared, is more than a long holds.
    assert got[1][0]["deviation"] is None and got[2][0]["deviation"] is None
    big = 2**52
    xs = [[big, 64], [-big, 64], [0, 128], [64, 192]]
    sums = [sum(c) for c in zip(*xs, strict=True)]
    assert got[3][0]["deviation"] == sum((4 * c - s) ** 2 for c, s in zip(xs[2], sums, strict=True))


@pytest.mark.parametrize("parts", [1, 5])
def test_scatter_is_the_same_however_it_is_cut(spark, parts):
    values = np.random.default_rng(9).integers(-50, 50, size=(50, 3))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(values)], "number long, x array<long>")
    fit = op.Fit.of(rows)
    assert (fit.n, fit.sums) == (50, tuple(values.sum(axis=0).tolist()))
    moved = values - values.mean(axis=0)
    matrix = op.blocks(rows, fit, block_rows=8)
    assert (matrix.numRowBlocks, matrix.numRows(), matrix.numCols()) == (7, 50, 3)
    np.testing.assert_allclose(matrix.toLocalMatrix().toArray(), moved, atol=1e-12)
    np.testing.assert_allclose(op.scatter(matrix, parts), moved.T @ moved, atol=1e-9)
    back = {r["number"]: r["values"] for r in op.rows_of(spark, matrix).collect()}
    np.testing.assert_allclose([back[k] for k in range(50)], moved, atol=1e-12)
