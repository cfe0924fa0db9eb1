import random

import numpy as np
import pytest

from chronoweave.llm import whitening
from chronoweave.llm.queries import QUERIES


def plainly(rows, k=16):
    """Fit and whitened rows by numpy's own eigenvalues, deviations with Python's whole numbers."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    q = [[int(np.floor(64 * float(c))) for c in v] for _, v in kept]
    x = np.array(sorted({tuple(r) for r in q}), np.float64)
    n, sums = len(x), [sum(c) for c in zip(*{tuple(r) for r in q})]
    y = x - x.mean(axis=0)
    values, units = np.linalg.eigh(y.T @ y / n)
    values, units = values[::-1], units[:, ::-1].T
    rank = int((values > 1e-12 * values[0]).sum()) if values[0] > 0 else 0
    k = min(k, rank)
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in q]
    white = (np.array(q) - x.mean(axis=0)) @ units[:k].T / np.sqrt(values[:k])
    return [i for i, _ in kept], n, deviation, white, values[:k] / values.sum()


def agree(rows, got, tolerance=1e-7):
    ids, n, deviation, white, explained = plainly(rows)
    k = white.shape[1]
    assert len(got) == len(ids) * k
    by_row = {}
    for r in got:
        assert r.n == n and r.identity_error <= 1e-6
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-8
        by_row.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    for c in range(k):
        signs = set()
        for i, d, w in zip(ids, deviation, white):
            found = by_row[i, d][c + 1]
            near = min(found, key=lambda f: min(abs(f - w[c]), abs(f + w[c])))
            assert min(abs(near - w[c]), abs(near + w[c])) < tolerance
            if abs(w[c]) > 0.01:
                signs.add(near * w[c] > 0)
        assert len(signs) == 1


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, v, 1, b"x", 2) for i, v in rows], "vec_id long, embedding array<float>, label int, x binary, dim int"
    )


def mixed(n=400, dim=20, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) * np.logspace(0, -1, dim)
    return [(i, v) for i, v in enumerate(base.astype(np.float32).tolist())]


def test_factor_and_rotations_equal_numpy():
    rng = np.random.default_rng(3)
    for d, r in ((1, 1), (2, 2), (5, 5), (9, 4), (40, 40), (33, 7)):
        b = rng.normal(size=(d, r)) * np.logspace(0, -3, r)
        a = b @ b.T
        factor = whitening.pivoted_cholesky(a)
        assert factor.shape == (d, r) and np.abs(factor @ factor.T - a).max() < 1e-12 * np.abs(a).max()
        values, units = whitening.one_sided_jacobi(factor)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:r], rtol=1e-9, atol=1e-14)
        assert np.abs(units @ units.T - np.eye(r)).max() < 1e-12
        assert np.abs(units @ a - values[:, None] * units).max() < 1e-12 * values[0]
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_packed_vectors_come_back():
    import pyarrow as pa

    rows = np.array([[0, 1, -1], [127, -128, 0], [128, 0, 0], [0, -129, 5], [40000, 0, 1], [-(1 << 31), 1 << 31, 0]])
    packed = whitening._pack(rows)
    assert [r[0] for r in packed] == [1, 1, 2, 2, 4, 8]
    assert (whitening._unpack(pa.array(packed, pa.binary()), 3) == rows).all()


def test_rows_equal_numpy(spark):
    rows = mixed()
    rows += [(7, rows[7][1]), (None, rows[9][1]), (500, rows[0][1])] * 3  # copies count once in the fit
    rows += [(600, None), (601, []), (602, [float("nan")] * 20), (603, [None] + [0.5] * 19), (604, [float("inf")] + [0.1] * 19), (605, [0.1] * 19)]
    got = whitening.whiten(frame(spark, rows).repartition(7)).collect()
    agree([r for r in rows if r[0] != 605], got)
    assert {r.component for r in got} == set(range(1, 17))


@pytest.mark.parametrize("rank", [1, 3])
def test_as_many_components_as_rank(spark, rank):
    rng = np.random.default_rng(4)
    base = rng.integers(-3, 4, size=(200, rank)) @ rng.integers(-2, 3, size=(rank, 8)) / 64
    rows = [(i, v) for i, v in enumerate(base.tolist())]
    got = whitening.whiten(frame(spark, rows)).collect()
    agree(rows, got)
    assert max(r.component for r in got) == np.linalg.matrix_rank(base)


def test_without_spread_there_are_no_rows(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [0.5, 0.25])] * 4)).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0


def test_great_entries(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-1e30, 3.0, 1e5]), rnd.random(), 0.0]) for i in range(50)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 50 and all(r.component == 1 and (r.deviation is None or r.deviation >= 0) for r in got)


def test_query_equals_numpy_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    agree(rows, QUERIES["op12_embedding_whitening"](spark, sf).collect())
