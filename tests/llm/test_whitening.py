import numpy as np
import pytest

from tests.llm import edge
from tidewater.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def dense(rows):
    """Whole numbers, covariance and its eigenpairs, falling, by NumPy."""
    x = np.floor(64 * np.array(rows, dtype=np.float32).astype(float)) + 1_000_000
    cov = np.cov(x.T, bias=True).reshape(x.shape[1], x.shape[1])
    e, u = np.linalg.eigh(cov)
    return x, cov, e[::-1], u[:, ::-1]


@pytest.mark.parametrize("d,wanted", [(1, 1), (7, 32), (64, 32), (150, 20), (400, 3)])
def test_solver_against_numpy(d, wanted):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((600, d)) * np.linspace(1, 1.4, d)
    v = x.T @ x / 600
    e, u = W.jacobi_davidson(lambda q: v @ q, d, wanted)
    k = min(d, wanted)
    assert u.shape == (d, k) and np.allclose(e, np.linalg.eigvalsh(v)[::-1][:k], rtol=1e-12)
    assert np.abs(u.T @ u - np.eye(k)).max() < 1e-12 and np.linalg.norm(v @ u - u * e, axis=0).max() < 1e-11


def test_equal_eigenvalues_and_low_rank():
    v = np.diag([5.0, 5, 5, 2, 2, *[0] * 60])
    e, u = W.jacobi_davidson(lambda q: v @ q, 65, 8)
    assert np.allclose(e, [5, 5, 5, 2, 2, 0, 0, 0], atol=1e-12) and np.abs(u.T @ u - np.eye(8)).max() < 1e-12


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    q = np.linalg.qr(rng.standard_normal((12, 2)))[0]
    r = rng.standard_normal((12, 2))
    r -= q @ (q.T @ r)
    t = W.minres(lambda x: a @ x, q, np.array([0.3, -0.4]), r, 10)
    p = np.eye(12) - q @ q.T
    for j, s in enumerate((0.3, -0.4)):
        assert np.allclose(p @ (a - s * np.eye(12)) @ t[:, j], r[:, j], atol=1e-8) and np.abs(q.T @ t[:, j]).max() < 1e-10


def test_against_brute_force_with_awkward_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.standard_normal(40).astype(np.float32).tolist(), 0) for i in range(300)] + [(5, [0.5] * 40, 1), (5, [0.5] * 40, 1), (None, [1.0] * 40, None)]
    bad = [(900, None, 0), (901, [1.0] * 39 + [None], 0), (902, [float("nan")] + [1.0] * 39, 0), (903, [float("inf")] * 40, 0), (904, [], 0)]
    df = edge.with_clashes(spark.createDataFrame(good + bad, SCHEMA).repartition(5)).withColumnRenamed("n", "component")
    out = edge.collected(W.whiten(df))
    x, cov, e, u = dense([r[1] for r in good])
    n, s = len(x), x.sum(axis=0)
    assert len(out) == 32 * n and {r["n"] for r in out} == {n} and {r["component"] for r in out} == set(range(1, 33))
    assert not {r["vec_id"] for r in out} & {900, 901, 902, 903, 904}
    w = (x - s / n) @ (u[:, :32] / np.sqrt(e[:32]))
    at = {r[0]: i for i, r in enumerate(good)}
    got = {(r["vec_id"], r["component"]): r for r in out}
    signs = np.array([np.sign(sum(got[r[0], k]["whitened"] * w[at[r[0]], k - 1] for r in good)) for k in range(1, 33)])
    for (ident, k), r in got.items():
        i = at[ident]
        assert abs(r["whitened"] - signs[k - 1] * w[i, k - 1]) < 1e-8
        assert r["deviation"] == int(((n * x[i].astype(object) - s.astype(object)) ** 2).sum())
        assert abs(r["explained"] - e[k - 1] / np.trace(cov)) < 1e-12 and r["identity_error"] < 1e-10


def test_sums_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN", 2)
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(6).tolist(), 0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(9)
    fit, trace, error = W.fitted(df)
    _, cov, e, _ = dense([r[1] for r in rows])
    assert np.allclose(fit.values, e, rtol=1e-10) and abs(trace - np.trace(cov)) < 1e-8 * trace and error < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(i, [1.0, 2.0], 0) for i in range(5)]])
def test_without_variance_there_is_no_component(spark, rows):
    assert W.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_low_rank_leaves_components_out(spark):
    rows = [(i, [float(i), float(i), 1.0], 0) for i in range(9)]
    out = W.whiten(spark.createDataFrame(rows, SCHEMA))
    assert {r["component"] for r in out.collect()} == {1}


@pytest.mark.parametrize("rows", [[(1, [1.0], 0), (2, [1.0, 2.0], 0)], [(1, [1e30], 0), (2, [0.0], 0)]])
def test_refused(spark, rows):
    with pytest.raises(Exception, match="lengths|64-bit"):
        W.whiten(spark.createDataFrame(rows, SCHEMA)).count()
