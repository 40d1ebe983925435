"""The joint Laplace fit against an independent dense version: deviance, gradient, minimum and standard errors."""

import numpy as np
import pandas as pd
import pytest

from sondeo.models import glmm
from sondeo.models.spec import ModelSpec


def dense_deviance(x, y, codes, beta, sigma):
    """-2 log of the Laplace likelihood with all matrices formed whole."""
    z = np.hstack([s * (g[:, None] == np.arange(g.max() + 1)) for s, g in zip(sigma, codes, strict=True)])
    u = np.zeros(z.shape[1])
    for _ in range(200):
        mu = 1 / (1 + np.exp(-(x @ beta + z @ u)))
        h = z.T @ (z * (mu * (1 - mu))[:, None]) + np.eye(len(u))
        step = np.linalg.solve(h, z.T @ (y - mu) - u)
        u = u + step
        if np.abs(step).max() < 1e-12:
            break
    eta = x @ beta + z @ u
    mu = 1 / (1 + np.exp(-eta))
    h = z.T @ (z * (mu * (1 - mu))[:, None]) + np.eye(len(u))
    return -2 * np.sum(y * eta - np.logaddexp(0, eta)) + u @ u + np.linalg.slogdet(h)[1]


def simulate(n, sizes, sigma, seed):
    rng = np.random.default_rng(seed)
    codes = [rng.integers(0, q, n) for q in sizes]
    x = rng.normal(size=n)
    f = rng.choice(["a", "b"], n)
    eta = -0.3 + 0.7 * x + 0.4 * (f == "b") + sum(s * rng.normal(size=q)[g] for s, q, g in zip(sigma, sizes, codes, strict=True))
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    p = pd.DataFrame({"y": y, "x": x, "f": f, **{f"g{r}": [f"s{c:03d}" for c in g] for r, g in enumerate(codes)}})
    return p, np.stack([np.ones(n), x, (f == "b").astype(float)], 1), codes


CASES = {"one": (1500, [15], [0.8]), "crossed": (1500, [12, 4], [0.7, 0.5]), "three": (1200, [8, 3, 5], [0.8, 0.6, 0.5])}


@pytest.mark.parametrize("case", CASES)
def test_gradient_is_that_of_the_dense_deviance(spark, case):
    n, sizes, sigma = CASES[case]
    p, x, codes = simulate(n, sizes, sigma, 3)
    d = glmm.GlmmData(spark.createDataFrame(p), ModelSpec("y", ("x", "f"), tuple(f"g{r}" for r in range(len(sizes)))))
    try:
        beta, sig = np.array([-0.1, 0.5, 0.3]), np.array(sigma) * 1.3
        points = d.at_modes(d.points(beta, sig))
        f = lambda v: dense_deviance(x, p.y.to_numpy(), codes, v[:3], v[3:])
        at = np.concatenate([beta, sig])
        assert abs(points.deviance[0] - f(at)) < 1e-7
        want = [(f(at + e) - f(at - e)) / 2e-5 for e in 1e-5 * np.eye(len(at))]
        assert np.allclose(d.gradients(points)[0], want, rtol=1e-4, atol=1e-3)
    finally:
        d.close()


@pytest.mark.parametrize("case", CASES)
def test_fit_is_the_minimum(spark, case):
    n, sizes, sigma = CASES[case]
    p, x, codes = simulate(n, sizes, sigma, 4)
    fit = glmm.fit_glmm(spark.createDataFrame(p), ModelSpec("y", ("x", "f"), tuple(f"g{r}" for r in range(len(sizes)))))
    f = lambda v: dense_deviance(x, p.y.to_numpy(), codes, v[:3], np.abs(v[3:]))
    at = np.concatenate([fit.beta, fit.sigma])
    assert fit.converged and fit.terms == ["(Intercept)", "x", "fb"]
    assert abs(f(at) - fit.deviance) < 1e-6
    k, e = len(at), 1e-3
    hess = np.array([[(f(at + e * (a + b)) - f(at + e * (a - b)) - f(at + e * (b - a)) + f(at - e * (a + b))) / (4 * e * e) for a in np.eye(k)] for b in np.eye(k)])
    free = np.array([True] * 3 + list(fit.sigma > 0))
    grad = np.array([(f(at + e * a) - f(at - e * a)) / (2 * e) for a in np.eye(k)])
    move = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
    assert np.abs(move).max() < 1e-3  # another Newton step of the dense version would not move it
    assert np.allclose(fit.se, np.sqrt(np.diagonal(2 * np.linalg.inv(hess[np.ix_(free, free)])))[:3], rtol=1e-2)


def test_points_in_turn_give_the_same(spark, monkeypatch):
    p, _, _ = simulate(600, [9, 3], [0.7, 0.5], 5)
    d = glmm.GlmmData(spark.createDataFrame(p), ModelSpec("y", ("x",), ("g0", "g1")))
    try:
        beta, sigma = np.tile([0.1, 0.4], (5, 1)), np.linspace(0.2, 1, 10).reshape(5, 2)
        whole = d.at_modes(d.points(beta, sigma))
        grads = d.gradients(whole)
        monkeypatch.setattr(glmm, "POINT_CELLS", 100)
        parts = d.at_modes(d.points(beta, sigma))
        assert np.allclose(whole.deviance, parts.deviance, atol=1e-9) and np.allclose(grads, d.gradients(parts), atol=1e-8)
    finally:
        d.close()


def test_modes_of_given_parameters(spark):
    p, x, codes = simulate(400, [6], [1.0], 6)
    rows, dev = glmm.conditional_modes(spark.createDataFrame(p), ModelSpec("y", ("x",), ("g0",)), {"(Intercept)": -0.2, "x": 0.5}, [0.9])
    assert [r[:2] for r in rows] == [("g0", f"s{i:03d}") for i in range(6)]
    assert abs(dev - dense_deviance(x[:, :2], p.y.to_numpy(), codes, np.array([-0.2, 0.5]), [0.9])) < 1e-7
