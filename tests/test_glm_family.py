"""Batched logistic fits: aliased and constant terms, segments, families and odd inputs against dense numpy fits."""

import numpy as np
import pandas as pd
import pytest

from sondeo.models import glm, logit
from sondeo.models.spec import ModelSpec


def dense_fit(x, y, steps=60):
    """Newton on a full-rank design."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        mu = 1 / (1 + np.exp(-x @ b))
        h = x.T @ (x * (mu * (1 - mu))[:, None])
        b = b + np.linalg.solve(h, x.T @ (y - mu))
    mu = 1 / (1 + np.exp(-x @ b))
    dev = -2 * np.sum(np.where(y > 0, np.log(mu), np.log(1 - mu)))
    return b, np.sqrt(np.diag(np.linalg.inv(x.T @ (x * (mu * (1 - mu))[:, None])))), dev


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(6)
    n = 4000
    p = pd.DataFrame({"g": rng.choice(list("abc"), n), "h": rng.choice(["u", "v"], n), "x": rng.normal(2000, 3, n), "z": rng.normal(size=n), "seg": rng.choice(["s1", "s2", "s3"], n, p=[0.7, 0.2, 0.1])})
    p["twice"] = 2 * p.x - 1
    p["same"] = 5.0
    p["one"] = "k"
    p["gh"] = p.g + p.h
    eta = 0.4 * (p.x - 2000) / 3 - 0.5 * p.z + p.g.map({"a": 0, "b": 0.5, "c": -0.5})
    p["y"] = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    p.loc[p.index % 50 == 7, "z"] = np.nan
    return p


@pytest.fixture(scope="module")
def frame(spark, data):
    out = data.astype(object).where(data.notna(), None)
    return spark.createDataFrame(out, "g string, h string, x double, z double, seg string, twice double, same double, one string, gh string, y int").persist()


def design(p, *terms):
    cols, names = [np.ones(len(p))], ["(Intercept)"]
    for t in terms:
        if p[t].dtype == object or str(p[t].dtype).startswith("str"):
            for v in sorted(p[t].unique())[1:]:
                cols.append((p[t] == v).to_numpy(float))
                names.append(t + v)
        else:
            cols.append(p[t].to_numpy(float))
            names.append(t)
    return np.stack(cols, 1), names


def test_full_rank_model_equals_a_dense_fit(frame, data):
    p = data.dropna()
    fit = glm.fit_glm(frame, ModelSpec("y", ("g", "x", "z")))
    x, names = design(p, "g", "x", "z")
    b, se, dev = dense_fit(np.where(np.arange(x.shape[1]) == names.index("x"), x - 2000 * (np.array(names) == "x"), x), p.y.to_numpy())
    assert fit.terms == names and fit.n == len(p) and fit.converged and not fit.separated
    assert np.allclose(fit.estimate[1:], b[1:], atol=1e-6) and np.allclose(fit.std_error[1:], se[1:], rtol=1e-5) and abs(fit.deviance - dev) < 1e-6


def test_aliased_and_constant_terms_are_empty(spark, frame, data):
    fit = glm.fit_glm(frame, ModelSpec("y", ("g", "same", "one", "x", "twice", "h", "gh", "z")))
    got = dict(zip(fit.terms, fit.estimate, strict=True))
    assert got["same"] is got["one"] is got["twice"] is None
    assert sum(v is None for t, v in got.items() if t.startswith("gh")) == 3  # five columns, two degrees of freedom left
    base = glm.fit_glm(frame, ModelSpec("y", ("gh", "x", "z")))
    assert abs(fit.deviance - base.deviance) < 1e-6 and fit.df_residual == base.df_residual
    row = glm.tidy(spark, fit).where("term = 'twice'").first()
    assert row["estimate"] is row["std_error"] is row["p_value"] is row["sig"] is row["odds"] is None


def test_segments_equal_single_fits(frame, data):
    spec = ModelSpec("y", ("g", "z"))
    fits = glm.fit_segments(frame, spec, "seg")
    assert set(fits) == {"s1", "s2", "s3"}
    for s, f in fits.items():
        p = data[data.seg == s].dropna()
        x, names = design(p, "g", "z")
        b, se, dev = dense_fit(x, p.y.to_numpy())
        assert f.terms == names and f.n == len(p)
        assert np.allclose(f.estimate, b, atol=1e-6) and np.allclose(f.std_error, se, rtol=1e-5) and abs(f.deviance - dev) < 1e-6


def test_a_level_missing_in_a_segment_moves_the_reference(spark):
    rng = np.random.default_rng(1)
    rows = [("s1" if i % 2 else "s2", "abc"[i % 3] if i % 2 else "bc"[i % 4 // 2], int(rng.random() < 0.4)) for i in range(600)]
    fits = glm.fit_segments(spark.createDataFrame(rows, "seg string, g string, y int"), ModelSpec("y", ("g",)), "seg")
    assert fits["s1"].terms == ["(Intercept)", "gb", "gc"] and fits["s2"].terms == ["(Intercept)", "gc"]
    assert all(v is not None for v in fits["s2"].estimate)


def test_family_shares_complete_rows_and_passes(frame, data, monkeypatch):
    passes = []
    real = logit._moments_pass
    monkeypatch.setattr(logit, "_moments_pass", lambda d, f: passes.append(len(f)) or real(d, f))
    fits = glm.fit_family(frame, {"a": ModelSpec("y", ("g",)), "b": ModelSpec("y", ("g", "z")), "c": ModelSpec("y", ("g", "z", "x"))})
    assert {f.n for f in fits.values()} == {len(data.dropna())}
    assert passes[0] == 3 and len(passes) <= 8
    devs = [fits[m, None].deviance for m in "abc"]
    assert devs == sorted(devs, reverse=True)


def test_fitted_totals_equal_observed(frame):
    spec = ModelSpec("y", ("g", "h", "z"))
    rows = glm.fitted_totals(frame, glm.fit_segments(frame, spec, "seg"), "seg").collect()
    assert len(rows) == 3 * (3 + 2 + 1)
    assert all(abs(r["observed"] - r["fitted"]) < 1e-6 for r in rows)


def test_only_one_outcome_or_no_rows(spark):
    rows = [("a" if i % 2 else "b", 1) for i in range(20)]
    fit = glm.fit_glm(spark.createDataFrame(rows, "g string, y int"), ModelSpec("y", ("g",)))
    assert fit.separated and fit.deviance < 1e-6 and fit.null_deviance == 0.0
    assert glm.fit_segments(spark.createDataFrame([], "seg string, g string, y int"), ModelSpec("y", ("g",)), "seg") == {}


def test_collected_cells_do_not_grow_with_the_rows(spark, frame):
    from sondeo.operators.partials import summed

    def add(batch, total):
        total[0] += batch.num_rows
        total[3] += 1.0

    for parts in (1, 7, 40):
        out = summed(frame.repartition(parts).select("y"), 5, add)
        assert out[0] == 4000 and out[3] >= 1 and out[1] == out[2] == out[4] == 0
