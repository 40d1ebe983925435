"""Models: closed forms, sigma -> 0 equality, IRT recovery and EM monotonicity."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from sondeo.models import glm, glmm, irt
from sondeo.models.spec import ModelSpec
from sondeo.models.stats import chi2_sf


def test_chi2_tail():
    assert abs(chi2_sf(3.841458820694124, 1) - 0.05) < 1e-10
    assert abs(chi2_sf(5.991464547107979, 2) - 0.05) < 1e-10
    assert abs(chi2_sf(0.0, 3) - 1.0) < 1e-12


def test_spec_edits():
    s = ModelSpec("status", ("sexo", "edad_c12", "estado", "trabajo"))
    assert s.drop_term("estado").terms == ("sexo", "edad_c12", "trabajo")
    r = s.to_random("estado")
    assert r.r_formula() == "status ~ sexo + edad_c12 + trabajo + (1|estado)"


@pytest.fixture(scope="module")
def binary(spark):
    rng = np.random.default_rng(11)
    n = 3000
    g = rng.choice(["a", "b", "c"], size=n, p=[0.5, 0.3, 0.2])
    p = np.where(g == "a", 0.3, np.where(g == "b", 0.5, 0.7))
    y = (rng.random(n) < p).astype(int)
    x = rng.normal(size=n)
    grp = rng.choice([f"s{i}" for i in range(6)], size=n)
    return spark.createDataFrame(pd.DataFrame({"y": y, "g": g, "x": x, "grp": grp})).persist()


def test_glm_single_factor_closed_form(spark, binary):
    fit = glm.fit_glm(binary, ModelSpec("y", ("g",)))
    pdf = binary.toPandas()
    cells = pdf.groupby("g")["y"].agg(["sum", "count"])
    s, f = cells["sum"], cells["count"] - cells["sum"]
    est = dict(zip(fit.terms, fit.estimate))
    se = dict(zip(fit.terms, fit.std_error))
    assert abs(est["(Intercept)"] - math.log(s["a"] / f["a"])) < 1e-8
    assert abs(est["gb"] - (math.log(s["b"] / f["b"]) - math.log(s["a"] / f["a"]))) < 1e-8
    assert abs(se["gc"] - math.sqrt(1 / s["c"] + 1 / f["c"] + 1 / s["a"] + 1 / f["a"])) < 1e-8


def test_glm_anova_sequential_consistent(spark, binary):
    tab = glm.anova_sequential(spark, binary, ModelSpec("y", ("g", "x"))).toPandas()
    full = glm.fit_glm(binary, ModelSpec("y", ("g", "x")))
    assert abs(tab["resid_dev"].iloc[-1] - full.deviance) < 1e-6
    assert abs(tab["deviance"].iloc[1:].sum() - (full.null_deviance - full.deviance)) < 1e-6


def test_glmm_sigma_zero_equals_glm(spark, binary):
    spec = ModelSpec("y", ("g", "x"), ("grp",))
    g = glm.fit_glm(binary, ModelSpec("y", ("g", "x")))
    d = glmm.GlmmData(binary, spec)
    try:
        assert d.names == g.terms
        assert abs(d.deviance_at(np.array(g.estimate), np.array([0.0]))[0] - g.deviance) < 1e-6
    finally:
        d.close()


def test_glmm_recovers_group_variance(spark):
    rng = np.random.default_rng(5)
    n, q, sigma = 6000, 12, 0.8
    u = rng.normal(size=q) * sigma
    grp = rng.integers(0, q, size=n)
    x = rng.normal(size=n)
    eta = -0.3 + 0.7 * x + u[grp]
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "grp": [f"g{i:02d}" for i in grp]}))
    fit = glmm.fit_glmm(df, ModelSpec("y", ("x",), ("grp",)))
    assert 0.4 < fit.sigma[0] < 1.3
    assert abs(fit.beta[1] - 0.7) < 0.12


def _simulate_gpcm(n, a, b, seed):
    rng = np.random.default_rng(seed)
    theta = rng.standard_normal(n)
    k, m = len(a), b.shape[1] + 1
    x = np.zeros((n, k))
    for i in range(k):
        z = np.zeros((n, m))
        for c in range(1, m):
            z[:, c] = z[:, c - 1] + a[i] * (theta - b[i, c - 1])
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        x[:, i] = (rng.random(n)[:, None] > p.cumsum(1)).sum(1) + 1
    return pd.DataFrame(x.astype(int), columns=[f"i{i}" for i in range(k)])


def test_gpcm_recovery_and_monotone_em(spark):
    a = np.array([0.8, 1.4, 1.1, 1.8])
    b = np.array([[-1.5, 0.0, 1.2], [-1.0, -0.2, 0.8], [-0.5, 0.3, 1.5], [-1.2, 0.1, 1.0]])
    pdf = _simulate_gpcm(8000, a, b, 21)
    pdf.loc[pdf.index % 17 == 0, "i2"] = None
    df = spark.createDataFrame(pdf)
    lls = []
    for iters in (2, 5, 10):
        lls.append(irt.fit_gpcm(df, list(pdf.columns), max_iter=iters, tol=0.0).loglik)
    assert lls[0] <= lls[1] + 1e-6 <= lls[2] + 2e-6
    fit = irt.fit_gpcm(df, list(pdf.columns))
    assert fit.converged
    assert np.max(np.abs(fit.slope - a)) < 0.15
    assert np.max(np.abs(fit.thresholds - b)) < 0.2
    scores = irt.eap_scores(df.withColumn("rid", F.monotonically_increasing_id()), fit, ["rid"]).toPandas()
    assert len(scores) == 8000 and abs(scores["theta"].mean()) < 0.1


def test_completion_status_has_both_outcomes(spark):
    from sondeo.plans import attrition

    c = attrition.completion(spark, SF_SMALL).groupBy("status").count().collect()
    assert {r.status for r in c} == {0, 1}


def test_cell_collapsed_glm_equals_row_level(spark, binary):
    df = binary.withColumn("k", (F.col("x") > 0).cast("int"))
    cells = glm.fit_glm(df, ModelSpec("y", ("g", "k")))
    rows = glm.fit_glm(df.withColumn("k", F.col("k").cast("double")), ModelSpec("y", ("g", "k")))
    assert cells.terms == rows.terms
    assert np.allclose(cells.estimate, rows.estimate, atol=1e-8)
    assert np.allclose(cells.std_error, rows.std_error, atol=1e-8)
    assert abs(cells.deviance - rows.deviance) < 1e-6 and abs(cells.null_deviance - rows.null_deviance) < 1e-6
    assert (cells.n, cells.df_residual) == (rows.n, rows.df_residual)


def test_cell_collapsed_glmm_equals_row_level(spark, binary):
    df = binary.withColumn("k", (F.col("x") > 0).cast("int"))
    spec = ModelSpec("y", ("g", "k"), ("grp",))
    cells = glmm.GlmmData(df, spec)
    rows = glmm.GlmmData(df.withColumn("k", F.col("k").cast("double")), spec)
    try:
        assert cells.grouped and not rows.grouped and cells.n == rows.n and cells.names == rows.names
        beta = np.tile([-0.4, 0.3, 0.2, 0.1], (2, 1))
        sigma = np.array([[0.3], [1.1]])
        assert np.allclose(cells.deviance_at(beta, sigma), rows.deviance_at(beta, sigma), atol=1e-6)
    finally:
        cells.close()
        rows.close()


def test_glm_flags(spark, binary):
    plain = glm.fit_glm(binary, ModelSpec("y", ("x",)))
    assert plain.converged and not plain.separated
    assert not glm.fit_glm(binary, ModelSpec("y", ("x",)), max_iter=1).converged
    apart = binary.withColumn("y", (F.col("x") > 0).cast("int"))
    fit = glm.fit_glm(apart.withColumn("side", F.when(F.col("x") > 0, "r").otherwise("l")), ModelSpec("y", ("side",)))
    assert fit.separated
    row = glm.glance(spark, {"m": fit}).first()
    assert row["separated"] is True and row["converged"] == fit.converged


def test_glmm_flags(spark):
    """Groups without any difference: sigma is 0 and flagged; an ordinary fit is not."""
    rows = [(y, f"s{g}") for g in range(5) for y in [0, 1, 1, 0, 1] * 8]
    flat = spark.createDataFrame(rows, "y int, grp string")
    fit = glmm.fit_glmm(flat, ModelSpec("y", (), ("grp",)))
    assert fit.singular and fit.sigma[0] == 0.0 and fit.converged
    rows = [(int(i < 4 + 3 * g), f"s{g}") for g in range(10) for i in range(40)]
    fit = glmm.fit_glmm(spark.createDataFrame(rows, "y int, grp string"), ModelSpec("y", (), ("grp",)))
    assert fit.converged and not fit.singular and fit.sigma[0] > 0.3
    assert glmm.variance_table(spark, fit).first()["singular"] is False


def test_stored_fits_are_read_back(spark, tmp_path, monkeypatch):
    from sondeo.models.store import ModelStore, key_of

    pdf = _simulate_gpcm(600, np.array([0.8, 1.4]), np.array([[-1.0, 0.0, 1.0], [-0.5, 0.3, 1.2]]), 3)
    store, calls = ModelStore(spark, str(tmp_path)), []

    def make():
        calls.append(1)
        return irt.fit_gpcm_scales(spark.createDataFrame(pdf), {"one": ["i0", "i1"], "two": ["i1"]}, max_iter=4)

    key = key_of("t", 1)
    assert store.read_gpcm(key) is None
    first, second = store.gpcm(key, make), store.gpcm(key, make)
    assert calls == [1] and key != key_of("t", 2)
    for s in ("one", "two"):
        assert first[s].items == second[s].items and (first[s].slope == second[s].slope).all() and (first[s].intercepts == second[s].intercepts).all()
        assert first[s].converged is second[s].converged is False and first[s].n == 600
    assert {(r["key"], r["scale"]) for r in store.catalog().select("key", "scale").distinct().collect()} == {(key, "one"), (key, "two")}


def test_expected_counts_do_not_depend_on_the_partitions(spark):
    pdf = _simulate_gpcm(3000, np.array([0.8, 1.4, 1.1]), np.array([[-1.0, 0.0, 1.0], [-0.5, 0.3, 1.2], [-1.5, 0.2, 0.9]]), 4)
    pats = irt.response_patterns(spark.createDataFrame(pdf), {"s": list(pdf.columns)})
    nodes, prior = irt.quadrature(21)
    logp = {0: irt._log_probs(np.ones(3), np.zeros((3, 4)), nodes)}
    one = irt.expected_counts(pats.repartition(1), logp, np.log(prior))[0]
    many = irt.expected_counts(pats.repartition(9), logp, np.log(prior))[0]
    assert abs(one[0] - many[0]) < 1e-6 and np.allclose(one[1], many[1])
    assert np.allclose(one[1].sum(axis=(1, 2)), 3000)
