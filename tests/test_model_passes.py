"""The work of the iterative fits: points and passes of the mixed models, partitions of the pattern table and of the summed cells."""

import re

import numpy as np
import pytest

from sondeo.models import glmm, irt
from sondeo.models.spec import ModelSpec
from test_glmm_laplace import CASES, dense_deviance, simulate


@pytest.mark.parametrize("case", CASES)
def test_hessian_is_that_of_the_dense_deviance(spark, case):
    n, sizes, sigma = CASES[case]
    p, x, codes = simulate(n, sizes, sigma, 7)
    d = glmm.GlmmData(spark.createDataFrame(p), ModelSpec("y", ("x", "f"), tuple(f"g{r}" for r in range(len(sizes)))))
    try:
        beta, sig = np.array([-0.1, 0.5, 0.3]), np.array(sigma) * 1.3
        _, hessian = d.derivatives(d.at_modes(d.points(beta, sig)))
    finally:
        d.close()
    f = lambda v: dense_deviance(x, p.y.to_numpy(), codes, v[:3], v[3:])
    at, e = np.concatenate([beta, sig]), 1e-3
    k = len(at)
    want = np.array([[(f(at + e * (a + b)) - f(at + e * (a - b)) - f(at + e * (b - a)) + f(at - e * (a + b))) / (4 * e * e) for a in np.eye(k)] for b in np.eye(k)])
    assert np.allclose(hessian, want, rtol=1e-3, atol=2e-2)


def test_a_step_works_on_one_point(spark, monkeypatch):
    """The points of all passes together: they were some hundreds when Hessians were differences of gradients."""
    points, sums = [], glmm.GlmmData._sums
    monkeypatch.setattr(glmm.GlmmData, "_sums", lambda self, at, size, work: points.append(len(at.beta)) or sums(self, at, size, work))
    p, _, _ = simulate(1500, [12, 4], [0.7, 0.5], 8)
    fit = glmm.fit_glmm(spark.createDataFrame(p), ModelSpec("y", ("x", "f"), ("g0", "g1")))
    assert fit.converged and sum(points) < 60


def test_models_of_a_family_share_rows(spark):
    p, _, _ = simulate(900, [9], [0.8], 9)
    p.loc[p.index % 10 == 0, "x"] = None
    df = spark.createDataFrame(p.astype({"x": object}).where(p.notna(), None), "y int, x double, f string, g0 string")
    specs = {"small": ModelSpec("y", ("f",), ("g0",)), "large": ModelSpec("y", ("x", "f"), ("g0",))}
    both = glmm.fit_glmms(df, specs)
    for k, s in specs.items():
        one = glmm.fit_glmm(glmm.common_rows(df, list(specs.values())), s)
        assert both[k].n == one.n == 810 and both[k].terms == one.terms
        assert abs(both[k].deviance - one.deviance) < 1e-6 and np.allclose(both[k].beta, one.beta, atol=1e-6)


def test_pattern_table_has_the_partitions_of_its_rows(spark, monkeypatch):
    """A cycle over some patterns is one task, however many partitions the respondents were dealt over."""
    seen, counts = [], irt.expected_counts
    monkeypatch.setattr(irt, "expected_counts", lambda pats, *a: seen.append(pats.rdd.getNumPartitions()) or counts(pats, *a))
    df = spark.range(4000, numPartitions=40).selectExpr("cast(id % 4 + 1 as int) AS a", "cast((id + id div 7 % 2) % 4 + 1 as int) AS b")
    irt.fit_gpcm(df, ["a", "b"], max_iter=2)
    assert set(seen) == {1}


def test_cells_are_dealt_over_the_partitions_they_need(spark, monkeypatch):
    """A task of a pass writes one file, not one for each partition set for the shuffles of rows; many cells keep many partitions."""
    from sondeo.operators import partials

    df, plans = spark.range(300, numPartitions=3), []
    arrow = type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or arrow(self))
    monkeypatch.setattr(partials, "TASK_CELLS", 100)
    at = {}
    for size in (100, 250, 100_000):  # 1 and 3 partitions; more than the 8 of the session
        at[size] = partials.summed(df, size, lambda batch, total: np.add.at(total, batch.column("id").to_numpy() % len(total), 1.0))
        assert at[size].sum() == 300 and np.array_equal(at[size], np.bincount(np.arange(300) % size, minlength=size))
    one, three, many = plans
    assert "SinglePartition" in one and "hashpartitioning" not in one
    assert re.findall(r"Exchange hashpartitioning\(cell#\d+L?, (\d+)\)", three) == ["3"]
    assert re.findall(r"Exchange hashpartitioning\(cell#\d+L?, (\d+)\)", many) == ["8"]
