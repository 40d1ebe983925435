"""Logistic GLM tables (M1-M8, M13) on the batched fits of ``logit``.

One call fits a model, a family of models on their common complete rows, or a model in every segment found in the data; each needs
one encoded design and one series of passes. Reference levels are the alphabetically first ones (R's treatment contrasts).
Aliased coefficients and those of constant terms are NULL, as R prints NA.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import col
from .design import Design
from .logit import SEPARATED, Fit, fit_all
from .spec import ModelSpec
from .stats import chi2_sf, normal_two_sided_p

Z_05 = 1.959963984540054  # two-sided 5% normal quantile: p <= 0.05  <=>  |z| >= Z_05

__all__ = ["SEPARATED", "GlmFit", "anova_compare", "anova_sequential", "fit_family", "fit_glm", "fit_segments", "fitted", "fitted_totals", "glance", "tidy"]


@dataclass
class GlmFit:
    spec: ModelSpec
    terms: list[str]
    estimate: list[float | None]  # None: aliased
    std_error: list[float | None]
    statistic: list[float | None]
    p_value: list[float | None]
    null_deviance: float
    deviance: float
    df_null: int
    df_residual: int
    aic: float
    n: int
    iterations: int
    converged: bool  # the iterations ended by their criterion, not by their limit
    separated: bool  # some fitted probability is 0 or 1 to within ``SEPARATED``: estimates of that term diverge
    term_of: list[str]  # term of each coefficient ("" for the intercept)
    segment: str | None = None


def _result(design: Design, f: Fit) -> GlmFit:
    at = {j: i for i, j in enumerate(f.used)}
    names, estimate, se, z, p = [], [], [], [], []
    for j in f.columns:
        names.append(design.columns[j][1])
        i = at.get(j)
        ok = i is not None and f.covariance[i, i] > 0
        estimate.append(float(f.beta[j]) if i is not None else None)
        se.append(math.sqrt(f.covariance[i, i]) if ok else None)
        z.append(estimate[-1] / se[-1] if ok else None)
        p.append(normal_two_sided_p(z[-1]) if ok else None)
    # A factor with one level in the segment has no column left: it is named as constant.
    terms = [design.columns[j][0] for j in f.columns]
    for t in f.spec.terms:
        if t not in terms:
            names, terms = [*names, t], [*terms, t]
            for values in (estimate, se, z, p):
                values.append(None)
    return GlmFit(
        spec=f.spec, terms=names, estimate=estimate, std_error=se, statistic=z, p_value=p,
        null_deviance=f.null_deviance, deviance=f.deviance, df_null=f.n - 1, df_residual=f.n - f.rank, aic=f.deviance + 2 * f.rank, n=f.n,
        iterations=f.iterations, converged=f.converged, separated=f.separated, term_of=terms, segment=f.segment,
    )


def fit_family(df: DataFrame, specs: Mapping[str, ModelSpec], segment: str | None = None, max_iter: int = 25, complete: bool = True) -> dict[tuple[str, str | None], GlmFit]:
    """Fits by (model, segment): all models on the rows that are complete for every one of them (M4, M8), in every segment found."""
    first = next(iter(specs.values()))
    terms = list(dict.fromkeys(t for s in specs.values() for t in s.terms))
    design = Design(df, first.response, terms, segment=segment, complete=complete)
    try:
        return {(f.model, f.segment): _result(design, f) for f in fit_all(design, specs, max_iter)}
    finally:
        design.close()


def fit_glm(df: DataFrame, spec: ModelSpec, max_iter: int = 25, complete: bool = True) -> GlmFit:
    """Binomial-logit GLM of ``spec`` (M1) on the complete rows (M4)."""
    return fit_family(df, {"m": spec}, max_iter=max_iter, complete=complete)["m", None]


def fit_segments(df: DataFrame, spec: ModelSpec, segment: str, max_iter: int = 25) -> dict[str, GlmFit]:
    """The model in every segment found in the data (M3), in one series of passes."""
    return {s: f for (_, s), f in fit_family(df, {"m": spec}, segment, max_iter).items()}


def fitted(fit: GlmFit) -> Column:
    """Fitted probability of a row as an expression over the columns of the model; aliased coefficients count as zero."""
    eta = F.lit(0.0)
    for name, term, b in zip(fit.terms, fit.term_of, fit.estimate, strict=True):
        if b is None:
            continue
        if not term:
            eta = eta + F.lit(b)
        elif name == term:
            eta = eta + F.lit(b) * col(term).cast("double")
        else:
            eta = eta + F.when(col(term) == name[len(term):], F.lit(b)).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-eta))


def fitted_totals(df: DataFrame, fits: Mapping[str | None, GlmFit], segment: str | None = None) -> DataFrame:
    """Observed and fitted totals of the response per segment, term and level: (segment,) term, level, n, observed, fitted.

    Factors give a row per level, numbers one row (level NULL) of totals weighted by their values. At a maximum of the likelihood both totals agree,
    for aliased levels too. One pass: the rows of a term are made in the row and aggregated map-side.
    """
    spec = next(iter(fits.values())).spec
    keys = [segment] if segment else []
    data = df.select(*[col(c) for c in dict.fromkeys([*keys, *spec.variables])]).dropna("any")
    mu = F.lit(None).cast("double")
    for s, f in fits.items():
        mu = F.when(col(segment) == s, fitted(f)).otherwise(mu) if segment else fitted(f)
    y = col(spec.response).cast("double")
    kind = dict(data.dtypes)
    entries = []
    for t in spec.terms:
        text = kind[t] == "string"
        weight = F.lit(1.0) if text else col(t).cast("double")
        level = col(t) if text else F.lit(None).cast("string")
        entries.append(F.struct(F.lit(t).alias("term"), level.alias("level"), (weight * y).alias("o"), (weight * F.col("__mu")).alias("f")))
    rows = data.withColumn("__mu", mu).select(*[col(k) for k in keys], F.inline(F.array(*entries)))
    return rows.groupBy(*[col(k) for k in keys], "term", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("o").alias("observed"), F.sum("f").alias("fitted"))


def tidy(spark: SparkSession, fit: GlmFit | Mapping[str, GlmFit], with_p: bool = True, model: str | None = None) -> DataFrame:
    """``broom::tidy`` + odds ratio + "*" when p <= .05 (M5). A mapping gives the tables of several fits, named in the column ``model``."""
    fits = dict(fit) if isinstance(fit, Mapping) else {model: fit}
    rows = []
    for name, f in fits.items():
        for t, b, se, z, p in zip(f.terms, f.estimate, f.std_error, f.statistic, f.p_value, strict=True):
            r = {"model": name, "term": t, "estimate": b, "std_error": se, "statistic": z, "odds": None if b is None else math.exp(min(b, 700.0)),
                 "sig": None if z is None else "*" if abs(z) >= Z_05 else "", "p_value": p}
            rows.append(r)
    schema = "model string, term string, estimate double, std_error double, statistic double, odds double, sig string, p_value double"
    drop = ([] if with_p else ["p_value"]) + ([] if isinstance(fit, Mapping) or model is not None else ["model"])
    return spark.createDataFrame(rows, schema).drop(*drop)


def glance(spark: SparkSession, fits: dict[str, GlmFit]) -> DataFrame:
    """Model summary rows: deviances, degrees of freedom, AIC, n (M6), and whether the fit converged or is separated."""
    rows = [{"model": k, "null_deviance": f.null_deviance, "deviance": f.deviance, "df_null": f.df_null,
             "df_residual": f.df_residual, "aic": f.aic, "n": f.n,
             "converged": f.converged, "separated": f.separated} for k, f in fits.items()]
    return spark.createDataFrame(rows, "model string, null_deviance double, deviance double, df_null bigint, df_residual bigint, aic double, n bigint, converged boolean, separated boolean")


def anova_sequential(spark: SparkSession, df: DataFrame, spec: ModelSpec) -> DataFrame:
    """``anova(glm)``: terms added in order, every fit on the rows complete for the
    full model (M7). Returns term, df, deviance, resid_df, resid_dev, p_value.

    All prefixes of the terms are fitted in the same passes. A term that is aliased by those before it has df 0."""
    prefixes = {t: ModelSpec(spec.response, tuple(spec.terms[: k + 1])) for k, t in enumerate(spec.terms)}
    fits = fit_family(df, prefixes)
    first = fits[spec.terms[0], None]
    before_df, before = first.df_null, first.null_deviance
    rows = [{"term": "NULL", "df": None, "deviance": None, "resid_df": before_df, "resid_dev": before, "p_value": None}]
    for t in spec.terms:
        f = fits[t, None]
        ddf, gain = before_df - f.df_residual, before - f.deviance
        rows.append({"term": t, "df": ddf, "deviance": gain, "resid_df": f.df_residual, "resid_dev": f.deviance, "p_value": chi2_sf(gain, ddf) if ddf > 0 else None})
        before_df, before = f.df_residual, f.deviance
    return spark.createDataFrame(rows, "term string, df bigint, deviance double, resid_df bigint, resid_dev double, p_value double")


def anova_compare(spark: SparkSession, df: DataFrame, specs: Mapping[str, ModelSpec]) -> DataFrame:
    """``anova(m1, m2, ...)``: all models on the rows complete for every model (M8, D15), fitted in the same passes.

    Consecutive models are compared by deviance change on the chi-square
    distribution; ``nested`` flags whether the earlier model's terms are a
    subset of the later one's (the comparison is only a likelihood-ratio test
    when they are).
    """
    fits = fit_family(df, specs)
    rows, prev = [], None
    for name, sp in specs.items():
        f = fits[name, None]
        r = {"model": name, "resid_df": f.df_residual, "resid_dev": f.deviance, "df": None, "deviance": None, "p_value": None, "nested": None}
        if prev is not None:
            pf, ps = prev
            ddf, gain = pf.df_residual - f.df_residual, pf.deviance - f.deviance
            r.update({"df": ddf, "deviance": gain, "p_value": chi2_sf(abs(gain), abs(ddf)) if ddf != 0 else None, "nested": set(ps.terms) <= set(sp.terms)})
        rows.append(r)
        prev = (f, sp)
    return spark.createDataFrame(rows, "model string, resid_df bigint, resid_dev double, df bigint, deviance double, p_value double, nested boolean")
