"""Unidimensional generalized partial credit model (K6-K9).

P(X = k | theta) is proportional to exp(sum_{v<=k} a (theta - b_v)), k = 0..m-1,
theta ~ N(0, 1) on a fixed quadrature grid (Bock & Aitkin EM; Muraki 1992).

Execution: responses are collapsed to distinct patterns with counts (one scan and one
aggregate for all scales; at most (m+1)^k rows whatever the number of respondents) and
cached in as many partitions as the patterns need (the shuffle that finds them has as many as the respondents need). Each EM cycle is one pass over the patterns: expected counts (items x categories x nodes)
and the log-likelihood are added up per task and summed by Spark, so what reaches the driver is one number per cell, however many
patterns there are; the driver runs a small Newton step per item. Person scores (EAP) are a
projection over the respondent rows with the fitted parameters shipped in the closure.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import col
from ..operators.partials import summed
from ..session import reliable_cache

NODES, BOUND = 61, 6.0
TASK_PATTERNS = 20_000  # patterns of a task of a cycle: some tenths of a second


@dataclass
class GpcmFit:
    items: list[str]
    slope: np.ndarray  # (k,)
    intercepts: np.ndarray  # (k, m) slope-intercept form, column 0 fixed at 0
    low: int
    loglik: float
    iterations: int
    converged: bool
    n: int
    n_nodes: int = NODES
    node_mass: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # (k, nodes): answers of each item by node, of the last cycle

    @property
    def thresholds(self) -> np.ndarray:
        """b_v = -(d_v - d_{v-1}) / a, v = 1..m-1."""
        return -(np.diff(self.intercepts, axis=1)) / self.slope[:, None]


def quadrature(n_nodes: int = NODES, bound: float = BOUND) -> tuple[np.ndarray, np.ndarray]:
    nodes = np.linspace(-bound, bound, n_nodes)
    w = np.exp(-0.5 * nodes**2)
    return nodes, w / w.sum()


def _log_probs(slope: np.ndarray, d: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """log P[item, category, node]."""
    m = d.shape[1]
    cat = np.arange(m)
    z = slope[:, None, None] * cat[None, :, None] * nodes[None, None, :] + d[:, :, None]
    zmax = z.max(axis=1, keepdims=True)
    return z - (zmax + np.log(np.exp(z - zmax).sum(axis=1, keepdims=True)))


def response_patterns(df: DataFrame, scales: dict[str, Sequence[str]], low: int = 1) -> DataFrame:
    """Distinct response patterns per scale (categories shifted to 0..m-1, NULL kept)
    with counts: columns ``scale`` (its number), ``i0..i{k-1}``, ``n`` (shorter scales padded with NULL)."""
    kmax = max(len(v) for v in scales.values())
    rows = []
    for number, items in enumerate(scales.values()):
        cols = [(col(i) - F.lit(low)).cast("int").alias(f"i{j}") for j, i in enumerate(items)]
        cols += [F.lit(None).cast("int").alias(f"i{j}") for j in range(len(items), kmax)]
        rows.append(F.struct(F.lit(number).alias("scale"), *cols))
    return df.select(F.inline(F.array(*rows))).groupBy("scale", *[f"i{j}" for j in range(kmax)]).agg(F.count(F.lit(1)).alias("n"))


def _posterior(x: list[np.ndarray], logp: np.ndarray, log_prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior over the nodes and log-likelihood of each row of answers (NaN: not answered)."""
    lp = np.tile(log_prior, (len(x[0]), 1))
    for i, xi in enumerate(x):
        ok = ~np.isnan(xi)
        lp[ok] += logp[i, xi[ok].astype(int)]
    top = lp.max(axis=1, keepdims=True)
    post = np.exp(lp - top)
    total = post.sum(axis=1, keepdims=True)
    return post / total, (np.log(total) + top)[:, 0]


def expected_counts(patterns: DataFrame, logps: dict[int, np.ndarray], log_prior: np.ndarray) -> dict[int, tuple[float, np.ndarray]]:
    """Log-likelihood and expected counts (items x categories x nodes) of the scales in ``logps``, in one pass over the patterns."""
    at, size = {}, 0
    for s, logp in logps.items():
        at[s] = size
        size += 1 + logp.size

    def add(batch, total):
        scale = batch.column("scale").to_numpy(zero_copy_only=False)
        n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
        for s, logp in logps.items():
            rows = np.flatnonzero(scale == s)
            if not len(rows):
                continue
            k, m, q = logp.shape
            x = [batch.column(f"i{i}").to_numpy(zero_copy_only=False).astype(float)[rows] for i in range(k)]
            post, ll = _posterior(x, logp, log_prior)
            total[at[s]] += n[rows] @ ll
            weighted = post * n[rows, None]
            cells = total[at[s] + 1 : at[s] + 1 + logp.size].reshape(k, m, q)
            for i in range(k):
                for c in range(m):
                    cells[i, c] += weighted[x[i] == c].sum(axis=0)

    sums = summed(patterns, size, add)
    return {s: (float(sums[at[s]]), sums[at[s] + 1 : at[s] + 1 + p.size].reshape(p.shape)) for s, p in logps.items()}


def _mstep_item(r: np.ndarray, nodes: np.ndarray, a: float, d: np.ndarray, iters: int = 25) -> tuple[float, np.ndarray]:
    """Newton ascent on one item's expected complete-data log-likelihood.

    Parameters (a, d_1..d_{m-1}); z_kq = a k theta_q + d_k is linear in them, so
    the Hessian is minus the count-weighted covariance of dz/dparam.
    """
    m, q = r.shape
    cat = np.arange(m)
    nq = r.sum(axis=0)
    g = np.zeros((m, q, m))  # dz_k,q / dparam
    g[:, :, 0] = cat[:, None] * nodes[None, :]
    for j in range(1, m):
        g[j, :, j] = 1.0
    par = np.concatenate([[a], d[1:]])
    for _ in range(iters):
        dd = np.concatenate([[0.0], par[1:]])
        z = par[0] * cat[:, None] * nodes[None, :] + dd[:, None]
        z -= z.max(axis=0, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=0, keepdims=True)
        resid = r - nq[None, :] * p
        grad = np.einsum("kq,kqj->j", resid, g)
        eg = np.einsum("kq,kqj->qj", p, g)
        egg = np.einsum("kq,kqi,kqj->qij", p, g, g)
        hess = -np.einsum("q,qij->ij", nq, egg - eg[:, :, None] * eg[:, None, :])
        step = np.linalg.solve(hess, -grad)
        par = par + step
        if np.max(np.abs(step)) < 1e-10:
            break
    return float(par[0]), np.concatenate([[0.0], par[1:]])


def fit_gpcm_scales(
    df: DataFrame,
    scales: dict[str, Sequence[str]],
    n_categories: int = 4,
    low: int = 1,
    n_nodes: int = NODES,
    tol: float = 1e-4,
    max_iter: int = 500,
) -> dict[str, GpcmFit]:
    """EM fits of one GPCM per scale (K6), all scales sharing each E-step pass.

    Every cycle is one pass over the cached pattern table of all scales; a scale whose parameters moved less than ``tol`` is frozen, so each
    result equals the scale's own fit.
    """
    scales = {k: list(v) for k, v in scales.items()}
    m = n_categories
    nodes, prior = quadrature(n_nodes)
    log_prior = np.log(prior)
    pats = reliable_cache(response_patterns(df, scales, low), task_rows=TASK_PATTERNS)
    try:
        kmax = max(len(v) for v in scales.values())
        marg_rows = pats.groupBy("scale").agg(
            *[F.sum(F.when(F.col(f"i{j}") == c, F.col("n"))).alias(f"c{j}_{c}") for j in range(kmax) for c in range(m)],
            F.sum("n").alias("N"),
        ).collect()
        marg = {r["scale"]: r for r in marg_rows}
        state = []
        for number, (name, items) in enumerate(scales.items()):
            d = np.zeros((len(items), m))
            for j, it in enumerate(items):
                counts = np.array([(marg[number][f"c{j}_{c}"] or 0) if number in marg else 0 for c in range(m)], dtype=float)
                if (counts == 0).any():
                    raise ValueError(f"item {it} of scale {name} has an empty category; merge categories before fitting")
                d[j] = np.log(counts / counts[0])
            state.append({"slope": np.ones(len(items)), "d": d, "ll": float("nan"), "it": 0, "done": False, "mass": np.zeros((len(items), n_nodes))})
        for cycle in range(1, max_iter + 1):
            active = [i for i, st in enumerate(state) if not st["done"]]
            if not active:
                break
            counts = expected_counts(pats, {i: _log_probs(state[i]["slope"], state[i]["d"], nodes) for i in active}, log_prior)
            for number, (ll, r) in counts.items():
                st = state[number]
                st["ll"], st["mass"], st["it"] = ll, r.sum(axis=1), cycle
                old = np.concatenate([st["slope"], st["d"].ravel()])
                for i in range(len(r)):
                    st["slope"][i], st["d"][i] = _mstep_item(r[i], nodes, st["slope"][i], st["d"][i])
                st["done"] = bool(np.max(np.abs(np.concatenate([st["slope"], st["d"].ravel()]) - old)) < tol)
        return {
            name: GpcmFit(items, st["slope"].copy(), st["d"].copy(), low, st["ll"], st["it"], st["done"], int(marg[i]["N"]), n_nodes, st["mass"])
            for i, ((name, items), st) in enumerate(zip(scales.items(), state, strict=True))
        }
    finally:
        pats.unpersist()


def fit_gpcm(df: DataFrame, items: Sequence[str], **kwargs) -> GpcmFit:
    """EM fit of a GPCM to the item columns of ``df`` (K6)."""
    return fit_gpcm_scales(df, {"_": list(items)}, **kwargs)["_"]


def item_table(spark: SparkSession, fits: dict[str, GpcmFit]) -> DataFrame:
    """``coef(model, simplify=TRUE)$items`` without the fixed c column (K8)."""
    m = max(f.intercepts.shape[1] for f in fits.values())
    rows = []
    for scale, f in fits.items():
        b = f.thresholds
        for i, it in enumerate(f.items):
            row = {"scale": scale, "item": it, "a1": float(f.slope[i])}
            for v in range(m - 1):
                row[f"b{v + 1}"] = float(b[i, v]) if v < b.shape[1] else None
            rows.append(row)
    cols = ", ".join(["scale string", "item string", "a1 double"] + [f"b{v + 1} double" for v in range(m - 1)])
    return spark.createDataFrame(rows, cols)


def threshold_table(items: DataFrame, limits: tuple[float, float] | None = (-4.0, 4.0)) -> DataFrame:
    """Thresholds in long form, optionally limited to an axis range (K9)."""
    bcols = [c for c in items.columns if c.startswith("b") and c[1:].isdigit()]
    long = items.unpivot(["scale", "item"], bcols, "threshold", "logits")
    if limits is not None:
        long = long.where(F.col("logits").between(limits[0], limits[1]))
    return long


def category_table(spark: SparkSession, fits: dict[str, GpcmFit]) -> DataFrame:
    """Answers of each item by category as the fitted curves expect them, given where the answers lie on the scale."""
    rows = []
    for scale, f in fits.items():
        p = np.exp(_log_probs(f.slope, f.intercepts, quadrature(f.n_nodes)[0]))
        expected = np.einsum("icq,iq->ic", p, f.node_mass)
        rows += [(scale, it, f.low + c, float(expected[i, c])) for i, it in enumerate(f.items) for c in range(expected.shape[1])]
    return spark.createDataFrame(rows, "scale string, item string, category int, expected double")


def fit_table(spark: SparkSession, fits: dict[str, GpcmFit]) -> DataFrame:
    """How each fit ended: log-likelihood, respondents, cycles, whether it converged."""
    rows = [(s, f.loglik, f.n, f.iterations, f.converged) for s, f in fits.items()]
    return spark.createDataFrame(rows, "scale string, loglik double, n bigint, iterations int, converged boolean")


def eap_scores(df: DataFrame, fit: GpcmFit, keep: Sequence[str], name: str = "theta") -> DataFrame:
    """Expected-a-posteriori person scores and posterior SDs (K7).

    A respondent with no answered item gets the prior (0, 1).
    """
    return eap_scales(df, {"_": fit}, keep, name).drop("scale")


def eap_scales(df: DataFrame, fits: dict[str, GpcmFit], keep: Sequence[str], name: str = "theta") -> DataFrame:
    """Person scores on every scale, one row per respondent and scale, in one scan."""
    import pyarrow as pa

    models = []
    for scale, f in fits.items():
        nodes, prior = quadrature(f.n_nodes)
        models.append((scale, list(f.items), f.low, nodes, np.log(prior), _log_probs(f.slope, f.intercepts, nodes)))
    keep = list(keep)
    names = [*keep, "scale", name, f"{name}_se"]

    def run(batches):
        for b in batches:
            for scale, items, low, nodes, log_prior, logp in models:
                x = [b.column(i).to_numpy(zero_copy_only=False).astype(float) - low for i in items]
                post, _ = _posterior(x, logp, log_prior)
                mean = post @ nodes
                sd = np.sqrt(np.maximum(post @ nodes**2 - mean**2, 0.0))
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array([scale] * b.num_rows, pa.string()), pa.array(mean), pa.array(sd)], names)

    schema = df.select(*keep).schema.add("scale", "string").add(name, "double").add(f"{name}_se", "double")
    items = list(dict.fromkeys(i for _, v, *_ in models for i in v))
    return df.select(*[col(c) for c in dict.fromkeys([*keep, *items])]).mapInArrow(run, schema)
