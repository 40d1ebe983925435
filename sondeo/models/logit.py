"""Logistic regressions of many models and segments in one series of passes.

Iteratively reweighted least squares for all models of a family and all segments of the rows at once: every pass over the encoded
rows gives, for each fit that has not converged, its weighted moments (p x p), score and log-likelihood, added up per task and summed by
Spark. Fits that have converged leave the passes. The first pass needs one moment matrix per segment only: at coefficients of zero all
models have the same weights, so sweeping the columns of a model in that matrix gives its first step, and the steps of nested models
follow from each other. The same sweeps tell, in the order of the terms, which columns carry no information beyond those before them: those
coefficients are aliased and stay empty, as does a factor or number that is constant in a segment. The reference level of a factor is the first that
occurs in the segment.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np

from ..operators.partials import summed
from .design import Design
from .spec import ModelSpec

ALIASED = 1e-10  # of a column's own moment: what is left of it beside the columns before it
SEPARATED = 1e-8
DECREMENT = 1e-10  # of the deviance: what another step could gain in a fit that has converged
FINISHED = 1e-14  # the same, when its iterations end: the next step would change nothing


def sweep(a: np.ndarray, j: int) -> None:
    """Sweep a symmetric matrix on column j, in place."""
    d = a[j, j]
    row = a[j] / d
    column = a[:, j].copy()
    a -= np.outer(column, row)
    a[j] = row
    a[:, j] = -column / d
    a[j, j] = 1.0 / d


def swept(moments: np.ndarray, score: np.ndarray, columns: list[int], check: bool) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Solution and inverse for the columns that are not aliased, and which those are (``check``: look for aliased ones)."""
    p = len(score)
    a = np.zeros((p + 1, p + 1))
    a[:p, :p], a[:p, p], a[p, :p] = moments, score, score
    used = []
    for j in columns:
        if check and a[j, j] <= ALIASED * moments[j, j]:
            continue
        sweep(a, j)
        used.append(j)
    return a[used, p], a[np.ix_(used, used)], used


@dataclass
class Fit:
    """One model in one segment."""

    model: str
    spec: ModelSpec
    segment: str | None
    columns: list[int]  # of the design, in the order of the terms; without reference levels
    used: list[int]  # those that are not aliased
    beta: np.ndarray  # over all columns of the design, zero where not used
    covariance: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    deviance: float = float("nan")
    n: int = 0
    successes: float = 0.0
    iterations: int = 0
    converged: bool = False
    separated: bool = False

    @property
    def rank(self) -> int:
        return len(self.used)

    @property
    def null_deviance(self) -> float:
        n, s = self.n, self.successes
        return float(-2 * (s * np.log(s / n) + (n - s) * np.log(1 - s / n))) if 0 < s < n else 0.0


def _moments_pass(design: Design, fits: list[Fit]) -> list[tuple[np.ndarray, np.ndarray, float, int]]:
    """(moments, score, log-likelihood, rows at an edge) over the used columns of each fit."""
    blocks = design.reader()
    number = {s: i for i, s in enumerate(design.segments)}
    jobs, at = [], 0
    for f in fits:
        k = len(f.used)
        jobs.append((number[f.segment], np.array(f.used), f.beta[f.used], at))
        at += k * k + k + 2
    by_segment: dict[int, list] = {}
    for job in jobs:
        by_segment.setdefault(job[0], []).append(job[1:])

    def add(batch, total):
        for x, y, w, _, seg in blocks(batch):
            for s, todo in by_segment.items():
                rows = slice(None) if seg is None else seg == s
                xs, ys, ws = x[rows], y[rows], w[rows]
                if not len(ys):
                    continue
                for used, beta, place in todo:
                    z = xs[:, used]
                    eta = z @ beta
                    mu = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
                    k = len(used)
                    weight = ws * mu * (1.0 - mu)
                    total[place : place + k * k] += (z.T @ (z * weight[:, None])).ravel()
                    total[place + k * k : place + k * k + k] += z.T @ (ys - ws * mu)
                    total[place + k * k + k] += np.sum(ys * eta - ws * np.logaddexp(0.0, eta))
                    total[place + k * k + k + 1] += np.sum(np.minimum(mu, 1.0 - mu) < SEPARATED)

    sums = summed(design.frame, at, add)
    out = []
    for f, (_, _, _, place) in zip(fits, jobs, strict=True):
        k = len(f.used)
        rest = sums[place + k * k :]
        out.append((sums[place : place + k * k].reshape(k, k), rest[:k], float(rest[k]), int(rest[k + 1])))
    return out


def _start(design: Design) -> dict[str | None, tuple[np.ndarray, np.ndarray]]:
    """Per segment the unweighted moments of all columns and their products with the response, whose first is the number of successes."""
    blocks, width, many = design.reader(), design.width, len(design.segments)

    def add(batch, total):
        cells = total.reshape(many, width + 1, width)
        for x, y, w, _, seg in blocks(batch):
            for s in range(many) if seg is None else np.unique(seg):
                rows = slice(None) if seg is None else seg == s
                cells[s, :width] += x[rows].T @ (x[rows] * w[rows, None])
                cells[s, width] += x[rows].T @ y[rows]

    cells = summed(design.frame, many * (width + 1) * width, add).reshape(many, width + 1, width)
    return {s: (cells[i, :width], cells[i, width]) for i, s in enumerate(design.segments)}


def _columns(design: Design, spec: ModelSpec, moments: np.ndarray) -> list[int]:
    """Columns of a model in the order of its terms, without the first level of each factor that occurs."""
    out = [0]
    for t in spec.terms:
        first = design.first[t]
        if t not in design.factors:
            out.append(first)
            continue
        present = [first + i for i in range(len(design.levels[t])) if moments[first + i, first + i] > 0]
        out += present[1:]
    return out


def fit_all(design: Design, specs: Mapping[str, ModelSpec], max_iter: int = 25) -> list[Fit]:
    """Every model in every segment, in the order of models, then segments."""
    fits = []
    start = _start(design) if design.n else {}
    for name, spec in specs.items():
        for s, (moments, products) in start.items():
            columns = _columns(design, spec, moments)
            # At coefficients of zero: weights w / 4, residuals y - w / 2.
            step, _, used = swept(moments / 4, products - moments[0] / 2, columns, check=True)
            beta = np.zeros(design.width)
            beta[used] = step
            fits.append(Fit(name, spec, s, columns, used, beta, n=int(round(moments[0, 0])), successes=float(products[0])))
    previous = {id(f): (np.inf, f.beta.copy()) for f in fits}
    active, done = list(fits), set()
    for i in range(1, max_iter + 1):
        if not active:
            break
        for f, (moments, score, ll, edge) in zip(active, _moments_pass(design, active), strict=True):
            f.iterations, f.separated = i, edge > 0
            old, before = previous[id(f)]
            if -2 * ll > old * (1 + 1e-12) + 1e-9:  # the step went too far
                f.beta = (f.beta + before) / 2
                continue
            f.deviance = -2 * ll
            previous[id(f)] = (f.deviance, f.beta.copy())
            step, inverse, good = swept(moments, score, list(range(len(f.used))), check=True)
            if len(good) < len(f.used):  # weights of zero: no information left about some coefficients
                f.covariance = np.full((len(f.used), len(f.used)), np.nan)
                f.covariance[np.ix_(good, good)] = inverse
            else:
                f.covariance = inverse
            gain = float(score[good] @ step)
            f.beta[np.array(f.used)[good]] += step
            f.converged = gain < DECREMENT * (f.deviance + 0.1)
            if gain < FINISHED * (f.deviance + 0.1):
                done.add(id(f))
        active = [f for f in active if id(f) not in done]
    return fits
