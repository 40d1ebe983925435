"""Random-intercept logistic models (M9-M12) by their Laplace likelihood.

eta = X beta + sum_r sigma_r u_r[g_r], u_r ~ N(0, I). For given (beta, sigma) the group effects have a mode u; the deviance
    D(beta, sigma) = -2 l(beta, sigma, u) + |u|^2 + log det H,    H = Z' W Z + I,
is minimised jointly over beta and sigma (lme4's ``nAGQ = 1``) by Newton's method with exact gradients and Hessians. How the modes move
with the parameters is known from sums per group level, so a step works on one point: two or three passes over the rows find its modes, one
gives the sums per level that its derivatives need, one the derivatives. The work of a row is that of a few products of its design with
itself, whatever the number of parameters tried. Three to five steps make a fit, the same Hessian gives the standard errors, and models that
are compared share their encoded rows.

H is never formed whole. The levels of the factor with most levels are independent of each other given the rest, so they are eliminated
as a diagonal (a Schur complement), and what is left has the size of the other factors; of the inverse only the entries that meet in a row of the
data are made. Sums reach the driver one per level and coefficient (and per pair of crossed levels), never per row; so the number of levels is bounded by
the driver's memory, some hundred thousand for one factor.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from ..operators.partials import summed
from .design import Design
from .logit import Fit, fit_all
from .spec import ModelSpec
from .stats import chi2_sf, normal_two_sided_p

STEPS = 40  # a fit that uses them all is reported as not converged
GRID = (0.0, 0.1, 0.25, 0.6, 1.5, 4.0)  # where the search for each sigma begins
SMALL_SIGMA = 0.02  # below, zero is tried
LARGEST_SIGMA = 50.0  # a larger optimum is reported as not converged
MODE_STEP = 1e-8  # largest change of a group effect when its mode is found
GAIN = 1e-9  # of the deviance that another step could give when the search ends
NOISE = 1e-13  # of a deviance: smaller differences are those of the order of summation
POINT_CELLS = 2_000_000  # cells of a pass: more points or columns than fit are worked on in turn


@dataclass
class GlmmFit:
    spec: ModelSpec
    terms: list[str]
    beta: np.ndarray
    se: np.ndarray
    sigma: np.ndarray
    groups: list[str]
    levels: list[list[str]]
    u: list[np.ndarray]  # effects of the levels: sigma times the mode
    deviance: float
    n: int
    evaluations: int  # passes over the rows
    converged: bool  # the search ended by its criterion, inside its range
    singular: bool  # some sigma is 0

    @property
    def npar(self) -> int:
        return len(self.beta) + len(self.sigma)

    @property
    def loglik(self) -> float:
        return -self.deviance / 2

    @property
    def aic(self) -> float:
        return self.deviance + 2 * self.npar

    @property
    def bic(self) -> float:
        return self.deviance + self.npar * math.log(self.n)


class Blocks:
    """H of one point, eliminated: ``order[0]`` is the factor with most levels, the others follow as one dense border."""

    def __init__(self, sigma: np.ndarray, weight: list[np.ndarray], cross: dict[tuple[int, int], np.ndarray], order: list[int]):
        self.order, self.sizes = order, [len(weight[r]) for r in order]
        self.a = 1.0 + sigma[order[0]] ** 2 * weight[order[0]]
        self.logdet = float(np.sum(np.log(self.a)))
        rest = order[1:]
        if not rest:
            return
        between = lambda r, s: sigma[r] * sigma[s] * (cross[r, s] if (r, s) in cross else cross[s, r].T)
        b = np.block([[np.diag(1.0 + sigma[r] ** 2 * weight[r]) if r == s else between(r, s) for s in rest] for r in rest])
        self.c = np.hstack([between(order[0], s) for s in rest])
        self.ca = self.c / self.a[:, None]
        schur = b - self.c.T @ self.ca
        self.inverse = np.linalg.inv(schur)
        self.logdet += float(np.linalg.slogdet(schur)[1])

    def _split(self, whole: np.ndarray) -> list[np.ndarray]:
        return np.split(whole, np.cumsum(self.sizes[1:])[:-1])

    def solve(self, rhs: list[np.ndarray]) -> list[np.ndarray]:
        """H^-1 times vectors, or matrices, cut by factor."""
        out: list = [None] * len(self.order)
        top = rhs[self.order[0]]
        if len(self.order) == 1:
            return [(top.T / self.a).T]
        low = self.inverse @ (np.concatenate([rhs[r] for r in self.order[1:]]) - self.ca.T @ top)
        out[self.order[0]] = ((top - self.c @ low).T / self.a).T
        for r, part in zip(self.order[1:], self._split(low), strict=True):
            out[r] = part
        return out

    def inverse_entries(self) -> tuple[list[np.ndarray], dict[tuple[int, int], np.ndarray]]:
        """Diagonal of the inverse per factor, and its blocks between factors."""
        diagonal: list = [None] * len(self.order)
        if len(self.order) == 1:
            return [1.0 / self.a], {}
        top, rest = self.order[0], self.order[1:]
        m = self.ca @ self.inverse
        diagonal[top] = 1.0 / self.a + np.sum(m * self.ca, 1)
        ends = np.cumsum([0, *self.sizes[1:]])
        off = {}
        for i, r in enumerate(rest):
            cut = slice(ends[i], ends[i + 1])
            diagonal[r] = np.diagonal(self.inverse)[cut].copy()
            off[top, r] = -m[:, cut]
            for j in range(i + 1, len(rest)):
                off[r, rest[j]] = self.inverse[cut, ends[j] : ends[j + 1]]
        return diagonal, {(min(r, s), max(r, s)): x if r < s else x.T for (r, s), x in off.items()}

    def products(self, diagonal: list[np.ndarray], off: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
        """tr(H^-1 A H^-1 B) of every two of k symmetric matrices, given by their diagonals (k x levels) and blocks between factors."""
        top, rest = self.order[0], self.order[1:]
        first = diagonal[top] / self.a
        out = first @ first.T
        if not rest:
            return out
        k = len(first)
        between = lambda r, s: off[r, s] if (r, s) in off else off[s, r].transpose(0, 2, 1)
        side = np.concatenate([between(top, s) for s in rest], 2)
        low = np.concatenate([np.concatenate([_diagonals(diagonal[r]) if r == s else between(r, s) for s in rest], 2) for r in rest], 1)
        moved = side - diagonal[top][:, :, None] * self.ca  # the same elimination as that of H
        twice = np.einsum("lr,kls->krs", self.ca, side + moved)
        low = low - (twice + twice.transpose(0, 2, 1)) / 2
        root = np.linalg.cholesky(self.inverse)
        moved = (moved @ root / np.sqrt(self.a)[:, None]).reshape(k, -1)
        low = (root.T @ low @ root).reshape(k, -1)
        return out + 2 * moved @ moved.T + low @ low.T


def _diagonals(rows: np.ndarray) -> np.ndarray:
    return rows[:, :, None] * np.eye(rows.shape[1])


@dataclass
class Points:
    """Parameters of K points and the modes of their group effects, with what a pass found there."""

    beta: np.ndarray  # K x p
    sigma: np.ndarray  # K x R
    u: list[np.ndarray]  # per factor K x levels
    deviance: np.ndarray | None = None
    blocks: list[Blocks] | None = None
    sums: tuple | None = None  # residuals and weights by level, weights by pair of levels

    def cut(self, rows) -> Points:
        return Points(self.beta[rows], self.sigma[rows], [u[rows] for u in self.u])


class GlmmData:
    """Encoded rows, the fixed part of the design (without aliased columns) and a first fit without group effects."""

    def __init__(self, df: DataFrame | None, spec: ModelSpec, design: Design | None = None, plain: Fit | None = None):
        """``design`` and ``plain``: those of a family of models, which closes its design itself."""
        if not spec.random:
            raise ValueError("a mixed model needs at least one random intercept")
        self.spec, self.own = spec, design is None
        self.design = design or Design(df, spec.response, spec.terms, groups=spec.random)
        self.grouped = self.design.collapsed
        self.plain = plain or fit_all(self.design, {"m": ModelSpec(spec.response, spec.terms)})[0]
        self.used = self.plain.used
        self.names = [self.design.columns[j][1] for j in self.used]
        self.levels = [self.design.levels[g] for g in spec.random]
        self.sizes = [len(v) for v in self.levels]
        self.order = sorted(range(len(self.sizes)), key=lambda r: -self.sizes[r])
        self.pairs = list(itertools.combinations(range(len(self.sizes)), 2))
        self.n, self.p, self.passes = self.design.n, len(self.used), 0

    def close(self) -> None:
        if self.own:
            self.design.close()

    def _sums(self, points: Points, size: int, at_row) -> np.ndarray:
        """``at_row(x, y, w, groups, k rows of eta, add)`` adds the sums of a block; ``size`` cells a point."""
        blocks, used = self.design.reader(), np.array(self.used)
        beta, sigma, u = points.beta, points.sigma, points.u
        k = len(beta)
        which = [self.design.groups.index(g) for g in self.spec.random]

        def add(batch, total):
            cells = total.reshape(k, size)
            for x, y, w, codes, _ in blocks(batch):
                z, groups = x[:, used], [codes[i] for i in which]
                eta = z @ beta.T
                for r, g in enumerate(groups):
                    eta += sigma[:, r] * u[r][:, g].T
                mu = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
                at_row(cells, z, y[:, None], w[:, None], groups, eta, mu)

        self.passes += 1
        return summed(self.design.frame, k * size, add).reshape(k, size)

    def _each(self, points: Points, size: int, work) -> list:
        """``work(some points)`` over all points, as many at a time as ``POINT_CELLS`` allows."""
        step = max(1, POINT_CELLS // size)
        return [work(points.cut(slice(i, i + step)), slice(i, i + step)) for i in range(0, len(points.beta), step)]

    def _level_sums(self, points: Points):
        """Log-likelihood, and residuals and weights added up by level and weights by pair of levels, for each point."""
        sizes, pairs = self.sizes, self.pairs
        at = np.cumsum([1, *sizes, *sizes, *[sizes[r] * sizes[s] for r, s in pairs]])
        m = len(sizes)

        def at_row(cells, z, y, w, groups, eta, mu):
            weight, residual = w * mu * (1.0 - mu), y - w * mu
            cells[:, 0] += np.sum(y * eta - w * np.logaddexp(0.0, eta), 0)
            for r, g in enumerate(groups):
                _add_by(cells, at[r], g, residual)
                _add_by(cells, at[m + r], g, weight)
            for i, (r, s) in enumerate(pairs):
                _add_by(cells, at[2 * m + i], groups[r].astype(np.int64) * sizes[s] + groups[s], weight)

        parts = self._each(points, int(at[-1]), lambda some, _: self._sums(some, int(at[-1]), at_row))
        cells = np.vstack(parts)
        cut = lambda i, n: cells[:, at[i] : at[i] + n]
        residual = [cut(r, sizes[r]) for r in range(m)]
        weight = [cut(m + r, sizes[r]) for r in range(m)]
        cross = [{p: cut(2 * m + i, sizes[p[0]] * sizes[p[1]])[k].reshape(sizes[p[0]], sizes[p[1]]) for i, p in enumerate(pairs)} for k in range(len(cells))]
        return cells[:, 0], residual, weight, cross

    def at_modes(self, points: Points, limit: int = 60) -> Points:
        """Move the group effects of all points to their modes (Newton) and set their deviances."""
        k, last, old = len(points.beta), np.full(len(points.beta), -np.inf), [u.copy() for u in points.u]
        for _ in range(limit):
            ll, residual, weight, cross = self._level_sums(points)
            value = ll - sum(np.sum(u * u, 1) for u in points.u) / 2
            worse = value < last - 1e-9 * (1 + np.abs(last))
            blocks = [Blocks(points.sigma[i], [w[i] for w in weight], cross[i], self.order) for i in range(k)]
            largest = 0.0
            for i in range(k):
                if worse[i]:
                    for r, u in enumerate(points.u):
                        u[i] = (u[i] + old[r][i]) / 2
                    largest = np.inf
                    continue
                last[i] = value[i]
                step = blocks[i].solve([points.sigma[i, r] * residual[r][i] - points.u[r][i] for r in range(len(self.sizes))])
                size = max(float(np.abs(x).max(initial=0.0)) for x in step)
                largest = max(largest, size)
                if size >= MODE_STEP:
                    for r, u in enumerate(points.u):
                        old[r][i] = u[i]
                        u[i] = u[i] + step[r]
            if largest < MODE_STEP:
                break
        points.blocks, points.sums = blocks, (residual, weight, cross)
        points.deviance = -2 * value + np.array([b.logdet for b in blocks])
        return points

    def _crossed(self, weight: list[np.ndarray], cross: dict[tuple[int, int], np.ndarray], by_level: list[np.ndarray]) -> list[np.ndarray]:
        """Z' W Z times a matrix with a row per level."""
        out = [w[:, None] * x for w, x in zip(weight, by_level, strict=True)]
        for r, s in self.pairs:
            out[r] = out[r] + cross[r, s] @ by_level[s]
            out[s] = out[s] + cross[r, s].T @ by_level[r]
        return out

    def gradients(self, points: Points) -> np.ndarray:
        """Gradient of the deviance over (beta, sigma) at points whose effects are at their modes."""
        return np.stack([self.derivatives(points, i)[0] for i in range(len(points.beta))])

    def derivatives(self, points: Points, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the deviance over (beta, sigma) at one of the points, whose effects are at their modes.

        With e the derivative of a row's eta (its modes moving along) and h = z' H^-1 z (z times sigma), the deviance has the gradient
        -2 sum residual d + sum w' h e + 2 sum w reach, where d is the part of e at fixed modes and reach the entry of H^-1 z at a factor's level.
        """
        sizes, pairs, p, m = self.sizes, self.pairs, self.p, len(self.sizes)
        k, one = p + m, points.cut(slice(at, at + 1))
        sigma, u, block = one.sigma[0], [x[0] for x in one.u], points.blocks[at]
        residual, weight, cross = [x[at] for x in points.sums[0]], [x[at] for x in points.sums[1]], points.sums[2][at]
        diagonal, off = block.inverse_entries()
        ends = np.cumsum([0, *sizes])
        levels = int(ends[-1])

        def reach(groups):
            """Entries of H^-1 z of a row at its level of each factor."""
            out = [sigma[r] * diagonal[r][g] for r, g in enumerate(groups)]
            for r, s in pairs:
                both = off[r, s][groups[r], groups[s]]
                out[r] = out[r] + sigma[s] * both
                out[s] = out[s] + sigma[r] * both
            return out

        # Sums per level: of w x, and of w' h.
        parts, step = [], max(1, POINT_CELLS // levels - 1)
        for lo in range(0, p, step):
            n = min(step, p - lo)

            def by_level(cells, z, y, w, groups, eta, mu, lo=lo, n=n):
                wx = w * mu * (1.0 - mu)
                h = sum(sigma[r] * x for r, x in enumerate(reach(groups)))
                values = np.hstack([wx * z[:, lo : lo + n], wx * (1.0 - 2.0 * mu) * h[:, None]])
                total = cells.reshape(n + 1, levels)
                for r, g in enumerate(groups):
                    _add_by(total, ends[r], g, values)

            parts.append(self._sums(one, (n + 1) * levels, by_level).reshape(n + 1, levels))
        cut = lambda x: [x[..., ends[r] : ends[r + 1]] for r in range(m)]
        curved = cut(parts[0][-1])
        weighted = [x.T for x in cut(np.vstack([x[:-1] for x in parts]))]
        scale = lambda by: [s * x for s, x in zip(sigma, by, strict=True)]
        # Z' W d, the moves of the modes, Z' W e.
        own = [np.zeros((size, m)) for size in sizes]
        for r in range(m):
            own[r][:, r] = u[r]
        fixed = [np.hstack(x) for x in zip(weighted, self._crossed(weight, cross, own), strict=True)]
        right = [-x for x in scale(fixed)]
        for r in range(m):
            right[r][:, p + r] += residual[r]
        moves = block.solve(right)
        whole = [x + y for x, y in zip(fixed, self._crossed(weight, cross, scale(moves)), strict=True)]
        v = block.solve(scale(curved))
        sv = self._crossed(weight, cross, [x[:, None] for x in scale(v)])

        # Products of the rows' derivatives, and their sums per level and pair of levels.
        shapes = [(k, k), (k, k), (k,), (k,), (m, k)]
        places = np.cumsum([0, *[math.prod(x) for x in shapes]])
        joint = [sizes[r] * sizes[s] for r, s in pairs]
        starts = np.cumsum([0, *sizes, *joint])
        step = max(1, POINT_CELLS // int(starts[-1]))
        sums, changes = None, []
        for lo in range(0, k, step):
            n = min(step, k - lo)
            head = int(places[-1]) if lo == 0 else 0

            def rows(cells, z, y, w, groups, eta, mu, lo=lo, n=n, head=head):
                mu, w, y = mu[:, 0], w[:, 0], y[:, 0]
                d = np.hstack([z, np.stack([x[g] for x, g in zip(u, groups, strict=True)], 1)])
                e = d + sum(sigma[r] * moves[r][g] for r, g in enumerate(groups))
                weights = w * mu * (1.0 - mu)
                first = weights * (1.0 - 2.0 * mu)
                if head:
                    near = reach(groups)
                    h = sum(sigma[r] * x for r, x in enumerate(near))
                    second = weights * (1.0 - 6.0 * mu * (1.0 - mu)) * h - first * sum(sigma[r] * v[r][g] for r, g in enumerate(groups))
                    found = [d.T @ (e * weights[:, None]), e.T @ (e * second[:, None]), (y - w * mu) @ d, (first * h) @ e, np.stack([(first * x) @ e for x in near])]
                    cells[0, :head] += np.concatenate([x.ravel() for x in found])
                values = e[:, lo : lo + n] * first[:, None]
                total = cells[0, head:].reshape(n, -1)
                for r, g in enumerate(groups):
                    _add_by(total, starts[r], g, values)
                for i, (r, s) in enumerate(pairs):
                    _add_by(total, starts[m + i], groups[r].astype(np.int64) * sizes[s] + groups[s], values)

            found = self._sums(one, head + n * int(starts[-1]), rows)[0]
            if head:
                sums = [found[a:b].reshape(x) for a, b, x in zip(places, places[1:], shapes, strict=False)]
            changes.append(found[head:].reshape(n, -1))
        change = np.vstack(changes)
        moments, bends, plain, tilt, near = sums
        traces = np.diag([float(weight[r] @ diagonal[r]) for r in range(m)])
        for r, s in pairs:
            traces[r, s] = traces[s, r] = float(np.sum(cross[r, s] * off[r, s]))
        gradient = tilt - 2 * plain
        gradient[p:] += 2 * traces @ sigma
        hessian = 2 * moments + bends
        for r in range(m):
            hessian[p + r] -= 2 * residual[r] @ moves[r]
            row = 2 * near[r] + (curved[r] - sv[r][:, 0]) @ moves[r] - v[r] @ whole[r]
            hessian[p + r] += row
            hessian[:, p + r] += row
        hessian[p:, p:] += 2 * traces
        # Derivatives of H itself.
        diagonals = [sigma[r] ** 2 * change[:, starts[r] : starts[r + 1]] for r in range(m)]
        between = {(r, s): sigma[r] * sigma[s] * change[:, starts[m + i] : starts[m + i + 1]].reshape(k, sizes[r], sizes[s]) for i, (r, s) in enumerate(pairs)}
        for r in range(m):
            diagonals[r][p + r] += 2 * sigma[r] * weight[r]
        for r, s in pairs:
            between[r, s][p + r] += sigma[s] * cross[r, s]
            between[r, s][p + s] += sigma[r] * cross[r, s]
        hessian -= block.products(diagonals, between)
        self.moves = moves
        return gradient, (hessian + hessian.T) / 2

    def points(self, beta: np.ndarray, sigma: np.ndarray, u: list[np.ndarray] | None = None) -> Points:
        beta, sigma = np.atleast_2d(beta).astype(float), np.atleast_2d(sigma).astype(float)
        k = len(beta)
        return Points(beta, sigma, [np.zeros((k, n)) if u is None else np.tile(u[r], (k, 1)) for r, n in enumerate(self.sizes)])

    def deviance_at(self, beta: np.ndarray, sigma: np.ndarray) -> np.ndarray:
        """Laplace deviance of each point."""
        return self.at_modes(self.points(beta, sigma)).deviance


def _add_by(cells: np.ndarray, first: int, code: np.ndarray, values: np.ndarray) -> None:
    """Add the rows of ``values`` (rows x points) into the cells ``first + code`` of each point."""
    order = np.argsort(code, kind="stable")
    found, start = np.unique(code[order], return_index=True)
    cells[:, first + found] += np.add.reduceat(values[order], start, axis=0).T


def _start(d: GlmmData) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the plain fit, and the sigmas of the grid that suit its residuals and weights by level best (a quadratic likelihood)."""
    beta = d.plain.beta[d.used]
    _, residual, weight, cross = d._level_sums(d.points(beta, np.zeros(len(d.sizes))))
    weights, scores = [w[0] for w in weight], [x[0] for x in residual]

    def deviance(sigma):
        block, right = Blocks(sigma, weights, cross[0], d.order), [s * x for s, x in zip(sigma, scores, strict=True)]
        return block.logdet - sum(float(x @ y) for x, y in zip(right, block.solve(right), strict=True))

    return beta, np.maximum(min((np.array(g) for g in itertools.product(GRID, repeat=len(d.sizes))), key=deviance), 0.05)


def fit_glmm(df: DataFrame, spec: ModelSpec) -> GlmmFit:
    """Random-intercept logistic model (M9, M10): the joint minimum of the Laplace deviance over (beta, sigma).

    A sigma that falls to 0, where the deviance is not larger, stays 0 (``singular``).
    """
    return fit_glmms(df, {"m": spec})["m"]


def fit_glmms(df: DataFrame, specs: Mapping[str, ModelSpec]) -> dict[str, GlmmFit]:
    """Mixed models of one response on their common complete rows, which are encoded once."""
    response = {s.response for s in specs.values()}
    if len(response) != 1:
        raise ValueError("the models need the same response")
    merged = lambda lists: list(dict.fromkeys(v for x in lists for v in x))
    design = Design(df, response.pop(), merged(s.terms for s in specs.values()), groups=merged(s.random for s in specs.values()))
    try:
        plain = fit_all(design, {k: ModelSpec(s.response, s.terms) for k, s in specs.items()})
        with ThreadPoolExecutor(len(specs)) as pool:  # the passes of one model leave cores idle where the rows are few
            parts = [pool.submit(inheritable_thread_target(df.sparkSession)(_fit), GlmmData(None, s, design, f)) for s, f in zip(specs.values(), plain, strict=True)]
            return {k: part.result() for k, part in zip(specs, parts, strict=True)}
    finally:
        design.close()


def _fit(d: GlmmData) -> GlmmFit:
    spec = d.spec
    beta, sigma = _start(d)
    m, p, u, moves = len(sigma), d.p, None, None
    free = [True] * m
    before, best = None, math.inf
    converged, cov = False, np.full((p, p), np.nan)
    for _ in range(STEPS):
        points = d.at_modes(d.points(beta, sigma, u))
        if points.deviance[0] > best + GAIN + NOISE * abs(best) and before is not None:  # the step went too far
            beta, sigma = (beta + before[0]) / 2, (sigma + before[1]) / 2
            u = before[2]
            continue
        u = [x[0].copy() for x in points.u]
        best, before = float(points.deviance[0]), (beta.copy(), sigma.copy(), u)
        live = [r for r in range(m) if free[r]]
        keep = [*range(p), *[p + r for r in live]]
        gradient, hessian = d.derivatives(points)
        gradient, hessian, moves = gradient[keep], hessian[np.ix_(keep, keep)], d.moves
        values, vectors = np.linalg.eigh(hessian)
        bent = np.maximum(np.abs(values), 1e-8 * np.abs(values).max())
        step = -vectors @ ((vectors.T @ gradient) / bent)
        gain = -float(gradient @ step) / 2
        if values.min() > 0:
            cov = 2 * np.linalg.inv(hessian)[:p, :p]
        old = sigma.copy()
        beta = beta + step[:p]
        if gain < GAIN and values.min() > 0:
            sigma[live] = np.maximum(sigma[live] + step[p:], 0.0)
            converged = bool(sigma.max() < LARGEST_SIGMA)
            break
        for i, r in enumerate(live):
            new = sigma[r] + step[p + i]
            if new < SMALL_SIGMA:
                tried = np.tile(sigma, (2, 1))
                tried[:, r] = 0.0, max(sigma[r] / 4, SMALL_SIGMA / 4)
                dev = d.at_modes(d.points(np.tile(beta, (2, 1)), tried, u)).deviance
                new = tried[int(dev[1] < dev[0] - GAIN - NOISE * abs(dev[0])), r]
                free[r] = bool(new > 0)
                before, best = None, math.inf
            sigma[r] = min(new, 4 * max(sigma[r], 0.25))
        moved = np.concatenate([step[:p], sigma - old])
        u = [x + y @ moved for x, y in zip(u, moves, strict=True)]  # where the modes are about to be
    last = d.at_modes(d.points(beta, sigma, u))
    effects = [sigma[r] * last.u[r][0] for r in range(m)]
    with np.errstate(invalid="ignore"):
        se = np.sqrt(np.diagonal(cov))
    return GlmmFit(spec, d.names, beta, se, sigma, list(spec.random), d.levels, effects, float(last.deviance[0]), d.n, d.passes, converged, bool((sigma == 0).any()))


def conditional_modes(df: DataFrame, spec: ModelSpec, beta: Mapping[str, float], sigma: Sequence[float]) -> tuple[list[tuple[str, str, float]], float]:
    """(factor, level, effect) of every level at given parameters (by coefficient name; others 0), and the Laplace deviance there."""
    d = GlmmData(df, spec)
    try:
        at = d.at_modes(d.points(np.array([beta.get(n, 0.0) for n in d.names]), np.array(sigma)))
        rows = [(g, level, float(sigma[r] * at.u[r][0, i])) for r, g in enumerate(spec.random) for i, level in enumerate(d.levels[r])]
        return rows, float(at.deviance[0])
    finally:
        d.close()


def random_table(spark: SparkSession, fit: GlmmFit) -> DataFrame:
    """Effect of every level of every random factor."""
    rows = [(g, level, float(e)) for g, levels, u in zip(fit.groups, fit.levels, fit.u, strict=True) for level, e in zip(levels, u, strict=True)]
    return spark.createDataFrame(rows, "group string, level string, effect double")


def fixed_table(spark: SparkSession, fit: GlmmFit, model: str | None = None) -> DataFrame:
    """Fixed effects with Wald z and p."""
    rows = []
    for t, b, s in zip(fit.terms, fit.beta, fit.se, strict=True):
        z = b / s
        r = {"term": t, "estimate": float(b), "std_error": float(s), "statistic": float(z), "p_value": normal_two_sided_p(z)}
        rows.append({"model": model, **r} if model else r)
    schema = ("model string, " if model else "") + "term string, estimate double, std_error double, statistic double, p_value double"
    return spark.createDataFrame(rows, schema)


def variance_table(spark: SparkSession, fit: GlmmFit, model: str | None = None) -> DataFrame:
    """Variance components and fit statistics."""
    rows = []
    for g, s, lv in zip(fit.groups, fit.sigma, fit.levels):
        r = {"group": g, "n_levels": len(lv), "variance": float(s * s), "sd": float(s), "loglik": fit.loglik,
             "aic": fit.aic, "bic": fit.bic, "deviance": fit.deviance, "n": fit.n, "converged": fit.converged, "singular": fit.singular}
        rows.append({"model": model, **r} if model else r)
    schema = ("model string, " if model else "") + "group string, n_levels int, variance double, sd double, loglik double, aic double, bic double, deviance double, n bigint, converged boolean, singular boolean"
    return spark.createDataFrame(rows, schema)


def lr_compare(spark: SparkSession, fits: dict[str, GlmmFit]) -> DataFrame:
    """``anova(h1, h2, ...)`` for mixed models: npar, AIC, BIC, logLik, deviance,
    chi-square of consecutive models and its p (M12). Models are ordered by npar."""
    items = sorted(fits.items(), key=lambda kv: kv[1].npar)
    rows, prev = [], None
    for name, f in items:
        r = {"model": name, "npar": f.npar, "aic": f.aic, "bic": f.bic, "loglik": f.loglik, "deviance": f.deviance,
             "chisq": None, "df": None, "p_value": None}
        if prev is not None:
            chisq = prev.deviance - f.deviance
            ddf = f.npar - prev.npar
            r.update({"chisq": chisq, "df": ddf, "p_value": chi2_sf(max(chisq, 0.0), ddf) if ddf > 0 else None})
        rows.append(r)
        prev = f
    return spark.createDataFrame(rows, "model string, npar int, aic double, bic double, loglik double, deviance double, chisq double, df int, p_value double")


def common_rows(df: DataFrame, specs: Sequence[ModelSpec]) -> DataFrame:
    cols: list[str] = []
    for s in specs:
        for v in s.variables:
            if v not in cols:
                cols.append(v)
    return df.select(*cols).dropna("any")
