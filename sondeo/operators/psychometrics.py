"""Reliability and classical item statistics (K1-K5).

Moments of all items come from one kind of pass: each task adds up, for every pair of items, how many rows answer both and
the sums and products over those rows (pairwise complete, like ``cov(use="pairwise")``), and Spark sums the cells of all tasks
(``partials.summed``). The plan has the same size for 4 and for 40 items, and only the k x k sums reach the
driver, where the closed-form coefficients are computed with numpy and returned as small DataFrames.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col
from .partials import summed


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _answers(batch: pa.RecordBatch, items: Sequence[str]) -> np.ndarray:
    """Rows x items as doubles, NaN where not answered."""
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in items], 1)


@dataclass
class Moments:
    """Pairwise sums of the columns i, j of a table over the rows that have both: counts n, sums and sums of squares of i, products.
    The columns are centred near their means before multiplying, which changes no moment and keeps the digits."""

    n: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    products: np.ndarray
    centre: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            c = (self.products - self.sums * self.sums.T / self.n) / (self.n - 1)
        c[self.n < 2] = np.nan
        return c

    def spread(self) -> np.ndarray:
        """Sum of squares of i about its mean over the rows that have j."""
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.squares - self.sums**2 / self.n

    @property
    def correlation(self) -> np.ndarray:
        d = self.spread()
        with np.errstate(invalid="ignore", divide="ignore"):
            return (self.products - self.sums * self.sums.T / self.n) / np.sqrt(d * d.T)

    def mean(self, i: int) -> float | None:
        return float(self.centre[i] + self.sums[i, i] / self.n[i, i]) if self.n[i, i] else None

    def sd(self, i: int) -> float | None:
        return float(np.sqrt(self.covariance[i, i])) if self.n[i, i] > 1 else None


def _tables(scales: Mapping[str, Sequence[str]], missing: str):
    """A function from a batch to one table per scale: its items, then the total of a row."""
    items = {s: list(v) for s, v in scales.items()}

    def of(batch: pa.RecordBatch):
        for v in items.values():
            x = _answers(batch, v)
            if missing is None:
                yield x
                continue
            total = np.nansum(x, 1)
            if missing == "complete":
                total[np.isnan(x).any(1)] = np.nan
            yield np.column_stack([x, total])

    return of


def pairwise_moments(df: DataFrame, scales: Mapping[str, Sequence[str]], missing: str | None = None) -> dict[str, Moments]:
    """Moments of every scale's items (and, with ``missing``, of the row totals after them), in two passes over the rows: means, then products."""
    names = list(dict.fromkeys(i for v in scales.values() for i in v))
    data = df.select(*[col(i).cast("double").alias(i) for i in names])
    widths = [len(v) + (missing is not None) for v in scales.values()]
    tables = _tables(scales, missing)
    first = np.cumsum([0, *[2 * k for k in widths]])

    def means(batch, total):
        for at, x in zip(first, tables(batch), strict=False):
            k = x.shape[1]
            total[at : at + k] += np.nansum(x, 0)
            total[at + k : at + 2 * k] += (~np.isnan(x)).sum(0)

    sums = summed(data, int(first[-1]), means)
    centres = [np.round(sums[at : at + k] / np.maximum(sums[at + k : at + 2 * k], 1)) for at, k in zip(first, widths, strict=False)]
    second = np.cumsum([0, *[4 * k * k for k in widths]])

    def products(batch, total):
        for at, centre, x in zip(second, centres, tables(batch), strict=False):
            k = x.shape[1]
            there = ~np.isnan(x)
            z = np.where(there, x - centre, 0.0)
            m = there.astype(float)
            cells = total[at : at + 4 * k * k].reshape(4, k, k)
            cells += np.stack([m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z])

    cells = summed(data, int(second[-1]), products)
    return {s: Moments(*cells[at : at + 4 * k * k].reshape(4, k, k), c) for s, at, k, c in zip(scales, second, widths, centres, strict=False)}


def covariance_matrix(df: DataFrame, items: Sequence[str]) -> np.ndarray:
    """Pairwise-complete sample covariance matrix of ``items``."""
    return pairwise_moments(df, {"_": list(items)})["_"].covariance


def _alpha(c: np.ndarray) -> float | None:
    """Raw alpha of a covariance matrix; undefined (None) below two items."""
    k = c.shape[0]
    if k < 2:
        return None
    return float(k / (k - 1) * (1 - np.trace(c) / c.sum()))


def _cor(c: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.diag(c))
    return c / np.outer(d, d)


def _avg_r(r: np.ndarray) -> float:
    k = r.shape[0]
    return (r.sum() - np.trace(r)) / (k * (k - 1))


def detect_reversed(c: np.ndarray) -> np.ndarray:
    """Keys from the first principal component of the correlation matrix:
    -1 for items whose loading has the minority sign (``check.keys``)."""
    r = _cor(c)
    vals, vecs = np.linalg.eigh(r)
    load = vecs[:, np.argmax(vals)]
    if load.sum() < 0:
        load = -load
    return np.where(load < 0, -1.0, 1.0)


def alpha_table(c: np.ndarray, keys: np.ndarray | None = None) -> dict[str, float]:
    if keys is not None:
        c = c * np.outer(keys, keys)
    k = c.shape[0]
    r = _cor(c)
    rbar = _avg_r(r)
    return {
        "raw_alpha": _alpha(c),
        "std_alpha": float(k * rbar / (1 + (k - 1) * rbar)),
        "average_r": float(rbar),
        "s_n": float(k * rbar / (1 - rbar)),
        "n_items": k,
    }


def cronbach_alpha(spark: SparkSession, df: DataFrame, items: Sequence[str], check_keys: bool = True, keys: Sequence[int] | None = None) -> DataFrame:
    """``psych::alpha(items, check.keys=...)`` summary row (K1).

    ``reversed`` lists the items whose sign was flipped (automatically from the
    first principal component, or by explicit ``keys``).
    """
    c = covariance_matrix(df, items)
    kv = np.array(keys, dtype=float) if keys is not None else (detect_reversed(c) if check_keys else np.ones(len(items)))
    row = alpha_table(c, kv)
    row["reversed"] = ",".join(it for it, s in zip(items, kv) if s < 0)
    schema = "raw_alpha double, std_alpha double, average_r double, s_n double, n_items int, reversed string"
    return spark.createDataFrame([row], schema)


def alpha_if_dropped(spark: SparkSession, df: DataFrame, items: Sequence[str], check_keys: bool = True, keys: Sequence[int] | None = None) -> DataFrame:
    """Alpha without each item and the item-rest correlation ``r.drop`` (K2)."""
    c = covariance_matrix(df, items)
    kv = np.array(keys, dtype=float) if keys is not None else (detect_reversed(c) if check_keys else np.ones(len(items)))
    cc = c * np.outer(kv, kv)
    rows = []
    total = cc.sum()
    for i, it in enumerate(items):
        keep = [j for j in range(len(items)) if j != i]
        sub = cc[np.ix_(keep, keep)]
        t = alpha_table(sub)
        cov_rest = cc[i].sum() - cc[i, i]
        var_rest = total - 2 * cc[i].sum() + cc[i, i]
        rows.append({
            "item": it,
            "raw_alpha": t["raw_alpha"],
            "std_alpha": t["std_alpha"],
            "average_r": t["average_r"],
            "r_drop": float(cov_rest / np.sqrt(cc[i, i] * var_rest)),
        })
    return spark.createDataFrame(rows, "item string, raw_alpha double, std_alpha double, average_r double, r_drop double")


def alpha_item_stats(spark: SparkSession, df: DataFrame, items: Sequence[str], check_keys: bool = True) -> DataFrame:
    """``psych::alpha()$item.stats`` (K2): answers, correlation of each item with the raw and with the standardised total, with the
    total of the others, mean and sd. Reversed items are mirrored about the range of all answers, as there."""
    m = pairwise_moments(df, {"_": list(items)})["_"]
    c = m.covariance
    keys = detect_reversed(c) if check_keys else np.ones(len(items))
    c = c * np.outer(keys, keys)
    r = _cor(c)
    ends = df.agg(F.min(F.least(*[col(i) for i in items])).alias("lo"), F.max(F.greatest(*[col(i) for i in items])).alias("hi")).first()
    rows = []
    for i, it in enumerate(items):
        rest = c.sum() - 2 * c[i].sum() + c[i, i]
        mean = m.mean(i)
        rows.append((
            it, int(m.n[i, i]), float(c[i].sum() / np.sqrt(c[i, i] * c.sum())), float(r[i].sum() / np.sqrt(r.sum())),
            float((c[i].sum() - c[i, i]) / np.sqrt(c[i, i] * rest)), mean if keys[i] > 0 else float(ends["lo"] + ends["hi"] - mean), m.sd(i),
        ))
    return spark.createDataFrame(rows, "item string, n bigint, raw_r double, std_r double, r_drop double, mean double, sd double")


def category_counts(df: DataFrame, items: Sequence[str], categories: Sequence[int]) -> tuple[int, np.ndarray]:
    """Rows, and per item the rows of each category and, last, of any answer; one pass."""
    items, values = list(items), list(categories)
    width = len(values) + 1

    def add(batch, total):
        total[0] += batch.num_rows
        cells = total[1:].reshape(len(items), width)
        x = _answers(batch, items)
        for j, v in enumerate(values):
            cells[:, j] += (x == v).sum(0)
        cells[:, -1] += (~np.isnan(x)).sum(0)

    sums = summed(df.select(*[col(i).cast("double").alias(i) for i in items]), 1 + len(items) * width, add)
    return int(sums[0]), sums[1:].reshape(len(items), width).astype(np.int64)


def item_proportions(spark: SparkSession, df: DataFrame, scales: Mapping[str, Sequence[str]], categories: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """Share of each answer category and of missing answers per item (K3, ``proportions``), without the other statistics."""
    names = list(dict.fromkeys(i for v in scales.values() for i in v))
    n, counts = category_counts(df, names, categories)
    at = {i: k for k, i in enumerate(names)}
    rows = [(s, i, *[float(c / n) if n else None for c in counts[at[i], :-1]], float((n - counts[at[i], -1]) / n) if n else None) for s, v in scales.items() for i in v]
    schema = T.StructType([T.StructField("scale", T.StringType()), T.StructField("item", T.StringType()), *[T.StructField(f"p{c}", T.DoubleType()) for c in categories], T.StructField("p_na", T.DoubleType())])
    return spark.createDataFrame(rows, schema)


def itemstats(
    spark: SparkSession,
    df: DataFrame,
    scales: Mapping[str, Sequence[str]],
    categories: Sequence[int] = (1, 2, 3, 4),
    missing: str = "sum_available",
) -> dict[str, DataFrame]:
    """Classical item statistics of several scales (K3, ``mirt::itemstats``).

    Pairwise moments of the items and the in-row total of every scale, and the
    category counts, give the tables ``overall``, ``items`` and ``proportions``, keyed by ``scale``.
    ``missing="sum_available"`` totals the answered items of a row
    (the saved scores); ``"complete"`` leaves the total missing unless every
    item of the scale is answered.
    """
    if missing not in ("sum_available", "complete"):
        raise ValueError("missing must be 'sum_available' or 'complete'")
    moments = pairwise_moments(df, scales, missing)
    names = list(dict.fromkeys(i for v in scales.values() for i in v))
    n_rows, counts = category_counts(df, names, categories)
    at = {i: k for k, i in enumerate(names)}
    complete = df.agg(*[F.count_if(_all_answered(v)).alias(f"c{k}") for k, v in enumerate(scales.values())]).first()
    # K (distinct answers per item) follows from the category counts when every answer is one of ``categories``.
    distinct = {i: int((counts[at[i], :-1] > 0).sum()) for i in names}
    odd = [i for i in names if counts[at[i], :-1].sum() != counts[at[i], -1]]
    if odd:
        distinct.update(df.agg(*[F.count_distinct(col(i)).alias(i) for i in odd]).first().asDict())
    overall, rows = [], []
    for number, (s, items) in enumerate(scales.items()):
        m, k = moments[s], len(items)
        c, r = m.covariance[:k, :k], m.correlation
        off = r[:k, :k][np.triu_indices(k, 1)]
        alpha, sd = _alpha(c), m.sd(k)
        overall.append({
            "scale": s, "n_complete": complete[f"c{number}"], "n": n_rows, "mean_total": m.mean(k), "sd_total": sd,
            "ave_r": float(off.mean()) if off.size else None, "sd_r": float(off.std(ddof=1)) if off.size > 1 else None,
            "alpha": alpha, "sem_alpha": float(sd * np.sqrt(1 - alpha)) if alpha is not None and sd is not None else None,
        })
        spread, product = m.spread(), m.products - m.sums * m.sums.T / np.maximum(m.n, 1)
        for i, it in enumerate(items):
            keep = [j for j in range(k) if j != i]
            # The rest is total - item over the rows that have the item.
            rest = spread[k, i] - 2 * product[i, k] + spread[i, k]
            rows.append({
                "scale": s, "item": it, "n": int(m.n[i, i]), "k": distinct[it], "mean": m.mean(i), "sd": m.sd(i),
                "total_r": float(r[i, k]), "total_r_if_rm": float((product[i, k] - spread[i, k]) / np.sqrt(spread[i, k] * rest)) if k > 1 else None,
                "alpha_if_rm": _alpha(c[np.ix_(keep, keep)]),
            })
    ov_schema = "scale string, n_complete bigint, n bigint, mean_total double, sd_total double, ave_r double, sd_r double, alpha double, sem_alpha double"
    it_schema = "scale string, item string, n bigint, k bigint, mean double, sd double, total_r double, total_r_if_rm double, alpha_if_rm double"
    return {"overall": spark.createDataFrame(overall, ov_schema), "items": spark.createDataFrame(rows, it_schema), "proportions": item_proportions(spark, df, scales, categories)}


def _all_answered(items: Sequence[str]):
    out = F.lit(True)
    for i in items:
        out = out & col(i).isNotNull()
    return out


def correlation_long(df: DataFrame, columns: Sequence[str], a: str = "scale_a", b: str = "scale_b", r: str = "r") -> DataFrame:
    """Pearson correlation matrix of ``columns`` in long form (K5). One aggregate, lazy."""
    k = len(columns)
    wide = df.agg(*[F.corr(col(columns[i]).cast("double"), col(columns[j]).cast("double")).alias(f"r{i}_{j}") for i, j in _pairs(k)])
    structs = []
    for i in range(k):
        for j in range(k):
            lo, hi = min(i, j), max(i, j)
            structs.append(F.struct(F.lit(columns[i]).alias(a), F.lit(columns[j]).alias(b), col(f"r{lo}_{hi}").alias(r)))
    return wide.select(F.inline(F.array(*structs)))
