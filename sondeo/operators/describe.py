"""Numeric summaries: ``summary()`` and ``psych::describe()``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, key_order
from .linkage import join_null_safe

_G = "__g"


def _groups(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Group keys; a whole-table summary uses one literal key so every step stays an equi-join."""
    if by:
        return df, list(by)
    return df.withColumn(_G, F.lit(0)), [_G]


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach per-group statistics to rows. Whole-table statistics (the
    literal key) become scalar subqueries -- merged into one aggregate job by
    Catalyst -- instead of a join on a constant key."""
    if list(keys) == [_G]:
        return left.withColumns({c: right.select(col(c)).scalar() for c in right.columns if c != _G})
    return join_null_safe(left, right, keys)


def summary_numeric(df: DataFrame, value: str, by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """min, 1st quartile, median, mean, 3rd quartile, max and NA count.

    Quartiles interpolate linearly (R type 7). ``percentile`` keeps a
    value->count map per group, so memory follows the number of distinct
    values; ``approx=True`` switches to ``percentile_approx`` for continuous
    columns with very many distinct values.
    """
    v = col(value)
    probs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    q = F.percentile_approx(v, probs, 10000) if approx else F.percentile(v, probs)
    agg = df.groupBy(*[col(b) for b in by]).agg(
        F.min(v).cast("double").alias("min"),
        q.alias("__q"),
        F.avg(v).alias("mean"),
        F.max(v).cast("double").alias("max"),
        F.count_if(v.isNull()).alias("n_na"),
    )
    out = agg.select(
        *[col(b) for b in by], "min",
        col("__q")[0].cast("double").alias("q1"), col("__q")[1].cast("double").alias("median"), "mean",
        col("__q")[2].cast("double").alias("q3"), "max", "n_na",
    )
    return out.orderBy(*key_order(by)) if by else out


def describe(df: DataFrame, value: str, by: Sequence[str] = (), trim: float = 0.1) -> DataFrame:
    """``psych::describe`` (type 3 skew/kurtosis).

    Three small per-group tables joined on the group keys:
    moments and median; MAD = 1.4826 * median |x - median| (rows joined to their
    group median); trimmed mean from the (value, count) table with cumulative
    counts per group -- the window runs over distinct values, not rows, which
    suits the discrete scores and ages it is used on.
    """
    base = df.where(col(value).isNotNull())
    base, keys = _groups(base, by)
    v = col(value).cast("double")
    mom = base.groupBy(*[col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.percentile(v, F.lit(0.5)).alias("median"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.skewness(v).alias("__g1"),
        F.kurtosis(v).alias("__g2"),
    )
    med = mom.select(*[col(k) for k in keys], col("median").alias("__med"))
    dev = _join(base, med, keys).groupBy(*[col(k) for k in keys]).agg(
        (F.percentile(F.abs(v - col("__med")), F.lit(0.5)) * F.lit(1.4826)).alias("mad")
    )
    vc = base.groupBy(*[col(k) for k in keys], v.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(col("__v")).rowsBetween(Window.unboundedPreceding, 0)
    vc = vc.withColumn("__cum", F.sum(col("__c")).over(w))
    nn = mom.select(*[col(k) for k in keys], col("n").alias("__n"))
    vc = _join(vc, nn, keys)
    lo = F.floor(col("__n") * F.lit(trim)) + 1
    hi = col("__n") + 1 - lo
    first = F.greatest(col("__cum") - col("__c") + 1, lo)
    last = F.least(col("__cum"), hi)
    take = F.greatest(last - first + 1, F.lit(0))
    trimmed = vc.groupBy(*[col(k) for k in keys]).agg(
        (F.sum(col("__v") * take) / F.sum(take)).alias("trimmed")
    )
    n = col("n").cast("double")
    out = _join(_join(mom, dev, keys), trimmed, keys).select(
        *[col(k) for k in keys if k != _G],
        col("n"), col("mean"), col("sd"), col("median"), col("trimmed"), col("mad"), col("min"), col("max"),
        (col("max") - col("min")).alias("range"),
        (col("__g1") * F.pow((n - 1) / n, 1.5)).alias("skew"),
        ((col("__g2") + 3) * F.pow(1 - 1 / n, 2) - 3).alias("kurtosis"),
        (col("sd") / F.sqrt(n)).alias("se"),
    )
    return out.orderBy(*key_order(by)) if by else out
