"""Numbers behind the plots: box statistics, density curves, regression lines,
trajectories (V1-V4). Drawing is out of scope."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, key_order
from .linkage import join_null_safe

_G = "__g"


def _groups(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
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


def box_stats(df: DataFrame, value: str, by: Sequence[str], coef: float = 1.5) -> DataFrame:
    """Box-plot statistics per group (V1): quartiles (type 7), whisker ends
    (most extreme values within ``coef`` x IQR of the box) and outlier count.

    Pass 1 aggregates quartiles per group; pass 2 joins rows to their group's
    fences (a small table, broadcast by AQE) and aggregates again.
    """
    base = df.where(col(value).isNotNull())
    base, keys = _groups(base, by)
    v = col(value).cast("double")
    q = base.groupBy(*[col(k) for k in keys]).agg(
        F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__q"), F.count(F.lit(1)).alias("n")
    )
    q = q.select(
        *[col(k) for k in keys], "n",
        col("__q")[0].alias("q1"), col("__q")[1].alias("median"), col("__q")[2].alias("q3"),
    ).withColumns({
        "__lo": col("q1") - F.lit(coef) * (col("q3") - col("q1")),
        "__hi": col("q3") + F.lit(coef) * (col("q3") - col("q1")),
    })
    fences = q.select(*[col(k) for k in keys], "__lo", "__hi")
    w = _join(base, fences, keys).groupBy(*[col(k) for k in keys]).agg(
        F.min(F.when(v >= col("__lo"), v)).alias("whisker_low"),
        F.max(F.when(v <= col("__hi"), v)).alias("whisker_high"),
        F.count_if((v < col("__lo")) | (v > col("__hi"))).alias("n_outliers"),
    )
    out = _join(q.drop("__lo", "__hi"), w, keys).select(
        *[col(k) for k in keys if k != _G], "n", "whisker_low", "q1", "median", "q3", "whisker_high", "n_outliers"
    )
    return out.orderBy(*key_order(by)) if by else out


def kde(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    n_points: int = 512,
    limits: tuple[float, float] | None = None,
    bin_width: float | None = None,
) -> DataFrame:
    """Gaussian kernel density on an ``n_points`` grid per group (V2).

    Bandwidth is Silverman's rule (``bw.nrd0``) per group. The grid spans ``limits`` when
    given (values outside are dropped first, like an axis limit) else the range of the whole table, the same for all groups, so curves can be
    laid over each other. Values are binned linearly onto the grid (each splits its weight between its two neighbouring points), and the
    binned weights are convolved with the kernel: past one map-side combined aggregate the work is groups x points x points, whatever the
    number of rows or distinct values. ``bin_width`` optionally rounds values for the quartiles of the bandwidth (e.g. 1e-3 for continuous
    scores), whose exact percentile keeps a value map.
    """
    base = df.where(col(value).isNotNull())
    if limits is not None:
        base = base.where(col(value).between(limits[0], limits[1]))
    base, keys = _groups(base, by)
    v = col(value).cast("double")
    rounded = F.round(v / bin_width) * bin_width if bin_width else v
    stats = base.groupBy(*[col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("__n"),
        F.stddev_samp(v).alias("__sd"),
        F.percentile(rounded, F.array(F.lit(0.25), F.lit(0.75))).alias("__q"),
    )
    lo = F.least(col("__sd"), (col("__q")[1] - col("__q")[0]) / F.lit(1.34))
    lo = F.when(lo > 0, lo).when(col("__sd") > 0, col("__sd")).otherwise(F.lit(1.0))
    stats = stats.select(*[col(k) for k in keys], "__n", (F.lit(0.9) * lo * F.pow(col("__n").cast("double"), F.lit(-0.2))).alias("bw"))
    if limits is not None:
        start, end = F.lit(float(limits[0])), F.lit(float(limits[1]))
    else:
        ends = base.agg(F.min(v).alias("a"), F.max(v).alias("b"))
        start, end = ends.select("a").scalar(), ends.select("b").scalar()
    placed = base.select(*[col(k) for k in keys], start.alias("__from"), ((end - start) / F.lit(n_points - 1)).alias("__step"), v.alias("__v"))
    at = F.when(col("__step") > 0, (col("__v") - col("__from")) / col("__step")).otherwise(0.0)
    cell = F.least(F.floor(at), F.lit(n_points - 2))
    halves = F.array(F.struct(cell.alias("__bin"), (1 - (at - cell)).alias("__w")), F.struct((cell + 1).alias("__bin"), (at - cell).alias("__w")))
    bins = placed.select(*[col(k) for k in keys], "__from", "__step", F.inline(halves)).where("__w > 0")
    bins = bins.groupBy(*[col(k) for k in keys], "__from", "__step", "__bin").agg(F.sum("__w").alias("__w"))
    bins = _join(bins, stats, keys)
    pts = bins.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("point"))
    z = (col("point") - col("__bin")) * col("__step") / col("bw")
    contrib = col("__w") * F.exp(F.lit(-0.5) * z * z) / (col("__n") * col("bw") * F.lit(math.sqrt(2 * math.pi)))
    out = pts.groupBy(*[col(k) for k in keys], "point", "__from", "__step").agg(F.sum(contrib).alias("density"))
    out = out.select(*[col(k) for k in keys if k != _G], "point", (col("__from") + col("point") * col("__step")).alias("x"), "density")
    return out.orderBy(*key_order(list(by) + ["point"]))


def lm_by_group(df: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """Least-squares line of ``y ~ x`` per group (V3) with the sums needed for
    a confidence band (``regr_*`` aggregates, one pass)."""
    Y, X = col(y).cast("double"), col(x).cast("double")
    out = df.groupBy(*[col(b) for b in by]).agg(
        F.regr_count(Y, X).alias("n"),
        F.regr_slope(Y, X).alias("slope"),
        F.regr_intercept(Y, X).alias("intercept"),
        F.regr_r2(Y, X).alias("r2"),
        F.regr_avgx(Y, X).alias("mean_x"),
        F.regr_sxx(Y, X).alias("sxx"),
        F.regr_syy(Y, X).alias("syy"),
        F.regr_sxy(Y, X).alias("sxy"),
    )
    return out.orderBy(*key_order(by))
