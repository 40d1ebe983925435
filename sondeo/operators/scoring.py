"""Row composites, scale scores and standardisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col


def row_sum(items: Sequence[str]) -> Column:
    """``rowSums(na.rm=TRUE)``: all-missing gives 0."""
    return sum((F.coalesce(col(i), F.lit(0)) for i in items[1:]), F.coalesce(col(items[0]), F.lit(0)))


def row_mean(items: Sequence[str]) -> Column:
    """``rowMeans(na.rm=TRUE)``; all-missing gives NULL instead of NaN."""
    present = sum((col(i).isNotNull().cast("int") for i in items[1:]), col(items[0]).isNotNull().cast("int"))
    return F.try_divide(row_sum(items).cast("double"), present)


def scale_scores(df: DataFrame, scales: Mapping[str, Sequence[str]]) -> DataFrame:
    """One total per scale, computed in the row (K4). No shuffle."""
    return df.withColumns({name: row_sum(items) for name, items in scales.items()})


def scores_from_long(df: DataFrame, keys: Sequence[str], dim: str, value: str, score: str = "score") -> DataFrame:
    """Scale totals from an already-long item table: ``coalesce(sum, 0)`` per (keys, dim)."""
    return df.groupBy(*[col(k) for k in keys], col(dim)).agg(F.coalesce(F.sum(col(value)), F.lit(0)).alias(score))


def standardize(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), suffix: str = "") -> DataFrame:
    """``scale(x)``: (x - mean) / sd with n-1 sd, NULLs ignored.

    Whole-table statistics are scalar subqueries (Spark merges them into one
    aggregate job); per-group statistics are a small grouped aggregate joined
    back on the group keys (AQE broadcasts it from its measured size). No
    un-partitioned window over rows. A constant column gives NULL (N16).
    """
    if not by:
        stats = df.agg(*[F.avg(col(c)).alias(f"m_{c}") for c in columns], *[F.stddev_samp(col(c)).alias(f"s_{c}") for c in columns])
        out = {}
        for c in columns:
            m = stats.select(col(f"m_{c}")).scalar()
            s = stats.select(col(f"s_{c}")).scalar()
            out[f"{c}{suffix}"] = F.try_divide(col(c) - m, s)
        return df.withColumns(out)
    stats = df.groupBy(*[col(b) for b in by]).agg(
        *[F.avg(col(c)).alias(f"__m_{c}") for c in columns], *[F.stddev_samp(col(c)).alias(f"__s_{c}") for c in columns]
    )
    stats = stats.toDF(*[f"__k_{b}" for b in by], *stats.columns[len(by):])
    cond = [col(b).eqNullSafe(col(f"__k_{b}")) for b in by]
    joined = df.join(stats, on=cond, how="left")
    out = joined.withColumns({f"{c}{suffix}": F.try_divide(col(c) - col(f"__m_{c}"), col(f"__s_{c}")) for c in columns})
    return out.drop(*[f"__k_{b}" for b in by], *[f"__m_{c}" for c in columns], *[f"__s_{c}" for c in columns])
