"""Frequency tables: one-way, two-way, within-group, filtered, multi-response."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, frequency_order, key_order, share_of_total, share_within


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def count_by(df: DataFrame, keys: str | Sequence[str], include_null: bool = True, name: str = "n") -> DataFrame:
    """``count(keys)`` (NA group kept) or ``table(keys)`` (``include_null=False``)."""
    ks = _keys(keys)
    if not include_null:
        df = df.dropna("any", subset=ks)
    return df.groupBy(*[col(k) for k in ks]).agg(F.count(F.lit(1)).alias(name))


def frequency(
    df: DataFrame,
    keys: str | Sequence[str],
    include_null: bool = True,
    name: str = "n",
    percent: str = "prop",
    sort: bool = False,
) -> DataFrame:
    """Counts and percent of the grand total.

    ``include_null=False`` follows ``table()``/``prop.table()`` (rows with a missing
    key are dropped before counting); True follows ``count()``.
    """
    ks = _keys(keys)
    agg = count_by(df, ks, include_null, name)
    out = agg.select(*[col(k) for k in ks], col(name), share_of_total(agg, name).alias(percent))
    return out.orderBy(*(frequency_order(name, ks) if sort else key_order(ks)))


def frequency_within(
    df: DataFrame,
    keys: Sequence[str],
    parents: Sequence[str],
    include_null: bool = True,
    name: str = "n",
    percent: str = "prop",
) -> DataFrame:
    """``count(a, b) %>% group_by(a) %>% mutate(n / sum(n))``."""
    agg = count_by(df, keys, include_null, name)
    return agg.select(*[col(k) for k in keys], col(name), share_within(name, parents).alias(percent))


def crosstab(df: DataFrame, row: str, column: str, levels: Sequence | None = None) -> DataFrame:
    """``table(row, column)``: zero-filled, missing values dropped on both sides.

    ``levels`` fixes the output columns; without it Spark collects the distinct
    values first (one extra small job).
    """
    base = df.where(col(row).isNotNull() & col(column).isNotNull())
    piv = base.groupBy(col(row)).pivot(column, list(levels) if levels is not None else None).count()
    value_cols = [c for c in piv.columns if c != row]
    return piv.fillna(0, subset=value_cols).orderBy(col(row))


def filtered_frequency(
    df: DataFrame,
    condition: Column,
    keys: Sequence[str],
    within: Sequence[str] | None = None,
    name: str = "n",
    percent: str = "pct",
) -> DataFrame:
    """``group_by(g) %>% filter(cond) %>% count(y) %>% mutate(n / sum(n) * 100)``.

    Without ``within`` the percent is of all filtered rows.
    """
    base = df.where(condition)
    groups = list(within or []) + [k for k in keys if k not in (within or [])]
    agg = count_by(base, groups, True, name)
    share = share_within(name, within) if within else share_of_total(agg, name)
    return agg.select(*[col(k) for k in groups], col(name), share.alias(percent))


MARK = "__respondent__"


def multi_response(
    df: DataFrame,
    options: Sequence[str],
    value: str = "value",
    by: Sequence[str] = (),
    name: str = "n",
    percent: str = "prop",
) -> DataFrame:
    """Mentions per option value, percent of **all respondents**.

    Option columns are stacked in-row (no join), blanks and rows with a missing
    ``by`` value are dropped (``na.omit``), and the respondent count comes from
    the same aggregation: every row also emits one marker entry, so the
    denominator needs no second pass over the input.
    """
    by = list(by)
    entries = [
        F.struct(F.lit(False).alias("_m"), *[col(b).alias(b) for b in by], col(o).cast("string").alias(value))
        for o in options
    ]
    entries.append(
        F.struct(F.lit(True).alias("_m"), *[F.lit(None).cast(df.schema[b].dataType).alias(b) for b in by], F.lit(None).cast("string").alias(value))
    )
    long = df.select(F.inline(F.array(*entries)))
    agg = long.groupBy("_m", *[col(b) for b in by], col(value)).agg(F.count(F.lit(1)).alias(name))
    total = agg.where(col("_m")).select(F.sum(col(name))).scalar()
    keep = ~col("_m") & col(value).isNotNull()
    for b in by:
        keep = keep & col(b).isNotNull()
    return (
        agg.where(keep)
        .select(*[col(b) for b in by], col(value), col(name), (col(name) / total * F.lit(100.0)).alias(percent))
        .orderBy(*frequency_order(name, by + [value]))
    )
