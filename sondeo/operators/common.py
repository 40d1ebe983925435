"""Small building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def share_of_total(agg: DataFrame, n: str = "n", scale: float = 100.0) -> Column:
    """``n / sum(n) * scale`` over the whole aggregated frame.

    The denominator is a scalar subquery over ``agg``; Spark reuses the
    aggregation's exchange for it.
    """
    total = agg.select(F.sum(col(n))).scalar()
    return col(n) / total * F.lit(scale)


def share_within(n: str, parents: Sequence[str], scale: float = 100.0) -> Column:
    """``n / sum(n) * scale`` within parent groups; only applied to aggregated rows,
    so the window shuffles one row per group."""
    w = Window.partitionBy(*[col(p) for p in parents])
    return col(n) / F.sum(col(n)).over(w) * F.lit(scale)


def key_order(keys: Sequence[str]) -> list[Column]:
    """dplyr sorts grouped output by key with the NA group last (O2)."""
    return [col(k).asc_nulls_last() for k in keys]


def frequency_order(n: str, keys: Sequence[str]) -> list[Column]:
    """``count(..., sort=TRUE)``: descending count, ties in key order (O1)."""
    return [col(n).desc()] + key_order(keys)


def stack_rows(df: DataFrame, keep: Sequence[str], entries: Sequence[tuple[str, Sequence[tuple[str, Column]]]], label: str) -> DataFrame:
    """Turn per-item columns of a (small) aggregated frame into rows.

    ``entries`` is ``[(item_label, [(field, expr), ...]), ...]``; every entry must
    produce the same fields. Used after a wide aggregation.
    """
    structs = [
        F.struct(F.lit(lab).alias(label), *[e.alias(f) for f, e in fields])
        for lab, fields in entries
    ]
    return df.select(*[col(k) for k in keep], F.inline(F.array(*structs)))
