"""Reshaping: wide <-> long, item-name splitting, unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

ITEM_NAME = r"^([^0-9_]+)_?([0-9]+)$"


def longer(df: DataFrame, ids: Sequence[str], values: Sequence[str], names_to: str = "name", values_to: str = "value") -> DataFrame:
    """``pivot_longer`` (R1). NULL cells are kept, like R; follow with ``dropna`` for ``na.omit``."""
    return df.unpivot([col(i) for i in ids], [col(v) for v in values], names_to, values_to)


def wider(
    df: DataFrame,
    ids: Sequence[str],
    names_from: str,
    values_from: str,
    levels: Sequence[str] | None = None,
    na_name: str = "NA",
) -> DataFrame:
    """``pivot_wider`` (R2): a NULL key becomes the column "NA"; absent cells are NULL."""
    key = F.coalesce(col(names_from).cast("string"), F.lit(na_name)).alias("__k")
    base = df.select(*[col(i) for i in ids], key, col(values_from))
    return base.groupBy(*[col(i) for i in ids]).pivot("__k", list(levels) if levels is not None else None).agg(F.first(col(values_from)))


def split_item_name(c: Column | str, lenient: bool = False) -> tuple[Column, Column]:
    """Dimension and item number of "liderazgo3" / "liderazgo_3" (R3).

    Strict mode raises on a name that does not split; lenient mode gives a
    NULL item for it so the caller can drop the row (R4).
    """
    name = col(c) if isinstance(c, str) else c
    ok = name.rlike(ITEM_NAME)
    dim = F.regexp_extract(name, ITEM_NAME, 1)
    item = F.regexp_extract(name, ITEM_NAME, 2)
    if lenient:
        return F.when(ok, dim).otherwise(F.regexp_extract(name, r"^([^0-9_]+)", 1)), F.when(ok, item)
    checked = F.when(ok, item).otherwise(F.raise_error(F.concat(F.lit("item name does not split: "), name)))
    return dim, checked


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """``bind_rows``: union by name, missing columns filled with NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_union(frames: Sequence[DataFrame]) -> DataFrame:
    """``unique(c(a, b))``."""
    return reduce(lambda a, b: a.union(b), frames).distinct()
