"""Column selection and renaming driven by the schema.

Selectors resolve to plain column-name lists at plan-build time; the plan
itself is then an ordinary projection that Catalyst prunes into the scan.
Pattern helpers are case-insensitive by default, like tidyselect.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def select_names(
    df: DataFrame,
    starts_with: str | Sequence[str] | None = None,
    ends_with: str | Sequence[str] | None = None,
    matches: str | None = None,
    dtype: str | None = None,
    exclude: Iterable[str] = (),
    ignore_case: bool = True,
) -> list[str]:
    """Union of the given criteria (like ``starts_with(a) | matches(b)``), minus ``exclude``.

    ``dtype`` is "numeric" or "string" (``where(is.numeric)`` / ``where(is.character)``).
    """
    flags = re.IGNORECASE if ignore_case else 0
    pats: list[str] = []
    if starts_with:
        for s in [starts_with] if isinstance(starts_with, str) else starts_with:
            pats.append("^" + re.escape(s))
    if ends_with:
        for s in [ends_with] if isinstance(ends_with, str) else ends_with:
            pats.append(re.escape(s) + "$")
    if matches:
        pats.append(matches)
    excl = set(exclude)
    out = []
    for f in df.schema.fields:
        if f.name in excl:
            continue
        hit = any(re.search(p, f.name, flags) for p in pats) if pats else True
        if dtype == "numeric":
            hit = hit and isinstance(f.dataType, _NUMERIC)
        elif dtype == "string":
            hit = hit and isinstance(f.dataType, T.StringType)
        if hit:
            out.append(f.name)
    return out


def item_columns(df: DataFrame, prefix: str) -> list[str]:
    """Items of a scale: ``prefix`` + optional "_" + digits only, so a composite named
    like the prefix is never picked up again (D17)."""
    return [c for c in df.columns if re.fullmatch(re.escape(prefix) + r"_?\d+", c, re.IGNORECASE)]


def rename_by_position(df: DataFrame, positions: Mapping[str, int]) -> DataFrame:
    """``rename(all_of(c(new = 8, ...)))`` with 1-based positions (P1); other names may repeat."""
    cols = df.columns
    by_pos = {p: n for n, p in positions.items()}
    return df.toDF(*[by_pos.get(i + 1, c) for i, c in enumerate(cols)])


def columns_at(df: DataFrame, *ranges: Iterable[int]) -> list[str]:
    """Names at 1-based positions, e.g. ``columns_at(df, range(27, 37), range(44, 74))`` (P5)."""
    cols = df.columns
    return [cols[i - 1] for r in ranges for i in r]


def set_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename every column at once."""
    return df.toDF(*names)


def select_strict(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``all_of``: a missing name is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def drop_lenient(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``select(-any_of(...))``: absent names are ignored."""
    return df.drop(*[n for n in names if n in df.columns])


def drop_blank_headers(df: DataFrame) -> DataFrame:
    """Auto-named blank-header columns ("...12") are removed."""
    return df.drop(*[c for c in df.columns if c.startswith("...")])


def across(df: DataFrame, names: Sequence[str], fn: Callable[[Column], Column], template: str = "{col}") -> DataFrame:
    """``mutate(across(names, fn, .names=template))`` in one projection."""
    return df.withColumns({template.format(col=n): fn(F.col(f"`{n}`")) for n in names})


def strip_suffix(df: DataFrame, suffix: str) -> DataFrame:
    """``rename_with(~str_remove(., suffix), ends_with(suffix))``."""
    mapping = {c: c[: -len(suffix)] for c in df.columns if c.endswith(suffix)}
    return df.withColumnsRenamed(mapping) if mapping else df


def item_names(scales: Sequence[tuple[str, int]], sep: str = "_") -> list[str]:
    """``c(paste0("agencia_", 1:10), ...)`` from a scale config."""
    return [f"{name}{sep}{i}" for name, n in scales for i in range(1, n + 1)]
