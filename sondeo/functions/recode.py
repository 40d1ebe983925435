"""Recodes and missing-value rules.

R's NA rules differ from SQL's NULL rules; the helpers below encode the R
behaviour the analyses depend on:

* ``x %in% set`` is FALSE for a missing x            -> :func:`isin_safe`
* ``case_when`` / ``ifelse`` without a default is NA  -> ``when`` chains without ``otherwise``
* ``ifelse(cond, a, b)`` is NA when cond is NA         -> :func:`if_else`
* ``as.numeric("x")`` is NA (with a warning)           -> :func:`safe_cast`
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def isin_safe(c: ColumnOrName, values: Iterable) -> Column:
    """NA-safe membership: never NULL, FALSE for a NULL input."""
    return F.coalesce(_c(c).isin(list(values)), F.lit(False))


def flag_in(c: ColumnOrName, values: Iterable) -> Column:
    """0/1 integer flag of NA-safe membership."""
    return isin_safe(c, values).cast("int")


def if_else(cond: Column, yes, no) -> Column:
    """R ``ifelse``: NULL condition gives NULL."""
    yes_c = yes if isinstance(yes, Column) else F.lit(yes)
    no_c = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond, yes_c).when(~cond, no_c)


def recode(c: ColumnOrName, mapping: Mapping, default=None) -> Column:
    """Closed-list recode ``value -> code``; anything else is NULL unless a default is given."""
    col = _c(c)
    expr = None
    for k, v in mapping.items():
        cond = col == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    if expr is None:
        return F.lit(default)
    return expr if default is None else expr.otherwise(F.lit(default))


def labels_to_codes(c: ColumnOrName, labels: Sequence[str], start: int = 1) -> Column:
    """Ordered label list -> integer codes start, start+1, ...."""
    return recode(c, {lab: start + i for i, lab in enumerate(labels)})


def codes_to_labels(c: ColumnOrName, labels: Sequence[str], start: int = 1) -> Column:
    """Inverse of :func:`labels_to_codes`."""
    return recode(c, {start + i: lab for i, lab in enumerate(labels)})


def multi_vocabulary_codes(c: ColumnOrName, code_labels: Mapping[int, Sequence[str]]) -> Column:
    """Several wordings sharing one code scale (C3): ``{4: [...], 3: [...], ...}``."""
    col = _c(c)
    expr = None
    for code, labels in code_labels.items():
        cond = isin_safe(col, labels)
        expr = F.when(cond, F.lit(code)) if expr is None else expr.when(cond, F.lit(code))
    return expr


def reverse_key(c: ColumnOrName, low: int = 1, high: int = 4) -> Column:
    """Reverse-keyed item: (low + high) - x, NULL kept."""
    return F.lit(low + high) - _c(c)


def null_if(c: ColumnOrName, cond: Column) -> Column:
    """Sentinel to NULL: keep x unless ``cond`` holds (C6). NULL stays NULL."""
    return F.when(~cond, _c(c))


def keep_between(c: ColumnOrName, low, high) -> Column:
    """Inclusive range check, out of range -> NULL."""
    col = _c(c)
    return F.when(col.between(low, high), col)


def contains_yes_no(c: ColumnOrName, token: str, yes: str = "Sí", no: str = "No") -> Column:
    """Yes/no by substring; NULL input stays NULL."""
    return if_else(_c(c).contains(token), yes, no)


def first_match(c: ColumnOrName, patterns: Sequence[tuple[str, str]]) -> Column:
    """Ordered regex -> label, first match wins, else NULL."""
    col = _c(c)
    expr = None
    for pat, label in patterns:
        cond = col.rlike(pat)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def collapse_value(c: ColumnOrName, value: str, to: str) -> Column:
    """``ifelse(x == value, to, x)`` with R's NA propagation."""
    col = _c(c)
    return if_else(col == F.lit(value), F.lit(to), col)


def any_text_to(c: ColumnOrName, to: str) -> Column:
    """Any non-missing free text becomes ``to`` (C10, "Con otros")."""
    return F.when(_c(c).isNotNull(), F.lit(to))


def safe_cast(c: ColumnOrName, dtype: str = "double") -> Column:
    """``as.numeric``: unparseable -> NULL instead of an ANSI error."""
    return _c(c).try_cast(dtype)


def outcome_flag(c: ColumnOrName, positive) -> Column:
    """Outcome label -> 1/0, NULL stays NULL."""
    return if_else(_c(c) == F.lit(positive), 1, 0)


def refusals_to_null(df: DataFrame, values: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Every string column: refusal labels -> NULL (C7). One projection."""
    cols = columns if columns is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~isin_safe(c, values), F.col(c)) for c in cols})
