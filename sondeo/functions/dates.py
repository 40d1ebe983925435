"""Dates, ages and interval bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import AGE_BREAKS, AGE_REFERENCE_DATE
from .recode import ColumnOrName, _c


def parse_dmy(c: ColumnOrName) -> Column:
    """Day-month-year text with any of ``/ - . space`` separators -> DATE; bad -> NULL."""
    norm = F.regexp_replace(F.trim(_c(c)), r"[-. ]+", "/")
    return F.try_to_date(norm, "d/M/yyyy")


def _ref(ref: str | Column) -> Column:
    return F.to_date(F.lit(ref)) if isinstance(ref, str) else ref


def age_calendar(dob: ColumnOrName, ref: str | Column = AGE_REFERENCE_DATE) -> Column:
    """Age in calendar years, rounded half-to-even (C17).

    Completed years plus the elapsed fraction of the year of age running at
    ``ref`` (length of that year measured between the two birthdays).
    """
    d, r = _c(dob), _ref(ref)
    before = (F.month(r) < F.month(d)) | ((F.month(r) == F.month(d)) & (F.dayofmonth(r) < F.dayofmonth(d)))
    years = F.year(r) - F.year(d) - F.when(before, 1).otherwise(0)
    last = F.add_months(d, years * 12)
    nxt = F.add_months(d, (years + 1) * 12)
    frac = F.datediff(r, last) / F.datediff(nxt, last)
    return F.bround(years + frac, 0)


def age_average_year(dob: ColumnOrName, ref: str | Column = AGE_REFERENCE_DATE) -> Column:
    """Age as elapsed days / 365.25, rounded half-to-even."""
    return F.bround(F.datediff(_ref(ref), _c(dob)) / F.lit(365.25), 0)


def with_age(df: DataFrame, age: str = "edad", birth: str = "fecha_nac", ref: str | Column = AGE_REFERENCE_DATE) -> DataFrame:
    """A table with its age column, whatever its export holds (C19), decided by the schema: an age column stays as it is; a
    numeric birth column already is the age; a text one is parsed day first and turned into calendar years at ``ref``."""
    kind = {f.name: f.dataType for f in df.schema.fields}
    if age in kind:
        return df
    if isinstance(kind[birth], T.NumericType):
        return df.withColumn(age, _c(birth))
    return df.withColumn(age, age_calendar(parse_dmy(birth), ref))


def bin_label(lo, hi) -> str:
    return f"({lo:g},{hi:g}]"


def cut_right_closed(c: ColumnOrName, breaks: Sequence[float] = AGE_BREAKS) -> Column:
    """Right-closed interval labels "(a,b]"; outside every interval -> NULL (C20).

    (Spark's ``Bucketizer`` is left-closed, hence the explicit chain.)
    """
    col = _c(c)
    expr = None
    for lo, hi in zip(breaks[:-1], breaks[1:]):
        cond = (col > F.lit(lo)) & (col <= F.lit(hi))
        lab = F.lit(bin_label(lo, hi))
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr
