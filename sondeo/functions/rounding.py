"""Rounding of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round_numeric(df: DataFrame, digits: int = 1, half_even: bool = True) -> DataFrame:
    """Round every fractional column. ``half_even`` follows R's ``round``; set False for half-up."""
    fn = F.bround if half_even else F.round
    cols = {
        f.name: fn(F.col(f"`{f.name}`"), digits)
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))
    }
    return df.withColumns(cols) if cols else df
