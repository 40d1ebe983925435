"""Grouped summaries, rates and one-pass grouping sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import REPORT_GROUPINGS
from .common import col, key_order

__all__ = ["REPORT_GROUPINGS", "Measure", "grouping_sets", "grouping_sets_moments", "grouping_sets_named", "mean_measures", "mean_sd_by", "prevalence_measures", "rate_aggs", "rate_measures", "summary_by"]

def grouping_sets(
    df: DataFrame,
    groupings: Mapping[str, Sequence[str]],
    aggs: Sequence[Column],
    label: str = "grouping",
) -> DataFrame:
    """The same aggregates over several groupings in **one** pass.

    Emits one ``GROUPING SETS`` aggregate (an Expand feeding a single hash
    aggregate, so one shuffle of partial aggregates regardless of the number of
    groupings). ``label`` names the grouping of each row; ``grouping()`` flags
    keep a real NULL group apart from a subtotal.
    """
    keys: list[str] = []
    for ks in groupings.values():
        for k in ks:
            if k not in keys:
                keys.append(k)
    sets = [[col(k) for k in ks] for ks in groupings.values()]
    if not keys:
        out = df.agg(*aggs)
        return out.select(F.lit(next(iter(groupings))).alias(label), *out.columns)
    flags = {k: F.grouping(col(k)) for k in keys}
    name = None
    for lab, ks in groupings.items():
        cond = F.lit(True)
        for k in keys:
            cond = cond & (flags[k] == (0 if k in ks else 1))
        name = F.when(cond, F.lit(lab)) if name is None else name.when(cond, F.lit(lab))
    agg_names = [f"_a{i}" for i in range(len(aggs))]
    out = df.groupingSets(sets, *[col(k) for k in keys]).agg(
        *[a.alias(n) for a, n in zip(aggs, agg_names)], name.alias(label)
    )
    return out.select(col(label), *[col(k) for k in keys], *[col(n) for n in agg_names])


def grouping_sets_named(
    df: DataFrame,
    groupings: Mapping[str, Sequence[str]],
    aggs: Mapping[str, Column],
    label: str = "grouping",
) -> DataFrame:
    """:func:`grouping_sets` with ``{output_name: aggregate}``."""
    names = list(aggs)
    out = grouping_sets(df, groupings, list(aggs.values()), label)
    return out.toDF(*out.columns[: len(out.columns) - len(names)], *names)


@dataclass(frozen=True)
class Measure:
    """A statistic that merges from cells: rows of a group, or the sum, mean or sample sd of a column (times ``factor``)."""

    kind: str  # "rows", "sum", "mean", "sd"
    column: str | None = None
    factor: float = 1.0


def grouping_sets_moments(df: DataFrame, groupings: Mapping[str, Sequence[str]], measures: Mapping[str, Measure], label: str = "grouping") -> DataFrame:
    """:func:`grouping_sets` in two levels (G19): counts, sums and central squares per cell of all keys first, then the grouping sets over the cells.

    The rows are aggregated once, map-side, without being copied for every grouping; what is copied are cells. Missing
    values of a column are left out of its statistics, an empty column gives NULL.
    """
    keys = list(dict.fromkeys(k for ks in groupings.values() for k in ks))
    columns = list(dict.fromkeys(m.column for m in measures.values() if m.column))
    spread = {m.column for m in measures.values() if m.kind == "sd"}
    n, s, q = ({c: f"__{x}{i}" for i, c in enumerate(columns)} for x in "nsq")
    cells = [F.count(F.lit(1)).alias("__rows")]
    for c in columns:
        v = col(c).cast("double")
        cells += [F.count(v).alias(n[c]), F.sum(v).alias(s[c])]
        if c in spread:
            cells.append((F.var_pop(v) * F.count(v)).alias(q[c]))
    base = df.groupBy(*[col(k) for k in keys]).agg(*cells)

    def merged(m: Measure) -> Column:
        if m.kind == "rows":
            return F.sum("__rows")
        count, total = F.sum(n[m.column]), F.sum(s[m.column])
        if m.kind == "sum":
            return total * F.lit(m.factor)
        if m.kind == "mean":
            return F.try_divide(total, count) * F.lit(m.factor)
        squares = F.sum(q[m.column]) + F.sum(F.try_divide(col(s[m.column]) * col(s[m.column]), col(n[m.column]))) - F.try_divide(total * total, count)
        return F.sqrt(F.greatest(F.try_divide(squares, count - 1), F.lit(0.0))) * F.lit(m.factor)

    return grouping_sets_named(base, groupings, {name: merged(m) for name, m in measures.items()}, label)


def summary_by(df: DataFrame, by: Sequence[str], value: str, mean: str = "mean", sd: str = "sd", n: str = "n") -> DataFrame:
    """``group_by(by) %>% summarise(mean(na.rm), sd(na.rm), n())`` (G1)."""
    return (
        df.groupBy(*[col(b) for b in by])
        .agg(F.avg(col(value)).alias(mean), F.stddev_samp(col(value)).alias(sd), F.count(F.lit(1)).alias(n))
        .orderBy(*key_order(by))
    )


def rate_aggs(flag: str, count_name: str = "n_studying", total_name: str = "n_total", pct_name: str = "pct") -> dict[str, Column]:
    """``sum(flag), n(), mean(flag) * 100`` for a 0/1 flag."""
    return {
        count_name: F.sum(col(flag)).cast("bigint"),
        total_name: F.count(F.lit(1)),
        pct_name: F.avg(col(flag)) * F.lit(100.0),
    }


def rate_measures(flag: str) -> dict[str, Measure]:
    """The measures of :func:`rate_aggs`."""
    return {"n_studying": Measure("sum", flag), "n_total": Measure("rows"), "pct": Measure("mean", flag, 100.0)}


def mean_measures(columns: Mapping[str, str]) -> dict[str, Measure]:
    """``{out_name: mean(column, na.rm=TRUE)}``."""
    return {out: Measure("mean", c) for out, c in columns.items()}


def prevalence_measures(code_columns: Sequence[str], n_name: str = "N") -> dict[str, Measure]:
    """``N = n()`` plus ``mean(code) * 100`` for every 0/1 code column."""
    return {n_name: Measure("rows"), **{c: Measure("mean", c, 100.0) for c in code_columns}}


def mean_sd_by(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``summarize(across(value, list(mean, sd), .names="{.col}_{.fn}"))``."""
    return df.groupBy(*[col(b) for b in by]).agg(
        F.avg(col(value)).alias(f"{value}_mean"), F.stddev_samp(col(value)).alias(f"{value}_sd")
    )
