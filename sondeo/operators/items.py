"""Item statistics and percent-positive tables.

All items are aggregated in one wide ``agg`` (per group when grouped) and the
small result is stacked into rows afterwards; the data itself is never
unpivoted, so no k-fold row expansion precedes the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, key_order, stack_rows


def item_statistics(df: DataFrame, items: Sequence[str], threshold: float = 3, item_label: str = "item", names: Sequence[str] | None = None) -> DataFrame:
    """Per item over non-missing answers: mean, sd and percent >= ``threshold``."""
    names = list(names) if names is not None else list(items)
    aggs = []
    for i, it in enumerate(items):
        c = col(it)
        aggs += [
            F.avg(c).alias(f"m{i}"),
            F.stddev_samp(c).alias(f"s{i}"),
            F.count_if(c >= threshold).alias(f"p{i}"),
            F.count(c).alias(f"n{i}"),
        ]
    wide = df.agg(*aggs)
    entries = [
        (names[i], [
            ("mean", col(f"m{i}")),
            ("sd", col(f"s{i}")),
            ("p_positive", F.try_divide(col(f"p{i}"), col(f"n{i}")) * F.lit(100.0)),
        ])
        for i in range(len(items))
    ]
    return stack_rows(wide, [], entries, item_label)


def percent_positive(
    df: DataFrame,
    items: Sequence[str],
    by: Sequence[str] = (),
    threshold: float = 3,
    name_col: str = "name",
    n: str = "n",
    percent: str = "prop",
) -> DataFrame:
    """Long percent-positive table.

    Rows with a missing answer or a missing ``by`` value are ignored
    (``na.omit``). As in the tidy pipeline, an (item, group) with no positive
    answer has no row at all.
    """
    by = list(by)
    aggs = []
    for i, it in enumerate(items):
        c = col(it)
        aggs += [F.count_if(c >= threshold).alias(f"p{i}"), F.count(c).alias(f"n{i}")]
    wide = df.groupBy(*[col(b) for b in by]).agg(*aggs)
    for b in by:
        wide = wide.where(col(b).isNotNull())
    entries = [(it, [(n, col(f"p{i}")), (percent, col(f"p{i}") / col(f"n{i}") * F.lit(100.0))]) for i, it in enumerate(items)]
    long = stack_rows(wide, by, entries, name_col).where(col(n) > 0)
    return long.select(col(name_col), *[col(b) for b in by], col(n), col(percent))


def percent_positive_wide(
    df: DataFrame,
    items: Sequence[str],
    by: str,
    levels: Sequence[str],
    threshold: float = 3,
    name_col: str = "name",
) -> DataFrame:
    """Percent positive per item with one column per level of ``by``.

    Cells of (item, level) with no positive answer are NULL, like
    ``pivot_wider`` over the filtered long table. Levels are given explicitly
    so the pivot needs no extra pass to discover them.
    """
    long = percent_positive(df, items, [by], threshold, name_col)
    return long.groupBy(col(name_col)).pivot(by, list(levels)).agg(F.first(col("prop"))).orderBy(*key_order([name_col]))
