"""Exact quantiles of continuous columns without a value map or a sort of whole groups.

A quantile (R type 7) interpolates between two neighbouring ranks. Mergeable sketches (``percentile_approx``) bracket each rank: with
accuracy A the value of a rank lies between the sketch's answers 2 / A to both sides of it. One more pass counts exactly
the rows below each bracket and collects the distinct values inside it, with their counts; running counts over those name the ranks. A bracket
holds about 4 / A of a group's rows, and a second sketch inside it brings that to 16 / A^2, so no task holds the values of a group.
Everything stays in DataFrames keyed by the group, whose number does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col
from .linkage import join_null_safe

ACCURACY = 2000
SLACK = 2.0 / ACCURACY


def _brackets(rows: DataFrame, keys: Sequence[str], ranks: DataFrame) -> DataFrame:
    """Per key and rank (0-based among the key's rows in ``rows``) two values that hold the rank's value between them."""
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("__v", F.lit([min(1.0, max(0.0, i * SLACK)) for i in range(int(1 / SLACK) + 1)]), F.lit(2 * ACCURACY)).alias("__s"),
        F.count(F.lit(1)).alias("__m"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"),
    )
    j = join_null_safe(ranks, sketch, keys)
    at = F.col("__rank") / F.greatest(F.col("__m") - 1, F.lit(1)) / F.lit(SLACK)
    low = F.floor(at).cast("int") - 1  # two marks below, as element_at counts from 1
    high = F.ceil(at).cast("int") + 3
    size = F.size("__s")
    return j.select(
        *ranks.columns,
        F.when(low >= 1, F.element_at("__s", low)).otherwise(F.col("__lo")).alias("__from"),
        F.when(high <= size, F.element_at("__s", F.least(high, size))).otherwise(F.col("__hi")).alias("__to"),
    )


def rank_values(df: DataFrame, value: str, by: Sequence[str], ranks: DataFrame) -> DataFrame:
    """The values of given ranks: ``ranks`` has the group columns, ``__rank`` (0-based among the group's non-missing values) and any others."""
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.where(col(value).isNotNull()).select(*[col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.lit(0).alias("__one"), col(value).cast("double").alias("__v"))
    asked = ranks.withColumnsRenamed(dict(zip(by, keys, strict=True))).withColumn("__one", F.lit(0)).withColumn("__want", F.col("__rank"))
    group = [*keys, "__one"]
    first = _brackets(rows, group, asked)
    spans = first.select(*group, "__want", "__from", "__to").distinct()
    inside = join_null_safe(rows, spans, group)  # a row meets the brackets of its group: twice the number of quantiles
    marked = inside.where(F.col("__v") <= F.col("__to"))
    below = marked.groupBy(*group, "__want").agg(F.count_if(F.col("__v") < F.col("__from")).alias("__below"))
    kept = marked.where(F.col("__v") >= F.col("__from")).select(*group, "__want", "__v")
    # Second sketch, inside the bracket: its ranks count from the rows below.
    local = join_null_safe(asked, below, [*group, "__want"]).withColumn("__rank", F.col("__rank") - F.col("__below"))
    second = _brackets(kept, [*group, "__want"], local.select(*group, "__want", "__rank").distinct())
    near = join_null_safe(kept, second, [*group, "__want"]).where(F.col("__v") <= F.col("__to"))
    counts = near.groupBy(*group, "__want", "__rank").agg(F.count_if(F.col("__v") < F.col("__from")).alias("__under"))
    values = near.where(F.col("__v") >= F.col("__from")).groupBy(*group, "__want", "__v").agg(F.count(F.lit(1)).alias("__c"))
    joined = join_null_safe(values, counts, [*group, "__want"])
    w = Window.partitionBy(*group, "__want").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("__under") + F.sum("__c").over(w)
    found = joined.withColumn("__last", last).where((F.col("__rank") < F.col("__last")) & (F.col("__rank") >= F.col("__last") - F.col("__c")))
    out = join_null_safe(asked, found.select(*group, "__want", F.col("__v").alias("__value")), [*group, "__want"])
    return out.drop("__one", "__want").withColumnsRenamed(dict(zip(keys, by, strict=True)))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), name: str = "quantile") -> DataFrame:
    """(by..., prob, quantile): type-7 quantiles of the non-missing values of every group; groups without any give no rows."""
    counts = df.where(col(value).isNotNull()).groupBy(*[col(b) for b in by]).agg(F.count(F.lit(1)).alias("__n")).where("__n > 0")
    asked = counts.withColumn("prob", F.explode(F.lit([float(p) for p in probs])))
    at = F.col("prob") * (F.col("__n") - 1)
    ends = asked.withColumn("__at", at).withColumn("__rank", F.explode(F.array_distinct(F.array(F.floor("__at"), F.ceil("__at")))))
    found = rank_values(df, value, by, ends)
    near = F.when(F.col("__rank") == F.floor("__at"), F.col("__value"))
    far = F.when(F.col("__rank") == F.ceil("__at"), F.col("__value"))
    grouped = found.groupBy(*[col(b) for b in by], "prob", "__at").agg(F.max(near).alias("__a"), F.max(far).alias("__b"))
    return grouped.select(*[col(b) for b in by], "prob", (F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__at") - F.floor("__at"))).alias(name))
