"""Plan-shape checks: hot keys are reduced before shuffles; no constant-key joins."""

import pytest
from pyspark.sql import functions as F

from sondeo.operators import describe, freq, linkage, plotdata, scoring


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    # key 0 holds a third of all rows
    return spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("row"),
        (F.col("id") % 7).alias("d"),
        F.when(F.col("id") % 5 == 0, F.lit("x")).alias("o1"),
        F.when(F.col("id") % 2 == 0, F.lit("y")).alias("o2"),
    )


def test_first_per_key_limits_before_exchange(skewed):
    out = linkage.first_per_key(skewed, "k", "row")
    plan = _plan(out)
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert out.where("k = 0").count() == 1 and out.count() == 20001


def test_latest_per_key_limits_before_exchange(skewed):
    out = linkage.latest_per_key(skewed, "k", "d")
    plan = _plan(out)
    assert "WindowGroupLimit" in plan and "Partial" in plan and "Join" not in plan
    assert out.where("k = 0").count() == skewed.where("k = 0 AND d = 6").count()


def test_multi_response_counts_hot_values(skewed):
    out = {r.v: r.n for r in freq.multi_response(skewed, ["o1", "o2"], value="v").collect()}
    assert out == {"x": 6000, "y": 15000}


def test_whole_table_stats_do_not_join(skewed):
    for df in (describe.describe(skewed, "d"), plotdata.box_stats(skewed, "d", []), scoring.standardize(skewed, ["d"])):
        plan = _plan(df)
        assert "Join" not in plan and "CartesianProduct" not in plan


def test_grouped_standardize_has_no_row_window(skewed):
    plan = _plan(scoring.standardize(skewed, ["d"], by=["k"]))
    assert "Window" not in plan
