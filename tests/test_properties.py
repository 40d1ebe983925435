"""Property tests: reshaping round trips, name splitting, frequencies."""

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_SMALL
from sondeo.operators import freq, reshape
from sondeo.plans import attrition


def test_scores_equal_after_unpivot_and_pivot(spark):
    a = attrition.adolescents(spark, SF_SMALL)
    sc = attrition.scales_from_names(a.columns)
    wide = a.select("id", *[attrition.row_sum(v).alias(k) for k, v in sc.items()])
    long = reshape.longer(wide, ["id"], list(sc), "dim", "score")
    back = reshape.wider(long, ["id"], "dim", "score", levels=list(sc))
    diff = wide.exceptAll(back.select(*wide.columns)).count() + back.select(*wide.columns).exceptAll(wide).count()
    assert diff == 0


def test_long_item_table_scores_equal_row_sums(spark):
    a = attrition.adolescents(spark, SF_SMALL)
    sc = attrition.scales_from_names(a.columns)
    items = [c for v in sc.values() for c in v]
    long = reshape.longer(a, ["id"], items, "name", "response")
    dim, item = reshape.split_item_name("name")
    long = long.withColumns({"dim": dim, "item": item})
    from sondeo.operators.scoring import scores_from_long

    by_long = scores_from_long(long, ["id"], "dim", "response")
    by_row = reshape.longer(a.select("id", *[attrition.row_sum(v).alias(k) for k, v in sc.items()]), ["id"], list(sc), "dim", "score")
    assert by_long.exceptAll(by_row.select("id", "dim", "score")).count() == 0


def test_item_name_split_strict_and_lenient(spark):
    df = spark.createDataFrame([("liderazgo3",), ("empatia_12",), ("liderazgo",)], "n string")
    dim, item = reshape.split_item_name("n", lenient=True)
    got = [tuple(r) for r in df.select(dim.alias("d"), item.alias("i")).collect()]
    assert got == [("liderazgo", "3"), ("empatia", "12"), ("liderazgo", None)]
    assert attrition.scales_from_names(["liderazgo1", "liderazgo", "empatia_2", "sexo"]) == {"liderazgo": ["liderazgo1"], "empatia": ["empatia_2"]}
    with pytest.raises(ValueError):
        attrition.scales_from_names(["liderazgo1", "liderazgo"], lenient=False)
    dim_s, item_s = reshape.split_item_name("n", lenient=False)
    with pytest.raises(Exception):
        df.select(item_s).collect()


def test_wider_names_null_key_na(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, None, 2.0), (2, "a", 3.0)], "id int, k string, v double")
    out = {r.id: (r.a, r.NA) for r in reshape.wider(df, ["id"], "k", "v", levels=["a", "NA"]).collect()}
    assert out == {1: (1.0, 2.0), 2: (3.0, None)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.sampled_from(["a", "b", "c"])), min_size=1, max_size=40))
def test_frequency_properties(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"x": pd.Series(values, dtype="object")}), "x string")
    with_na = {r.x: (r.n, r.prop) for r in freq.frequency(df, "x").collect()}
    assert sum(n for n, _ in with_na.values()) == len(values)
    assert abs(sum(p for _, p in with_na.values()) - 100.0) < 1e-9
    without = {r.x: r.n for r in freq.frequency(df, "x", include_null=False).collect()}
    assert None not in without and sum(without.values()) == sum(v is not None for v in values)
