"""One test per R missing-value rule N1-N16 on literal frames."""

import math

from pyspark.sql import functions as F

from sondeo.functions import dates as dt
from sondeo.functions import recode as rc
from sondeo.functions import text as tx
from sondeo.operators import describe, freq, linkage, scoring


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_n1_membership_false_for_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("z",)], "x string")
    assert rows(df.select(rc.isin_safe("x", ["a", "b"]).alias("m")), "m") == [(True,), (False,), (False,)]


def test_n2_ifelse_null_condition_gives_null(spark):
    df = spark.createDataFrame([("Sí, claro",), ("No",), (None,)], "x string")
    assert rows(df.select(rc.contains_yes_no("x", "Sí").alias("y")), "y") == [("Sí",), ("No",), (None,)]


def test_n3_case_when_without_default(spark):
    df = spark.createDataFrame([("M",), ("H",), ("X",), (None,)], "x string")
    out = rows(df.select(rc.recode("x", {"M": "Mujer", "H": "Hombre"}).alias("y")), "y")
    assert out == [("Mujer",), ("Hombre",), (None,), (None,)]


def test_n4_row_sum_all_missing_is_zero(spark):
    df = spark.createDataFrame([(None, None), (1, None), (2, 3)], "a int, b int")
    assert rows(df.select(scoring.row_sum(["a", "b"]).alias("s")), "s") == [(0,), (1,), (5,)]


def test_n5_row_mean_all_missing_is_null(spark):
    df = spark.createDataFrame([(None, None), (1, None), (2, 3)], "a int, b int")
    assert rows(df.select(scoring.row_mean(["a", "b"]).alias("m")), "m") == [(None,), (1.0,), (2.5,)]


def test_n6_sd_of_one_value_is_null(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 3.0)], "g int, v double")
    got = dict(rows(df.groupBy("g").agg(F.stddev_samp("v").alias("s")), "g", "s"))
    assert got[1] is None and abs(got[2] - math.sqrt(2)) < 1e-12


def test_n7_table_drops_na_count_keeps_it(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "x string")
    assert sorted(rows(freq.count_by(df, "x", include_null=False), "x", "n")) == [("a", 2)]
    assert sorted(rows(freq.count_by(df, "x", include_null=True), "x", "n"), key=str) == [("a", 2), (None, 1)]


def test_n8_filter_drops_null_condition(spark):
    df = spark.createDataFrame([("Otro",), ("2019-2020",), (None,)], "p string")
    assert rows(df.where(F.col("p") != "Otro"), "p") == [("2019-2020",)]


def test_n9_join_matches_null_keys(spark):
    a = spark.createDataFrame([(None, 1), (2, 2)], "k int, x int")
    b = spark.createDataFrame([(None, "n"), (2, "t")], "k int, y string")
    assert sorted(rows(linkage.join_null_safe(a, b, ["k"]), "x", "y")) == [(1, "n"), (2, "t")]


def test_n10_regex_on_null_text_codes_zero(spark):
    df = spark.createDataFrame([("Mi Amigo",), (None,)], "t string")
    assert rows(df.select(tx.code_text("t", ["amig"]).alias("c")), "c") == [(1,), (0,)]


def test_n11_paste_prints_na(spark):
    df = spark.createDataFrame([(12, "Ana"), (13, None)], "id int, n string")
    assert rows(df.select(tx.link_key("id", "n").alias("k")), "k") == [("12ana",), ("13NA",)]


def test_n12_missing_date_drops_the_key(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (1, 3, 5), (2, 4, None), (2, 5, 9)], "k int, id int, d int")
    assert sorted(rows(linkage.latest_per_key(df, "k", "d"), "id")) == [(1,), (2,)]


def test_n13_na_omit_any_column(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (None, "b")], "a int, b string")
    assert rows(df.dropna("any"), "a") == [(2,)]


def test_n14_extract_without_match_is_null(spark):
    df = spark.createDataFrame([("(2019 - 2020)",), ("Sin periodo",)], "g string")
    assert rows(df.select(tx.extract_first("g", r"\(.*").alias("e")), "e") == [("(2019 - 2020)",), (None,)]


def test_n15_bad_number_is_null(spark):
    df = spark.createDataFrame([("3",), ("x",)], "s string")
    assert rows(df.select(rc.safe_cast("s").alias("v")), "v") == [(3.0,), (None,)]


def test_n16_zero_variance_zscore_is_null(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, v double")
    assert [r.v for r in scoring.standardize(df, ["v"]).collect()] == [None, None]


def test_bad_date_is_null(spark):
    df = spark.createDataFrame([("31/31/2010",), ("5-6-2011",)], "s string")
    got = [r.d for r in df.select(dt.parse_dmy("s").alias("d")).collect()]
    assert got[0] is None and str(got[1]) == "2011-06-05"


def test_summary_counts_na(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    r = describe.summary_numeric(df, "x").first()
    assert r.n_na == 1 and r.median == 2.0
