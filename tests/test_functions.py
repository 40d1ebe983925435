"""Scalar functions, selectors and header handling."""

from pyspark.sql import functions as F

from sondeo.functions import dates as dt
from sondeo.functions import recode as rc
from sondeo.functions import selectors as sel
from sondeo.functions import text as tx
from sondeo.functions.rounding import round_numeric
from sondeo.sources.exports import clean_names, merge_header


def test_period_label(spark):
    df = spark.createDataFrame([("Generación 3 (2019 - 2020)",), ("Otra (no recuerdo)",), ("Sin periodo",), (None,)], "g string")
    got = [r.p for r in df.select(tx.period_from_label("g").alias("p")).collect()]
    assert got == ["2019-2020", "Otro", None, None]


def test_reverse_key_and_vocabularies(spark):
    df = spark.createDataFrame([("Muy parecido a mí",), ("Pocas veces",), ("otra cosa",), (None,)], "x string")
    codes = df.select(rc.multi_vocabulary_codes("x", {4: ["Muy parecido a mí", "Siempre/Casi siempre"], 2: ["Poco parecido a mí", "Pocas veces"]}).alias("c"))
    assert [r.c for r in codes.collect()] == [4, 2, None, None]
    rev = codes.select(rc.reverse_key("c").alias("r"))
    assert [r.r for r in rev.collect()] == [1, 3, None, None]


def test_first_match_municipality(spark):
    from sondeo.config import MUNICIPALITY_PATTERNS

    df = spark.createDataFrame([("Ciudad Victoria",), ("García NL",), ("Presa",), ("otro",)], "m string")
    got = [r.c for r in df.select(rc.first_match(F.lower("m"), MUNICIPALITY_PATTERNS).alias("c")).collect()]
    assert got == ["Cd. Victoria", "García", "Ecatepec", None]


def test_key_repair_and_case(spark):
    df = spark.createDataFrame([("M5CU12 Juan Perez",), ("ab5CU 5CU",)], "k string")
    assert [r.k for r in df.select(tx.repair_mentor_key("k").alias("k")).collect()] == ["M5CH12", "ab5CH"]
    df2 = spark.createDataFrame([("monterrey NUEVO",)], "s string")
    r = df2.select(tx.sentence_case("s").alias("a"), tx.title_case("s").alias("b")).first()
    assert (r.a, r.b) == ("Monterrey nuevo", "Monterrey Nuevo")


def test_replace_first_only(spark):
    df = spark.createDataFrame([("liderazgo12",)], "s string")
    assert df.select(tx.replace_first("s", r"(\d)", "_$1").alias("x")).first().x == "liderazgo_12"


def test_ages_and_bins(spark):
    df = spark.createDataFrame([("6/6/2011",), ("7/6/2011",), ("5/12/2010",)], "s string").withColumn("d", dt.parse_dmy("s"))
    out = df.select(dt.age_calendar("d").alias("a"), dt.age_average_year("d").alias("b"), dt.cut_right_closed(F.lit(11)).alias("c")).collect()
    assert [r.a for r in out] == [12.0, 12.0, 13.0]  # 5 Dec 2010: 12 years + 183/365
    assert out[0].c == "(0,11]"
    df3 = spark.createDataFrame([(0,), (11,), (12,), (99,), (100,)], "e int")
    assert [r.c for r in df3.select(dt.cut_right_closed("e").alias("c")).collect()] == [None, "(0,11]", "(11,12]", "(16,99]", None]


def test_selectors(spark):
    df = spark.createDataFrame([(1, 2, "a", 3)], "L1_num int, l2_num int, name string, liderazgo int")
    assert sel.select_names(df, matches=r"^L\d") == ["L1_num", "l2_num"]
    assert sel.select_names(df, dtype="string") == ["name"]
    assert sel.select_names(df, ends_with="_num", exclude=["l2_num"]) == ["L1_num"]
    assert sel.columns_at(df, range(2, 4)) == ["l2_num", "name"]
    assert sel.rename_by_position(df, {"x": 3}).columns == ["L1_num", "l2_num", "x", "liderazgo"]
    assert sel.item_names([("a", 2), ("b", 1)]) == ["a_1", "a_2", "b_1"]
    df2 = spark.createDataFrame([(1, 2, 3)], "liderazgo1 int, liderazgo_2 int, liderazgo int")
    assert sel.item_columns(df2, "liderazgo") == ["liderazgo1", "liderazgo_2"]
    assert sel.strip_suffix(spark.createDataFrame([(1,)], "Liderazgo_val int"), "_val").columns == ["Liderazgo"]


def test_round_numeric_half_even(spark):
    df = spark.createDataFrame([(2.25, 1)], "x double, n int")
    assert round_numeric(df, 1).first() == (2.2, 1)


def test_clean_names_and_headers():
    assert clean_names(["¿Aceptas participar en esta encuesta?", "ID número", "ID número", "2do"]) == [
        "aceptas_participar_en_esta_encuesta", "id_numero", "id_numero_2", "x2do"]
    top = ["Respondent ID", "¿Qué haces?", None, None]
    bottom = [None, "Estudio", "Trabajo", "Otro (especifique)..."]
    assert merge_header(top, bottom) == ["Respondent ID", "Estudio", "Trabajo", "Otro"]
