"""Sources, sinks and streaming ingestion."""

import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from conftest import SF_SMALL
from sondeo.sources import exports, sinks
from sondeo.sources.fixtures import survey_base
from sondeo.streaming import waves


def _write_two_row_csv(path, top, bottom, rows):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(",".join(top) + "\n")
        fh.write(",".join(bottom) + "\n")
        for r in rows:
            fh.write(",".join(r) + "\n")


def test_two_row_header_ingestion(spark):
    d = tempfile.mkdtemp(prefix="sondeo-csv-")
    top = ["Respondent ID", "¿Aceptas participar en esta encuesta?", "¿Con quién mantienes contacto?", "", ""]
    bottom = ["", "Response", "Mentores", "Mentitos", "Otro (especifique)"]
    base = survey_base(spark, SF_SMALL).select("respondent_id", "estado", "componente_01").limit(50).toPandas()
    rows = [[str(r.respondent_id), "Sí" if i % 3 else "No", str(r.estado or ""), str(r.componente_01 or ""), "texto"] for i, r in enumerate(base.itertuples())]
    p1 = os.path.join(d, "online.csv")
    p2 = os.path.join(d, "vaciado.csv")
    _write_two_row_csv(p1, top, bottom, rows[:30])
    _write_two_row_csv(p2, top, bottom, rows[30:])
    df = exports.read_two_row_header(spark, [p1, p2], header_path=p1)
    assert df.columns[:5] == ["respondent_id", "response", "mentores", "mentitos", "otro_especifique"]
    assert df.count() == 50
    assert df.where(F.col("response") == "Response").count() == 0
    assert df.select("_row").distinct().count() == 50


def test_sinks_roundtrip_and_named_read(spark):
    root = tempfile.mkdtemp(prefix="sondeo-out-")
    a = spark.createDataFrame([("x", 1.0)], "term string, estimate double")
    b = spark.createDataFrame([("y", 2.0)], "term string, estimate double")
    sinks.write_results({"glm 23-24": a, "glm nl 24-25": b}, root)
    got = sinks.read_results(spark, root, "glm*", name_regex=r"glm .*?-[0-9]{2}").toPandas()
    assert sorted(got["model"]) == ["glm 23-24", "glm nl 24-25"]
    part = os.path.join(root, "waves")
    w = exports.ingest_waves({"23-24": a, "24-25": b})
    sinks.write_table(w, part, partition_by=["wave"])
    assert sorted(os.listdir(part))[-2:] == ["wave=23-24", "wave=24-25"]


def test_wave_stream_available_now(spark):
    root = tempfile.mkdtemp(prefix="sondeo-stream-")
    landing = os.path.join(root, "landing")
    base = survey_base(spark, SF_SMALL).select("respondent_id", "sexo", "edad")
    for wv in ("23-24", "24-25"):
        base.where(F.col("respondent_id") % 2 == (0 if wv == "23-24" else 1)).write.parquet(os.path.join(landing, f"wave={wv}"))
    schema = "respondent_id bigint, sexo string, edad int"
    stream = waves.wave_stream(spark, landing, schema, lambda df: df.withColumn("edad", F.when(F.col("edad") != 99, F.col("edad"))), wave_regex=r"wave=([^/]+)")
    q = waves.start_wave_ingestion(stream, os.path.join(root, "sink"), os.path.join(root, "chk"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(root, "sink"))
    assert out.count() == base.count()
    assert out.where(F.col("edad") == 99).count() == 0
    assert {r.wave for r in out.select("wave").distinct().collect()} == {"23-24", "24-25"}


def test_second_header_line_goes_whatever_it_holds(spark, tmp_path):
    from sondeo.sources.exports import merge_header, read_two_row_header

    assert merge_header(["Acepta?", "Q2", "Q3"], ["Response", "Response", "Edad"]) == ["Acepta?", "Q2", "Edad"]
    (tmp_path / "a.csv").write_text("Q1,Q2\nResponse,Edad\nsi,1\nResponse,Edad\n")
    (tmp_path / "b.csv").write_text("Q1,Q2\nOpen-Ended Response,Edad\nno,2\n")
    df = read_two_row_header(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], header_path=str(tmp_path / "a.csv"))
    assert sorted(tuple(r)[:2] for r in df.collect()) == [("Response", "Edad"), ("no", "2"), ("si", "1")]


def test_replace_first_after_a_newline(spark):
    from sondeo.functions.text import replace_first

    df = spark.createDataFrame([("a\nb1 b2",)], "x string")
    assert df.select(replace_first("x", r"b(?<n>\d)", "c$1")).head()[0] == "a\nc1 b2"
