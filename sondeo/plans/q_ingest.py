"""Registered queries of ingestion, selection, stored results and the smaller column functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PERSONAL_COLUMNS, PERSON_NAME_COLUMNS, SIMILARITY_FREQUENCY_LABELS
from ..functions import dates as dt
from ..functions import recode as rc
from ..functions import selectors as sel
from ..functions import text as tx
from ..functions.rounding import round_numeric
from ..operators import quantiles, reshape
from ..session import checkpoint_dir
from ..sources import exports, fixtures, sinks
from ..sources.tables import load
from . import attrition
from . import psychometrics as ps
from .catalog import register, round6
from .q_attrition import ADOL_SQL
from .sqlkit import r6, survey_cte


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/sondeo-files-{uuid.uuid4().hex[:12]}/{name}"


# --------------------------------------------------------------------- S1-S4, S9: two-row headers

TOP = ["Respondent ID", "Collector ID", "Date Created", "Email Address", "¿Aceptas participar en esta encuesta?", "Estado",
       *["¿Qué tanto te pareces?"] * 8, "¿Con quién mantienes contacto?", "", ""]
BOTTOM = ["", "", "", "", "Response", "Response", *[f"Frase {i}" for i in range(1, 9)], "Otro (especifique)", "Otro (especifique)", ""]
EXPORTS = {"online": ("Online Línea Base 25-26", BOTTOM), "vaciado": ("Vaciado Línea Base 25-26", ["Open-Ended Response" if b == "Response" else b for b in BOTTOM])}


def written_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey written as two exports (names with blanks, different second header lines) and read back in one scan under the first one's header."""
    e = ps.export_frame(spark, sf_dir).withColumn("acepta", F.when(F.col("respondent_id") % 7 == 0, F.lit("No")).otherwise(F.lit("Sí")))
    mail = F.concat(F.lit("r"), F.col("respondent_id").cast("string"), F.lit("@example.org"))
    cols = [F.col("respondent_id"), F.lit("c1").alias("collector"), F.lit("2025-09-01").alias("created"), mail.alias("mail"), F.col("acepta"), F.col("estado"),
            *[F.col(f"p{i}") for i in range(1, 9)], F.lit("otra, persona").alias("o1"), F.lit(None).cast("string").alias("o2"), F.lit("x").alias("blank")]
    paths = []
    for number, (folder, bottom) in enumerate(EXPORTS.values()):
        path = scratch(spark, folder)
        sinks.write_two_row_export(e.where(F.col("respondent_id") % 2 == number).select(*cols), path, TOP, bottom)
        paths.append(path)
    return exports.read_two_row_header(spark, paths, clean=False)


_EXPORT_CTE = f"""WITH {survey_cte()},
e AS (SELECT respondent_id AS id, CASE WHEN respondent_id % 2 = 0 THEN 'online' ELSE 'vaciado' END AS origin, estado, respondent_id % 7 <> 0 AS acepta, {', '.join(f'q{i}' for i in range(1, 9))} FROM survey)"""


@register("ingest_exports", f"""{_EXPORT_CTE}
SELECT id, origin, estado, {', '.join(f'CAST(q{i} AS DOUBLE) AS {n}' for i, n in enumerate(ps.ITEMS, start=1))} FROM e WHERE acepta""")
def ingest_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-row-header exports to coded items: header merge, blank headers, positions, clean names, personal data removed, consent
    and key filters, recode (S1-S4, S9, P1, P3, P5, P6, P12, P13, C3)."""
    raw = sel.drop_blank_headers(written_exports(spark, sf_dir))
    df = sel.rename_by_position(raw, {"id": 1}).toDF(*["id", *exports.clean_names(raw.columns[1:])])
    df = sel.drop_lenient(df, [*PERSONAL_COLUMNS, *PERSON_NAME_COLUMNS])
    accepted = df.where((F.col("aceptas_participar_en_esta_encuesta") == "Sí") & F.col("id").isNotNull())
    origin = F.when(F.col("file").contains("/Online "), "online").otherwise("vaciado")
    answers = sel.columns_at(accepted, range(4, 12))
    coded = accepted.select(
        F.col("id").cast("bigint").alias("id"), origin.alias("origin"), "estado",
        *[rc.multi_vocabulary_codes(a, SIMILARITY_FREQUENCY_LABELS).cast("double").alias(a) for a in answers],
    )
    return sel.select_strict(sel.set_names(coded, ["id", "origin", "estado", *ps.ITEMS]), ["id", "origin", "estado", *ps.ITEMS])


@register("ingest_ordinals", f"""{_EXPORT_CTE}
SELECT origin, count(*) AS n, count(*) AS n_ordinals, count(*) FILTER (WHERE acepta) AS n_accepted, CAST(0 AS BIGINT) AS n_header_rows FROM e GROUP BY origin""")
def ingest_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct ordinals (file, split, place), accepted rows and left-over header rows of each export."""
    df = written_exports(spark, sf_dir)
    origin = F.when(F.col("_file").contains("/Online "), "online").otherwise("vaciado")
    yes = F.col("`¿Aceptas participar en esta encuesta?`")
    return df.groupBy(origin.alias("origin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("_file", "_block", "_place").alias("n_ordinals"),
        F.count_if(yes == "Sí").alias("n_accepted"), F.count_if(yes.isin("Response", "Open-Ended Response")).alias("n_header_rows"),
    )


# --------------------------------------------------------------------- S6-S8: stored tables


@register("typed_export", f"""WITH {survey_cte()} SELECT respondent_id, CAST(edad AS DOUBLE) AS edad, sexo, true AS in_order FROM survey""")
def typed_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimited export with one header row read into a typed table with an ordinal that follows the file."""
    path = scratch(spark, "exportación 1")
    rows = fixtures.survey_base(spark, sf_dir).select("respondent_id", "edad", "sexo")
    rows.repartitionByRange("respondent_id").sortWithinPartitions("respondent_id").write.option("header", True).csv(path)
    df = exports.read_export(spark, path, schema="respondent_id bigint, edad double, sexo string")
    before = F.lag("respondent_id").over(Window.partitionBy("_file").orderBy(exports.ROW))
    return df.select("respondent_id", "edad", "sexo", (F.coalesce(before, F.lit(-1)) < F.col("respondent_id")).alias("in_order"))


@register("wave_partitions", f"""WITH {survey_cte()} SELECT wave, sexo, count(*) AS n FROM survey GROUP BY wave, sexo""")
def wave_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey written as one partition per wave and read back."""
    path = scratch(spark, "lb mentitos")
    sinks.write_table(fixtures.survey_base(spark, sf_dir).select("respondent_id", "sexo", "wave"), path, partition_by=["wave"])
    return spark.read.parquet(path).groupBy("wave", "sexo").agg(F.count(F.lit(1)).alias("n"))


@register("results_catalog", f"""WITH {survey_cte()}
SELECT 'freq ' || wave AS model, estatus, count(*) AS n FROM survey GROUP BY wave, estatus""")
def results_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table per wave found, stored under names with blanks, read back at once and named by path."""
    b = fixtures.survey_base(spark, sf_dir)
    counts = b.groupBy("wave", "estatus").agg(F.count(F.lit(1)).alias("n"))
    waves = [r["wave"] for r in counts.select("wave").distinct().collect()]  # one row per wave
    root = scratch(spark, "out")
    sinks.write_results({f"freq {w}": counts.where(F.col("wave") == w).drop("wave") for w in waves}, root)
    return sinks.read_results(spark, root, "freq*", name_regex=r"freq [0-9]{2}-[0-9]{2}").select("model", "estatus", "n")


# --------------------------------------------------------------------- selection and small functions


@register("rater_items", f"""SELECT id, 10 * liderazgo1 AS liderazgo1, 10 * liderazgo2 AS liderazgo2, CAST(10 * empatia1 AS BIGINT) AS empatia1, CAST(10 * empatia2 AS DOUBLE) AS empatia2
FROM ({fixtures.ratings_360_sql()})""")
def rater_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items chosen by pattern, an expression over all of them under templated names, strict selection, suffix removed."""
    r = fixtures.ratings_360(spark, sf_dir).withColumn("...7", F.lit(1))
    r = sel.drop_blank_headers(r)
    items = sel.select_names(r, matches=r"^(liderazgo|empatia)\d+$")
    wide = sel.across(r, items, lambda c: c * 10, "{col}_x10")
    chosen = sel.select_strict(wide, ["id", *sel.select_names(wide, ends_with="_x10", dtype="numeric")])
    return sel.strip_suffix(chosen, "_x10").withColumn("empatia2", F.col("empatia2").cast("double"))


@register("link_keys", """SELECT c_custkey, CAST(c_custkey AS VARCHAR) || coalesce(lower(substr(CASE WHEN c_custkey % 17 <> 0 THEN c_mktsegment END, 1, 3)), 'NA') AS link FROM customer""")
def link_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite link key: id and the first letters of a name, a missing name printed as NA."""
    c = load(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"]).withColumn("nombre", F.when(F.col("c_custkey") % 17 != 0, F.col("c_mktsegment")))
    return c.select("c_custkey", tx.link_key("c_custkey", "nombre").alias("link"))


@register("repaired_keys", """WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '5CU' ELSE '5CH' END || c_custkey || ' 5CU ' || coalesce(c_mktsegment, '') AS raw FROM customer)
SELECT c_custkey, regexp_replace(regexp_replace(raw, ' .*', ''), '5CU', '5CH') AS id_mentor FROM k""")
def repaired_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentor keys with trailing text removed and the known code typo mended."""
    c = load(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    code = F.when(F.col("c_custkey") % 5 == 0, F.lit("5CU")).otherwise(F.lit("5CH"))
    raw = F.concat(code, F.col("c_custkey").cast("string"), F.lit(" 5CU "), F.coalesce("c_mktsegment", F.lit("")))
    return c.select("c_custkey", tx.repair_mentor_key(raw).alias("id_mentor"))


@register("rounded_rates", f"""WITH {ADOL_SQL}
SELECT estado, round_even(avg(edad), 1) AS mean_age, round_even(avg(status) * 100.0, 1) AS pct, CAST(sum(status) AS BIGINT) AS completed FROM adol GROUP BY estado""")
def rounded_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome labels to 1/0 and every fractional column of the result rounded half to even."""
    a = attrition.adolescents(spark, sf_dir)
    label = F.when(F.col("status") == 1, F.lit(attrition.STATUS_LABELS[0])).otherwise(F.lit(attrition.STATUS_LABELS[1]))
    a = a.withColumn("status", rc.outcome_flag(label, attrition.STATUS_LABELS[0]))
    out = a.groupBy("estado").agg(F.avg("edad").alias("mean_age"), (F.avg("status") * 100).alias("pct"), F.sum("status").alias("completed"))
    return round_numeric(out, 1)


@register("age_sources", f"""WITH {survey_cte()}, b AS ({fixtures.birth_dates_sql()}),
p AS (SELECT respondent_id, CAST(try_strptime(regexp_replace(trim(fecha_nac), '[-. ]+', '/', 'g'), '%d/%m/%Y') AS DATE) AS dob FROM b),
y AS (SELECT *, year(DATE '2023-06-06') - year(dob) - CASE WHEN month(DATE '2023-06-06') < month(dob)
        OR (month(DATE '2023-06-06') = month(dob) AND day(DATE '2023-06-06') < day(dob)) THEN 1 ELSE 0 END AS yrs FROM p)
SELECT 'edad' AS source, respondent_id, CAST(edad AS DOUBLE) AS edad FROM survey
UNION ALL SELECT 'fecha_nac number', respondent_id, CAST(edad AS DOUBLE) FROM survey
UNION ALL SELECT 'fecha_nac text', respondent_id, round_even(yrs + date_diff('day', CAST(dob + to_years(yrs) AS DATE), DATE '2023-06-06')
        / date_diff('day', CAST(dob + to_years(yrs) AS DATE), CAST(dob + to_years(yrs + 1) AS DATE)), 0) FROM y""")
def age_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of three kinds of exports: given, in a numeric birth column, from birth-date text."""
    b = fixtures.survey_base(spark, sf_dir).select("respondent_id", "edad")
    frames = {"edad": b, "fecha_nac number": b.withColumnRenamed("edad", "fecha_nac"), "fecha_nac text": fixtures.birth_dates(spark, sf_dir)}
    parts = [dt.with_age(f).select(F.lit(k).alias("source"), "respondent_id", F.col("edad").cast("double").alias("edad")) for k, f in frames.items()]
    return reshape.union_by_name(parts)


@register("regex_rows", f"""WITH {survey_cte()} SELECT municipio, count(*) AS n FROM survey WHERE regexp_matches(municipio, '(?i)garc(i|í)a|^santa') GROUP BY municipio""")
def regex_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text matches a pattern."""
    b = fixtures.survey_base(spark, sf_dir).select("municipio")
    return tx.keep_matching(b, "municipio", r"(?i)garc(i|í)a|^santa").groupBy("municipio").agg(F.count(F.lit(1)).alias("n"))


@register("wide_with_missing", f"""WITH {ADOL_SQL}, c AS (SELECT estado, sexo, count(*) AS n FROM adol GROUP BY estado, sexo)
SELECT estado, CAST(max(n) FILTER (WHERE sexo = 'Hombre') AS DOUBLE) AS Hombre, CAST(max(n) FILTER (WHERE sexo = 'Mujer') AS DOUBLE) AS Mujer,
  CAST(max(n) FILTER (WHERE sexo IS NULL) AS DOUBLE) AS "NA" FROM c GROUP BY estado""")
def wide_with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by state, one column per sex found and one for the missing (R2)."""
    counts = attrition.adolescents(spark, sf_dir).groupBy("estado", "sexo").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return reshape.wider(counts, ["estado"], "sexo", "n")


# --------------------------------------------------------------------- G20, V1: continuous columns

_PROBS = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


@register("price_quantiles", " UNION ALL ".join(
    f"SELECT o_orderpriority, CAST({p} AS DOUBLE) AS prob, {r6(f'quantile_cont(o_totalprice, {p})', 'quantile')} FROM orders GROUP BY o_orderpriority"
    f" UNION ALL SELECT NULL, CAST({p} AS DOUBLE), {r6(f'quantile_cont(o_totalprice, {p})', 'quantile')} FROM orders" for p in _PROBS))
def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of a continuous column by group and over the whole table, from bracketed ranks."""
    o = load(spark, sf_dir, "orders", ["o_orderpriority", "o_totalprice"], balance=True)
    whole = quantiles.exact_quantiles(o, "o_totalprice", _PROBS).withColumn("o_orderpriority", F.lit(None).cast("string"))
    return round6(quantiles.exact_quantiles(o, "o_totalprice", _PROBS, ["o_orderpriority"]).unionByName(whole))
