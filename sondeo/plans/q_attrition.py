"""Registered attrition queries: ages, linkage, scores, standardisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AGE_BREAKS, MUNICIPALITY_PATTERNS, NA_PATTERN
from ..functions import dates as dt
from ..functions import recode as rc
from ..functions import text as tx
from ..operators import freq, grouped, linkage
from ..operators.scoring import standardize
from ..sources import fixtures
from . import attrition
from .catalog import register, round6
from .sqlkit import r6, survey_cte

MUNI_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(municipio), '{pat}') THEN '{lab}'" for pat, lab in MUNICIPALITY_PATTERNS) + " END"
REFUSALS_SQL = ", ".join(f"'{v}'" for v in NA_PATTERN)

ENDLINE_SQL = """endline AS (SELECT o_custkey AS cid FROM orders WHERE o_orderdate >= TIMESTAMP '2001-05-01'
  UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 2001)"""

ADOL_SQL = f"""{survey_cte()}, {ENDLINE_SQL},
adol AS (SELECT respondent_id AS id, customer_id, CASE sexo WHEN 'M' THEN 'Mujer' WHEN 'H' THEN 'Hombre' END AS sexo,
   CASE WHEN edad = 99 OR edad < 10 THEN NULL ELSE edad END AS edad, estado, wave, fecha, estatus AS trabajo,
   CASE WHEN contains(modelo_seguir, 'Sí') THEN 'Sí' WHEN NOT contains(modelo_seguir, 'Sí') THEN 'No' END AS modelo_seguir,
   {MUNI_SQL} AS municipio,
   CASE WHEN socioeco = 0 THEN NULL ELSE socioeco END AS socioeco,
   CASE WHEN customer_id IN (SELECT cid FROM endline) THEN 1 ELSE 0 END AS status,
   q1 AS liderazgo1, q2 AS liderazgo2, q3 AS liderazgo3, q4 AS liderazgo4,
   q5 AS empatia1, q6 AS empatia2, q7 AS empatia3, q8 AS empatia4 FROM survey),
adol_w AS (SELECT *, coalesce(liderazgo1, 0) + coalesce(liderazgo2, 0) + coalesce(liderazgo3, 0) + coalesce(liderazgo4, 0) AS liderazgo,
   coalesce(empatia1, 0) + coalesce(empatia2, 0) + coalesce(empatia3, 0) + coalesce(empatia4, 0) AS empatia FROM adol),
adol_long AS (SELECT id, estado, status, edad, 'liderazgo' AS dim, liderazgo AS score FROM adol_w
   UNION ALL SELECT id, estado, status, edad, 'empatia', empatia FROM adol_w),
r360 AS ({fixtures.ratings_360_sql()}),
r360_k AS (SELECT id, TRY_CAST(regexp_replace(regexp_replace(id_mentor_raw, ' .*', ''), '5CU', '5CH') AS BIGINT) AS id_mentor,
   coalesce(liderazgo1, 0) + coalesce(liderazgo2, 0) AS liderazgo_360, coalesce(empatia1, 0) + coalesce(empatia2, 0) AS empatia_360 FROM r360),
ment AS ({fixtures.mentors_sql()}),
ment_k AS (SELECT id_mentor, CASE WHEN sexo_mentor = 'Otro (especifique)' THEN 'Otro' ELSE sexo_mentor END AS sexo_mentor,
   coalesce(liderazgo1, 0) + coalesce(liderazgo2, 0) AS liderazgo_mentor, coalesce(empatia1, 0) + coalesce(empatia2, 0) AS empatia_mentor FROM ment)"""


# --------------------------------------------------------------------- C16-C20


@register("age_from_dob", f"""WITH b AS ({fixtures.birth_dates_sql()}),
p AS (SELECT respondent_id, fecha_nac, CAST(try_strptime(regexp_replace(trim(fecha_nac), '[-. ]+', '/', 'g'), '%d/%m/%Y') AS DATE) AS dob FROM b),
y AS (SELECT *, year(DATE '2023-06-06') - year(dob) - CASE WHEN month(DATE '2023-06-06') < month(dob)
        OR (month(DATE '2023-06-06') = month(dob) AND day(DATE '2023-06-06') < day(dob)) THEN 1 ELSE 0 END AS yrs FROM p),
a AS (SELECT *, round_even(yrs + date_diff('day', CAST(dob + to_years(yrs) AS DATE), DATE '2023-06-06')
        / date_diff('day', CAST(dob + to_years(yrs) AS DATE), CAST(dob + to_years(yrs + 1) AS DATE)), 0) AS edad_calendar,
        round_even(date_diff('day', dob, DATE '2023-06-06') / 365.25, 0) AS edad_365 FROM y)
SELECT respondent_id, fecha_nac, CAST(dob AS VARCHAR) AS dob, edad_calendar, edad_365,
  CASE WHEN edad_calendar BETWEEN 10 AND 30 THEN edad_calendar END AS edad FROM a""")
def age_from_dob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Birth-date text -> date -> age at the reference date, two conventions; out of 10..30 -> NULL."""
    b = fixtures.birth_dates(spark, sf_dir).withColumn("dob", dt.parse_dmy("fecha_nac"))
    out = b.withColumns({"edad_calendar": dt.age_calendar("dob"), "edad_365": dt.age_average_year("dob")})
    out = out.withColumn("edad", rc.keep_between("edad_calendar", 10, 30))
    return out.withColumn("dob", F.col("dob").cast("string"))


def _bins_sql() -> str:
    cases = " ".join(f"WHEN edad > {lo} AND edad <= {hi} THEN '({lo},{hi}]'" for lo, hi in zip(AGE_BREAKS[:-1], AGE_BREAKS[1:]))
    return f"WITH {ADOL_SQL}\nSELECT CASE {cases} END AS edad_cat, count(*) AS n FROM adol GROUP BY 1"


@register("age_bins", _bins_sql())
def age_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned age (sentinels -> NULL) in right-closed bins, counted with the NA bin."""
    a = attrition.adolescents(spark, sf_dir).withColumn("edad_cat", dt.cut_right_closed("edad"))
    return freq.count_by(a, "edad_cat")


# --------------------------------------------------------------------- F8, G24, J3


@register("latest_record", f"""WITH e AS ({fixtures.dated_events_sql()}),
s AS (SELECT user_id, max(fecha) AS mx, count(*) - count(fecha) AS nn FROM e GROUP BY user_id)
SELECT e.* REPLACE (strftime(e.fecha, '%Y-%m-%d') AS fecha) FROM e JOIN s ON e.user_id = s.user_id WHERE e.fecha = s.mx AND s.nn = 0""")
def latest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest-dated record(s) per user, ties kept, users with a missing date dropped.
    The survey date is reported as ISO text."""
    out = linkage.latest_per_key(fixtures.dated_events(spark, sf_dir), "user_id", "fecha")
    return round6(out.withColumn("fecha", F.date_format("fecha", "yyyy-MM-dd")))


@register("first_record", f"""WITH e AS ({fixtures.dated_events_sql()})
SELECT * REPLACE (strftime(fecha, '%Y-%m-%d') AS fecha) FROM e WHERE event_id IN (SELECT min(event_id) FROM e GROUP BY user_id)""")
def first_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First record per user in ingestion order (``distinct(id, .keep_all=TRUE)``).
    The survey date is reported as ISO text."""
    out = linkage.first_per_key(fixtures.dated_events(spark, sf_dir), "user_id", "event_id")
    return round6(out.withColumn("fecha", F.date_format("fecha", "yyyy-MM-dd")))


@register("completion_flag", """WITH ids AS (
  SELECT o_custkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '2001-05-01'
  UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 2001)
SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey IN (SELECT id FROM ids) THEN 1 ELSE 0 END AS status FROM customer""")
def completion_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed-the-programme flag from two endline tables."""
    return attrition.completion(spark, sf_dir)


@register("completion_rate", """WITH ids AS (
  SELECT o_custkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '2001-05-01'
  UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 2001),
f AS (SELECT c_mktsegment, CASE WHEN c_custkey IN (SELECT id FROM ids) THEN 'Concluyó' ELSE 'No concluyó' END AS status FROM customer)
SELECT c_mktsegment, status, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment) * 100.0, 6) AS prop
FROM f GROUP BY c_mktsegment, status""")
def completion_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share completing per segment, labelled outcome (J3, C25 labels, G8)."""
    c = attrition.completion(spark, sf_dir, labels=True)
    return round6(freq.frequency_within(c, ["c_mktsegment", "status"], ["c_mktsegment"]))


# --------------------------------------------------------------------- J1, J2, W1, W5, G26


@register("score_join_long", f"""WITH {ADOL_SQL},
r_long AS (SELECT id, id_mentor, 'liderazgo_360' AS dim_360, liderazgo_360 AS score_360 FROM r360_k
   UNION ALL SELECT id, id_mentor, 'empatia_360', empatia_360 FROM r360_k),
m_long AS (SELECT id_mentor, 'liderazgo_mentor' AS dim_mentor, liderazgo_mentor AS score_mentor FROM ment_k
   UNION ALL SELECT id_mentor, 'empatia_mentor', empatia_mentor FROM ment_k)
SELECT a.id, a.estado, a.status, a.dim, a.score, r.id_mentor, r.dim_360, r.score_360, m.dim_mentor, m.score_mentor
FROM adol_long a JOIN r_long r ON a.id = r.id JOIN m_long m ON r.id_mentor = m.id_mentor""")
def score_join_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long adolescent scores joined to 360 and mentor scores, full fan-out."""
    return attrition.linked_long_scores(spark, sf_dir)


def _z(col: str, src: str) -> str:
    return f"(({col}) - (SELECT avg({col}) FROM {src})) / (SELECT stddev_samp({col}) FROM {src})"


@register("score_join_wide", f"""WITH {ADOL_SQL},
a AS (SELECT id, sexo, estado, status, {_z('socioeco', 'adol_w')} AS socioeco, {_z('liderazgo', 'adol_w')} AS liderazgo,
   {_z('empatia', 'adol_w')} AS empatia FROM adol_w),
r AS (SELECT id, id_mentor, {_z('liderazgo_360', 'r360_k')} AS liderazgo_360, {_z('empatia_360', 'r360_k')} AS empatia_360 FROM r360_k),
m AS (SELECT id_mentor, sexo_mentor, {_z('liderazgo_mentor', 'ment_k')} AS liderazgo_mentor, {_z('empatia_mentor', 'ment_k')} AS empatia_mentor FROM ment_k)
SELECT m.id_mentor, m.sexo_mentor, {r6('m.liderazgo_mentor', 'liderazgo_mentor')}, {r6('m.empatia_mentor', 'empatia_mentor')},
  r.id, {r6('r.liderazgo_360', 'liderazgo_360')}, {r6('r.empatia_360', 'empatia_360')},
  a.sexo, a.estado, a.status, {r6('a.socioeco', 'socioeco')}, {r6('a.liderazgo', 'liderazgo')}, {r6('a.empatia', 'empatia')}
FROM m JOIN r ON m.id_mentor = r.id_mentor JOIN a ON r.id = a.id""")
def score_join_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide z-scored mentor ⋈ 360 ⋈ adolescent table."""
    return round6(attrition.linked_wide_scores(spark, sf_dir))


@register("zscore_by_wave", f"""WITH {ADOL_SQL}
SELECT id, wave,
  {r6('(socioeco - avg(socioeco) OVER (PARTITION BY wave)) / stddev_samp(socioeco) OVER (PARTITION BY wave)', 'socioeco')},
  {r6('(liderazgo - avg(liderazgo) OVER (PARTITION BY wave)) / stddev_samp(liderazgo) OVER (PARTITION BY wave)', 'liderazgo')},
  {r6('(empatia - avg(empatia) OVER (PARTITION BY wave)) / stddev_samp(empatia) OVER (PARTITION BY wave)', 'empatia')}
FROM adol_w""")
def zscore_by_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-wave standardisation of socio-economic level and scale totals."""
    a = attrition.adolescents(spark, sf_dir)
    scales = attrition.scales_from_names(a.columns)
    w = a.select("id", "wave", "socioeco", *[attrition.row_sum(v).alias(k) for k, v in scales.items()])
    return round6(standardize(w, ["socioeco", *scales], by=["wave"]))


@register("score_summary_by_status", f"""WITH {ADOL_SQL}
SELECT dim, status, {r6('avg(score)', 'score_mean')}, {r6('stddev_samp(score)', 'score_sd')} FROM adol_long GROUP BY dim, status""")
def score_summary_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and sd of scale scores by dimension and outcome."""
    a = attrition.adolescents(spark, sf_dir)
    long = a.select("id", "estado", "status", "edad", attrition.score_array(attrition.scales_from_names(a.columns), "dim", "score").alias("_s")).select(
        "id", "estado", "status", "edad", F.inline("_s"))
    return round6(grouped.mean_sd_by(long, ["dim", "status"], "score"))


@register("score_summary_by_age", f"""WITH {ADOL_SQL}
SELECT CAST(edad AS DOUBLE) AS edad, dim, status, {r6('avg(score)', 'score_mean')}, {r6('stddev_samp(score)', 'score_sd')} FROM adol_long GROUP BY edad, dim, status""")
def score_summary_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and sd of scale scores by age, dimension and outcome."""
    a = attrition.adolescents(spark, sf_dir)
    long = a.select("edad", "status", attrition.score_array(attrition.scales_from_names(a.columns), "dim", "score").alias("_s")).select(
        "edad", "status", F.inline("_s"))
    out = grouped.mean_sd_by(long, ["edad", "dim", "status"], "score")
    return round6(out.withColumn("edad", F.col("edad").cast("double")))


@register("attrition_clean", f"""WITH {survey_cte()}
SELECT respondent_id AS id,
  CAST(CASE WHEN edad BETWEEN 10 AND 30 THEN edad END AS DOUBLE) AS edad,
  CAST(CASE WHEN socioeco = 0 THEN NULL ELSE socioeco END AS DOUBLE) AS socioeco,
  CASE WHEN upper(substr(municipio, 1, 1)) || lower(substr(municipio, 2)) IN ({REFUSALS_SQL}) THEN NULL
       ELSE upper(substr(municipio, 1, 1)) || lower(substr(municipio, 2)) END AS municipio_texto,
  {MUNI_SQL} AS municipio,
  CASE WHEN contains(modelo_seguir, 'Sí') THEN 'Sí' WHEN NOT contains(modelo_seguir, 'Sí') THEN 'No' END AS modelo_seguir
FROM survey""")
def attrition_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline cleaning chain per respondent (numeric outputs as DOUBLE): age range (F7), sentinel (C6),
    sentence-cased place then exact refusals (C14, C7, D18), canonical place by
    first matching pattern (C9), yes/no before refusals (C8, D3)."""
    b = fixtures.survey_base(spark, sf_dir)
    out = b.select(
        F.col("respondent_id").alias("id"),
        rc.keep_between("edad", 10, 30).cast("double").alias("edad"),
        rc.null_if("socioeco", F.col("socioeco") == 0).cast("double").alias("socioeco"),
        tx.sentence_case("municipio").alias("municipio_texto"),
        rc.first_match(F.lower("municipio"), MUNICIPALITY_PATTERNS).alias("municipio"),
        rc.contains_yes_no("modelo_seguir", "Sí").alias("modelo_seguir"),
    )
    return rc.refusals_to_null(out, NA_PATTERN)
