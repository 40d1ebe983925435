"""Survey-shaped inputs derived from the driver tables.

The analyses expect questionnaire exports (one row per respondent, Likert
items, demographics, multi-response options, open text, several raters).
The driver ships TPC-H-like tables instead, so each input below is a
deterministic projection of those tables. Every row of the source tables is
kept; modulo expressions only *derive* attribute values (missing answers,
sentinel codes), they never filter rows.

Each builder has a twin SQL text (``*_sql``) that DuckDB runs unchanged, used
by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MENTOR_REVERSED_ITEMS, MENTOR_SCALES
from ..functions.selectors import item_names
from ..plans.memo import shared_plan
from .tables import load

# Free-text municipality answers and raw "role model" answers cycled over
# customers / orders (fixture constants).
PLACE_TEXTS = ["Ciudad Victoria", "santa catarina", "ECATEPEC", "La Presa", "Garcia", "García NL", "Fama",
               "Chihuahua capital", "Prefiero no contestar", "Monterrey", "No contestó"]
ROLE_MODEL_TEXTS = ["Sí, mi mamá", "No", "Prefiero no contestar", "Sí", "No contestó", "No sé"]

# Item noise multipliers of the eight survey items (fixture constants).
ITEM_MULTIPLIERS = [101, 211, 307, 401, 503, 601, 701, 809]
MENTOR_ITEMS = item_names(MENTOR_SCALES)
REVERSED_ITEM = 5  # q5 is generated reverse-keyed


def _item(mult: int) -> "F.Column":
    okey = F.col("o_orderkey")
    raw = F.lit(6) * F.floor(F.col("o_totalprice")).cast("bigint") + F.lit(2000) * ((okey * mult) % 997)
    return F.least(F.lit(4), F.lit(1) + F.floor(raw / F.lit(1250000)).cast("int"))


@shared_plan
def survey_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order = one respondent (B1).

    orders -> customer -> nation -> region. nation/region are fixed-size
    dimensions that Catalyst broadcasts from their measured size; the
    orders-customer join is sized by AQE (sort-merge at scale).
    """
    o = load(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], balance=True)
    c = load(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    n = load(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    r = load(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    # Star order: fact x its dimension first, then the fixed-size dimensions.
    # (Without table statistics Spark sizes a join as the product of its
    # inputs, so pre-joining the dimensions would make them look larger than
    # the fact table and steer the broadcast to the wrong side.)
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)

    okey, ckey = F.col("o_orderkey"), F.col("o_custkey")
    cols = {
        "respondent_id": okey,
        "customer_id": ckey,
        "fecha": F.col("o_orderdate"),
        "wave": F.when(F.year("o_orderdate") < 1998, F.lit("23-24")).otherwise(F.lit("24-25")),
        "sexo": F.when(F.col("o_orderstatus") == "O", F.lit("M"))
        .when(F.col("o_orderstatus") == "F", F.lit("H"))
        .when(okey % 2 == 0, F.lit("M"))
        .otherwise(F.lit("X")),
        "edad": F.when(ckey % 20 == 0, F.lit(99)).when(ckey % 23 == 0, F.lit(None)).otherwise(F.lit(10) + (ckey % 8).cast("int")),
        "estado": F.when(okey % 41 != 0, F.col("r_name")),
        "generacion": F.when(okey % 31 == 0, F.lit(None).cast("string"))
        .when(okey % 11 == 0, F.lit("Otra (no recuerdo)"))
        .when(okey % 13 == 0, F.lit("Sin periodo"))
        .otherwise(
            F.concat(
                F.lit("Generacion "), (ckey % 4).cast("string"), F.lit(" ("),
                (F.lit(2018) + ckey % 4).cast("string"), F.lit(" - "),
                (F.lit(2019) + ckey % 4).cast("string"), F.lit(")"),
            )
        ),
        "estatus": F.when(okey % 19 != 0, F.col("c_mktsegment")),
        "socioeco": F.when(ckey % 9 == 0, F.lit(0)).otherwise((ckey % 10).cast("int")),
        "componente_01": F.when(okey % 3 == 0, F.lit("comp A")),
        "componente_02": F.when(okey % 4 == 0, F.lit("comp B")),
        "componente_03": F.when(okey % 5 == 0, F.col("o_orderpriority")),
        "status": F.when(F.col("o_orderstatus") == "F", F.lit(1)).otherwise(F.lit(0)),
        "municipio": F.element_at(F.array(*[F.lit(t) for t in PLACE_TEXTS]), (ckey % len(PLACE_TEXTS) + 1).cast("int")),
        "modelo_seguir": F.when(okey % 13 != 7, F.element_at(F.array(*[F.lit(t) for t in ROLE_MODEL_TEXTS]), (okey % len(ROLE_MODEL_TEXTS) + 1).cast("int"))),
    }
    for i, m in enumerate(ITEM_MULTIPLIERS, start=1):
        val = _item(m)
        if i == REVERSED_ITEM:
            val = F.lit(5) - val
        cols[f"q{i}"] = F.when(okey % 29 != i, val)
    return j.select(*[v.alias(k) for k, v in cols.items()])


def survey_base_sql() -> str:
    """DuckDB twin of :func:`survey_base` (a SELECT, to be used as a CTE)."""
    items = []
    for i, m in enumerate(ITEM_MULTIPLIERS, start=1):
        val = f"least(4, 1 + CAST(floor((6*CAST(floor(o_totalprice) AS BIGINT) + 2000*((o_orderkey*{m}) % 997)) / 1250000) AS INT))"
        if i == REVERSED_ITEM:
            val = f"5 - {val}"
        items.append(f"CASE WHEN o_orderkey % 29 = {i} THEN NULL ELSE {val} END AS q{i}")
    return f"""SELECT o_orderkey AS respondent_id, o_custkey AS customer_id, o_orderdate AS fecha,
 CASE WHEN year(o_orderdate) < 1998 THEN '23-24' ELSE '24-25' END AS wave,
 CASE o_orderstatus WHEN 'O' THEN 'M' WHEN 'F' THEN 'H' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'M' ELSE 'X' END END AS sexo,
 CASE WHEN o_custkey % 20 = 0 THEN 99 WHEN o_custkey % 23 = 0 THEN NULL ELSE 10 + CAST(o_custkey % 8 AS INT) END AS edad,
 CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE r_name END AS estado,
 CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'Otra (no recuerdo)' WHEN o_orderkey % 13 = 0 THEN 'Sin periodo'
      ELSE concat('Generacion ', CAST(o_custkey % 4 AS VARCHAR), ' (', CAST(2018 + o_custkey % 4 AS VARCHAR), ' - ', CAST(2019 + o_custkey % 4 AS VARCHAR), ')') END AS generacion,
 CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE c_mktsegment END AS estatus,
 CASE WHEN o_custkey % 9 = 0 THEN 0 ELSE CAST(o_custkey % 10 AS INT) END AS socioeco,
 CASE WHEN o_orderkey % 3 = 0 THEN 'comp A' END AS componente_01,
 CASE WHEN o_orderkey % 4 = 0 THEN 'comp B' END AS componente_02,
 CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS componente_03,
 CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS status,
 [{', '.join(chr(39) + t + chr(39) for t in PLACE_TEXTS)}][o_custkey % {len(PLACE_TEXTS)} + 1] AS municipio,
 CASE WHEN o_orderkey % 13 = 7 THEN NULL ELSE [{', '.join(chr(39) + t + chr(39) for t in ROLE_MODEL_TEXTS)}][o_orderkey % {len(ROLE_MODEL_TEXTS)} + 1] END AS modelo_seguir,
 {', '.join(items)}
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


# ---------------------------------------------------------------------------
# B2: other derived inputs
# ---------------------------------------------------------------------------

BAD_DATE_TEXT = "31/31/2010"


@shared_plan
def birth_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(respondent_id, fecha_nac text d/m/yyyy), an impossible date every 37th order."""
    o = load(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"], balance=True)
    d = F.col("o_orderdate")
    txt = F.concat_ws("/", F.dayofmonth(d).cast("string"), F.month(d).cast("string"), (F.year(d) + 12).cast("string"))
    return o.select(
        F.col("o_orderkey").alias("respondent_id"),
        F.when(F.col("o_orderkey") % 37 == 0, F.lit(BAD_DATE_TEXT)).otherwise(txt).alias("fecha_nac"),
    )


def birth_dates_sql() -> str:
    return f"""SELECT o_orderkey AS respondent_id,
 CASE WHEN o_orderkey % 37 = 0 THEN '{BAD_DATE_TEXT}'
      ELSE concat(CAST(day(o_orderdate) AS VARCHAR), '/', CAST(month(o_orderdate) AS VARCHAR), '/', CAST(year(o_orderdate) + 12 AS VARCHAR)) END AS fecha_nac
FROM orders"""


@shared_plan
def dated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with a day-level survey date, missing for every 997th event."""
    e = load(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"], balance=True)
    return e.select(
        "event_id", "user_id", "event_type", "value",
        F.when(F.col("event_id") % 997 != 0, F.date_trunc("day", F.col("ts"))).alias("fecha"),
    )


def dated_events_sql() -> str:
    return """SELECT event_id, user_id, event_type, value,
 CASE WHEN event_id % 997 = 0 THEN NULL ELSE date_trunc('day', ts) END AS fecha
FROM events"""


@shared_plan
def ratings_360(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 360 rating per order from its line items (A5).

    Item values use exact (integer) arithmetic only, so they do not depend on
    summation order. ``id_mentor_raw`` is the first supplier of the order followed by free text
    that the key repair removes (J5). ``liderazgo`` is an un-numbered composite
    the lenient item split must drop (R4).
    """
    li = load(spark, sf_dir, "lineitem", ["l_orderkey", "l_suppkey", "l_quantity", "l_discount"], balance=True)
    agg = li.groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("s"),
        F.max("l_quantity").alias("mx"),
        F.min("l_quantity").alias("mn"),
        F.count(F.lit(1)).alias("nl"),
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("sd"),
    )
    return agg.select(
        F.col("l_orderkey").alias("id"),
        F.concat(F.col("s").cast("string"), F.lit(" mentor")).alias("id_mentor_raw"),
        (F.lit(1) + F.col("mx").cast("bigint") % 4).alias("liderazgo1"),
        (F.lit(1) + F.col("nl") % 4).alias("liderazgo2"),
        (F.lit(1) + F.col("mn").cast("bigint") % 4).alias("empatia1"),
        F.when(F.col("l_orderkey") % 17 != 0, F.lit(1) + F.col("sd") % 4).alias("empatia2"),
        (F.col("mx") + F.col("mn")).alias("liderazgo"),
    )


def ratings_360_sql() -> str:
    return """SELECT l_orderkey AS id, CAST(min(l_suppkey) AS VARCHAR) || ' mentor' AS id_mentor_raw,
 1 + CAST(max(l_quantity) AS BIGINT) % 4 AS liderazgo1,
 1 + count(*) % 4 AS liderazgo2,
 1 + CAST(min(l_quantity) AS BIGINT) % 4 AS empatia1,
 CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE 1 + CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) % 4 END AS empatia2,
 max(l_quantity) + min(l_quantity) AS liderazgo
FROM lineitem GROUP BY l_orderkey"""


@shared_plan
def mentors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mentor per supplier."""
    s = load(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])
    k = F.col("s_suppkey")
    return s.select(
        k.alias("id_mentor"),
        F.when(F.col("s_nationkey") % 3 == 0, F.lit("Mujer"))
        .when(F.col("s_nationkey") % 3 == 1, F.lit("Hombre"))
        .otherwise(F.lit("Otro (especifique)"))
        .alias("sexo_mentor"),
        (F.lit(1) + k % 4).alias("liderazgo1"),
        (F.lit(1) + F.col("s_nationkey") % 4).alias("liderazgo2"),
        (F.lit(1) + F.floor(F.abs(F.col("s_acctbal"))).cast("bigint") % 4).alias("empatia1"),
        (F.lit(1) + (k * 7) % 4).alias("empatia2"),
    )


def mentors_sql() -> str:
    return """SELECT s_suppkey AS id_mentor,
 CASE WHEN s_nationkey % 3 = 0 THEN 'Mujer' WHEN s_nationkey % 3 = 1 THEN 'Hombre' ELSE 'Otro (especifique)' END AS sexo_mentor,
 1 + s_suppkey % 4 AS liderazgo1,
 1 + s_nationkey % 4 AS liderazgo2,
 1 + CAST(floor(abs(s_acctbal)) AS BIGINT) % 4 AS empatia1,
 1 + (s_suppkey * 7) % 4 AS empatia2
FROM supplier"""


def _mentor_item(j: int) -> str:
    """Answer of mentor item j (from 0), the same text in Spark SQL and DuckDB: noise around an order's price class."""
    value = f"least(4, greatest(1, CAST(floor(o_totalprice) AS BIGINT) // 130000 + (o_orderkey * {2 * j + 3}) % 11 // 4))"
    return f"CASE WHEN o_orderkey % 43 = {j + 1} THEN NULL ELSE {value} END"


@shared_plan
def mentor_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mentor questionnaire per order: 40 items in five scales (``config.MENTOR_SCALES``), the reverse-keyed ones as answered."""
    o = load(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"], balance=True)
    items = [f"CAST({_mentor_answer(j, n)} AS INT) AS {n}" for j, n in enumerate(MENTOR_ITEMS)]
    return o.selectExpr("o_orderkey AS respondent_id", *[i.replace("//", "div") for i in items])


def _mentor_answer(j: int, name: str) -> str:
    return f"5 - ({_mentor_item(j)})" if name in MENTOR_REVERSED_ITEMS else _mentor_item(j)


def mentor_survey_sql() -> str:
    return "SELECT o_orderkey AS respondent_id, " + ", ".join(f"CAST({_mentor_answer(j, n)} AS INT) AS {n}" for j, n in enumerate(MENTOR_ITEMS)) + " FROM orders"


@shared_plan
def open_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-text answers: whole documents with their language and source as groups."""
    return load(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"], balance=True)
