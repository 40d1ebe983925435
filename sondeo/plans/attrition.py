"""Attrition analysis: baseline waves, raters and mentors -> linked score tables -> models."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EDUCATION_CODES, MUNICIPALITY_PATTERNS, NA_PATTERN, SKILLS, STATE_CODES
from ..functions import recode as rc
from ..functions import text as tx
from ..operators.common import col
from ..operators.linkage import first_per_key, join_null_safe, membership_flag
from ..operators.reshape import ITEM_NAME
from ..operators.scoring import row_sum, standardize
from ..sources import fixtures
from .memo import shared_plan
from ..sources.tables import load

# The survey fixture has eight adolescent items and four rater items: two and one for each of the four skills of the models.
SKILL_ITEMS = {"liderazgo": ("liderazgo1", "liderazgo2"), "empatia": ("empatia1", "empatia2"), "decision": ("liderazgo3", "liderazgo4"), "equipo": ("empatia3", "empatia4")}
RATER_ITEMS = {"liderazgo": ("liderazgo1",), "empatia": ("empatia1",), "decision": ("liderazgo2",), "equipo": ("empatia2",)}
# The fixture's regions stand for the states of the analyses; other regions have no code and become NULL, as other states do there.
STATE_OF_REGION = {"AMERICA": "Nuevo León", "ASIA": "Chihuahua", "EUROPE": "Tamaulipas", "AFRICA": "Estado de México"}
# Education cycles over customers; an answer outside the code list becomes NULL.
EDUCATION_ANSWERS = [*EDUCATION_CODES, "Otro"]
SKILL_PATTERN = r"^(liderazgo|empatia|decision|equipo)"
SEX_LABELS = {"M": "Mujer", "H": "Hombre"}
STATUS_LABELS = ("Concluyó", "No concluyó")


def scales_from_names(columns: Sequence[str], pattern: str = SKILL_PATTERN, lenient: bool = True) -> dict[str, list[str]]:
    """Split item column names into {dimension: [columns]} at plan time.

    Names matching ``pattern`` but without an item number (a composite such as
    "liderazgo") are skipped in lenient mode and rejected in strict mode.
    """
    out: dict[str, list[str]] = {}
    for c in columns:
        if not re.search(pattern, c, re.IGNORECASE):
            continue
        m = re.match(ITEM_NAME, c)
        if not m:
            if lenient:
                continue
            raise ValueError(f"item name does not split: {c}")
        out.setdefault(m.group(1).rstrip("_"), []).append(c)
    return out


def score_array(scales: dict[str, list[str]], dim: str, score: str, suffix: str = "") -> Column:
    """array<struct<dim, score>> of scale totals, built in the row."""
    return F.array(*[F.struct(F.lit(f"{d}{suffix}").alias(dim), row_sum(items).alias(score)) for d, items in scales.items()])


def endlines(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The two endline tables: customers ordering on or after 2001-05-01, and
    urgent orders of 2001 (the second endline file)."""
    o = load(spark, sf_dir, "orders", ["o_custkey", "o_orderdate", "o_orderpriority"])
    end1 = o.where(F.col("o_orderdate") >= F.lit("2001-05-01").cast("timestamp"))
    end2 = o.where((F.col("o_orderpriority") == "1-URGENT") & (F.year("o_orderdate") == 2001))
    return [end1, end2]


@shared_plan
def adolescents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline adolescents: cleaned covariates, skill items and completion (A4).

    Items q1..q8 become liderazgo1..4 / empatia1..4; sentinels become NULL
    (age 99 or under 10, socio-economic level 0); the role-model answer is
    reduced to Sí/No *before* refusals become NULL (so a refusal reads "No",
    as in the original order of steps); the place text maps to a canonical
    municipality by first matching pattern; ``status`` is 1 when the respondent's
    customer appears in an endline (J3); first record per id wins.
    """
    b = fixtures.survey_base(spark, sf_dir)
    items = {f"liderazgo{i}": F.col(f"q{i}") for i in range(1, 5)}
    items.update({f"empatia{i - 4}": F.col(f"q{i}") for i in range(5, 9)})
    df = b.select(
        F.col("respondent_id").alias("id"),
        "customer_id",
        rc.recode("sexo", SEX_LABELS).alias("sexo"),
        rc.null_if("edad", (F.col("edad") == 99) | (F.col("edad") < 10)).alias("edad"),
        "estado", "wave", "fecha",
        F.col("estatus").alias("trabajo"),
        rc.contains_yes_no("modelo_seguir", "Sí").alias("modelo_seguir"),
        rc.first_match(F.lower("municipio"), MUNICIPALITY_PATTERNS).alias("municipio"),
        rc.null_if("socioeco", F.col("socioeco") == 0).alias("socioeco"),
        *[v.alias(k) for k, v in items.items()],
    )
    df = rc.refusals_to_null(df, NA_PATTERN)
    df = membership_flag(df, "customer_id", endlines(spark, sf_dir), "o_custkey", "status")
    return first_per_key(df, "id", "fecha")  # the earliest record of an id


@shared_plan
def ratings_360(spark: SparkSession, sf_dir: str) -> DataFrame:
    """360 ratings with the mentor key repaired and cast."""
    r = fixtures.ratings_360(spark, sf_dir)
    return r.withColumn("id_mentor", tx.repair_mentor_key("id_mentor_raw").try_cast("bigint")).drop("id_mentor_raw")


@shared_plan
def mentors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixtures.mentors(spark, sf_dir)
    return m.withColumn("sexo_mentor", rc.collapse_value("sexo_mentor", "Otro (especifique)", "Otro"))


@shared_plan
def linked_long_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adolescent x 360 x mentor long scores (J1; a missing key matches a missing key, N9): every adolescent dimension
    paired with every 360 and every mentor dimension.

    Joins run on one-row-per-entity tables (adolescent and 360 on ``id``, then
    mentor on ``id_mentor``); the dimension fan-out is generated in the row
    afterwards, so the shuffles carry one row per respondent, not one per
    (dimension x dimension) pair.
    """
    a = adolescents(spark, sf_dir)
    r = ratings_360(spark, sf_dir)
    m = mentors(spark, sf_dir)
    sa = scales_from_names(a.columns)
    sr = scales_from_names(r.columns)
    sm = scales_from_names(m.columns)
    a2 = a.select("id", "estado", "status", score_array(sa, "dim", "score").alias("_a"))
    r2 = r.select("id", "id_mentor", score_array(sr, "dim_360", "score_360", "_360").alias("_r"))
    m2 = m.select("id_mentor", score_array(sm, "dim_mentor", "score_mentor", "_mentor").alias("_m"))
    j = join_null_safe(join_null_safe(a2, r2, ["id"]), m2, ["id_mentor"])
    out = j.select("id", "estado", "status", "id_mentor", "_r", "_m", F.inline("_a"))
    out = out.select("*", F.inline("_r")).drop("_r")
    out = out.select("*", F.inline("_m")).drop("_m")
    return out.select("id", "estado", "status", "dim", "score", "id_mentor", "dim_360", "score_360", "dim_mentor", "score_mentor")


def wide_scores(df: DataFrame, key_cols: Sequence[str], suffix: str = "", extra_z: Sequence[str] = ()) -> DataFrame:
    """One row per entity with z-scored scale totals (W5 over the whole table)."""
    scales = scales_from_names(df.columns)
    named = {f"{d}{suffix}": row_sum(items) for d, items in scales.items()}
    wide = df.select(*[col(k) for k in key_cols], *[v.alias(k) for k, v in named.items()])
    return standardize(wide, list(named) + list(extra_z))


@shared_plan
def linked_wide_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mentor ⋈ 360 on id_mentor ⋈ adolescent on id, each side z-scored first."""
    a = wide_scores(adolescents(spark, sf_dir), ["id", "sexo", "estado", "status", "socioeco"], extra_z=["socioeco"])
    r = wide_scores(ratings_360(spark, sf_dir), ["id", "id_mentor"], "_360")
    m = wide_scores(mentors(spark, sf_dir), ["id_mentor", "sexo_mentor"], "_mentor")
    return join_null_safe(join_null_safe(m, r, ["id_mentor"]), a, ["id"])


def skill_totals(items: dict[str, Sequence[str]], suffix: str = "") -> list[Column]:
    """One total per skill of the models, in their order."""
    return [row_sum(items[k]).alias(f"{k}{suffix}") for k in SKILLS]


@shared_plan
def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariates of the completion models, not scaled: coded states and education (reference level first), age
    centred at 12, socio-economic level, totals of the four skills."""
    a = adolescents(spark, sf_dir)
    answer = F.element_at(F.array(*[F.lit(t) for t in EDUCATION_ANSWERS]), (F.col("customer_id") % len(EDUCATION_ANSWERS) + 1).cast("int"))
    a = a.withColumns({"estado": rc.recode("estado", STATE_OF_REGION), "nivel_educ": answer})
    return a.select(
        "id", "status", "sexo", (F.col("edad") - 12).alias("edad_c12"),
        rc.recode("estado", STATE_CODES).alias("estado"), "trabajo", rc.recode("nivel_educ", EDUCATION_CODES).alias("nivel_educ"),
        "socioeco", "modelo_seguir", "wave", *skill_totals(SKILL_ITEMS),
    )


@shared_plan
def model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model_rows`` with socio-economic level and skills scaled over the whole table."""
    return standardize(model_rows(spark, sf_dir), ["socioeco", *SKILLS])


@shared_plan
def linked_model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model_frame`` with the scaled skills of the 360 raters and of the mentor (J2): rows with all three."""
    def side(df: DataFrame, keys: list[str], suffix: str) -> DataFrame:
        return standardize(df.select(*keys, *skill_totals(RATER_ITEMS, suffix)), [f"{k}{suffix}" for k in SKILLS])

    r = side(ratings_360(spark, sf_dir), ["id", "id_mentor"], "_360")
    m = side(mentors(spark, sf_dir), ["id_mentor", "sexo_mentor"], "_mentor")
    return join_null_safe(join_null_safe(model_frame(spark, sf_dir), r, ["id"]), m, ["id_mentor"])


@shared_plan
def pooled_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model_rows`` scaled within each wave found in the data, the wave as ``periodo``."""
    return standardize(model_rows(spark, sf_dir), ["socioeco", *SKILLS], by=["wave"]).withColumnRenamed("wave", "periodo")


@shared_plan
def completion(spark: SparkSession, sf_dir: str, labels: bool = False) -> DataFrame:
    """Baseline customers flagged by presence in either endline."""
    cust = load(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    yes, no = (STATUS_LABELS if labels else (1, 0))
    return membership_flag(cust, "c_custkey", endlines(spark, sf_dir), "o_custkey", "status", yes, no)
