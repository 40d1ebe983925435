"""Alumni follow-up analysis: export -> recoded respondent table -> report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ALUMNI_LIKERT_ITEMS, LIKERT_LABELS, STUDYING_STATUSES
from ..functions import recode as rc
from ..functions import text as tx
from ..operators.scoring import row_mean
from ..sources import fixtures
from .memo import shared_plan

# The survey fixture's market segments stand in for occupational statuses.
FIXTURE_STUDYING = ["BUILDING", "MACHINERY"]
SEX_LABELS = {"M": "Mujer", "H": "Hombre"}
SEX_LEVELS = ["Hombre", "Mujer"]
LIKERT_NUM = [f"{c}_num" for c in ALUMNI_LIKERT_ITEMS]


def export_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw export: Likert answers as labels, as a survey tool writes them."""
    base = fixtures.survey_base(spark, sf_dir)
    labels = {name: rc.codes_to_labels(f"q{i}", LIKERT_LABELS) for i, name in enumerate(ALUMNI_LIKERT_ITEMS, start=1)}
    return base.select(*[c for c in base.columns if not c.startswith("q")], *[v.alias(k) for k, v in labels.items()])


def recode_export(df: DataFrame, studying=STUDYING_STATUSES) -> DataFrame:
    """One projection: sex labels, studying flag, coalesced level, Likert codes,
    composites, generation period and the "General" constant."""
    cols = {
        "sexo": rc.recode("sexo", SEX_LABELS),
        "continua_estudiando": rc.flag_in("estatus", studying),
        "nivel_actual_estudios": F.coalesce(F.col("componente_03"), F.col("componente_01")),
    }
    cols.update({f"{c}_num": rc.labels_to_codes(c, LIKERT_LABELS) for c in ALUMNI_LIKERT_ITEMS})
    out = df.withColumns(cols)
    out = out.withColumns({
        "likert_total": row_mean(LIKERT_NUM),
        "satisfaction_index": row_mean([c for c in LIKERT_NUM if not c.startswith("l5")]),
        "periodo": tx.period_from_label("generacion"),
        "general": F.lit("General"),
    })
    return out


@shared_plan
def alumni_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recode_export(export_frame(spark, sf_dir), FIXTURE_STUDYING)
