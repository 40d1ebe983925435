"""Psychometrics flow: export with two wordings -> 4-point codes -> reverse keying
-> item statistics, reliability, IRT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MENTOR_REVERSED_ITEMS, MENTOR_SCALES, SIMILARITY_FREQUENCY_LABELS
from ..functions import recode as rc
from ..functions.selectors import item_names
from ..sources import fixtures
from .memo import shared_plan

SCALES = [("liderazgo", 4), ("empatia", 4)]
ITEMS = item_names(SCALES)
REVERSED = ["empatia_1"]


def scale_map() -> dict[str, list[str]]:
    return {name: [f"{name}_{i}" for i in range(1, n + 1)] for name, n in SCALES}


def export_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as words: similarity wording for even respondents, frequency wording for odd."""
    b = fixtures.survey_base(spark, sf_dir)
    even = (F.col("respondent_id") % 2) == 0
    cols = {}
    for i in range(1, 9):
        code = F.col(f"q{i}")
        expr = None
        for k, (sim, frq) in SIMILARITY_FREQUENCY_LABELS.items():
            lab = F.when(even, F.lit(sim)).otherwise(F.lit(frq))
            expr = F.when(code == k, lab) if expr is None else expr.when(code == k, lab)
        cols[f"p{i}"] = expr
    return b.select("respondent_id", "estado", "sexo", *[v.alias(k) for k, v in cols.items()])


@shared_plan
def item_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recoded (C3), renamed by position (P6/P15) and reverse-keyed (C4) item matrix."""
    e = export_frame(spark, sf_dir)
    coded = e.select("respondent_id", "estado", "sexo", *[rc.multi_vocabulary_codes(f"p{i}", SIMILARITY_FREQUENCY_LABELS).alias(n) for i, n in enumerate(ITEMS, start=1)])
    return coded.withColumns({c: rc.reverse_key(c) for c in REVERSED})


def mentor_scales() -> dict[str, list[str]]:
    return {name: item_names([(name, n)]) for name, n in MENTOR_SCALES}


@shared_plan
def mentor_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 mentor items with the reverse-keyed ones turned (C4)."""
    return fixtures.mentor_survey(spark, sf_dir).withColumns({c: rc.reverse_key(c) for c in MENTOR_REVERSED_ITEMS})
