"""Registered queries: name -> (Spark plan, DuckDB oracle SQL).

Every query reads the driver tables of ``sf_dir`` (or data Spark derives from
them) in full. Doubles are rounded to 6 decimals on both sides so the
comparison is insensitive to summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import items as it
from . import alumni
from .sqlkit import alumni_cte, likert_long

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def round6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 decimals (comparison convention)."""
    cols = {f.name: F.round(F.col(f"`{f.name}`"), 6) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(cols) if cols else df


LIKERT_NUM = alumni.LIKERT_NUM

# ---------------------------------------------------------------------------
# flagship: percent positive per Likert item, one column per sex
# ---------------------------------------------------------------------------


@register(
    "likert_positive_by_sex",
    f"""WITH {alumni_cte()},
long AS ({likert_long('alumni', ['sexo'])}),
g AS (SELECT name, sexo, count(*) AS n_all, count(*) FILTER (WHERE value >= 3) AS n_pos
      FROM long WHERE value IS NOT NULL AND sexo IS NOT NULL GROUP BY name, sexo)
SELECT name,
  round(max(CASE WHEN sexo = 'Hombre' AND n_pos > 0 THEN n_pos / n_all * 100.0 END), 6) AS Hombre,
  round(max(CASE WHEN sexo = 'Mujer' AND n_pos > 0 THEN n_pos / n_all * 100.0 END), 6) AS Mujer
FROM g GROUP BY name""",
)
def likert_positive_by_sex(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = alumni.alumni_table(spark, sf_dir)
    return round6(it.percent_positive_wide(df, LIKERT_NUM, "sexo", alumni.SEX_LEVELS))


# Query families live in their own modules; importing them registers them.
from . import q_alumni  # noqa: E402,F401
from . import q_attrition  # noqa: E402,F401
from . import q_stats  # noqa: E402,F401
from . import q_models  # noqa: E402,F401
from . import q_ingest  # noqa: E402,F401
