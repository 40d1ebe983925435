"""Helpers that write the DuckDB oracle SQL for the registered queries."""

from __future__ import annotations

from collections.abc import Sequence

from ..config import ALUMNI_LIKERT_ITEMS, LIKERT_LABELS
from ..sources import fixtures


def r6(expr: str, alias: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {alias}"


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def survey_cte() -> str:
    return f"survey AS ({fixtures.survey_base_sql()})"


def alumni_cte(studying: Sequence[str] = ("BUILDING", "MACHINERY")) -> str:
    """``alumni`` view matching :func:`sondeo.plans.alumni.alumni_table`."""
    lab = []
    for i, name in enumerate(ALUMNI_LIKERT_ITEMS, start=1):
        cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(LIKERT_LABELS, start=1))
        lab.append(f"CASE q{i} {cases} END AS {name}")
    nums = []
    for name in ALUMNI_LIKERT_ITEMS:
        cases = " ".join(f"WHEN '{v}' THEN {k}" for k, v in enumerate(LIKERT_LABELS, start=1))
        nums.append(f"CASE {name} {cases} END AS {name}_num")
    num_cols = [f"{n}_num" for n in ALUMNI_LIKERT_ITEMS]
    no_l5 = [c for c in num_cols if not c.startswith("l5")]

    def rmean(cols):
        s = " + ".join(f"coalesce({c}, 0)" for c in cols)
        n = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in cols)
        return f"CASE WHEN ({n}) = 0 THEN NULL ELSE CAST(({s}) AS DOUBLE) / ({n}) END"

    st = ", ".join(f"'{s}'" for s in studying)
    return f"""{survey_cte()},
exported AS (SELECT respondent_id, customer_id, fecha, wave, sexo, edad, estado, generacion, estatus, socioeco,
   componente_01, componente_02, componente_03, status, {', '.join(lab)} FROM survey),
recoded AS (SELECT * REPLACE (CASE sexo WHEN 'M' THEN 'Mujer' WHEN 'H' THEN 'Hombre' END AS sexo),
   CAST(coalesce(estatus IN ({st}), false) AS INT) AS continua_estudiando,
   coalesce(componente_03, componente_01) AS nivel_actual_estudios,
   {', '.join(nums)} FROM exported),
alumni AS (SELECT *, {rmean(num_cols)} AS likert_total, {rmean(no_l5)} AS satisfaction_index,
   CASE WHEN NOT contains(generacion, '(') THEN NULL
        WHEN regexp_replace(regexp_replace(regexp_extract(generacion, '\\(.*', 0), '\\D', '', 'g'), '^(\\d{{4}})', '\\1-') = '' THEN 'Otro'
        ELSE regexp_replace(regexp_replace(regexp_extract(generacion, '\\(.*', 0), '\\D', '', 'g'), '^(\\d{{4}})', '\\1-') END AS periodo,
   'General' AS general FROM recoded)"""


def likert_long(source: str = "alumni", extra: Sequence[str] = ()) -> str:
    """UNION ALL unpivot of the eight numeric Likert items (NULLs kept)."""
    ex = "".join(f"{e}, " for e in extra)
    parts = [f"SELECT respondent_id, {ex}'{n}_num' AS name, {n}_num AS value FROM {source}" for n in ALUMNI_LIKERT_ITEMS]
    return "\nUNION ALL ".join(parts)


def items_cte() -> str:
    """``items`` view matching :func:`sondeo.plans.psychometrics.item_matrix`."""
    from ..config import SIMILARITY_FREQUENCY_LABELS
    from . import psychometrics as ps

    labels, codes = [], []
    for i in range(1, 9):
        cases = " ".join(
            f"WHEN {k} THEN CASE WHEN respondent_id % 2 = 0 THEN '{sim}' ELSE '{frq}' END"
            for k, (sim, frq) in SIMILARITY_FREQUENCY_LABELS.items()
        )
        labels.append(f"CASE q{i} {cases} END AS p{i}")
    for i, name in enumerate(ps.ITEMS, start=1):
        cases = " ".join(
            f"WHEN p{i} IN ({', '.join(chr(39) + x + chr(39) for x in labs)}) THEN {k}" for k, labs in SIMILARITY_FREQUENCY_LABELS.items()
        )
        expr = f"CASE {cases} END"
        if name in ps.REVERSED:
            expr = f"5 - {expr}"
        codes.append(f"{expr} AS {name}")
    return f"""{survey_cte()},
exported_items AS (SELECT respondent_id, estado, sexo, {', '.join(labels)} FROM survey),
items AS (SELECT respondent_id, estado, sexo, {', '.join(codes)} FROM exported_items)"""
