"""Registered alumni-report queries (frequencies, items, grouping sets, text coding)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ALUMNI_LIKERT_ITEMS, TEXT_CATEGORIES
from ..functions import recode as rc
from ..functions import text as tx
from ..operators import freq, grouped, items
from ..sources import fixtures
from . import alumni
from .catalog import LIKERT_NUM, register, round6
from .sqlkit import alumni_cte, likert_long, q, r6

GROUPINGS = grouped.REPORT_GROUPINGS


def _gs_label_sql() -> str:
    return """CASE WHEN grouping(estado) = 1 AND grouping(sexo) = 1 AND grouping(periodo) = 1 THEN 'General'
     WHEN grouping(estado) = 0 AND grouping(sexo) = 1 AND grouping(periodo) = 1 THEN 'Estado'
     WHEN grouping(estado) = 1 AND grouping(sexo) = 0 AND grouping(periodo) = 1 THEN 'Género'
     WHEN grouping(estado) = 0 AND grouping(sexo) = 0 AND grouping(periodo) = 1 THEN 'Estado y género'
     WHEN grouping(estado) = 1 AND grouping(sexo) = 1 AND grouping(periodo) = 0 THEN 'Generación' END AS "grouping\""""


GS_SQL = "GROUP BY GROUPING SETS ((), (estado), (sexo), (estado, sexo), (periodo))"

# --------------------------------------------------------------------- G3-G10


@register("freq_one_way", f"""WITH {alumni_cte()}
SELECT estado, count(*) AS n, {r6('count(*) / sum(count(*)) OVER () * 100.0', 'prop')} FROM alumni GROUP BY estado""")
def freq_one_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``count(estado) %>% mutate(prop = n / sum(n) * 100)`` -- NA group kept."""
    return round6(freq.frequency(alumni.alumni_table(spark, sf_dir), "estado", include_null=True))


@register("freq_one_way_no_null", f"""WITH {alumni_cte()}
SELECT sexo, count(*) AS n, {r6('count(*) / sum(count(*)) OVER () * 100.0', 'prop')} FROM alumni WHERE sexo IS NOT NULL GROUP BY sexo""")
def freq_one_way_no_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prop.table(table(sexo)) * 100`` -- NA dropped."""
    return round6(freq.frequency(alumni.alumni_table(spark, sf_dir), "sexo", include_null=False))


@register("freq_two_way", f"""WITH {alumni_cte()}
SELECT estatus, sexo, count(*) AS n, {r6('count(*) / sum(count(*)) OVER () * 100.0', 'prop')} FROM alumni GROUP BY estatus, sexo""")
def freq_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``count(estatus, sexo, sort=TRUE) %>% mutate(prop)`` -- percent of the grand total."""
    return round6(freq.frequency(alumni.alumni_table(spark, sf_dir), ["estatus", "sexo"], sort=True))


@register("freq_within", f"""WITH {alumni_cte()}
SELECT estado, sexo, count(*) AS n, {r6('count(*) / sum(count(*)) OVER (PARTITION BY estado) * 100.0', 'prop')} FROM alumni GROUP BY estado, sexo""")
def freq_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``count(estado, sexo) %>% group_by(estado) %>% mutate(prop)``."""
    return round6(freq.frequency_within(alumni.alumni_table(spark, sf_dir), ["estado", "sexo"], ["estado"]))


@register("crosstab", f"""WITH {alumni_cte()}
SELECT estado, count(*) FILTER (WHERE sexo = 'Hombre') AS Hombre, count(*) FILTER (WHERE sexo = 'Mujer') AS Mujer
FROM alumni WHERE estado IS NOT NULL AND sexo IS NOT NULL GROUP BY estado""")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``table(estado, sexo)``: zero-filled, NA dropped both ways."""
    return freq.crosstab(alumni.alumni_table(spark, sf_dir), "estado", "sexo", alumni.SEX_LEVELS)


@register("filtered_count", f"""WITH {alumni_cte()}
SELECT nivel_actual_estudios, count(*) AS n, {r6('count(*) / sum(count(*)) OVER () * 100.0', 'pct')}
FROM alumni WHERE continua_estudiando = 1 GROUP BY nivel_actual_estudios""")
def filtered_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``filter(continua_estudiando == 1) %>% count(nivel_actual_estudios)``."""
    df = alumni.alumni_table(spark, sf_dir)
    return round6(freq.filtered_frequency(df, F.col("continua_estudiando") == 1, ["nivel_actual_estudios"]))


@register("filtered_count_within", f"""WITH {alumni_cte()}
SELECT estado, nivel_actual_estudios, count(*) AS n, {r6('count(*) / sum(count(*)) OVER (PARTITION BY estado) * 100.0', 'pct')}
FROM alumni WHERE continua_estudiando = 1 GROUP BY estado, nivel_actual_estudios""")
def filtered_count_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``group_by(estado) %>% filter(continua == 1) %>% count(nivel) %>% mutate(pct)``."""
    df = alumni.alumni_table(spark, sf_dir)
    return round6(freq.filtered_frequency(df, F.col("continua_estudiando") == 1, ["nivel_actual_estudios"], within=["estado"]))


@register("row_count", f"""WITH {alumni_cte()} SELECT count(*) AS n FROM alumni""")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nrow(df)``."""
    return alumni.alumni_table(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------- G11-G12

_COMP = ["componente_01", "componente_02", "componente_03"]


def _mr_sql(by: str | None, collapse_last: bool) -> str:
    last = "CASE WHEN componente_03 IS NOT NULL THEN 'Con otros' END" if collapse_last else "componente_03"
    sel_by = f"{by}, " if by else ""
    parts = [f"SELECT {sel_by}componente_01 AS componente FROM alumni", f"SELECT {sel_by}componente_02 FROM alumni", f"SELECT {sel_by}{last} FROM alumni"]
    where = "componente IS NOT NULL" + (f" AND {by} IS NOT NULL" if by else "")
    return f"""WITH {alumni_cte()},
long AS ({' UNION ALL '.join(parts)})
SELECT {sel_by}componente, count(*) AS n, {r6('count(*) / (SELECT count(*) FROM alumni) * 100.0', 'prop')}
FROM long WHERE {where} GROUP BY {sel_by}componente"""


@register("multi_response", _mr_sql(None, False))
def multi_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Program components: mentions and percent of all respondents."""
    df = alumni.alumni_table(spark, sf_dir)
    return round6(freq.multi_response(df, _COMP, value="componente"))


@register("multi_response_by_group", _mr_sql("estado", True))
def multi_response_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts by network participation; the free-text option collapses to "Con otros" (G12, C10)."""
    df = alumni.alumni_table(spark, sf_dir).withColumn("componente_03", rc.any_text_to("componente_03", "Con otros"))
    return round6(freq.multi_response(df, _COMP, value="componente", by=["estado"]))


# --------------------------------------------------------------------- G13-G14


def _item_stats_sql() -> str:
    parts = []
    for n in ALUMNI_LIKERT_ITEMS:
        c = f"{n}_num"
        parts.append(
            f"SELECT '{n}' AS item, {r6(f'avg({c})', 'mean')}, {r6(f'stddev_samp({c})', 'sd')}, "
            f"{r6(f'count(*) FILTER (WHERE {c} >= 3) / count({c}) * 100.0', 'p_positive')} FROM alumni"
        )
    return f"WITH {alumni_cte()}\n" + "\nUNION ALL ".join(parts)


@register("item_stats", _item_stats_sql())
def item_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likert item mean, sd and percent positive (>= 3) over answered rows."""
    df = alumni.alumni_table(spark, sf_dir)
    return round6(items.item_statistics(df, LIKERT_NUM, names=ALUMNI_LIKERT_ITEMS))


@register("positive_long", f"""WITH {alumni_cte()},
long AS ({likert_long('alumni')}),
g AS (SELECT name, count(*) AS n_all, count(*) FILTER (WHERE value >= 3) AS n FROM long WHERE value IS NOT NULL GROUP BY name)
SELECT name, n, {r6('n / n_all * 100.0', 'prop')} FROM g WHERE n > 0""")
def positive_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long percent-positive table."""
    return round6(items.percent_positive(alumni.alumni_table(spark, sf_dir), LIKERT_NUM))


PERIODS = ["2018-2019", "2019-2020", "2020-2021", "2021-2022", "Otro"]


@register("likert_positive_by_period", f"""WITH {alumni_cte()},
long AS ({likert_long('alumni', ['periodo'])}),
g AS (SELECT name, periodo, count(*) AS n_all, count(*) FILTER (WHERE value >= 3) AS n_pos
      FROM long WHERE value IS NOT NULL AND periodo IS NOT NULL GROUP BY name, periodo)
SELECT name, {', '.join(f"round(max(CASE WHEN periodo = '{p}' AND n_pos > 0 THEN n_pos / n_all * 100.0 END), 6) AS {q(p)}" for p in PERIODS)}
FROM g GROUP BY name""")
def likert_positive_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent positive per item, one column per generation period (G15, R2): the known ones and any other found in the data."""
    df = alumni.alumni_table(spark, sf_dir)
    found = [r["periodo"] for r in df.select("periodo").where("periodo IS NOT NULL").distinct().collect()]  # one row per period
    levels = [*PERIODS, *sorted(set(found) - set(PERIODS))]
    return round6(items.percent_positive_wide(df, LIKERT_NUM, "periodo", levels))


# --------------------------------------------------------------------- G1, G2, G16-G19


@register("age_by_state_sex", f"""WITH {alumni_cte()}
SELECT estado, sexo, {r6('avg(edad)', 'mean_age')}, {r6('stddev_samp(edad)', 'sd_age')}, count(*) AS n FROM alumni GROUP BY estado, sexo""")
def age_by_state_sex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, sd and n of age by state and sex."""
    df = alumni.alumni_table(spark, sf_dir)
    return round6(grouped.summary_by(df, ["estado", "sexo"], "edad", "mean_age", "sd_age", "n"))


@register("grouped_rates", f"""WITH {alumni_cte()}
SELECT {_gs_label_sql()}, estado, sexo, periodo, CAST(sum(continua_estudiando) AS BIGINT) AS n_studying, count(*) AS n_total,
  {r6('avg(continua_estudiando) * 100.0', 'pct')}
FROM alumni {GS_SQL}""")
def grouped_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studying rate for the five report groupings in one grouping-sets pass."""
    df = alumni.alumni_table(spark, sf_dir)
    out = grouped.grouping_sets_moments(df, GROUPINGS, grouped.rate_measures("continua_estudiando"))
    return round6(out.withColumn("n_studying", F.col("n_studying").cast("bigint")))


_MEANS = {"L1_mean": "l1_motivacion_estudiar_num", "L5_mean": "l5_obstaculos_superados_num", "Composite": "likert_total"}


@register("grouped_means", f"""WITH {alumni_cte()}
SELECT {_gs_label_sql()}, estado, sexo, periodo, {', '.join(r6(f'avg({c})', k) for k, c in _MEANS.items())}
FROM alumni {GS_SQL}""")
def grouped_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item 1, item 5 and composite means for the five groupings."""
    df = alumni.alumni_table(spark, sf_dir)
    return round6(grouped.grouping_sets_moments(df, GROUPINGS, grouped.mean_measures(_MEANS)))


def _all_measures() -> dict:
    m = {"N": grouped.Measure("rows"), "mean_age": grouped.Measure("mean", "edad"), "sd_age": grouped.Measure("sd", "edad")}
    m.update(grouped.rate_measures("continua_estudiando"))
    m.update(grouped.mean_measures({f"{c}_mean": f"{c}_num" for c in ALUMNI_LIKERT_ITEMS}))
    m.update(grouped.mean_measures({"Composite": "likert_total", "Satisfaction": "satisfaction_index"}))
    return m


def _all_sql() -> str:
    cols = ["count(*) AS N", r6("avg(edad)", "mean_age"), r6("stddev_samp(edad)", "sd_age"),
            "CAST(sum(continua_estudiando) AS BIGINT) AS n_studying", "count(*) AS n_total", r6("avg(continua_estudiando) * 100.0", "pct")]
    cols += [r6(f"avg({c}_num)", f"{c}_mean") for c in ALUMNI_LIKERT_ITEMS]
    cols += [r6("avg(likert_total)", "Composite"), r6("avg(satisfaction_index)", "Satisfaction")]
    return f"WITH {alumni_cte()}\nSELECT {_gs_label_sql()}, estado, sexo, periodo, {', '.join(cols)} FROM alumni {GS_SQL}"


@register("grouping_sets_all", _all_sql())
def grouping_sets_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report aggregate over every grouping in a single aggregate."""
    out = grouped.grouping_sets_moments(alumni.alumni_table(spark, sf_dir), GROUPINGS, _all_measures())
    return round6(out.withColumn("n_studying", F.col("n_studying").cast("bigint")))


# --------------------------------------------------------------------- C11 + G18

_TEXT_GROUPINGS = {"General": [], "Idioma": ["lang"], "Fuente": ["source"], "Idioma y fuente": ["lang", "source"]}


def coded_documents(spark: SparkSession, sf_dir: str, drop_missing_text: bool = True) -> DataFrame:
    """Whole open-text answers coded 0/1 for every keyword category, in one projection (C11)."""
    docs = fixtures.open_text(spark, sf_dir)
    if drop_missing_text:
        docs = docs.where(F.col("text").isNotNull())
    codes = {}
    for grp, cats in TEXT_CATEGORIES.items():
        codes.update(tx.code_text_columns("text", cats, grp))
    return docs.select("doc_id", "lang", "source", *[v.alias(k) for k, v in codes.items()])


def _coded_sql() -> str:
    codes, aggs = [], []
    for grp, cats in TEXT_CATEGORIES.items():
        for cat, kws in cats.items():
            name = f"{cat}_{grp}"
            codes.append(f"CAST(coalesce(regexp_matches(lower(text), '{'|'.join(kws)}'), false) AS INT) AS {q(name)}")
            aggs.append(r6(f"avg({q(name)}) * 100.0", q(name)))
    label = """CASE WHEN grouping(lang) = 1 AND grouping(source) = 1 THEN 'General'
     WHEN grouping(lang) = 0 AND grouping(source) = 1 THEN 'Idioma'
     WHEN grouping(lang) = 1 AND grouping(source) = 0 THEN 'Fuente'
     ELSE 'Idioma y fuente' END AS "grouping\""""
    return f"""WITH coded AS (SELECT doc_id, lang, source, {', '.join(codes)} FROM documents WHERE text IS NOT NULL)
SELECT {label}, lang, source, count(*) AS N, {', '.join(aggs)}
FROM coded GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))"""


@register("coded_text_prevalence", _coded_sql())
def coded_text_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N and percent of texts per keyword category for four groupings, one pass."""
    coded = coded_documents(spark, sf_dir)
    code_cols = [c for c in coded.columns if c not in ("doc_id", "lang", "source")]
    return round6(grouped.grouping_sets_moments(coded, _TEXT_GROUPINGS, grouped.prevalence_measures(code_cols)))


# --------------------------------------------------------------------- C13


@register("period_label", f"""WITH {alumni_cte()} SELECT respondent_id, generacion, periodo FROM alumni""")
def period_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation label -> period "yyyy-yyyy" / "Otro" / NULL, per respondent."""
    return alumni.alumni_table(spark, sf_dir).select("respondent_id", "generacion", "periodo")


@register("period_counts", f"""WITH {alumni_cte()} SELECT periodo, count(*) AS n FROM alumni GROUP BY periodo""")
def period_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``count(periodo)`` (G6 without percent)."""
    return freq.count_by(alumni.alumni_table(spark, sf_dir), "periodo")


_LEVEL_GROUPINGS = {k: v + ["nivel_actual_estudios"] for k, v in GROUPINGS.items()}


@register("study_levels_by_grouping", f"""WITH {alumni_cte()},
g AS (SELECT {_gs_label_sql()}, estado, sexo, periodo, nivel_actual_estudios, count(*) AS n_total FROM alumni
      WHERE continua_estudiando = 1
      GROUP BY GROUPING SETS ((nivel_actual_estudios), (estado, nivel_actual_estudios), (sexo, nivel_actual_estudios),
                              (estado, sexo, nivel_actual_estudios), (periodo, nivel_actual_estudios)))
SELECT *, {r6('n_total / sum(n_total) OVER (PARTITION BY "grouping", estado, sexo, periodo) * 100.0', 'pct')} FROM g""")
def study_levels_by_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current study level among those studying, percent within each group of each
    report grouping -- one grouping-sets pass (G9, G19, W2)."""
    from ..operators.common import share_within

    df = alumni.alumni_table(spark, sf_dir).where(F.col("continua_estudiando") == 1)
    gs = grouped.grouping_sets_named(df, _LEVEL_GROUPINGS, {"n_total": F.count(F.lit(1))})
    return round6(gs.withColumn("pct", share_within("n_total", ["grouping", "estado", "sexo", "periodo"])))
