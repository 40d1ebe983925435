"""Registered model queries: logistic GLMs (M1-M8, M13), mixed models (M9-M12), IRT (K6-K9)."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EDUCATION_CODES, SKILLS, STATE_CODES
from ..models import glm
from ..models.spec import ModelSpec
from . import alumni, attrition
from .catalog import register, round6
from .q_attrition import ADOL_SQL
from .sqlkit import alumni_cte, items_cte

# --------------------------------------------------------------------- closed-form checkable GLM

_G_SQL = f"""WITH {alumni_cte()},
g AS (SELECT estatus, CAST(sum(status) AS DOUBLE) AS s, CAST(count(*) - sum(status) AS DOUBLE) AS f FROM alumni WHERE estatus IS NOT NULL GROUP BY estatus),
ref AS (SELECT * FROM g ORDER BY estatus LIMIT 1)"""


@register("glm_single_factor_tidy", f"""{_G_SQL},
t AS (SELECT '(Intercept)' AS term, ln(ref.s / ref.f) AS estimate, sqrt(1 / ref.s + 1 / ref.f) AS std_error FROM ref
      UNION ALL SELECT 'estatus' || g.estatus, ln(g.s / g.f) - ln(ref.s / ref.f), sqrt(1 / g.s + 1 / g.f + 1 / ref.s + 1 / ref.f)
      FROM g, ref WHERE g.estatus <> ref.estatus)
SELECT term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error, round(estimate / std_error, 6) AS statistic,
  round(exp(estimate), 6) AS odds, CASE WHEN abs(estimate / std_error) >= 1.959963984540054 THEN '*' ELSE '' END AS sig FROM t""")
def glm_single_factor_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic GLM ``status ~ estatus``: tidy coefficient table with odds and significance (M1, M4, M5).

    A one-factor logistic model is saturated, so the SQL twin is its closed form
    (log-odds differences, standard errors sqrt(sum 1/cell)).
    """
    fit = glm.fit_glm(alumni.alumni_table(spark, sf_dir), ModelSpec("status", ("estatus",)))
    return round6(glm.tidy(spark, fit, with_p=False))


@register("glm_p_values", f"""{_G_SQL},
t AS (SELECT '(Intercept)' AS term, ln(ref.s / ref.f) / sqrt(1 / ref.s + 1 / ref.f) AS z FROM ref
      UNION ALL SELECT 'estatus' || g.estatus, (ln(g.s / g.f) - ln(ref.s / ref.f)) / sqrt(1 / g.s + 1 / g.f + 1 / ref.s + 1 / ref.f)
      FROM g, ref WHERE g.estatus <> ref.estatus),
area AS (SELECT term, sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(z * i / 4000, 2) / 2)) * abs(z) / 4000 / 3 / sqrt(2 * pi()) AS half
  FROM t, range(4001) r(i) GROUP BY term, z)
SELECT term, round(greatest(1 - 2 * half, 0), 6) + 0.0 AS p_value FROM area""")
def glm_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided Wald p-values of the single-factor model, against a numerical integral of the normal density (M5)."""
    fit = glm.fit_glm(alumni.alumni_table(spark, sf_dir), ModelSpec("status", ("estatus",)))
    return round6(glm.tidy(spark, fit).select("term", "p_value")).withColumn("p_value", F.col("p_value") + F.lit(0.0))


@register("glm_deviance", f"""{_G_SQL},
tot AS (SELECT sum(s) AS S, sum(f) AS F, count(*) AS k FROM g),
d AS (SELECT -2 * (S * ln(S / (S + F)) + F * ln(F / (S + F))) AS null_deviance,
        -2 * (SELECT sum(s * ln(s / (s + f)) + f * ln(f / (s + f))) FROM g) AS deviance, S, F, k FROM tot)
SELECT round(null_deviance, 4) AS null_deviance, round(deviance, 4) AS deviance, CAST(S + F - 1 AS BIGINT) AS df_null,
  CAST(S + F - k AS BIGINT) AS df_residual, round(deviance + 2 * k, 4) AS aic, CAST(S + F AS BIGINT) AS n FROM d""")
def glm_deviance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null / residual deviance, degrees of freedom, AIC and n of ``status ~ estatus`` (M6).

    Deviances are sums over all rows, so they are compared at 4 decimals.
    """
    fit = glm.fit_glm(alumni.alumni_table(spark, sf_dir), ModelSpec("status", ("estatus",)))
    g = glm.glance(spark, {"m": fit}).drop("model", "converged", "separated")
    return g.withColumns({c: F.round(c, 4) for c in ("null_deviance", "deviance", "aic")})


# --------------------------------------------------------------------- nested discrete models: closed forms

_NESTED_SQL = f"""WITH {ADOL_SQL},
r AS (SELECT status, estado, estado || ':' || sexo AS estado_sexo, estado || ':' || sexo || ':' || modelo_seguir AS celda FROM adol),
c AS (SELECT * FROM r WHERE estado IS NOT NULL AND estado_sexo IS NOT NULL AND celda IS NOT NULL),
cells AS (SELECT 0 AS k, 'NULL' AS term, '' AS cell, CAST(sum(status) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM c
  UNION ALL SELECT 1, 'estado', estado, sum(status), count(*) FROM c GROUP BY estado
  UNION ALL SELECT 2, 'estado_sexo', estado_sexo, sum(status), count(*) FROM c GROUP BY estado_sexo
  UNION ALL SELECT 3, 'celda', celda, sum(status), count(*) FROM c GROUP BY celda),
d AS (SELECT k, term, sum(n) AS n, count(*) AS rank, -2 * sum(CASE WHEN s > 0 THEN s * ln(s / n) ELSE 0 END + CASE WHEN s < n THEN (n - s) * ln((n - s) / n) ELSE 0 END) AS dev
  FROM cells GROUP BY k, term),
t AS (SELECT k, term, rank, CAST(n - rank AS BIGINT) AS resid_df, dev, lag(dev) OVER (ORDER BY k) - dev AS gain, rank - lag(rank) OVER (ORDER BY k) AS df FROM d)"""


def nested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three factors, each nested in the one before: the larger models hold aliased columns and are saturated."""
    a = attrition.adolescents(spark, sf_dir)
    both = F.concat(F.col("estado"), F.lit(":"), F.col("sexo"))
    return a.select("status", "estado", both.alias("estado_sexo"), F.concat(both, F.lit(":"), F.col("modelo_seguir")).alias("celda"))


@register("glm_anova_nested", f"""{_NESTED_SQL}
SELECT term, CAST(df AS DOUBLE) AS df, round(gain, 4) AS deviance, resid_df, round(dev, 4) AS resid_dev FROM t""")
def glm_anova_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential analysis of deviance of nested factors: aliased columns take no degrees of freedom (M1, M7)."""
    tab = glm.anova_sequential(spark, nested_rows(spark, sf_dir), ModelSpec("status", ("estado", "estado_sexo", "celda")))
    return tab.select("term", F.col("df").cast("double").alias("df"), F.round("deviance", 4).alias("deviance"), "resid_df", F.round("resid_dev", 4).alias("resid_dev"))


@register("glm_compare_nested", f"""{_NESTED_SQL}
SELECT CASE k WHEN 1 THEN 'small' WHEN 2 THEN 'middle' ELSE 'large' END AS model, resid_df, round(dev, 4) AS resid_dev,
  CAST(CASE WHEN k > 1 THEN df END AS DOUBLE) AS df, CASE WHEN k > 1 THEN round(gain, 4) END AS deviance, CASE WHEN k > 1 THEN true END AS nested FROM t WHERE k > 0""")
def glm_compare_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison of nested models on common complete rows, all fitted in the same passes (M8)."""
    terms = ("estado", "estado_sexo", "celda")
    specs = {m: ModelSpec("status", terms[: k + 1]) for k, m in enumerate(("small", "middle", "large"))}
    tab = glm.anova_compare(spark, nested_rows(spark, sf_dir), specs)
    return tab.select("model", "resid_df", F.round("resid_dev", 4).alias("resid_dev"), F.col("df").cast("double").alias("df"), F.round("deviance", 4).alias("deviance"), "nested")


@register("glm_aliased_tidy", f"""WITH {ADOL_SQL},
c AS (SELECT status, estado, estado || ':' || sexo AS cell FROM adol WHERE estado IS NOT NULL AND sexo IS NOT NULL),
g AS (SELECT estado, cell, ln(sum(status) / (count(*) - sum(status))) AS lo, 1 / sum(status) + 1 / (count(*) - sum(status)) AS v FROM c GROUP BY estado, cell),
first AS (SELECT * FROM g ORDER BY cell LIMIT 1),
last AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY estado ORDER BY cell DESC) = 1),
t AS (SELECT '(Intercept)' AS term, lo AS estimate, sqrt(v) AS std_error FROM first
  UNION ALL SELECT 'estado' || l.estado, l.lo - f.lo, sqrt(l.v + f.v) FROM last l, first f WHERE l.estado <> f.estado
  UNION ALL SELECT 'estado_sexo' || g.cell, g.lo - f.lo, sqrt(g.v + f.v) FROM g, first f WHERE g.estado = f.estado AND g.cell <> f.cell
  UNION ALL SELECT 'estado_sexo' || g.cell, CASE WHEN g.cell <> l.cell THEN g.lo - l.lo END, CASE WHEN g.cell <> l.cell THEN sqrt(g.v + l.v) END
    FROM g JOIN last l USING (estado), first f WHERE g.estado <> f.estado)
SELECT term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error FROM t""")
def glm_aliased_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of a rank-deficient design: aliased ones are NULL, the others as in the full-rank design (M1, M5)."""
    fit = glm.fit_glm(nested_rows(spark, sf_dir), ModelSpec("status", ("estado", "estado_sexo")))
    return round6(glm.tidy(spark, fit).select("term", "estimate", "std_error"))


# --------------------------------------------------------------------- full models

BASE_TERMS = ("sexo", "edad_c12", "estado", "trabajo", "nivel_educ", "socioeco", "modelo_seguir", *SKILLS)
BASE = ModelSpec("status", BASE_TERMS)
MENTOR_SEX = "sexo_mentor"
model_frame, linked_model_frame = attrition.model_frame, attrition.linked_model_frame


def family() -> dict[str, ModelSpec]:
    """The four compared models: adolescents only, with the 360 raters, with the mentor, with all."""
    s360, mentor = [f"{k}_360" for k in SKILLS], [f"{k}_mentor" for k in SKILLS]
    return {
        "base": BASE,
        "with_360": BASE.add_terms(*s360),
        "with_mentor": BASE.add_terms(MENTOR_SEX, *mentor),
        "global": BASE.add_terms(MENTOR_SEX, *s360, *mentor),
    }


_STATES = " ".join(f"WHEN '{r}' THEN '{STATE_CODES[s]}'" for r, s in attrition.STATE_OF_REGION.items())
_LEVELS = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(EDUCATION_CODES.values()))
_SKILLS_SQL = ", ".join(f"{' + '.join(f'coalesce({i}, 0)' for i in attrition.SKILL_ITEMS[k])} AS {k}" for k in SKILLS)
MODEL_SQL = f"""{ADOL_SQL},
raw AS (SELECT id, status, sexo, edad - 12 AS edad_c12, CASE estado {_STATES} END AS estado, trabajo,
  CASE customer_id % {len(attrition.EDUCATION_ANSWERS)} {_LEVELS} END AS nivel_educ, socioeco, modelo_seguir, wave, {_SKILLS_SQL} FROM adol)"""
_SCALED = ["socioeco", *SKILLS]


def _scaled_sql(over: str) -> str:
    z = ", ".join(f"({c} - avg({c}) OVER ({over})) / stddev_samp({c}) OVER ({over}) AS {c}" for c in _SCALED)
    return f"z AS (SELECT * REPLACE ({z}) FROM raw)"


def _totals_sql(scaled: str, terms: tuple[str, ...], by: str | None, rename: str = "") -> str:
    complete = " AND ".join(f"{t} IS NOT NULL" for t in ("status", *terms, *([by] if by else [])))
    numbers = {"edad_c12", *_SCALED}
    head = f"{by}, " if by else ""
    parts = [
        f"SELECT {head}'{t}' AS term, NULL AS level, count(*) AS n, round(sum({t} * status), 4) AS observed, round(sum({t} * status), 4) AS fitted FROM c{f' GROUP BY {by}' if by else ''}"
        if t in numbers
        else f"SELECT {head}'{t}' AS term, {t} AS level, count(*) AS n, round(CAST(sum(status) AS DOUBLE), 4) AS observed, round(CAST(sum(status) AS DOUBLE), 4) AS fitted FROM c GROUP BY {head}{t}"
        for t in terms
    ]
    return f"WITH {MODEL_SQL}, {_scaled_sql(scaled)}, c AS (SELECT *{rename} FROM z WHERE {complete})\n" + "\nUNION ALL ".join(parts)


def _totals(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) + F.lit(0.0) for c in ("observed", "fitted")})


@register("glm_full_totals", _totals_sql("", BASE_TERMS, None))
def glm_full_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full completion model on demographics and the four skills: fitted totals per level equal the observed ones (M1, M2, M4)."""
    df = model_frame(spark, sf_dir)
    return _totals(glm.fitted_totals(df, {None: glm.fit_glm(df, BASE)}))


@register("glm_segment_totals", _totals_sql("", tuple(t for t in BASE_TERMS if t != "estado"), "estado"))
def glm_segment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model without the state term in every state of the data, in one series of passes: fitted and observed totals (M3)."""
    df, spec = model_frame(spark, sf_dir), BASE.drop_term("estado")
    return _totals(glm.fitted_totals(df, glm.fit_segments(df, spec, "estado"), "estado"))


@register("glm_pooled_totals", _totals_sql("PARTITION BY wave", (*BASE_TERMS, "wave"), None).replace("'wave' AS term", "'periodo' AS term"))
def glm_pooled_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All waves of the data, scaled per wave, with a period term: fitted and observed totals (M13, W5 per wave)."""
    df = attrition.pooled_waves(spark, sf_dir)
    return _totals(glm.fitted_totals(df, {None: glm.fit_glm(df, BASE.add_terms("periodo"))}))


@register("glm_full_tidy")
def glm_full_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion model on demographics and the four skills: coefficients, z, p, odds (M1, M2, M4, M5)."""
    return round6(glm.tidy(spark, glm.fit_glm(model_frame(spark, sf_dir), BASE)))


@register("glm_segment_tidy")
def glm_segment_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model without the state term in every state of the data (M3)."""
    fits = glm.fit_segments(model_frame(spark, sf_dir), BASE.drop_term("estado"), "estado")
    return round6(glm.tidy(spark, fits).withColumnRenamed("model", "estado"))


@register("glm_anova_seq")
def glm_anova_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential analysis of deviance of the full model (M7)."""
    return round6(glm.anova_sequential(spark, model_frame(spark, sf_dir), BASE))


@register("glm_compare")
def glm_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adolescent-only vs +360 vs +mentor vs global models on common complete rows (M8)."""
    return round6(glm.anova_compare(spark, linked_model_frame(spark, sf_dir), family()))


@register("glm_pooled_waves")
def glm_pooled_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-wave z-scores, all waves of the data stacked, period term added (M13, W5 per wave, U1)."""
    return round6(glm.tidy(spark, glm.fit_glm(attrition.pooled_waves(spark, sf_dir), BASE.add_terms("periodo"))))


@register("glm_glance")
def glm_glance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model summaries (deviances, df, AIC, n) of the full model and of its fits in every state (M6, M3)."""
    frame = model_frame(spark, sf_dir)
    states = glm.fit_segments(frame, BASE.drop_term("estado"), "estado")
    return round6(glm.glance(spark, {"full": glm.fit_glm(frame, BASE), **{f"state {s}": f for s, f in states.items()}}))


# --------------------------------------------------------------------- IRT

from ..models import irt  # noqa: E402
from ..models.store import key_of, session_store  # noqa: E402
from ..operators.plotdata import kde  # noqa: E402
from . import psychometrics as ps  # noqa: E402


def _irt_fits(spark: SparkSession, sf_dir: str) -> dict:
    """The fits of all scales; made once and read from the store by every table of them."""
    return session_store(spark).gpcm(key_of("gpcm", sf_dir, ps.scale_map()), lambda: irt.fit_gpcm_scales(ps.item_matrix(spark, sf_dir), ps.scale_map()))


@register("irt_items")
def irt_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPCM item parameters per scale: slope a1 and thresholds b1..b3 (K6, K8)."""
    return round6(irt.item_table(spark, _irt_fits(spark, sf_dir)))


@register("irt_fit")
def irt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood, respondents, cycles and convergence of each scale's fit (K6)."""
    return round6(irt.fit_table(spark, _irt_fits(spark, sf_dir)))


@register("irt_thresholds")
def irt_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds in long form limited to (-4, 4) logits (K9)."""
    return round6(irt.threshold_table(irt.item_table(spark, _irt_fits(spark, sf_dir))))


@register("irt_scores")
def irt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EAP person scores and their SEs for every respondent and scale (K7)."""
    return round6(irt.eap_scales(ps.item_matrix(spark, sf_dir), _irt_fits(spark, sf_dir), ["respondent_id"], "score"))


@register("irt_score_density")
def irt_score_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of IRT scores per scale within (-4, 4), 512 points (V2 on K7)."""
    scores = irt.eap_scales(ps.item_matrix(spark, sf_dir), _irt_fits(spark, sf_dir), ["respondent_id"], "score")
    return round6(kde(scores, "score", ["scale"], limits=(-4.0, 4.0), bin_width=1e-3))


_CATEGORIES_SQL = "\nUNION ALL ".join(
    f"SELECT '{scale}' AS scale, '{i}' AS item, CAST({i} AS INT) AS category, round(CAST(count(*) AS DOUBLE), 3) AS expected FROM items WHERE {i} IS NOT NULL GROUP BY {i}"
    for scale, v in ps.scale_map().items() for i in v)


@register("irt_category_totals", f"WITH {items_cte()}\n{_CATEGORIES_SQL}")
def irt_category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected answers per item and category of the fitted model: they equal the observed ones."""
    return irt.category_table(spark, _irt_fits(spark, sf_dir)).withColumn("expected", F.round("expected", 3))


# Fixed parameters of the checked scores: slope, then thresholds, the same for every item of a scale.
FIXED_SLOPE, FIXED_THRESHOLDS = 0.9, (-1.2, 0.1, 1.3)


def fixed_fits() -> dict:
    import numpy as np

    d = np.concatenate([[0.0], -FIXED_SLOPE * np.cumsum(FIXED_THRESHOLDS)])
    return {s: irt.GpcmFit(list(v), np.full(len(v), FIXED_SLOPE), np.tile(d, (len(v), 1)), 1, 0.0, 0, True, 0) for s, v in ps.scale_map().items()}


def _eap_sql() -> str:
    steps = [sum(FIXED_THRESHOLDS[:k]) for k in range(len(FIXED_THRESHOLDS) + 1)]
    z = [f"{FIXED_SLOPE} * ({k} * t - ({b}))" for k, b in enumerate(steps)]
    curve = ", ".join(f"{e} - ln({' + '.join(f'exp({x})' for x in z)}) AS p{k + 1}" for k, e in enumerate(z))
    parts = []
    for scale, v in ps.scale_map().items():
        one = lambda i: f"coalesce(CASE {i} " + " ".join(f"WHEN {k + 1} THEN p{k + 1}" for k in range(len(z))) + " END, 0)"
        parts.append(f"""SELECT respondent_id, '{scale}' AS scale, t, -t * t / 2 + {' + '.join(map(one, v))} AS lp FROM items, curve""")
    both = "\nUNION ALL ".join(parts)
    return f"""WITH {items_cte()},
curve AS (SELECT t, {curve} FROM (SELECT -{irt.BOUND} + {2 * irt.BOUND} * i / {irt.NODES - 1} AS t FROM range({irt.NODES}) r(i))),
l AS ({both}),
e AS (SELECT respondent_id, scale, sum(exp(lp) * t) / sum(exp(lp)) AS m, sum(exp(lp) * t * t) / sum(exp(lp)) AS m2 FROM l GROUP BY respondent_id, scale)
SELECT respondent_id, scale, round(m, 6) + 0.0 AS score, round(sqrt(m2 - m * m), 6) AS score_se FROM e"""


@register("irt_fixed_scores", _eap_sql())
def irt_fixed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EAP scores of every respondent and scale at fixed item parameters (K7)."""
    out = irt.eap_scales(ps.item_matrix(spark, sf_dir), fixed_fits(), ["respondent_id"], "score")
    return round6(out).withColumn("score", F.col("score") + F.lit(0.0))


_FIXED_ROWS = ", ".join(f"('{s}', '{i}', 'b{k + 1}', CAST({b} AS DOUBLE))" for s, v in ps.scale_map().items() for i in v for k, b in enumerate(FIXED_THRESHOLDS))


@register("irt_answered_thresholds", f"""WITH {items_cte()}, f(scale, item, threshold, logits) AS (VALUES {_FIXED_ROWS}),
n AS ({chr(10).join(f"{'UNION ALL ' if k else ''}SELECT '{i}' AS item, count({i}) AS n FROM items" for k, i in enumerate(ps.ITEMS))})
SELECT scale, item, threshold, logits, n FROM f JOIN n USING (item) WHERE logits BETWEEN -1 AND 2""")
def irt_answered_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds at fixed parameters in long form, limited to an axis range, with the answers of their items (K8, K9)."""
    long = irt.threshold_table(irt.item_table(spark, fixed_fits()), (-1.0, 2.0))
    m = ps.item_matrix(spark, sf_dir)
    counts = m.agg(*[F.count(i).alias(i) for i in ps.ITEMS]).unpivot([], list(ps.ITEMS), "item", "n")
    return round6(long.join(counts, "item").select("scale", "item", "threshold", "logits", "n"))


# --------------------------------------------------------------------- mixed models

from ..models import glmm  # noqa: E402

MIXED_SPEC = BASE.to_random("estado")


@contextmanager
def _kept(*frames: DataFrame):
    """Frames that a query derives several times (rows, their means and deviations): computed once while it runs."""
    for f in frames:
        f.persist()
    try:
        yield
    finally:
        for f in frames:
            f.unpersist()


MODE_BETA, MODE_SIGMA = -0.5, 0.8  # fixed parameters of the checked conditional modes

# Newton's method for the mode of each region's effect, 40 steps of a recursion; then the Laplace deviance at the modes.
_MODES_SQL = f"""WITH RECURSIVE {ADOL_SQL},
g AS (SELECT estado, CAST(count(*) AS DOUBLE) AS n, CAST(sum(status) AS DOUBLE) AS s FROM adol WHERE estado IS NOT NULL GROUP BY estado),
it(k, estado, n, s, u) AS (SELECT 0, estado, n, s, CAST(0 AS DOUBLE) FROM g
  UNION ALL SELECT k + 1, estado, n, s,
    u + ({MODE_SIGMA} * (s - n / (1 + exp(-({MODE_BETA} + {MODE_SIGMA} * u)))) - u)
        / (1 + {MODE_SIGMA} * {MODE_SIGMA} * n / (1 + exp(-({MODE_BETA} + {MODE_SIGMA} * u))) / (1 + exp({MODE_BETA} + {MODE_SIGMA} * u))) FROM it WHERE k < 40),
m AS (SELECT estado, n, s, u, {MODE_BETA} + {MODE_SIGMA} * u AS eta FROM it WHERE k = 40)"""


@register("glmm_group_modes", f"""{_MODES_SQL}
SELECT estado, round({MODE_SIGMA} * u, 6) AS effect FROM m""")
def glmm_group_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional modes of the region effects at fixed parameters (M9)."""
    rows, _ = glmm.conditional_modes(attrition.adolescents(spark, sf_dir), ModelSpec("status", (), ("estado",)), {"(Intercept)": MODE_BETA}, [MODE_SIGMA])
    return round6(spark.createDataFrame([r[1:] for r in rows], "estado string, effect double"))


@register("glmm_laplace_deviance", f"""{_MODES_SQL}
SELECT round(sum(-2 * (s * eta - n * ln(1 + exp(eta))) + u * u + ln(1 + {MODE_SIGMA} * {MODE_SIGMA} * n / (1 + exp(-eta)) / (1 + exp(eta)))), 4) AS deviance FROM m""")
def glmm_laplace_deviance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laplace deviance at fixed parameters."""
    _, dev = glmm.conditional_modes(attrition.adolescents(spark, sf_dir), ModelSpec("status", (), ("estado",)), {"(Intercept)": MODE_BETA}, [MODE_SIGMA])
    return spark.createDataFrame([(dev,)], "deviance double").select(F.round("deviance", 4).alias("deviance"))


@register("glmm_fixed")
def glmm_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random intercept for state: fixed effects with Wald z."""
    with _kept(attrition.model_rows(spark, sf_dir)):
        return round6(glmm.fixed_table(spark, glmm.fit_glmm(model_frame(spark, sf_dir), MIXED_SPEC)))


@register("glmm_random")
def glmm_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random intercepts for state and period on the pooled waves: the effect of every level."""
    with _kept(attrition.model_rows(spark, sf_dir)):
        return round6(glmm.random_table(spark, glmm.fit_glmm(attrition.pooled_waves(spark, sf_dir), MIXED_SPEC.add_random("periodo"))))


@register("glmm_variance")
def glmm_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance components, log-likelihood, AIC, BIC of the state random-intercept model;
    pooled waves add a crossed period intercept (M9-M11, M13)."""
    with _kept(attrition.model_rows(spark, sf_dir)):
        one = glmm.fit_glmm(model_frame(spark, sf_dir), MIXED_SPEC)
        two = glmm.fit_glmm(attrition.pooled_waves(spark, sf_dir), MIXED_SPEC.add_random("periodo"))
    return round6(glmm.variance_table(spark, one, "state").unionByName(glmm.variance_table(spark, two, "state_period")))


@register("glmm_compare")
def glmm_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood-ratio comparison of the four mixed models on common rows."""
    specs = {k: s.to_random("estado") for k, s in family().items()}
    with _kept(attrition.model_rows(spark, sf_dir), attrition.ratings_360(spark, sf_dir)):
        data = glmm.common_rows(linked_model_frame(spark, sf_dir), list(specs.values()))
        return round6(glmm.lr_compare(spark, glmm.fit_glmms(data, specs)))
