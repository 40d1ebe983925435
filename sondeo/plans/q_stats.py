"""Registered statistics queries: describe, reliability, item statistics, plot data."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ALUMNI_LIKERT_ITEMS, MENTOR_REVERSED_ITEMS
from ..operators import describe as ds
from ..operators import plotdata as pdz
from ..operators import psychometrics as pm
from ..operators.scoring import scale_scores
from ..sources import fixtures
from . import alumni, attrition
from . import psychometrics as ps
from .catalog import LIKERT_NUM, register, round6
from .q_attrition import ADOL_SQL
from .sqlkit import alumni_cte, items_cte, r6

# --------------------------------------------------------------------- G20, G22


@register("summary_numeric", f"""WITH {alumni_cte()}
SELECT CAST(min(edad) AS DOUBLE) AS min, {r6('quantile_cont(edad, 0.25)', 'q1')}, {r6('quantile_cont(edad, 0.5)', 'median')},
  {r6('avg(edad)', 'mean')}, {r6('quantile_cont(edad, 0.75)', 'q3')}, CAST(max(edad) AS DOUBLE) AS max,
  count(*) FILTER (WHERE edad IS NULL) AS n_na FROM alumni""")
def summary_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``summary(edad)``: quartiles (type 7), mean, extremes and NA count."""
    return round6(ds.summary_numeric(alumni.alumni_table(spark, sf_dir), "edad"))


def _describe_sql(by: list[str]) -> str:
    g = ", ".join(by)
    gsel = f"{g}, " if by else ""
    gby = f"GROUP BY {g}" if by else ""
    on = " AND ".join(f"x.{b} IS NOT DISTINCT FROM s.{b}" for b in by) or "TRUE"
    part = f"PARTITION BY {', '.join('x.' + b for b in by)}" if by else ""
    return f"""WITH {alumni_cte()},
x AS (SELECT {gsel}CAST(edad AS DOUBLE) AS v FROM alumni WHERE edad IS NOT NULL),
s AS (SELECT {gsel}count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd, quantile_cont(v, 0.5) AS med, min(v) AS mn, max(v) AS mx FROM x {gby}),
m AS (SELECT {', '.join('s.' + b for b in by) + ', ' if by else ''}avg(power(v - s.mean, 2)) AS m2, avg(power(v - s.mean, 3)) AS m3, avg(power(v - s.mean, 4)) AS m4,
      quantile_cont(abs(v - s.med), 0.5) * 1.4826 AS mad FROM x JOIN s ON {on} {('GROUP BY ' + ', '.join('s.' + b for b in by)) if by else ''}),
r AS (SELECT x.*, s.n, row_number() OVER ({part} ORDER BY v) AS rk FROM x JOIN s ON {on}),
t AS (SELECT {gsel}avg(v) AS trimmed FROM r WHERE rk >= floor(n * 0.1) + 1 AND rk <= n - floor(n * 0.1) {gby})
SELECT {', '.join('s.' + b for b in by) + ', ' if by else ''}s.n, {r6('s.mean', 'mean')}, {r6('s.sd', 'sd')}, {r6('s.med', 'median')}, {r6('t.trimmed', 'trimmed')},
  {r6('m.mad', 'mad')}, {r6('s.mn', 'min')}, {r6('s.mx', 'max')}, {r6('s.mx - s.mn', 'range')},
  {r6('m.m3 / power(m.m2, 1.5) * power((s.n - 1) / s.n, 1.5)', 'skew')},
  {r6('m.m4 / power(m.m2, 2) * power(1 - 1 / s.n, 2) - 3', 'kurtosis')}, {r6('s.sd / sqrt(s.n)', 'se')}
FROM s JOIN m ON {on.replace('x.', 'm.')} JOIN t ON {on.replace('x.', 't.')}"""


@register("describe_numeric", _describe_sql([]))
def describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``psych::describe(edad)``."""
    return round6(ds.describe(alumni.alumni_table(spark, sf_dir), "edad"))


@register("describe_by_sex", _describe_sql(["sexo"]))
def describe_by_sex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``psych::describe`` per sex (G22, grouped)."""
    return round6(ds.describe(alumni.alumni_table(spark, sf_dir), "edad", by=["sexo"]))


# --------------------------------------------------------------------- K1, K2

_K = len(LIKERT_NUM)
_FLIP = [1 if not c.startswith("l5") else -1 for c in LIKERT_NUM]


def _cov_cte(src: str, cols: list[str]) -> str:
    k = len(cols)
    terms = [f"covar_samp({cols[i]}, {cols[j]}) AS c_{i}_{j}" for i in range(k) for j in range(i, k)]
    return f"cv AS (SELECT {', '.join(terms)} FROM {src})"


def _c(i: int, j: int) -> str:
    return f"c_{min(i, j)}_{max(i, j)}"


def _alpha_exprs(idx: list[int], signs: list[int]) -> dict[str, str]:
    k = len(idx)
    total = " + ".join(f"({signs[i] * signs[j]}) * {_c(i, j)}" for i in idx for j in idx)
    trace = " + ".join(_c(i, i) for i in idx)
    rsum = " + ".join(f"({signs[i] * signs[j]}) * {_c(i, j)} / sqrt({_c(i, i)} * {_c(j, j)})" for i in idx for j in idx if i != j)
    rbar = f"(({rsum}) / {k * (k - 1)})"
    return {
        "raw_alpha": f"{k} / {k - 1} * (1 - ({trace}) / ({total}))",
        "std_alpha": f"{k} * {rbar} / (1 + {k - 1} * {rbar})",
        "average_r": rbar,
        "s_n": f"{k} * {rbar} / (1 - {rbar})",
    }


def _alpha_sql(signs: list[int]) -> str:
    e = _alpha_exprs(list(range(_K)), signs)
    rev = ",".join(c for c, s in zip(LIKERT_NUM, signs) if s < 0)
    return f"""WITH {alumni_cte()}, {_cov_cte('alumni', LIKERT_NUM)}
SELECT {', '.join(r6(v, k) for k, v in e.items())}, {_K} AS n_items, '{rev}' AS reversed FROM cv"""


@register("alpha_raw", _alpha_sql([1] * _K))
def alpha_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cronbach's alpha of the eight Likert items as answered (K1)."""
    return round6(pm.cronbach_alpha(spark, alumni.alumni_table(spark, sf_dir), LIKERT_NUM, check_keys=False))


@register("alpha_keyed", _alpha_sql(_FLIP))
def alpha_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alpha with automatic reverse keying from the first principal component (K1, ``check.keys``)."""
    return round6(pm.cronbach_alpha(spark, alumni.alumni_table(spark, sf_dir), LIKERT_NUM, check_keys=True))


def _drop_sql() -> str:
    parts = []
    for i in range(_K):
        idx = [j for j in range(_K) if j != i]
        e = _alpha_exprs(idx, _FLIP)
        tot = " + ".join(f"({_FLIP[a] * _FLIP[b]}) * {_c(a, b)}" for a in range(_K) for b in range(_K))
        row = " + ".join(f"({_FLIP[i] * _FLIP[b]}) * {_c(i, b)}" for b in range(_K))
        rdrop = f"(({row}) - {_c(i, i)}) / sqrt({_c(i, i)} * (({tot}) - 2 * ({row}) + {_c(i, i)}))"
        parts.append(f"SELECT '{LIKERT_NUM[i]}' AS item, {r6(e['raw_alpha'], 'raw_alpha')}, {r6(e['std_alpha'], 'std_alpha')}, "
                     f"{r6(e['average_r'], 'average_r')}, {r6(rdrop, 'r_drop')} FROM cv")
    return f"WITH {alumni_cte()}, {_cov_cte('alumni', LIKERT_NUM)}\n" + "\nUNION ALL ".join(parts)


@register("alpha_if_dropped", _drop_sql())
def alpha_if_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alpha if each item is dropped, and item-rest correlation, after keying (K2)."""
    return round6(pm.alpha_if_dropped(spark, alumni.alumni_table(spark, sf_dir), LIKERT_NUM, check_keys=True))


# --------------------------------------------------------------------- K3, K5

_SCALES = ps.scale_map()


def _itemstats_sql(part: str, scales: dict[str, list[str]] | None = None, source: str | None = None) -> str:
    out = []
    for s, its in (scales or _SCALES).items():
        k = len(its)
        tot = " + ".join(f"coalesce({c}, 0)" for c in its)
        if part == "overall":
            comp = " AND ".join(f"{c} IS NOT NULL" for c in its)
            corrs = [f"corr({a}, {b})" for a, b in combinations(its, 2)]
            trace = " + ".join(f"covar_samp({c}, {c})" for c in its)
            allc = " + ".join(f"covar_samp({a}, {b})" for a in its for b in its)
            alpha = f"{k} / {k - 1} * (1 - ({trace}) / ({allc}))"
            out.append(f"""SELECT '{s}' AS scale, count(*) FILTER (WHERE {comp}) AS n_complete, count(*) AS n,
  {r6(f'avg({tot})', 'mean_total')}, {r6(f'stddev_samp({tot})', 'sd_total')},
  {r6(f"list_avg([{', '.join(corrs)}])", 'ave_r')}, {r6(f"list_stddev_samp([{', '.join(corrs)}])", 'sd_r')},
  {r6(alpha, 'alpha')}, {r6(f'stddev_samp({tot}) * sqrt(1 - ({alpha}))', 'sem_alpha')} FROM items""")
        elif part == "items":
            for it in its:
                rest = [c for c in its if c != it]
                kk = len(rest)
                trace = " + ".join(f"covar_samp({c}, {c})" for c in rest)
                allc = " + ".join(f"covar_samp({a}, {b})" for a in rest for b in rest)
                out.append(f"""SELECT '{s}' AS scale, '{it}' AS item, count({it}) AS n, count(DISTINCT {it}) AS k,
  {r6(f'avg({it})', 'mean')}, {r6(f'stddev_samp({it})', 'sd')}, {r6(f'corr({it}, {tot})', 'total_r')},
  {r6(f'corr({it}, ({tot}) - {it})', 'total_r_if_rm')}, {r6(f'{kk} / {kk - 1} * (1 - ({trace}) / ({allc}))', 'alpha_if_rm')} FROM items""")
        else:
            for it in its:
                ps_ = ", ".join(r6(f"count(*) FILTER (WHERE {it} = {c}) / count(*)", f"p{c}") for c in (1, 2, 3, 4))
                out.append(f"SELECT '{s}' AS scale, '{it}' AS item, {ps_}, {r6(f'(count(*) - count({it})) / count(*)', 'p_na')} FROM items")
    return f"WITH {source or items_cte()}\n" + "\nUNION ALL ".join(out)


def _itemstats(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return pm.itemstats(spark, ps.item_matrix(spark, sf_dir), _SCALES)


@register("itemstats_overall", _itemstats_sql("overall"))
def itemstats_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-scale totals, inter-item r, alpha and its standard error (K3 overall)."""
    return round6(_itemstats(spark, sf_dir)["overall"])


@register("itemstats_items", _itemstats_sql("items"))
def itemstats_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-item N, categories, mean, sd, item-total / item-rest r, alpha if removed (K3 items)."""
    return round6(_itemstats(spark, sf_dir)["items"])


@register("item_proportions", _itemstats_sql("props"))
def item_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each answer category and of missing answers per item (K3 proportions)."""
    return round6(pm.item_proportions(spark, ps.item_matrix(spark, sf_dir), _SCALES))


_MENTOR = ps.mentor_scales()
_MENTOR_CTE = "items AS (SELECT respondent_id, " + ", ".join(f"5 - {i} AS {i}" if i in MENTOR_REVERSED_ITEMS else i for v in _MENTOR.values() for i in v) + f" FROM ({fixtures.mentor_survey_sql()}))"


@register("itemstats_mentor_overall", _itemstats_sql("overall", _MENTOR, _MENTOR_CTE))
def itemstats_mentor_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, inter-item r, alpha and its standard error of the five mentor scales, 40 items (K3 overall, P15, C4)."""
    return round6(pm.itemstats(spark, ps.mentor_items(spark, sf_dir), _MENTOR)["overall"])


@register("itemstats_mentor_items", _itemstats_sql("items", _MENTOR, _MENTOR_CTE))
def itemstats_mentor_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the 40 mentor items (K3 items)."""
    return round6(pm.itemstats(spark, ps.mentor_items(spark, sf_dir), _MENTOR)["items"])


def _item_stats_sql() -> str:
    total = " + ".join(f"({_FLIP[a] * _FLIP[b]}) * {_c(a, b)}" for a in range(_K) for b in range(_K))
    both = " + ".join(f"({_FLIP[a] * _FLIP[b]}) * {_c(a, b)} / sqrt({_c(a, a)} * {_c(b, b)})" for a in range(_K) for b in range(_K))
    parts = []
    for i, it in enumerate(LIKERT_NUM):
        row = " + ".join(f"({_FLIP[i] * _FLIP[b]}) * {_c(i, b)}" for b in range(_K))
        std = " + ".join(f"({_FLIP[i] * _FLIP[b]}) * {_c(i, b)} / sqrt({_c(i, i)} * {_c(b, b)})" for b in range(_K))
        drop = f"(({row}) - {_c(i, i)}) / sqrt({_c(i, i)} * (({total}) - 2 * ({row}) + {_c(i, i)}))"
        mean = f"avg({it})" if _FLIP[i] > 0 else f"(SELECT min(least({', '.join(LIKERT_NUM)})) + max(greatest({', '.join(LIKERT_NUM)})) FROM alumni) - avg({it})"
        parts.append(f"SELECT '{it}' AS item, (SELECT count({it}) FROM alumni) AS n, {r6(f'({row}) / sqrt({_c(i, i)} * ({total}))', 'raw_r')}, {r6(f'({std}) / sqrt({both})', 'std_r')}, "
                     f"{r6(drop, 'r_drop')}, (SELECT {r6(mean, 'm')} FROM alumni) AS mean, (SELECT {r6(f'stddev_samp({it})', 's')} FROM alumni) AS sd FROM cv")
    return f"WITH {alumni_cte()}, {_cov_cte('alumni', LIKERT_NUM)}\n" + "\nUNION ALL ".join(parts)


@register("alpha_item_stats", _item_stats_sql())
def alpha_item_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, correlations with raw, standardised and rest totals, mean and sd of the keyed items (K2)."""
    return round6(pm.alpha_item_stats(spark, alumni.alumni_table(spark, sf_dir), LIKERT_NUM))


def _scale_cor_sql() -> str:
    names = list(_SCALES)
    tots = {s: " + ".join(f"coalesce({c}, 0)" for c in its) for s, its in _SCALES.items()}
    parts = [f"SELECT '{a}' AS scale_a, '{b}' AS scale_b, {r6(f'corr({tots[a]}, {tots[b]})', 'r')} FROM items" for a in names for b in names]
    return f"WITH {items_cte()}\n" + "\nUNION ALL ".join(parts)


@register("scale_correlations", _scale_cor_sql())
def scale_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson correlations between scale totals (K4, K5)."""
    m = scale_scores(ps.item_matrix(spark, sf_dir), _SCALES).select(*_SCALES)
    return round6(pm.correlation_long(m, list(_SCALES)))


# --------------------------------------------------------------------- V1-V4


def _adol_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attrition.adolescents(spark, sf_dir)
    sc = attrition.scales_from_names(a.columns)
    return a.select("id", "sexo", "estado", "status", "socioeco", "edad", attrition.score_array(sc, "dim", "score").alias("_s")).select(
        "id", "sexo", "estado", "status", "socioeco", "edad", F.inline("_s"))


@register("box_stats", f"""WITH {ADOL_SQL},
l AS (SELECT a.sexo, l.dim, l.status, CAST(l.score AS DOUBLE) AS v FROM adol_long l JOIN adol a ON a.id = l.id),
q AS (SELECT sexo, dim, status, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY ALL),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.sexo, f.dim, f.status, f.n, {r6('min(CASE WHEN v >= lo THEN v END)', 'whisker_low')}, {r6('f.q1', 'q1')}, {r6('f.median', 'median')},
  {r6('f.q3', 'q3')}, {r6('max(CASE WHEN v <= hi THEN v END)', 'whisker_high')}, count(*) FILTER (WHERE v < lo OR v > hi) AS n_outliers
FROM l JOIN f ON l.sexo IS NOT DISTINCT FROM f.sexo AND l.dim = f.dim AND l.status = f.status
GROUP BY f.sexo, f.dim, f.status, f.n, f.q1, f.median, f.q3""")
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box statistics of scale scores by dimension x outcome, faceted by sex (V1)."""
    return round6(pdz.box_stats(_adol_long(spark, sf_dir), "score", ["sexo", "dim", "status"]))


@register("kde_grid", f"""WITH {ADOL_SQL},
vals AS (SELECT dim, CAST(score AS DOUBLE) AS v FROM adol_long),
st AS (SELECT dim, count(*) AS n, stddev_samp(v) AS sd, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, min(v) AS mn, max(v) AS mx FROM vals GROUP BY dim),
bw AS (SELECT dim, n, 0.9 * (CASE WHEN least(sd, (q3 - q1) / 1.34) > 0 THEN least(sd, (q3 - q1) / 1.34) WHEN sd > 0 THEN sd ELSE 1.0 END) * power(CAST(n AS DOUBLE), -0.2) AS bw FROM st),
r AS (SELECT min(v) AS lo, (max(v) - min(v)) / 511 AS step FROM vals),
p AS (SELECT dim, (v - lo) / step AS pos, least(floor((v - lo) / step), 510) AS cell FROM vals, r),
vc AS (SELECT dim, bin, sum(w) AS c FROM (SELECT dim, cell AS bin, 1 - (pos - cell) AS w FROM p UNION ALL SELECT dim, cell + 1, pos - cell FROM p) GROUP BY dim, bin),
g AS (SELECT bw.*, i.range AS point, lo, step FROM bw, r, range(512) i)
SELECT g.dim, CAST(g.point AS INTEGER) AS point, {r6('lo + point * step', 'x')}, {r6('sum(vc.c * exp(-0.5 * power((g.point - vc.bin) * step / g.bw, 2)) / (g.n * g.bw * sqrt(2 * pi())))', 'density')}
FROM g JOIN vc ON g.dim = vc.dim GROUP BY g.dim, g.point, lo, step""")
def kde_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian density of scale scores per dimension on a 512-point grid (V2)."""
    return round6(pdz.kde(_adol_long(spark, sf_dir), "score", ["dim"]))


@register("lm_by_group", f"""WITH {ADOL_SQL},
l AS (SELECT a.socioeco, l.dim, l.estado, l.score FROM adol_long l JOIN adol a ON a.id = l.id)
SELECT dim, estado, CAST(regr_count(score, socioeco) AS BIGINT) AS n, {r6('regr_slope(score, socioeco)', 'slope')}, {r6('regr_intercept(score, socioeco)', 'intercept')},
  {r6('regr_r2(score, socioeco)', 'r2')}, {r6('regr_avgx(score, socioeco)', 'mean_x')}, {r6('regr_sxx(score, socioeco)', 'sxx')},
  {r6('regr_syy(score, socioeco)', 'syy')}, {r6('regr_sxy(score, socioeco)', 'sxy')} FROM l GROUP BY dim, estado""")
def lm_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares line of score on socio-economic level per (dimension, state) (V3)."""
    return round6(pdz.lm_by_group(_adol_long(spark, sf_dir), "score", "socioeco", ["dim", "estado"]))


def _trend_label(c):
    return F.initcap(F.regexp_replace(F.regexp_replace(c, r"l\d_|_num", ""), "_", " "))


@register("trend_means", f"""WITH {alumni_cte()},
m AS (SELECT periodo, {', '.join(f'avg({c}_num) AS {c}_num' for c in ALUMNI_LIKERT_ITEMS)} FROM alumni WHERE periodo <> 'Otro' GROUP BY periodo),
l AS ({' UNION ALL '.join(f"SELECT periodo, '{c}_num' AS pregunta, {c}_num AS promedio FROM m" for c in ALUMNI_LIKERT_ITEMS)})
SELECT periodo, array_to_string(list_transform(string_split(replace(regexp_replace(pregunta, 'l\\d_|_num', '', 'g'), '_', ' '), ' '),
    lambda w: upper(w[1]) || lower(w[2:])), ' ') AS pregunta, {r6('promedio', 'promedio')} FROM l""")
def trend_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of every Likert item per generation, long, with readable labels."""
    df = alumni.alumni_table(spark, sf_dir).where(F.col("periodo") != "Otro")
    wide = df.groupBy("periodo").agg(*[F.avg(c).alias(c) for c in LIKERT_NUM])
    long = wide.unpivot(["periodo"], LIKERT_NUM, "pregunta", "promedio")
    return round6(long.withColumn("pregunta", _trend_label(F.col("pregunta"))))


def _freq_sql() -> str:
    parts = []
    for c in LIKERT_NUM:
        ps_ = ", ".join(r6(f"count(*) FILTER (WHERE {c} = {k}) / count({c})", f"p{k}") for k in (1, 2, 3, 4))
        parts.append(f"SELECT '{c}' AS item, {ps_}, {r6(f'(count(*) - count({c})) / count(*)', 'miss')} FROM alumni")
    return f"WITH {alumni_cte()}\n" + "\nUNION ALL ".join(parts)


@register("alpha_response_freq", _freq_sql())
def alpha_response_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response frequencies printed with alpha: share of each answer among answered, and missing share (K2)."""
    df = alumni.alumni_table(spark, sf_dir)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(LIKERT_NUM):
        aggs += [F.count(c).alias(f"a{i}")] + [F.count_if(F.col(c) == k).alias(f"c{i}_{k}") for k in (1, 2, 3, 4)]
    wide = df.agg(*aggs)
    from ..operators.common import stack_rows

    entries = [(c, [(f"p{k}", F.col(f"c{i}_{k}") / F.col(f"a{i}")) for k in (1, 2, 3, 4)] + [("miss", (F.col("__n") - F.col(f"a{i}")) / F.col("__n"))])
               for i, c in enumerate(LIKERT_NUM)]
    return round6(stack_rows(wide, [], entries, "item"))


@register("box_socio_by_status", f"""WITH {ADOL_SQL},
l AS (SELECT status, CAST(socioeco AS DOUBLE) AS v FROM adol WHERE edad IS NOT NULL AND socioeco IS NOT NULL),
q AS (SELECT status, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY status),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.status, f.n, {r6('min(CASE WHEN v >= lo THEN v END)', 'whisker_low')}, {r6('f.q1', 'q1')}, {r6('f.median', 'median')},
  {r6('f.q3', 'q3')}, {r6('max(CASE WHEN v <= hi THEN v END)', 'whisker_high')}, count(*) FILTER (WHERE v < lo OR v > hi) AS n_outliers
FROM l JOIN f ON l.status = f.status GROUP BY f.status, f.n, f.q1, f.median, f.q3""")
def box_socio_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box statistics of socio-economic level by outcome, respondents with a known age (V1)."""
    a = attrition.adolescents(spark, sf_dir).where(F.col("edad").isNotNull())
    return round6(pdz.box_stats(a, "socioeco", ["status"]))


def _boxes_sql(facet: str | None, known: str) -> str:
    """Boxes of scale scores by dimension and outcome, per ``facet``, over respondents whose ``known`` is given."""
    head = f"CAST(a.{facet} AS DOUBLE) AS {facet}" if facet == "edad" else f"a.{facet}"
    keys = [*([facet] if facet else []), "dim", "status"]
    g = ", ".join(keys)
    on = " AND ".join(f"l.{k} = f.{k}" for k in keys)
    return f"""WITH {ADOL_SQL},
l AS (SELECT {head + ', ' if facet else ''}l.dim, l.status, CAST(l.score AS DOUBLE) AS v FROM adol_long l JOIN adol a ON a.id = l.id WHERE a.{known} IS NOT NULL),
q AS (SELECT {g}, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY ALL),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT {', '.join('f.' + k for k in keys)}, f.n, {r6('min(CASE WHEN v >= lo THEN v END)', 'whisker_low')}, {r6('f.q1', 'q1')}, {r6('f.median', 'median')},
  {r6('f.q3', 'q3')}, {r6('max(CASE WHEN v <= hi THEN v END)', 'whisker_high')}, count(*) FILTER (WHERE v < lo OR v > hi) AS n_outliers
FROM l JOIN f ON {on} GROUP BY {', '.join('f.' + k for k in keys)}, f.n, f.q1, f.median, f.q3"""


def _scores_with(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Scale scores in long form with some columns of the respondent."""
    a = attrition.adolescents(spark, sf_dir)
    long = attrition.score_array(attrition.scales_from_names(a.columns), "dim", "score")
    return a.select("status", *columns, F.inline(long))


@register("box_by_status", _boxes_sql(None, "municipio"))
def box_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box statistics of scale scores by dimension and outcome, respondents with a known place (V1)."""
    return round6(pdz.box_stats(_scores_with(spark, sf_dir, "municipio").where("municipio IS NOT NULL"), "score", ["dim", "status"]))


@register("box_by_place", _boxes_sql("municipio", "municipio"))
def box_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box statistics of scale scores by dimension and outcome, one facet per place (V1)."""
    return round6(pdz.box_stats(_scores_with(spark, sf_dir, "municipio").where("municipio IS NOT NULL"), "score", ["municipio", "dim", "status"]))


@register("box_by_age", _boxes_sql("edad", "edad"))
def box_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box statistics of scale scores by dimension and outcome, one facet per age (V1)."""
    known = _scores_with(spark, sf_dir, "edad").where("edad IS NOT NULL").withColumn("edad", F.col("edad").cast("double"))
    return round6(pdz.box_stats(known, "score", ["edad", "dim", "status"]))


@register("distinct_profiles", f"""WITH {ADOL_SQL} SELECT DISTINCT estado, sexo, status FROM adol""")
def distinct_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (state, sex, outcome) rows."""
    return attrition.adolescents(spark, sf_dir).select("estado", "sexo", "status").distinct()


@register("score_summary_by_place", f"""WITH {ADOL_SQL},
l AS (SELECT a.municipio, l.dim, l.status, l.score FROM adol_long l JOIN adol a ON a.id = l.id)
SELECT municipio, dim, status, {r6('avg(score)', 'score_mean')}, {r6('stddev_samp(score)', 'score_sd')} FROM l GROUP BY municipio, dim, status""")
def score_summary_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and sd of scale scores by canonical municipality, dimension and outcome."""
    from ..operators import grouped

    a = attrition.adolescents(spark, sf_dir)
    sc = attrition.scales_from_names(a.columns)
    long = a.select("municipio", "status", attrition.score_array(sc, "dim", "score").alias("_s")).select("municipio", "status", F.inline("_s"))
    return round6(grouped.mean_sd_by(long, ["municipio", "dim", "status"], "score"))
