"""Operators against brute force (pandas) on the small fixture, and properties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from sondeo.operators import freq, grouped, items, linkage, plotdata, psychometrics, scoring
from sondeo.plans import alumni


@pytest.fixture(scope="module")
def al(spark):
    return alumni.alumni_table(spark, SF_SMALL).persist()


@pytest.fixture(scope="module")
def alp(al):
    return al.toPandas()


def test_frequency_matches_pandas(al, alp):
    got = {r.estado: (r.n, r.prop) for r in freq.frequency(al, "estado").collect()}
    exp = alp["estado"].value_counts(dropna=False)
    assert sum(n for n, _ in got.values()) == len(alp)
    for k, n in exp.items():
        gn, gp = got[None if pd.isna(k) else k]
        assert gn == n and abs(gp - n / len(alp) * 100) < 1e-9


def test_grouping_sets_equal_separate_groupbys(al):
    aggs = grouped.rate_aggs("continua_estudiando")
    gs = grouped.grouping_sets_named(al, grouped.REPORT_GROUPINGS, aggs).toPandas()
    for label, keys in grouped.REPORT_GROUPINGS.items():
        part = gs[gs["grouping"] == label]
        sep = (al.groupBy(*keys).agg(*[v.alias(k) for k, v in aggs.items()]) if keys else al.agg(*[v.alias(k) for k, v in aggs.items()])).toPandas()
        assert len(part) == len(sep)
        assert part["n_total"].sum() == sep["n_total"].sum()
        assert part["n_studying"].sum() == sep["n_studying"].sum()


def test_percent_positive_matches_unpivot_path(al, alp):
    got = items.percent_positive(al, alumni.LIKERT_NUM, ["sexo"]).toPandas()
    long = alp.melt(id_vars=["respondent_id", "sexo"], value_vars=alumni.LIKERT_NUM).dropna()
    g = long.assign(pos=long["value"] >= 3).groupby(["variable", "sexo"]).agg(n=("pos", "sum"), tot=("pos", "size")).reset_index()
    g = g[g["n"] > 0]
    m = got.merge(g, left_on=["name", "sexo"], right_on=["variable", "sexo"])
    assert len(m) == len(g) == len(got)
    assert np.allclose(m["prop"], m["n_x"] / m["tot"] * 100)


def test_multi_response_denominator_is_all_rows(al, alp):
    got = freq.multi_response(al, ["componente_01", "componente_02", "componente_03"], value="c").toPandas()
    vals = pd.concat([alp[c] for c in ["componente_01", "componente_02", "componente_03"]]).dropna().value_counts()
    for _, r in got.iterrows():
        assert r["n"] == vals[r["c"]]
        assert abs(r["prop"] - vals[r["c"]] / len(alp) * 100) < 1e-9


def test_first_and_latest_per_key(spark):
    df = spark.createDataFrame([(1, 3, 5), (1, 1, 7), (1, 2, 7), (2, 9, 1), (3, 4, None)], "k int, row int, d int")
    first = sorted(tuple(r) for r in linkage.first_per_key(df, "k", "row").collect())
    assert first == [(1, 1, 7), (2, 9, 1), (3, 4, None)]
    latest = sorted(r.row for r in linkage.latest_per_key(df, "k", "d").collect())
    assert latest == [1, 2, 9]


def test_membership_flag_with_two_endlines(spark):
    base = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id int")
    e1 = spark.createDataFrame([(1,), (1,)], "cid int")
    e2 = spark.createDataFrame([(3,), (None,)], "cid int")
    got = {r.id: r.status for r in linkage.membership_flag(base, "id", [e1, e2], "cid").collect()}
    assert got == {1: 1, 2: 0, 3: 1, None: 1}


def test_standardize_by_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), ("b", 14.0), (None, 5.0), (None, 7.0)], "g string, v double")
    out = {(r.g, r.v0): r.v for r in scoring.standardize(df.withColumn("v0", F.col("v")), ["v"], by=["g"]).collect()}
    z = 1 / np.sqrt(2)
    assert abs(out[("a", 1.0)] + z) < 1e-12 and abs(out[("b", 14.0)] - z) < 1e-12 and abs(out[(None, 7.0)] - z) < 1e-12


def test_alpha_invariant_to_order_and_double_reversal(spark, al):
    items_ = alumni.LIKERT_NUM
    a1 = psychometrics.cronbach_alpha(spark, al, items_, check_keys=True).first()
    a2 = psychometrics.cronbach_alpha(spark, al, list(reversed(items_)), check_keys=True).first()
    assert abs(a1.raw_alpha - a2.raw_alpha) < 1e-12
    assert a1.reversed == "l5_obstaculos_superados_num"
    flipped = al.withColumn("l5_obstaculos_superados_num", 5 - F.col("l5_obstaculos_superados_num"))
    a3 = psychometrics.cronbach_alpha(spark, flipped, items_, check_keys=False).first()
    assert abs(a1.raw_alpha - a3.raw_alpha) < 1e-9


def test_alpha_matches_numpy(spark, al, alp):
    x = alp[alumni.LIKERT_NUM].astype(float)
    c = x.cov().to_numpy()  # pairwise complete, like the Spark aggregate
    k = c.shape[0]
    raw = k / (k - 1) * (1 - np.trace(c) / c.sum())
    got = psychometrics.cronbach_alpha(spark, al, alumni.LIKERT_NUM, check_keys=False).first()
    assert abs(got.raw_alpha - raw) < 1e-9


def test_kde_integrates_to_about_one(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame({"v": rng.normal(size=2000)}))
    out = plotdata.kde(df, "v", limits=(-4.0, 4.0)).toPandas()
    assert len(out) == 512
    area = np.trapezoid(out["density"], out["x"])
    assert 0.97 < area < 1.01


def test_box_stats_brute_force(spark):
    vals = [1, 2, 3, 4, 5, 6, 7, 8, 100]
    df = spark.createDataFrame([(v,) for v in vals], "v int")
    r = plotdata.box_stats(df, "v", []).first()
    q1, q3 = np.percentile(vals, [25, 75])
    assert (r.q1, r.q3) == (q1, q3) and r.whisker_high == 8 and r.n_outliers == 1


def test_describe_trimmed_and_mad(spark):
    vals = [1, 2, 2, 3, 4, 5, 6, 7, 8, 40]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    r = __import__("sondeo.operators.describe", fromlist=["describe"]).describe(df, "v").first()
    assert abs(r.trimmed - np.mean(sorted(vals)[1:-1])) < 1e-12
    assert abs(r.mad - 1.4826 * np.median(np.abs(np.array(vals) - np.median(vals)))) < 1e-12


def test_itemstats_complete_policy(spark):
    df = spark.createDataFrame([(1, 2), (2, None), (3, 4), (4, 3), (2, 2)], "a int, b int")
    avail = psychometrics.itemstats(spark, df, {"s": ["a", "b"]})["overall"].first()
    comp = psychometrics.itemstats(spark, df, {"s": ["a", "b"]}, missing="complete")["overall"].first()
    assert abs(avail.mean_total - np.mean([3, 2, 7, 7, 4])) < 1e-12
    assert abs(comp.mean_total - np.mean([3, 7, 7, 4])) < 1e-12
    assert comp.n_complete == 4


def test_itemstats_category_count_with_unlisted_values(spark):
    df = spark.createDataFrame([(1, 2), (5, 2), (3, 4), (4, 3)], "a int, b int")
    items = {r.item: r.k for r in psychometrics.itemstats(spark, df, {"s": ["a", "b"]})["items"].collect()}
    assert items == {"a": 4, "b": 3}


def test_pairwise_moments_match_aggregates(spark, al):
    items_ = alumni.LIKERT_NUM
    pairs = [(a, b) for a in items_ for b in items_]
    row = al.agg(*[F.covar_samp(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)], *[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)]).first()
    m = psychometrics.pairwise_moments(al.repartition(7), {"_": items_})["_"]
    assert np.allclose(m.covariance.ravel(), [row[f"c{k}"] for k in range(len(pairs))], rtol=1e-9, atol=1e-12)
    assert np.allclose(m.correlation.ravel(), [row[f"r{k}"] for k in range(len(pairs))], rtol=1e-9, atol=1e-12)


def test_moments_of_empty_and_unanswered_items(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b int")
    m = psychometrics.pairwise_moments(df, {"_": ["a", "b"]})["_"]
    assert m.mean(0) == 1.5 and m.mean(1) is None and m.sd(1) is None and np.isnan(m.covariance[0, 1])
    assert psychometrics.pairwise_moments(df.limit(0), {"_": ["a", "b"]})["_"].n.sum() == 0
    assert psychometrics.item_proportions(spark, df, {"s": ["a", "b"]}).where("item = 'b'").first()["p_na"] == 1.0
