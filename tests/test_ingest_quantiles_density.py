"""Ingestion with two header rows, exact quantiles, density, grouping sets over cells and latest rows on awkward inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondeo.functions import dates, text
from sondeo.operators import grouped, linkage, plotdata, quantiles
from sondeo.sources import exports, sinks


def test_export_round_trip_with_blanks_and_other_second_lines(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 3 else 'a "b", c', "ñ") for i in range(40)], "id long, t string, u string")
    top, bottom = ["Respondent ID", "Q", ""], ["", "Response", "Response"]
    one, two = str(tmp_path / "Línea Base 25-26"), str(tmp_path / "otra carpeta")
    sinks.write_two_row_export(df.where("id < 25").repartition(3), one, top, bottom)
    sinks.write_two_row_export(df.where("id >= 25").repartition(2), two, top, ["", "Open-Ended Response", "x"])
    got = exports.read_two_row_header(spark, [one, two], escape='"', quote='"')
    assert got.columns == ["respondent_id", "q", "x3", "_file", "_block", "_place", "_row"]
    rows = got.collect()
    assert sorted(int(r[0]) for r in rows) == list(range(40))
    assert len({(r["_file"], r["_block"], r["_place"]) for r in rows}) == len({r["_row"] for r in rows}) == 40
    assert {"Línea Base 25-26", "otra carpeta"} == {r["_file"].split("/")[-2] for r in rows}


def test_header_line_of_a_file_read_in_several_splits(spark, tmp_path):
    path = tmp_path / "big file.csv"
    path.write_text("Q1,Q2\nResponse,Edad\n" + "".join(f"{i},{i * 2}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = exports.read_two_row_header(spark, str(path))
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len({r["_block"] for r in rows}) > 3
    ordered = sorted(rows, key=lambda r: (r["_block"], r["_place"]))
    assert [int(r[0]) for r in ordered] == list(range(5000))


@pytest.mark.parametrize("case", ["normal", "heavy tail", "ties", "small", "one", "negative"])
def test_exact_quantiles(spark, case):
    rng = np.random.default_rng(4)
    v = {
        "normal": rng.normal(size=30_000),
        "heavy tail": np.exp(rng.normal(size=20_000) * 20),
        "ties": rng.integers(0, 5, 20_000).astype(float),
        "small": rng.normal(size=7),
        "one": np.array([3.5]),
        "negative": -np.abs(rng.normal(size=5_000)) ** 3,
    }[case]
    probs = [0.0, 0.001, 0.25, 0.5, 0.77, 0.999, 1.0]
    df = spark.createDataFrame([(float(x), "ab"[i % 2] if i % 5 else None) for i, x in enumerate(v)], "v double, g string").unionByName(spark.createDataFrame([(None, "a"), (None, "c")], "v double, g string"))
    got = {r["prob"]: r["quantile"] for r in quantiles.exact_quantiles(df, "v", probs).collect()}
    assert got == pytest.approx(dict(zip(probs, np.quantile(v, probs), strict=True)), rel=1e-12)
    groups = {r: [] for r in ("a", "b", None)}
    for i, x in enumerate(v):
        groups["ab"[i % 2] if i % 5 else None].append(x)
    found = quantiles.exact_quantiles(df, "v", probs, ["g"]).collect()
    want = {(g, p): q for g, x in groups.items() if x for p, q in zip(probs, np.quantile(x, probs), strict=True)}
    assert {(r["g"], r["prob"]): r["quantile"] for r in found} == pytest.approx(want, rel=1e-12)


def test_no_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, "a")], "v double, g string")
    assert quantiles.exact_quantiles(df, "v", [0.5], ["g"]).count() == 0
    assert quantiles.exact_quantiles(df, "v", [0.5]).count() == 0


def test_density_uses_one_grid_for_all_groups(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=4000), rng.normal(5, 2, 3000)
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "g string, v double")
    out = plotdata.kde(df, "v", ["g"], bin_width=1e-6).toPandas()
    xs = {g: p.sort_values("point").x.to_numpy() for g, p in out.groupby("g")}
    assert np.allclose(xs["a"], xs["b"]) and np.isclose(xs["a"][0], min(a.min(), b.min())) and np.isclose(xs["a"][-1], max(a.max(), b.max()))
    for g, v in (("a", a), ("b", b)):
        q = np.quantile(v, [0.25, 0.75])
        bw = 0.9 * min(v.std(ddof=1), (q[1] - q[0]) / 1.34) * len(v) ** -0.2
        exact = np.exp(-0.5 * ((xs[g][:, None] - v) / bw) ** 2).sum(1) / (len(v) * bw * np.sqrt(2 * np.pi))
        assert np.abs(out[out.g == g].sort_values("point").density.to_numpy() - exact).max() < 0.01 * exact.max()


def test_grouping_sets_over_cells_equal_those_over_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(rng.choice(["x", "y", None]), rng.choice(["p", "q"]), None if rng.random() < 0.2 else float(rng.integers(0, 40)), int(rng.random() < 0.3)) for _ in range(3000)]
    df = spark.createDataFrame([(None if a is None else str(a), str(b), c, d) for a, b, c, d in rows], "a string, b string, v double, f int")
    sets = {"all": [], "a": ["a"], "both": ["a", "b"]}
    m = {"n": grouped.Measure("rows"), "s": grouped.Measure("sum", "f"), "m": grouped.Measure("mean", "v"), "sd": grouped.Measure("sd", "v"), "pct": grouped.Measure("mean", "f", 100.0)}
    got = grouped.grouping_sets_moments(df, sets, m)
    want = grouped.grouping_sets_named(df, sets, {"n": F.count(F.lit(1)), "s": F.sum("f").cast("double"), "m": F.avg("v"), "sd": F.stddev_samp("v"), "pct": F.avg("f") * 100})
    key = lambda r: tuple(map(str, r[:3]))
    for g, w in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
        assert g[:3] == w[:3] and np.allclose(g[3:], w[3:])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and "Aggregate" in plan[plan.index("Expand"):]  # copies are made of cells: the rows are aggregated below


def test_latest_rows_in_one_exchange(spark):
    rows = [(1, 5), (1, 7), (1, 7), (2, None), (2, 3), (3, None), (None, 2), (None, 4)]
    df = spark.createDataFrame(rows, "k int, t int")
    assert sorted(map(tuple, linkage.latest_per_key(df, "k", "t").collect()), key=str) == [(1, 7), (1, 7), (None, 4)]
    some = linkage.latest_per_key(df, "k", "t", require_complete=False)
    assert sorted(map(tuple, some.collect()), key=str) == [(1, 7), (1, 7), (2, 3), (None, 4)]
    plan = some._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("WindowGroupLimit") == 2 and "Join" not in plan


def test_age_by_schema_and_matching_rows(spark):
    text_birth = spark.createDataFrame([("6/6/2010",), ("31/31/2010",), (None,)], "fecha_nac string")
    assert [r["edad"] for r in dates.with_age(text_birth).collect()] == [13.0, None, None]
    assert [r["edad"] for r in dates.with_age(spark.createDataFrame([(12,)], "fecha_nac int")).collect()] == [12]
    assert dates.with_age(spark.createDataFrame([(11, "x")], "edad int, fecha_nac string")).columns == ["edad", "fecha_nac"]
    rows = spark.createDataFrame([("agencia_1",), ("equipo",), (None,)], "item string")
    assert [r[0] for r in text.keep_matching(rows, "item", "agencia").collect()] == ["agencia_1"]
