import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from demandara.operators import isolation, quality
from demandara.operators.prefix import running_total
from demandara.operators.quantiles import grouped_quantiles, median_deviation, value_counts

from .helpers import frame, series

VALUES = st.lists(st.one_of(st.integers(-50, 50).map(float),
                            st.floats(-1e6, 1e6, allow_nan=False).map(lambda x: round(x, 3))),
                  min_size=1, max_size=40)


@settings(max_examples=12, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(VALUES, min_size=1, max_size=4))
def test_quantiles_equal_numpy(spark, groups):
    rows = [(f"g{i}", v) for i, g in enumerate(groups) for v in g]
    df = spark.createDataFrame(rows, "k string, v double")
    out = {r.k: r for r in grouped_quantiles(
        df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.75, "d": 0.9}).collect()}
    for i, g in enumerate(groups):
        r = out[f"g{i}"]
        assert r.n_valores == len(g)
        np.testing.assert_allclose([r.a, r.b, r.c, r.d], np.quantile(g, [.25, .5, .75, .9]),
                                   rtol=1e-9, atol=1e-9)


def test_bands_take_one_window_pass_and_compare_before_the_array(spark, monkeypatch):
    from demandara.operators import quantiles
    plans, write = [], quantiles.materialise

    def watched(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)

    counts = value_counts(spark.range(100).selectExpr("id % 3 k", "id * 0.5 v"), ["k"], "v")
    monkeypatch.setattr(quantiles, "materialise", watched)
    rows = quantiles.quantiles_of_counts(counts, ["k"], {"q1": 0.25, "q3": 0.75}).collect()
    assert {r.k: (r.q1, r.q3) for r in rows} == {
        k: tuple(np.quantile(np.arange(k, 100, 3) * 0.5, [0.25, 0.75])) for k in range(3)}
    assert len([x for x in plans[0].splitlines() if "Window " in x]) == 1
    asked = next(x for x in plans[0].splitlines() if "Filter " in x and "lambda" in x)
    assert asked.index(" OR ") < asked.index("lambda")


def test_quantiles_of_one_crowded_band(spark):
    """A million distinct values of one band are ordered some thousand at a time."""
    from demandara.operators import quantiles
    n = 1_000_000
    df = spark.range(n).selectExpr("'a' AS k", "1000 + pmod(id * 7919, 1000000) * 1e-6 AS v")
    probs = {"a": 0.25, "b": 0.5, "c": 0.999}
    counts = value_counts(df, ["k"], "v")
    assert counts.select(quantiles.value_band(F.col("_v")).alias("b")).distinct().count() == 1
    r = grouped_quantiles(df, ["k"], "v", probs).first()
    assert r.n_valores == n
    np.testing.assert_allclose([r.a, r.b, r.c], [1000 + p * (n - 1) * 1e-6
                                                 for p in probs.values()], rtol=1e-12)
    wanted = F.array(F.struct(F.lit("b").alias("_q"), F.lit(n // 2).cast("long").alias("_r"),
                              F.lit(0.0).alias("_frac")))
    held = quantiles.cells(counts, ["k"], wanted)
    assert held.groupBy("_b", "_c").count().agg(F.max("count")).first()[0] <= 2000


@pytest.mark.parametrize("few", [0, 3])
def test_cut_bands_equal_numpy(spark, monkeypatch, few):
    from demandara.operators import quantiles
    monkeypatch.setattr(quantiles, "FEW_VALUES", few)
    rng = np.random.default_rng(few)
    groups = {"a": rng.normal(-50, 0.02, 400), "b": rng.integers(-3, 4, 300).astype(float),
              "c": np.concatenate([[7.0] * 90, 7 + rng.random(60) * 1e-9, [7.019]])}
    df = spark.createDataFrame([(k, float(x)) for k, g in groups.items() for x in g],
                               "k string, v double")
    probs = {f"p{i}": i / 8 for i in range(9)}
    out = {r.k: r for r in grouped_quantiles(df, ["k"], "v", probs).collect()}
    for k, g in groups.items():
        np.testing.assert_allclose([out[k][p] for p in probs], np.quantile(g, list(
            probs.values())), rtol=1e-12)


def test_quantiles_with_infinite_values(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, "inf", "-inf")], "v double")
    r = grouped_quantiles(df, [], "v", {"m": 0.5}).first()
    assert r.m == 2.0 and r.n_valores == 5


def test_quantiles_of_whole_table(spark):
    df = spark.createDataFrame([(float(x),) for x in range(101)], "v double")
    assert grouped_quantiles(df, [], "v", {"m": 0.5}).first().m == 50.0


def test_median_deviation(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(10, 4, 301).round(2)
    df = spark.createDataFrame([("a", float(v)) for v in x], "k string, v double")
    r = median_deviation(value_counts(df, ["k"], "v"), ["k"]).first()
    assert r.mediana == pytest.approx(np.median(x))
    assert r.mad == pytest.approx(np.median(np.abs(x - np.median(x))))


def test_running_total_with_many_ties(spark):
    rows = [(f"{i:04d}", float(v)) for i, v in enumerate([0] * 300 + [5] * 300 + [9, 1, 7])]
    df = spark.createDataFrame(rows, "codigo string, valor double")
    from pyspark.sql import functions as F
    out = running_total(df, "valor", [F.desc("valor"), F.asc("codigo")], "acum", "todo",
                        partitions=7).toPandas()
    out = out.sort_values(["valor", "codigo"], ascending=[False, True])
    np.testing.assert_allclose(out.acum, out.valor.cumsum())
    assert (out.todo == out.valor.sum()).all()


def test_constant_series_has_no_outliers(spark):
    rows = [("a", dt.date(2024, 1, 1), 5.0)] * 12 + [("b", dt.date(2024, 1, 1), 5.0)]
    df = spark.createDataFrame(rows, "codigo string, fecha date, cantidad double")
    for flag in (quality.flag_iqr, quality.flag_zscore, quality.flag_mad):
        assert flag(df, ["codigo"], "cantidad").where("es_outlier").count() == 0


def _score(rows):
    """Quality score of one frame, written out."""
    p = pd.DataFrame(rows, columns=["codigo", "fecha", "cantidad"])
    n = len(p)
    score = 100 - (30 if n < 10 else 0)
    complete = 100 * p.notna().mean().mean()
    score -= max(0, 80 - complete) * 0.5
    f = pd.to_datetime(p.fecha)
    ok = f.dropna().sort_values()
    span = (ok.max() - ok.min()).days if len(ok) else 0
    score -= 15 if f.isna().any() or span < 7 else 0
    score -= 2 * (ok.diff().dt.days > 7).sum() + 5 * (ok.duplicated().any())
    q1, q3 = p.cantidad.quantile(0.25), p.cantidad.quantile(0.75)
    share = 100 * ((p.cantidad < q1 - 1.5 * (q3 - q1)) | (p.cantidad > q3 + 1.5 * (q3 - q1))).mean()
    score -= share * 0.5 if share > 10 else 0
    return max(0, min(100, score))


def test_quality_score(spark):
    d = dt.date(2024, 1, 1)

    def day(i):
        return d + dt.timedelta(days=i)

    cases = {
        "limpia": [(day(i), float(i % 5 + 1)) for i in range(40)],
        "corta": [(day(i), 1.0) for i in range(4)],
        "huecos": [(day(i * 8), float(i)) for i in range(12)],
        "repetida": [(day(i // 2), float(i)) for i in range(30)],
        "nulos": [(day(i) if i % 3 else None, float(i) if i % 2 else None) for i in range(30)],
        "picos": [(day(i), 500.0 if i % 6 == 0 else 1.0 + i % 2) for i in range(60)],
        "ceros": [(day(i), 0.0 if i % 3 else 4.0) for i in range(30)],
    }
    rows = [(k, f, v) for k, rs in cases.items() for f, v in rs]
    df = spark.createDataFrame(rows, "codigo string, fecha date, cantidad double")
    out = {r.codigo: r for r in quality.quality_text(quality.quality_score(df)).collect()}
    for k, rs in cases.items():
        assert out[k].score == pytest.approx(_score([(k, f, v) for f, v in rs])), k
    assert not out["corta"].is_valid and out["limpia"].is_valid
    kinds = {k: {i.tipo for i in out[k].issues} for k in cases}
    assert kinds["corta"] == {"pocos_registros"}
    assert "gaps" in kinds["huecos"] and "duplicados" in kinds["repetida"]
    assert {"nulos", "completitud"} <= kinds["nulos"] and "ceros" in kinds["ceros"]
    assert out["limpia"].resumen.startswith("Excelente calidad de datos.")


def test_missing_column_is_critical(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1))] * 12, "codigo string, fecha date")
    r = quality.quality_score(df).first()
    assert not r.is_valid and r.criticos == 1


def depths_of(spark, values, keys=("k",)):
    df = spark.createDataFrame([("a", float(v)) for v in values], "k string, v double")
    return {r._v: r.profundidad for r in
            isolation.value_depths(df, list(keys), "v").collect()}


def test_mean_depth_equals_simulated_trees(spark):
    values = np.array([0.0, 1.0, 1.5, 2.0, 9.0])
    rng = np.random.default_rng(0)
    total = np.zeros(len(values))

    def grow(idx, depth):
        if len(idx) == 1:
            total[idx[0]] += depth
            return
        cut = rng.uniform(values[idx[0]], values[idx[-1]])
        left = [i for i in idx if values[i] <= cut]
        right = [i for i in idx if values[i] > cut]
        if not left or not right:
            return grow(idx, depth)
        grow(left, depth + 1)
        grow(right, depth + 1)

    trees = 20000
    for _ in range(trees):
        grow(list(range(len(values))), 0)
    found = depths_of(spark, values)
    np.testing.assert_allclose([found[v] for v in values], total / trees, rtol=0.03)


@pytest.mark.parametrize("keys", [["k"], []])
def test_depth_counts_every_value(spark, keys):
    """Against the sum over all gaps, with dense bands, a negative side and far values."""
    rng = np.random.default_rng(4)
    values = np.unique(np.concatenate([
        np.arange(3000.0), rng.integers(-900, 0, 300), [1e6, 1e9]]))
    found = depths_of(spark, values, keys)
    gap = np.diff(values)
    wanted = [(gap[:i] / (v - values[:i])).sum() + (gap[i:] / (values[i + 1:] - v)).sum()
              for i, v in enumerate(values)]
    got = np.array([found[v] for v in values])
    np.testing.assert_allclose(got, wanted, rtol=0.05)
    np.testing.assert_allclose(got[-2:], wanted[-2:], rtol=1e-3)
    assert found[1e9] < found[1e6] < got[:-2].min()


def test_isolation_flags_the_far_values(spark):
    rng = np.random.default_rng(2)
    x = [float(v) for v in rng.integers(40, 60, 480)] + [500.0, 700.0, -300.0] * 4
    df = spark.createDataFrame([("a", v) for v in x], "k string, v double")
    out = isolation.flag_isolation(df, ["k"], "v").toPandas()
    assert out[out.v.isin([500.0, 700.0, -300.0])].es_outlier.all()
    assert out.es_outlier.mean() <= 0.1


def test_impute_ffill_per_series(spark):
    from demandara.operators.cleaning import impute
    df = frame(spark, series([None, 1, None, 3, None], "a") + series([None, None], "b"))
    got = impute(df, "cantidad", "ffill", ["series_id"]).orderBy("series_id", "fecha")
    assert [r.cantidad for r in got.collect()] == [None, 1, 1, 3, 3, None, None]
    got = impute(df, "cantidad", "bfill", ["series_id"]).orderBy("series_id", "fecha")
    assert [r.cantidad for r in got.collect()] == [1, 1, 3, 3, None, None, None]
    got = impute(df, "cantidad", "median", ["series_id"]).orderBy("series_id", "fecha")
    assert [r.cantidad for r in got.collect()] == [2, 1, 2, 3, 2, None, None]


@pytest.mark.parametrize("metodo", ["iqr", "zscore", "mad"])
def test_limits_from_counts_equal_limits_from_rows(spark, metodo):
    rng = np.random.default_rng(5)
    rows = [(k, float(v)) for k in "abc" for v in rng.integers(0, 30, 80)]
    df = spark.createDataFrame(rows, "k string, v double")
    direct = {"iqr": quality.iqr_limits, "zscore": quality.zscore_limits,
              "mad": quality.mad_limits}[metodo](df, ["k"], "v")
    counted = quality.limits_of_counts(value_counts(df, ["k"], "v"), ["k"], metodo)
    cols = ["k", "limite_inferior", "limite_superior"]
    a, b = (x.select(*cols).toPandas().sort_values("k")[cols[1:]] for x in (direct, counted))
    np.testing.assert_allclose(a, b, rtol=1e-9)


def test_completeness_limits_are_settings(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None), (3, 2.0), (4, 1.0)], "a int, b double")
    cfg = quality.QualityConfig(completitud_error=60.0, completitud_aviso=70.0)
    for how, want in ((quality.DEFAULTS, {"a": "warning", "b": "warning"}), (cfg, {"a": "error", "b": None})):
        assert {r.columna: r.severidad for r in quality.completeness(df, how).collect()} == want
    rows = spark.createDataFrame([("x", dt.date(2024, 1, 1 + k), 1.0 if k % 2 else None) for k in range(20)],
                                 "codigo string, fecha date, cantidad double")
    scores = {}
    for aviso in (80.0, 95.0):
        r = quality.quality_score(rows, cfg=quality.QualityConfig(completitud_aviso=aviso)).first()
        scores[aviso] = r.score
    assert scores[80.0] - scores[95.0] == pytest.approx((95 - 250 / 3) / 2)
