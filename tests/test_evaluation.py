import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandara.plans import backtest, crossval, features, flow, metrics, registry

from .helpers import (Ridge, feature_frame, fit_on_first_part, frame, predict_ahead,
                      random_series, series)


def test_cut_dates(spark):
    df = frame(spark, random_series(150, 1, "a") + random_series(89, 2, "b")
               + random_series(90, 3, "c"))
    cuts = backtest.cut_dates(df).toPandas()
    assert set(cuts.series_id) == {"a"}  # c has 90 rows but only 59 before its only cut
    a = cuts.sort_values("orden")
    last = dt.date(2023, 1, 30) + dt.timedelta(days=149)
    assert list(a.corte) == [last - dt.timedelta(days=d) for d in (60, 30)]
    assert (a.n_train >= 60).all()
    for _, r in a.iterrows():
        assert r.n_train == (r.corte - dt.date(2023, 1, 30)).days


def test_linear_walk_forward_equals_refitting(spark):
    rows = random_series(170, 7, "a", step=2) + random_series(100, 8, "b")
    pairs = backtest.walk_forward(frame(spark, rows), "linear", ventana=20, n_pasos=3,
                                  min_train=60).toPandas()
    assert set(pairs.series_id) == {"a", "b"}
    p_all = {n: [r for r in rows if r[0] == n] for n in ("a", "b")}
    for (name, cut), g in pairs.groupby(["series_id", "corte"]):
        g = g.sort_values("dia")
        before = [r for r in p_all[name] if r[1] < cut]
        assert (g.n_train == len(before)).all()
        p = feature_frame(before)
        model, _, _ = fit_on_first_part(p, features.FEATURES)
        np.testing.assert_allclose(g.prediccion, predict_ahead(model, p, features.FEATURES,
                                                               len(g)), rtol=1e-5, atol=1e-5)
        after = [r for r in p_all[name] if cut <= r[1] < cut + dt.timedelta(days=20)]
        assert list(g.real) == [r[2] for r in after]


def test_linear_walk_forward_needs_full_lags(spark):
    with pytest.raises(ValueError):
        backtest.walk_forward(frame(spark, random_series(90, 1)), "linear", min_train=20)


def test_step_metrics_without_positive_actuals(spark):
    rows = [("a", "m", dt.date(2024, 1, 1), 60, i, dt.date(2024, 1, 1 + i), 0.0, 2.0)
            for i in range(1, 4)]
    df = spark.createDataFrame(rows, "series_id string, modelo string, corte date, n_train int, "
                                     "dia int, fecha date, real double, prediccion double")
    r = backtest.step_metrics(df).first()
    assert math.isinf(r.mape) and r.r2 == 0 and r.mae == 2
    agg = backtest.aggregate_steps(backtest.step_metrics(df)).first()
    assert math.isinf(agg.mape_mean) and agg.mape_std == 0 and agg.es_estable


SMALL = {k: {"trees": 2, "depth": 2} for k in ("random_forest", "gradient_boosting", "xgboost")}


@pytest.mark.parametrize("modelo", ["prophet", "arima", "random_forest"])
def test_walk_forward_equals_forecasts_of_the_rows_before(spark, modelo):
    """Every cut's predictions are those of a plain forecast of the rows before that cut."""
    from demandara.plans import strategies
    rows = random_series(130, 7, "a|x", step=2) + random_series(130, 8, "b", step=2)
    how = SMALL.get(modelo, {})
    pairs = backtest.walk_forward(frame(spark, rows), modelo, ventana=20, n_pasos=2,
                                  min_train=60, **how).toPandas()
    assert set(pairs.series_id) == {"a|x", "b"} and (pairs.modelo == modelo).all()
    assert pairs.groupby("series_id").corte.nunique().eq(2).all()
    for cut, g in pairs.groupby("corte"):
        before = frame(spark, [r for r in rows if r[1] < cut])
        plain, _ = strategies.run(modelo, before, 20, **how)
        both = g.merge(plain.toPandas(), left_on=["series_id", "dia"],
                       right_on=["series_id", "paso"])
        assert len(both) == len(g)
        np.testing.assert_allclose(both.prediccion_x, both.prediccion_y, rtol=1e-6, atol=1e-6)
        assert (g.n_train == [sum(r[0] == s and r[1] < cut for r in rows)
                              for s in g.series_id]).all()


def test_walk_forward_refuses_unknown_models(spark):
    with pytest.raises(ValueError, match="no back-test of other"):
        backtest.walk_forward(frame(spark, random_series(90, 1)), "other")


@pytest.mark.parametrize("modelo", ["xgboost", "random_forest"])
def test_pooled_back_test_never_sees_later_days(spark, modelo):
    """What another, longer series does after a cut must not change the forecast of that cut."""
    short, long = random_series(110, 1, "a"), random_series(170, 2, "b")
    changed = long[:100] + [(n, d, v * 50 + 1000) for n, d, v in long[100:]]
    got = []
    for other in (long, changed):
        out = backtest.walk_forward(frame(spark, short + other), modelo, ventana=10, n_pasos=2, min_train=60,
                                    trees=3, depth=3).toPandas()
        got.append(out[out.series_id == "a"].sort_values(["corte", "dia"]).reset_index(drop=True))
        assert set(out.series_id) == {"a", "b"} and len(out) == 40
    cuts = sorted(got[0].corte.unique())
    assert len(cuts) == 2 and cuts[-1] <= short[-1][1] and cuts[0] <= long[99][1]
    early = got[0].corte <= long[99][1]
    np.testing.assert_allclose(got[0].prediccion[early], got[1].prediccion[early], rtol=1e-9)


def test_model_dates_cover_every_cut(spark):
    days = [dt.date(2023, 1, 30) + dt.timedelta(days=k) for k in range(40)]
    cuts = spark.createDataFrame([(f"s{k}", d) for k, d in enumerate(days + days[30:] * 5)],
                                 "series_id string, corte date")
    assert backtest.model_dates(cuts, 40) == days
    few = backtest.model_dates(cuts, 6)
    assert few[0] == days[0] and few == sorted(set(few)) and len(few) == 6 and few[-1] >= days[30]
    assert backtest.model_dates(cuts.limit(0), 6) == []


def test_ensemble_back_test_without_cuts(spark):
    df = frame(spark, random_series(40, 1))
    assert backtest.walk_forward(df, "random_forest").count() == 0


def test_compare_models_ranks(spark):
    df = frame(spark, random_series(150, 1, "a") + random_series(120, 2, "b"))
    out = backtest.compare_models(df, ventana=20, n_pasos=1, settings=SMALL).toPandas()
    for _, g in out.groupby("series_id"):
        g = g.sort_values("posicion")
        assert set(g.modelo) == set(backtest.MODELS)
        assert list(g.posicion) == list(range(1, 9)) and g.mae_mean.is_monotonic_increasing
        assert g.recomendacion.iloc[0].startswith("Modelo recomendado: " + g.modelo.iloc[0])
        assert g.recomendacion.iloc[1:].isna().all()


def folds(m, k=5):
    size = m // (k + 1)
    return [(m - (k - i) * size, m - (k - i - 1) * size) for i in range(k)]


def test_temporal_cv_equals_direct(spark):
    rows = random_series(113, 4)
    out = crossval.temporal_cv(frame(spark, rows)).first()
    p = feature_frame(rows).dropna()
    x, y = p[features.FEATURES].to_numpy(float), p.cantidad.to_numpy(float)
    mae, r2 = [], []
    for a, b in folds(len(p)):
        f = Ridge(x[:a], y[:a]).predict(x[a:b])
        mae.append(np.abs(y[a:b] - f).mean())
        r2.append(1 - ((y[a:b] - f) ** 2).sum() / ((y[a:b] - y[a:b].mean()) ** 2).sum())
    assert out.mae_mean == pytest.approx(np.mean(mae), rel=1e-5)
    assert out.mae_std == pytest.approx(np.std(mae), rel=1e-5)
    assert out.r2_mean == pytest.approx(np.mean(r2), rel=1e-5)
    assert out.n_splits == 5


def test_search_alpha(spark):
    df = frame(spark, random_series(120, 4, "a") + random_series(140, 5, "b"))
    out = crossval.search_alpha(df, "ridge", mode="reference").toPandas()
    assert len(out) == 14
    for _, g in out.groupby("series_id"):
        assert g[g.mejor].mae_mean.iloc[0] == g.mae_mean.min() and g.mejor.sum() == 1
    p = feature_frame(random_series(120, 4)).dropna()
    x, y = p[features.FEATURES].to_numpy(float), p.cantidad.to_numpy(float)
    mae = np.mean([np.abs(y[a:b] - Ridge(x[:a], y[:a], 10.0, scale=False).predict(x[a:b])).mean()
                   for a, b in folds(len(p))])
    got = out[(out.series_id == "a") & (out.alpha == 10.0)].mae_mean.iloc[0]
    assert got == pytest.approx(mae, rel=1e-4)
    fewer = crossval.search_alpha(df, "lasso", n_iter=2).toPandas()
    assert fewer.alpha.nunique() == 2


def test_random_search_and_choice(spark):
    rows = [r for i in range(3) for r in random_series(80 + i, i, f"S{i}")]
    df = frame(spark, rows)
    out = crossval.random_search(df, "random_forest", n_iter=2, folds=2,
                                 grid={"trees": [2], "depth": [2, 3]}).toPandas()
    assert len(out) == 2 and out.mejor.sum() == 1
    assert out.params.iloc[0]["trees"] == "100"
    from dataclasses import replace
    from demandara.plans import trees
    small = {k: replace(trees.CONFIGS[k], trees=2, depth=2)
             for k in ("random_forest", "gradient_boosting")}
    got = crossval.auto_select(df, folds=2, configs=small).toPandas()
    assert len(got) == 9 and (got.posicion == 1).sum() == 3
    # Noise can't be predicted: a candidate near one would see the day it predicts.
    assert got.r2_mean.max() < 0.6
    with pytest.raises(ValueError):
        crossval.auto_select(df, criterio="otro")


def test_sample_settings_are_distinct():
    got = crossval.sample_settings({"a": [1, 2, 3], "b": [1, 2]}, 4)
    assert len(got) == 4 and len({tuple(s.items()) for s in got}) == 4
    assert len(crossval.sample_settings({"a": [1, 2]}, 50)) == 2


def test_mape_variants(spark):
    df = spark.createDataFrame([("a", 0.0, 3.0), ("a", 4.0, 2.0)],
                               "series_id string, real double, prediccion double")
    got = {v: metrics.error_metrics(df, ["series_id"], v).first().mape
           for v in ("mas_uno", "sin_ceros", "cero_es_uno")}
    assert got == {"mas_uno": pytest.approx((3 + 0.4) / 2 * 100), "sin_ceros": 50.0,
                   "cero_es_uno": pytest.approx((3 + 0.5) / 2 * 100)}


def raw(name, n, seed):
    return [(name, f, v) for _, f, v in random_series(n, seed, low=1)]


def test_run_forecast_marks_bad_series(spark):
    rows = raw("buena", 90, 1) + raw("corta", 4, 2) + [(None, dt.date(2024, 1, 1), 4.0)]
    df = spark.createDataFrame(rows, "codigo string, fecha date, cantidad double")
    run = flow.run_forecast(df, flow.ForecastConfig(backtest=True, horizonte=10,
                                                    remover_outliers=True))
    status = {r.series_id: r.estado for r in run.estado.collect()}
    assert status == {"buena": "OK", "corta": "Datos no válidos"}
    assert {r.series_id for r in run.predicciones.collect()} == {"buena"}
    assert run.predicciones.count() == 10 and run.backtest.count() == 1
    run = flow.run_forecast(df, flow.ForecastConfig(validar=False))
    assert {r.series_id: r.estado for r in run.estado.collect()} == {
        "buena": "OK", "corta": "Datos insuficientes"}


def test_run_forecast_with_choice(spark):
    df = spark.createDataFrame(raw("a", 90, 1) + raw("b", 80, 2),
                               "codigo string, fecha date, cantidad double")
    run = flow.run_forecast(df, flow.ForecastConfig(auto_seleccionar=True,
                                                    candidatos=["linear"], horizonte=5))
    assert run.predicciones.count() == 10 and run.seleccion.count() == 2


def test_model_store(spark, tmp_path):
    store = registry.ModelStore(spark, str(tmp_path / "modelos"))
    assert store.metadata().count() == 0
    rows = random_series(90, 1, "a") + random_series(60, 2, "b")
    daily = frame(spark, rows)
    run_id = flow.save_run(store, daily, "r1")
    with pytest.raises(ValueError):
        flow.save_run(store, daily, "r1")
    flow.save_run(store, daily, "r1", overwrite=True)
    with pytest.raises(ValueError):
        store.load("otro")
    meta = store.metadata().orderBy("model_id").collect()
    assert [m.model_id for m in meta] == ["a-linear", "b-linear"] and meta[0].n_muestras == 90
    assert store.size_bytes() > 0
    again = flow.predict_from_saved(store, run_id, daily, 5).toPandas()
    from demandara.plans import ridge
    split, coefs = ridge.train(daily)
    fresh = ridge.predict(ridge.start_points(split), coefs, 5).toPandas()
    key = ["series_id", "paso"]
    np.testing.assert_allclose(again.sort_values(key).prediccion,
                               fresh.sort_values(key).prediccion, rtol=1e-9)


STORED = {"linear": {}, "short": {}, "prophet": {}, "arima": {}, **SMALL}


@pytest.mark.parametrize("modelo", list(STORED))
def test_every_model_is_stored_whole(spark, tmp_path, modelo):
    from demandara.plans import strategies, stored
    assert set(stored.MODELS) == set(strategies.available()) == set(STORED)
    store = registry.ModelStore(spark, str(tmp_path / "m"))
    daily = frame(spark, random_series(80, 1, "a") + random_series(60, 2, "b") + random_series(4, 3, "c"))
    flow.save_run(store, daily, "r1", modelo=modelo, **STORED[modelo])
    other = registry.ModelStore(spark, str(tmp_path / "m"))
    got = flow.predict_from_saved(other, "r1", daily, 6).toPandas()
    fresh = strategies.run(modelo, daily, 6, **STORED[modelo])[0].toPandas()
    if modelo == "linear":  # stores what it fitted, without the fallback
        fresh = fresh[fresh.series_id != "c"]
    key = ["series_id", "paso"]
    got, fresh = (x.sort_values(key).reset_index(drop=True) for x in (got, fresh))
    assert got[key].equals(fresh[key]) and (got.fecha == fresh.fecha).all()
    for c in ("prediccion", "limite_inferior", "limite_superior"):
        np.testing.assert_allclose(got[c], fresh[c], rtol=1e-9, atol=1e-9)
    assert {m.modelo_tipo for m in other.metadata().collect()} == {modelo}
    kept = other.purge(30)
    again = flow.predict_from_saved(kept, "r1", daily, 6).toPandas().sort_values(key)
    np.testing.assert_allclose(again.prediccion, got.prediccion, rtol=1e-9, atol=1e-9)


def test_a_run_that_was_cut_off_is_not_listed(spark, tmp_path, monkeypatch):
    store = registry.ModelStore(spark, str(tmp_path / "m"))
    daily = frame(spark, random_series(60, 1, "a"))
    flow.save_run(store, daily, "whole", modelo="short")

    def cut(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(registry.ModelStore, "_finish", cut)
        for run, again in (("half", False), ("whole", True)):
            with pytest.raises(RuntimeError):
                flow.save_run(store, daily, run, again, modelo="linear")
    assert [r.run_id for r in store.metadata().select("run_id").distinct().collect()] == ["whole"]
    assert {r.modelo_tipo for r in store.metadata().collect()} == {"short"}
    with pytest.raises(ValueError):
        store.load("half")
    flow.save_run(store, daily, "half", modelo="short")
    assert len(store.manifests()) == 2 and store.load("half").count() == 1
    with pytest.raises(ValueError, match="no store"):
        flow.save_run(store, daily, modelo="otro")
    with pytest.raises(ValueError, match="no Spark ML"):
        store.load_ml("half")


def test_purge_keeps_the_best(spark, tmp_path):
    store = registry.ModelStore(spark, str(tmp_path / "m"))
    daily = frame(spark, series(range(30), "x"))
    met = spark.createDataFrame([("x", 3.0, 3.0, 0.5, 9.0)],
                                "series_id string, mae double, rmse double, r2 double, mape double")
    old = F.lit("2020-01-01").cast("timestamp")
    for i, (name, mae) in enumerate((("m1", 3.0), ("m2", 1.0), ("m3", 2.0))):
        meta = registry.metadata_rows(met.withColumn("mae", F.lit(mae)), daily, name,
                                      trained_at=old if i < 2 else None)
        store.save(meta, met, f"r{i}")
    assert registry.best_models(store.metadata()).first().model_id == "x-m2"
    assert [r.model_id for r in registry.old_models(store.metadata(), 30).collect()] == ["x-m1"]
    fresh = store.purge(30)
    assert {r.model_id for r in fresh.metadata().collect()} == {"x-m2", "x-m3"}
    assert registry.list_models(store.metadata(), "desconocido").count() == 0
    assert registry.compare_saved(store.metadata().limit(1)).count() == 0


def test_backtest_of_an_unknown_model_is_refused(spark):
    from demandara.plans import flow
    rows = frame(spark, random_series(80, 1, "a")).withColumnRenamed("series_id", "codigo")
    with pytest.raises(ValueError):
        flow.run_forecast(rows, flow.ForecastConfig(modelo="otro", backtest=True))


def test_a_run_back_tests_its_own_model_and_settings(spark):
    from demandara.plans import flow
    daily = frame(spark, random_series(80, 1, "a"))
    run = flow.run_forecast(daily.withColumnRenamed("series_id", "codigo"), flow.ForecastConfig(
        modelo="prophet", validar=False, backtest=True, horizonte=10, n_pasos=1,
        modelo_kwargs={"yearly": 2}))
    own = backtest.aggregate_steps(backtest.step_metrics(backtest.walk_forward(
        daily, "prophet", 10, 1, yearly=2))).first()
    got = run.backtest.collect()
    assert [r.modelo for r in got] == ["prophet"]
    assert got[0].mae_mean == pytest.approx(own.mae_mean, rel=1e-9)


def test_a_series_without_finite_numbers_stops_nothing(spark):
    from demandara.operators.demand import daily_demand
    from demandara.plans import linear
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("a", "2024-01-01", float("nan")), ("a", "2024-01-01", 2.0),
                                ("b", "2024-01-01", float("inf"))], "codigo string, fecha string, "
                               "cantidad double")
    got = {r.series_id: r.cantidad for r in daily_demand(df).collect()}
    assert got == {"a": 2.0, "b": 0.0}
    rows = spark.createDataFrame([("good", float(k), 3.0 * k + 1) for k in range(8)]
                                 + [("bad", float("nan"), 1.0), ("flat", 1.0, 2.0)],
                                 "series_id string, x double, y double")
    for how in ({"method": "ols"}, {"method": "ridge", "alpha": 0.0}, {"method": "lasso",
                                                                       "alpha": 1e-9}):
        fits = linear.fit(rows, ["series_id"], F.array(F.lit(1.0), F.col("x"), F.col("y")), 3, **how)
        coef = {r.series_id: r.coef[0] for r in fits.collect()}
        assert coef["good"] == pytest.approx(3.0, rel=1e-4)


def test_whole_codes_are_judged(spark):
    from demandara.functions import text
    from pyspark.sql import functions as F
    from demandara.sources.scans import material_cap
    codes = ["A" * 50, "A" * 51, "A" * 50 + " b", "x" * 10, "x" * 11, ""]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    got = [tuple(r) for r in df.select(text.valid_material_code(F.col("c")),
                                       text.valid_place(F.col("c"))).collect()]
    assert got == [(True, False), (False, False), (False, False), (True, True), (True, False),
                   (False, False)]
    many = spark.range(700).select(F.col("id").cast("string").alias("codigo"))
    assert material_cap(many, 600).count() == 600


def test_short_series_get_a_simple_split(spark):
    """Eight usable rows are too few for five folds: one split, its test rows never trained on."""
    rng = np.random.default_rng(8)
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=d), float(rng.integers(5, 50)))
            for s, n in (("corta", 38), ("larga", 90), ("minima", 32)) for d in range(n)]
    daily = spark.createDataFrame(rows, "series_id string, fecha date, cantidad double")
    out = {r.series_id: r for r in crossval.temporal_cv(daily).collect()}
    assert {k: r.n_splits for k, r in out.items()} == {"corta": 1, "larga": 5}
    assert np.isfinite(out["corta"].mae_mean)
    folds = crossval.folds_of(crossval.feature_rows(daily, lags="full")).toPandas()
    short = folds[folds.series_id == "corta"]
    assert (short._seg[short.fold.notna()] == 5).all() and (short._seg[short.fold.isna()] == 0).all()
    assert len(short) == 8 and short.fold.notna().sum() == 2
