import datetime as dt
import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandara.plans import (features, forecast, linear, moving_average, recursive, ridge, seasonal_ar,
                             short_series, strategies, trees, trend_season)
from demandara.plans.linear import product_sums

from .helpers import (Ridge, by_day, calendar, feature_frame, fit_on_first_part, frame, predict_ahead,
                      random_series, series)

LONG = [random_series(n, n, f"S{n}") for n in (36, 48, 90, 200)]


@pytest.fixture(scope="module")
def long_series(spark):
    return frame(spark, [r for rows in LONG for r in rows])


def test_ridge_equals_normal_equations(long_series):
    split, coefs = ridge.train(long_series)
    got = ridge.predict(ridge.start_points(split), coefs, 30).toPandas()
    scores = {r.series_id: r for r in ridge.evaluate(split, coefs).collect()}
    for rows in LONG:
        name = rows[0][0]
        p = feature_frame(rows)
        model, train, test = fit_on_first_part(p, features.FEATURES)
        expected = predict_ahead(model, p, features.FEATURES, 30)
        mine = got[got.series_id == name].sort_values("paso")
        np.testing.assert_allclose(mine.prediccion, expected, rtol=1e-6, atol=1e-6)
        y, f = test.cantidad.to_numpy(), model.predict(test[features.FEATURES].to_numpy(float))
        assert scores[name].mae == pytest.approx(np.abs(y - f).mean(), rel=1e-6)
        assert scores[name].mape == pytest.approx((np.abs((y - f) / (y + 1))).mean() * 100,
                                                  rel=1e-6)
        if len(y) > 1:
            assert scores[name].r2 == pytest.approx(
                1 - ((y - f) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rel=1e-6)


def test_ridge_keeps_precision_on_a_high_level(spark):
    rows = [(n, f, v + 1e7) for n, f, v in random_series(120, 5, "alta")]
    split, coefs = ridge.train(frame(spark, rows))
    p = feature_frame(rows)
    model, _, _ = fit_on_first_part(p, features.FEATURES)
    got = ridge.predict(ridge.start_points(split), coefs, 5).orderBy("paso").toPandas()
    np.testing.assert_allclose(got.prediccion, predict_ahead(model, p, features.FEATURES, 5),
                               rtol=1e-9)


def test_short_branches_of_the_feature_matrix(spark):
    sizes = (1, 4, 6, 9, 11, 12, 20, 29, 30, 34)
    rows = [r for n in sizes for r in random_series(n, n, f"S{n}")]
    out = by_day(features.temporal_split(features.feature_rows(frame(spark, rows))))
    for n in sizes:
        g = out[out.series_id == f"S{n}"]
        longest = 7 if n >= 7 else 1
        assert g.usable.sum() == max(0, n - longest)
        m = n - longest
        if m >= 4:
            assert g.is_test.sum() == math.ceil(0.2 * m)
            assert g.is_train.sum() == m - math.ceil(0.2 * m)
        assert g.cantidad_lag_14.isna().all()
        assert g.cantidad_ma_30.isna().all() == (n < 30)


def test_causal_features_do_not_see_the_day(spark):
    rows = random_series(80, 1)
    changed = rows[:-1] + [(rows[-1][0], rows[-1][1], 1e6)]
    cols = ["series_id", "fecha", *features.FEATURES]
    a = by_day(features.feature_rows(frame(spark, rows), "causal").select(*cols))
    b = by_day(features.feature_rows(frame(spark, changed), "causal").select(*cols))
    pd.testing.assert_frame_equal(a, b)
    p = by_day(features.feature_rows(frame(spark, rows), "causal"))
    np.testing.assert_allclose(p.sig_cantidad_ma_7.iloc[-2], p.cantidad_ma_7.iloc[-1])
    np.testing.assert_allclose(p.sig_cantidad_lag_14.iloc[-2], p.cantidad_lag_14.iloc[-1])


def test_ols_and_lasso_solutions(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ [2.0, -1.0, 0.0] + 5 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([("a", *map(float, r), float(v)) for r, v in zip(x, y)],
                               "k string, x1 double, x2 double, x3 double, y double")
    z = F.array(F.lit(1.0), "x1", "x2", "x3", "y")
    r = linear.fit(df, ["k"], z, 5, method="ols", scale=False).first()
    expected = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    np.testing.assert_allclose([r.intercepto, *r.coef], expected, rtol=1e-8)
    resid = y - np.column_stack([np.ones(200), x]) @ expected
    assert r.sse == pytest.approx((resid ** 2).sum(), rel=1e-6)
    r = linear.fit(df, ["k"], z, 5, method="lasso", alpha=0.5, scale=False).first()
    # Optimality of the absolute penalty: gradient is alpha * sign, or inside it at zero.
    w = np.array(r.coef)
    g = x.T @ (y - r.intercepto - x @ w) / 200
    for wi, gi in zip(w, (x - x.mean(0)).T @ (y - y.mean() - (x - x.mean(0)) @ w) / 200):
        assert gi == pytest.approx(0.5 * np.sign(wi), abs=1e-6) if wi else abs(gi) <= 0.5 + 1e-6
    assert w[2] == 0 and g is not None


def _short(values, days=3):
    mean = float(np.mean(values))
    std = float(np.std(values, ddof=1)) if len(values) > 1 else float("nan")
    tail = values[-7:]
    slope = (tail[-1] - tail[0]) / len(tail) if len(values) >= 3 else 0
    half = 1.5 * (std if std > 0 else mean * 0.2)
    return [(max(0, mean + slope * i * 0.1), half) for i in range(1, days + 1)]


def test_short_series_forecast(spark):
    cases = {"uno": [7], "dos": [3, 9], "const": [4, 4, 4, 4], "cero": [0, 0, 0],
             "baja": [90, 40, 20, 5, 1, 1, 1, 0], "neg": [-5, -2, -9]}
    df = frame(spark, [r for k, v in cases.items() for r in series(v, k)])
    out = short_series.short_forecast(short_series.short_stats(df), 3).toPandas()
    for k, v in cases.items():
        g = out[out.series_id == k].sort_values("paso")
        for (pred, half), (_, row) in zip(_short([float(x) for x in v]), g.iterrows()):
            assert row.prediccion == pytest.approx(pred)
            assert row.limite_superior == pytest.approx(pred + half)
            assert row.limite_inferior == pytest.approx(max(0, pred - half))
    m = {r.series_id: r for r in short_series.short_metrics(short_series.short_stats(df))
         .collect()}
    assert m["const"].mae == pytest.approx(0.8) and m["const"].rmse == pytest.approx(1.0)
    assert m["const"].r2 == 1.0 and m["const"].mape == 0.0
    assert m["neg"].mape == 50.0 and m["uno"].r2 == 0.0


def test_mass_forecast_covers_every_material(spark):
    rows = (random_series(80, 1, "larga") + random_series(3, 2, "corta")
            + series([5] * 50, "constante") + series([0] * 40, "cero") + series([9], "una"))
    codes = spark.createDataFrame(
        [(c, "x" * 60) for c in ("larga", "corta", "constante", "cero", "una", "nada")],
        "codigo string, descripcion string")
    out = {r.codigo: r for r in forecast.mass_forecast(codes, frame(spark, rows)).collect()}
    assert len(out) == 6
    assert out["nada"].estado == "Sin datos" and out["nada"].demanda_total == 0
    assert all(out[c].estado == "OK" for c in out if c != "nada")
    assert out["constante"].demanda_total == 150 and out["cero"].demanda_total == 0
    assert out["una"].demanda_total == 270
    assert all(len(r.descripcion) == 50 for r in out.values())


def test_intervals(spark):
    pred = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 2.0)],
                                 "series_id string, paso int, prediccion double")
    met = spark.createDataFrame([("a", 4.0)], "series_id string, mae double")
    r = forecast.intervals_by_level(pred, met, 0.90).orderBy("paso").collect()
    assert r[0].limite_superior == pytest.approx(10 + 1.645 * 4 * 0.5)
    assert r[1].limite_inferior == 0
    r = forecast.intervals_by_spread(pred, 0.5).orderBy("paso").collect()
    assert r[0].limite_superior == pytest.approx(10 + 1.96 * np.std([10, 2], ddof=1) * 0.3)


def weekly(n, name="W", noise=0.0, seed=0):
    rng = np.random.default_rng(seed)
    base = [20 + 0.05 * i + 8 * math.sin(2 * math.pi * i / 7) + noise * rng.normal()
            for i in range(n)]
    return series(base, name)


def test_trend_and_season_follows_a_clean_pattern(spark):
    n = 1100  # about three years, as the yearly terms need
    def level(i):  # a growing level times a weekly swing
        return (20 + 0.05 * i) * (1 + 0.25 * math.sin(2 * math.pi * i / 7))

    rows = series([level(i) for i in range(n)])
    df = frame(spark, rows)
    cfg = trend_season.TrendConfig(alpha=0.01)
    pred = trend_season.predict(df, 14, cfg).orderBy("paso").toPandas()
    true = np.array([level(i) for i in range(n, n + 14)])
    assert np.abs(pred.prediccion - true).mean() < 2.0
    assert (pred.limite_inferior <= pred.prediccion).all()
    assert (pred.prediccion <= pred.limite_superior).all()
    last = max(r[1] for r in rows)
    assert pred.fecha.iloc[0] == last + dt.timedelta(days=1)
    parts = trend_season.components(df, cfg).toPandas()
    rebuilt = (1 + parts.trend) * (1 + parts.yearly) * (1 + parts.weekly) - 1
    assert np.isfinite(rebuilt).all() and len(parts) == n


def plain_recursion(rows, model, days):
    """Day by day: the causal features of a next row, recomputed in pandas from all values."""
    p = pd.DataFrame(rows, columns=["series_id", "fecha", "cantidad"])
    n, media, out = len(p), p.cantidad.mean(), []
    y = p.cantidad.tolist()
    for k in range(1, days + 1):
        day = p.fecha.iloc[-1] + dt.timedelta(days=k)
        cal = calendar(pd.DataFrame({"fecha": [day]}), at_prediction=True).iloc[0]
        past = pd.Series(y)
        known = {f"cantidad_lag_{j}": y[-j] - media for j in (1, 7, 14, 30)
                 if n >= (1 if j == 1 else 7 if j == 7 else 35)}
        known["cantidad_ma_7"] = past[-7:].mean() - media
        known["cantidad_std_7"] = past[-7:].std()
        known["cantidad_diff"] = y[-1] - y[-2]
        if n >= 30:
            known["cantidad_ma_30"] = past[-30:].mean() - media
        value = media + model.intercepto + sum(
            c * (cal[f] if f in cal.index else known.get(f, 0.0)) for f, c in zip(features.FEATURES, model.coef))
        out.append(max(0.0, value))
        y.append(out[-1])
    return out


def test_recursive_prediction_is_the_plain_loop(spark):
    many = LONG + [random_series(12, 5, "S12"), random_series(33, 6, "S33")]
    df = frame(spark, [r for rows in many for r in rows])
    split, coefs = ridge.train(df, mode="causal")
    got = ridge.predict(ridge.start_points(split), coefs, 40, values=recursive.recent_values(split)).toPandas()
    models = {r.series_id: r for r in coefs.collect()}
    assert len(models) == len(many)
    for rows in many:
        mine = got[got.series_id == rows[0][0]].sort_values("paso")
        np.testing.assert_allclose(mine.prediccion, plain_recursion(rows, models[rows[0][0]], 40),
                                   rtol=1e-8, atol=1e-8)
        assert mine.fecha.iloc[0] == rows[-1][1] + dt.timedelta(days=1)
    pred, _ = strategies.run("linear", df, 5, mode="causal", recursive=True)
    first = pred.where("paso = 1").toPandas().set_index("series_id").prediccion
    want = got[got.paso == 1].set_index("series_id").prediccion
    np.testing.assert_allclose(first[want.index], want)


def test_seasonal_ar_recursion(spark):
    df = frame(spark, weekly(120, noise=1.0))
    model = seasonal_ar.fit_all(df)
    m = model.first()
    got = seasonal_ar.predict(df, 20, model).orderBy("paso").toPandas()
    y = [v for _, _, v in weekly(120, noise=1.0)]
    w = list(np.diff(y)) if m.d else list(y)
    level = y[-1]
    path = []
    e = list(m.restos)
    for _ in range(20):
        nxt = m.intercepto + sum(c * w[-k] for c, k in zip(m.coef, seasonal_ar.LAGS))
        nxt += sum(c * e[-k] for k, c in enumerate(m.ma_coef, 1))
        w.append(nxt)
        e.append(0.0)
        level = level + nxt if m.d else nxt
        path.append(max(0.0, level))
    np.testing.assert_allclose(got.prediccion, path, rtol=1e-9)
    width = got.limite_superior - got.prediccion
    assert (width.diff().dropna() >= -1e-9).all()
    assert width.iloc[0] == pytest.approx(seasonal_ar.Z95 * math.sqrt(m.sigma2))


def test_seasonal_ar_candidate_is_least_squares(spark):
    rows = weekly(90, noise=2.0, seed=3)
    df = frame(spark, rows)
    cands = seasonal_ar.fit_candidates(seasonal_ar.prepared(df)).toPandas()
    assert len(cands) == 18
    y = np.array([v for _, _, v in rows])
    c = cands[(cands.ar == 2) & (cands.d == 0) & (cands.ar_semanal == 1)].iloc[0]
    t = np.arange(15, 90)
    x = np.column_stack([np.ones(len(t)), y[t - 1], y[t - 2], y[t - 7]])
    b, *_ = np.linalg.lstsq(x, y[t], rcond=None)
    np.testing.assert_allclose([c.intercepto, c.coef[0], c.coef[1], c.coef[3]], b, rtol=1e-6)
    assert c.coef[2] == 0 and c.coef[4] == 0
    sse = ((y[t] - x @ b) ** 2).sum()
    assert c.aic == pytest.approx(len(t) * math.log(sse / len(t)) + 2 * 5, rel=1e-6)


def test_a_singular_problem_leaves_its_neighbours_alone(spark):
    rng = np.random.default_rng(3)
    rows = [("good", x, x * 2 + float(rng.normal()), 3.0 * x + 1) for x in rng.normal(size=40).tolist()]
    same = [("same", x, x, 2.0 * x) for x in rng.normal(size=40).tolist()]
    z = F.array(F.lit(1.0), "a", "b", "y")

    def coefs(data):
        df = spark.createDataFrame(data, "k string, a double, b double, y double").coalesce(1)
        return {r.k: r.coef for r in linear.fit(df, ["k"], z, 4, alpha=0.0).collect()}

    both = coefs(rows + same)
    assert both["good"] == coefs(rows)["good"] and np.isfinite(both["same"]).all()


def test_lasso_settles_on_nearly_equal_features(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=400)
    rows = [("x", float(b), float(b + 1e-3 * e), float(b + f))
            for b, e, f in zip(base, rng.normal(size=400), rng.normal(size=400))]
    df = spark.createDataFrame(rows, "k string, a double, b double, y double")
    r = linear.fit(df, ["k"], F.array(F.lit(1.0), "a", "b", "y"), 4, method="lasso", alpha=0.01,
                   scale=False).first()
    x, y = np.array([r_[1:3] for r_ in rows]), np.array([r_[3] for r_ in rows])
    left = y - r.intercepto - x @ np.array(r.coef)
    slope = (x - x.mean(0)).T @ left / len(y)
    for c, g in zip(r.coef, slope):  # the conditions of the least point
        assert abs(g) <= 0.01 + 1e-6 and (c == 0 or g == pytest.approx(0.01 * np.sign(c), abs=1e-6))


def arma(n, phi, theta, weekly_theta, seed, const=5.0, d=0):
    """A simulated series with (1 + theta B)(1 + weekly_theta B^7) and unit innovations."""
    rng = np.random.default_rng(seed)
    e, w = rng.normal(size=n + 300), np.zeros(n + 300)
    for t in range(8, n + 300):
        w[t] = (const + phi * w[t - 1] + e[t] + theta * e[t - 1] + weekly_theta * e[t - 7]
                + theta * weekly_theta * e[t - 8])
    return np.cumsum(w[300:]) if d else w[300:]


def plain_innovations(y, m, first):
    w = np.concatenate([[0.0], np.diff(y)]) if m["d"] else np.asarray(y)
    e = np.zeros(len(w))
    for t in range(first, len(w)):
        e[t] = w[t] - m["intercepto"] - sum(c * w[t - k] for c, k in zip(m["coef"], seasonal_ar.LAGS) if c)
        e[t] -= sum(c * e[t - k] for k, c in enumerate(m["ma_coef"], 1) if t >= k)
    return e


def test_moving_average_recovers_simulated_series(spark):
    many = {f"S{k}": arma(600, 0.6, 0.5, 0.6, k) for k in range(12)}
    df = frame(spark, [r for name, y in many.items() for r in series(y, name)])
    models = [r.asDict() for r in seasonal_ar.fit_all(df).collect()]
    assert len(models) == 12 and all(m["ma_semanal"] == 1 for m in models)
    assert sum((m["ar"], m["d"], m["ma"]) == (1, 0, 1) for m in models) >= 6
    same = [m for m in models if (m["ar"], m["d"], m["ma"], m["ar_semanal"]) == (1, 0, 1, 0)]
    for m in same:
        assert m["coef"][0] == pytest.approx(0.6, abs=0.15)
        assert m["ma_coef"][0] == pytest.approx(0.5, abs=0.15)
        assert m["ma_coef"][6] == pytest.approx(0.6, abs=0.15)
        assert m["ma_coef"][7] == pytest.approx(m["ma_coef"][0] * m["ma_coef"][6])
    for m in models:
        e = plain_innovations(many[m["series_id"]], m, 15)
        np.testing.assert_allclose(m["restos"], e[-9:], rtol=1e-8, atol=1e-8)
        n = 600 - 15
        assert m["n_train"] == n and m["sigma2"] == pytest.approx((e ** 2).sum() / n)
        assert m["sigma2"] == pytest.approx(1.0, abs=0.25)
        k = m["ar"] + m["ar_semanal"] + m["ma"] + m["ma_semanal"] + 2
        assert m["aic"] == pytest.approx(n * math.log(m["sigma2"]) + 2 * k)
        assert m["bic"] == pytest.approx(n * math.log(m["sigma2"]) + k * math.log(n))


def test_moving_average_forecast_is_the_plain_recursion(spark):
    y = arma(300, 0.4, 0.7, 0.5, 3, const=0.3, d=1) + 500
    df = frame(spark, series(y))
    model = seasonal_ar.fit_all(df)
    m = model.first().asDict()
    assert m["ma"] + m["ma_semanal"] > 0
    got = seasonal_ar.predict(df, 25, model).orderBy("paso").toPandas()
    w, e, level = list(np.diff(y) if m["d"] else y), list(m["restos"]), y[-1]
    lags = dict(zip(seasonal_ar.LAGS, m["coef"]))
    path, psi, spread = [], [], []
    for t in range(25):
        w.append(m["intercepto"] + sum(c * w[-k] for k, c in lags.items())
                 + sum(c * e[-k] for k, c in enumerate(m["ma_coef"], 1)))
        e.append(0.0)
        level = level + w[-1] if m["d"] else w[-1]
        path.append(level)
        psi.append(1.0 if t == 0 else sum(c * psi[t - k] for k, c in lags.items() if t >= k)
                   + (m["ma_coef"][t - 1] if t <= 9 else 0.0))
        weights = np.cumsum(psi) if m["d"] else np.array(psi)
        spread.append(math.sqrt(m["sigma2"] * (weights ** 2).sum()))
    np.testing.assert_allclose(got.prediccion, path, rtol=1e-9)
    np.testing.assert_allclose(got.limite_superior - got.prediccion,
                               seasonal_ar.Z95 * np.array(spread), rtol=1e-9)


def test_refined_moving_average_is_a_least_point():
    for d in (0, 1):
        values = [arma(200 + k, 0.5, -0.4, 0.3, k, d=d) for k in range(6)]
        f = moving_average.fit(values, d, False, False)
        batch = moving_average.Batch(values, d, False)
        base = (batch.errors(f["params"][:, None])[:, 0] ** 2).sum(axis=1)
        np.testing.assert_allclose(base / batch.n, f["sigma2"])
        on = moving_average._switches(f["order"])
        for j in range(moving_average.N_PARAMS):
            for step in (1e-3, -1e-3):
                moved = f["params"].copy()
                moved[:, j] += step * np.where(on[:, j], 1 + abs(moved[:, j]), 0)
                inside = moving_average.invertible(moved[:, -3:])
                sse = (batch.errors(moved[:, None])[:, 0] ** 2).sum(axis=1)
                assert (sse[inside] >= base[inside] * (1 - 1e-6)).all()


def test_moving_average_of_odd_series(spark):
    rows = (series([5.0] * 60, "flat") + series([1.0, float("nan")] * 30, "gaps") + series(range(12), "short")
            + series([0.0] * 59 + [1e12], "spike") + series([3.0] * 9, "tiny") + random_series(25, 4, "middle"))
    model = {r.series_id: r for r in seasonal_ar.fit_all(frame(spark, rows)).collect()}
    assert set(model) == {"flat", "gaps", "short", "spike", "middle"}
    assert model["gaps"].ma == 0 and (model["short"].ar, model["short"].d) == (1, 1)
    both = seasonal_ar.moving_average_fit(frame(spark, rows))
    assert {r.series_id: math.isinf(r.aic) for r in both.collect()}["gaps"]
    orders = seasonal_ar.diagnostics(seasonal_ar.fit_all(frame(spark, rows)))
    assert {"ar", "d", "ma", "ar_semanal", "ma_semanal", "periodo"} <= set(orders.columns)
    assert seasonal_ar.fit_all(frame(spark, [])).count() == 0


def test_short_series_get_the_default_order(spark):
    out = seasonal_ar.fit_all(frame(spark, random_series(15, 1))).first()
    assert (out.ar, out.d, out.ar_semanal) == (1, 1, 0)


def test_pooled_trees(spark):
    rows = [r for i in range(6) for r in weekly(70 + i, f"W{i}", noise=1.0, seed=i)]
    rows += random_series(6, 9, "corta")
    df = frame(spark, rows)
    for name in ("random_forest", "gradient_boosting", "xgboost"):
        pred, met = strategies.run(name, df, 7, trees=5, depth=3)
        p = pred.toPandas()
        assert (p.groupby("series_id").size() == 7).all() and p.series_id.nunique() == 7
        assert (p.prediccion >= 0).all() and (p.limite_inferior <= p.prediccion).all()
        assert met.count() == 7
    split = features.temporal_split(features.feature_rows(df))
    model = trees.fit_trees(split, trees.TreeConfig("forest", trees=5, depth=3))
    imp = trees.importance(model, spark).toPandas()
    assert imp.importance.sum() == pytest.approx(1.0)


@pytest.mark.parametrize("name", ["linear", "prophet", "arima", "short"])
def test_every_strategy_covers_every_series(spark, name):
    rows = random_series(60, 1, "a") + random_series(20, 2, "b") + random_series(4, 3, "c")
    pred, met = strategies.run(name, frame(spark, rows), 5)
    counts = {r.series_id: r["count"] for r in pred.groupBy("series_id").count().collect()}
    assert counts == {"a": 5, "b": 5, "c": 5}
    assert met.count() == 3


def test_strategy_registry(spark):
    with pytest.raises(KeyError):
        strategies.get("inexistente")
    strategies.register("doble", "Doble", lambda d, h, factor=2: (d, factor * h))
    assert strategies.run("doble", None, 3, factor=4)[1] == 12
    assert "doble" in strategies.available() and strategies.labels()["linear"]
    assert Ridge is not None


def test_order_sums_come_from_rows_of_values(spark):
    rows = [r for i, n in enumerate((9, 10, 19, 34, 35, 60)) for r in random_series(n, i, f"s{i}")]
    df = frame(spark, rows)
    for train_only in (False, True):
        had = seasonal_ar.prepared(df)
        z = F.array(F.lit(1.0), *[F.col(f"l_{k}") for k in seasonal_ar.LAGS], F.col("w"))
        want = {(r.series_id, r.d): r.g for r in product_sums(
            had.where("is_train") if train_only else had, ["series_id", "d"], z, seasonal_ar.WIDTH).collect()}
        got = {(r.series_id, r.d): r.g for r in seasonal_ar.value_sums(
            seasonal_ar.held_series(df, train_only)).collect()}
        assert set(got) == set(want) and len(got) == 10
        for key in got:
            assert got[key] == pytest.approx(want[key], rel=1e-12)
    # No windows over the daily rows, and nothing but rows of values and of sums moves.
    assert "Window" not in seasonal_ar.fit_all(df)._jdf.queryExecution().toString()


def test_refinement_works_out_taken_steps_only(monkeypatch):
    rng, asked = np.random.default_rng(4), []
    values = [rng.integers(1, 50, 30).astype(float) for _ in range(200)]
    slopes = moving_average.Batch._slopes

    def counted(self, params, *rest):
        asked.append(len(params))
        return slopes(self, params, *rest)

    monkeypatch.setattr(moving_average.Batch, "_slopes", counted)
    moving_average.fit(values, 0, True, False)
    assert asked[0] == 200 and sum(asked) < 200 * moving_average.STEPS * 0.9


def test_product_sums_stay_small():
    data = np.random.default_rng(3).normal(size=(4096, 36))
    starts, up = np.arange(0, 4096, 24), np.triu_indices(36)
    tracemalloc.start()
    got = linear.triangle_sums(data, starts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, np.add.reduceat(data[:, up[0]] * data[:, up[1]], starts, axis=0))
    assert peak < 5 << 20  # all products at once take four times as much
