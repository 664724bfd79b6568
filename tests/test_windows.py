import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandara.operators import windows as win

from .helpers import by_day, frame, random_series, series

SIZES = [1, 2, 6, 7, 9, 29, 30, 34, 35, 60, 200]


@pytest.fixture(scope="module")
def many(spark):
    rows = [r for i, n in enumerate(SIZES) for r in random_series(n, i, f"S{n}")]
    return frame(spark, rows)


def groups(df):
    return {k: g.reset_index(drop=True) for k, g in by_day(df).groupby("series_id")}


def same(a, b):
    np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float), rtol=1e-9, atol=1e-9)


def test_lags_follow_length(many):
    for name, g in groups(win.lag_features(many)).items():
        n = int(name[1:])
        same(g.cantidad_lag_1, g.cantidad.shift(1))
        for k, least in ((7, 7), (14, 35), (30, 35)):
            expected = g.cantidad.shift(k) if n >= least else pd.Series([np.nan] * n)
            same(g[f"cantidad_lag_{k}"], expected)


def test_rolling(many):
    out = win.rolling_std(win.rolling_mean(many))
    for g in groups(out).values():
        same(g.cantidad_ma_7, g.cantidad.rolling(7, min_periods=1).mean())
        same(g.cantidad_ma_30, g.cantidad.rolling(30, min_periods=1).mean())
        same(g.cantidad_std_7, g.cantidad.rolling(7, min_periods=1).std())


def test_ewma_equals_pandas_on_long_series(spark):
    rows = random_series(1500, 3, "L") + random_series(64, 4, "M") + random_series(65, 5, "N") \
        + random_series(8, 6, "C")
    for name, g in groups(win.ewma(frame(spark, rows))).items():
        for s in (7, 14, 30):
            got = g[f"cantidad_ewma_{s}"]
            if len(g) >= s:
                same(got, g.cantidad.ewm(span=s, min_periods=1).mean())
            else:
                assert got.isna().all(), name


def test_ewma_of_a_million_rows(spark):
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int"))
    df = spark.range(1_000_000).select(F.lit("a").alias("series_id"), day.alias("fecha"),
                                       (F.abs(F.hash("id")) % 100).cast("double").alias("cantidad"))
    got = win.ewma(df).orderBy("fecha").drop("fecha").toPandas()
    for s in (7, 14, 30):
        same(got[f"cantidad_ewma_{s}"], got.cantidad.ewm(span=s).mean())


def test_gap_of_seven_days_is_none(spark):
    d = dt.date(2024, 1, 1)
    rows = [("A", d, 1.0), ("A", d + dt.timedelta(7), 1.0), ("A", d + dt.timedelta(15), 1.0)]
    out = win.find_gaps(frame(spark, rows)).collect()
    assert [(r.inicio, r.fin) for r in out] == [(d + dt.timedelta(7), d + dt.timedelta(15))]


def test_baselines(many):
    out = {r.series_id: r for r in win.baseline_errors(many).collect()}
    for name, g in groups(many).items():
        y, r = g.cantidad.to_numpy(), out[name]
        if len(y) == 1:
            assert r.naive_mae is None and r.mejor_baseline is None
            continue
        naive = np.abs(np.diff(y)).mean()
        seasonal = np.abs(y[7:] - y[:-7]).mean() if len(y) > 7 else naive
        ma = (np.abs(y[1:] - pd.Series(y).rolling(7, min_periods=1).mean().shift(1)[1:]).mean()
              if len(y) > 7 else naive)
        same([r.naive_mae, r.seasonal_mae, r.ma_mae], [naive, seasonal, ma])
        scores = {"naive": naive, "seasonal": seasonal, "ma": ma}
        assert r.mejor_baseline == min(scores, key=scores.get)


def test_recent_slope(spark):
    rows = series([5, 9], "dos") + series([1, 2, 4], "tres") + series(range(20), "veinte")
    out = {r.series_id: r.tendencia for r in win.recent_slope(frame(spark, rows)).collect()}
    assert out["dos"] == 0
    assert out["tres"] == pytest.approx(1.0)
    assert out["veinte"] == pytest.approx(6 / 7)
