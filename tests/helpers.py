"""Small series and plain pandas / NumPy versions of the operators under test."""

import datetime as dt
import math

import numpy as np
import pandas as pd

START = dt.date(2023, 1, 30)
SCHEMA = "series_id string, fecha date, cantidad double"


def series(values, name="A", start=START, step=1):
    return [(name, start + dt.timedelta(days=i * step), None if v is None else float(v))
            for i, v in enumerate(values)]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def random_series(n, seed, name="A", step=1, low=0, high=60):
    rng = np.random.default_rng(seed)
    return series(rng.integers(low, high, n), name, step=step)


def by_day(df):
    return df.toPandas().sort_values(["series_id", "fecha"]).reset_index(drop=True)


def feature_frame(rows):
    """Reference-mode features of one series of at least 35 rows, in pandas."""
    p = pd.DataFrame(rows, columns=["series_id", "fecha", "cantidad"])
    return calendar(p.assign(
        **{f"cantidad_lag_{k}": p.cantidad.shift(k) for k in (1, 7, 14, 30)},
        cantidad_ma_7=p.cantidad.rolling(7, min_periods=1).mean(),
        cantidad_ma_30=p.cantidad.rolling(30, min_periods=1).mean(),
        cantidad_std_7=p.cantidad.rolling(7, min_periods=1).std(),
        cantidad_diff=p.cantidad.diff()))


def calendar(p, at_prediction=False):
    f = pd.to_datetime(p.fecha)
    day = f.dt.day
    end = (day >= 28) if at_prediction else f.dt.is_month_end
    start = (day <= 3) if at_prediction else f.dt.is_month_start
    return p.assign(
        dia_semana=f.dt.dayofweek, dia_mes=day, mes=f.dt.month, trimestre=f.dt.quarter,
        mes_sin=np.sin(2 * np.pi * f.dt.month / 12), mes_cos=np.cos(2 * np.pi * f.dt.month / 12),
        dia_sin=np.sin(2 * np.pi * f.dt.dayofweek / 7),
        dia_cos=np.cos(2 * np.pi * f.dt.dayofweek / 7),
        es_fin_mes=end.astype(int), es_inicio_mes=start.astype(int))


class Ridge:
    """Ridge on standardised features with a free intercept, by normal equations."""

    def __init__(self, x, y, alpha=1.0, scale=True):
        self.mean = x.mean(0)
        sd = x.std(0)
        sd = np.where(sd < 1e-9, 1.0, sd)
        self.sd = sd if scale else np.ones_like(sd)
        z = (x - self.mean) / self.sd
        self.y0 = y.mean()
        self.w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - self.y0))

    def predict(self, x):
        return self.y0 + ((x - self.mean) / self.sd) @ self.w


def fit_on_first_part(p, features):
    usable = p.dropna()
    n_test = math.ceil(0.2 * len(usable))
    train, test = usable.iloc[:-n_test], usable.iloc[-n_test:]
    model = Ridge(train[features].to_numpy(float), train.cantidad.to_numpy(float))
    return model, train, test


def predict_ahead(model, p, features, days):
    last = p.iloc[-1]
    dates = [last.fecha + dt.timedelta(days=i) for i in range(1, days + 1)]
    ahead = calendar(pd.DataFrame({"fecha": dates}), at_prediction=True)
    for f in features:
        if f not in ahead.columns:
            ahead[f] = last[f]
    return np.maximum(0.0, model.predict(ahead[features].to_numpy(float)))
