"""Trend and season model of every series.

On log(1 + y): a piecewise linear trend with evenly spaced bends over the first 80 % of the
history, yearly and weekly Fourier terms, fitted for all series with the shared
least-squares job. On the log scale seasons multiply the trend. Intervals are quantiles of
the residuals. Forecasts start after the last observed day and use a fit on all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import horizon_days
from ..operators.windows import ordered, series
from .linear import dot, fit
from .metrics import error_metrics

MIN_ROWS = 10
YEAR_DAYS = 365.25
# Importance labels shown for the three components.
COMPONENT_SHARES = {"Estacionalidad Anual": 0.35, "Estacionalidad Semanal": 0.30,
                    "Tendencia": 0.35}


@dataclass(frozen=True)
class TrendConfig:
    yearly: int = 10
    weekly: int = 3
    bends: int = 10
    bend_range: float = 0.8
    alpha: float = 1.0
    interval: float = 0.95


def _trend_terms(cfg: TrendConfig, t: Column) -> list[Column]:
    knots = [cfg.bend_range * (i + 1) / (cfg.bends + 1) for i in range(cfg.bends)]
    return [t, *[F.greatest(t - F.lit(k), F.lit(0.0)) for k in knots]]


def _season_terms(order: int, phase: Column) -> list[Column]:
    terms = []
    for k in range(1, order + 1):
        angle = phase * F.lit(2.0 * k) * F.pi()
        terms += [F.sin(angle), F.cos(angle)]
    return terms


def _terms(cfg: TrendConfig, fecha: Column) -> dict[str, list[Column]]:
    """Terms of a date; needs the columns ``inicio`` and ``dias`` of its series."""
    day = F.datediff(fecha, F.lit("2000-01-03").cast("date")).cast("double")
    t = F.datediff(fecha, "inicio") / F.greatest(F.col("dias"), F.lit(1))
    return {"trend": _trend_terms(cfg, t),
            "yearly": _season_terms(cfg.yearly, day / YEAR_DAYS),
            "weekly": _season_terms(cfg.weekly, day / 7.0)}


def _flat(cfg: TrendConfig, fecha: Column) -> list[Column]:
    return [t for part in _terms(cfg, fecha).values() for t in part]


def prepared(daily: DataFrame, share: float = 0.2) -> DataFrame:
    """Rows with log target, position and the range of their series."""
    s = series()
    df = daily.withColumns({
        "n": F.count(F.lit(1)).over(s), "pos": F.row_number().over(ordered()),
        "inicio": F.min("fecha").over(s), "fin": F.max("fecha").over(s)})
    return df.withColumns({
        "dias": F.datediff("fin", "inicio"),
        "logy": F.log1p(F.greatest("cantidad", F.lit(0.0))),
        "is_train": F.col("pos") <= F.floor(F.col("n") * (1 - share))})


def fit_trend(rows: DataFrame, cfg: TrendConfig = TrendConfig()) -> DataFrame:
    """Coefficients per series from the given prepared rows."""
    terms = _flat(cfg, F.col("fecha"))
    z = F.array(F.lit(1.0), *terms, F.col("logy"))
    return fit(rows.where(F.col("n") >= MIN_ROWS), ["series_id"], z, len(terms) + 2,
               alpha=cfg.alpha)


def _log_prediction(cfg: TrendConfig) -> Column:
    return F.col("intercepto") + dot(_flat(cfg, F.col("fecha")))


def _joined(rows: DataFrame, coefs: DataFrame) -> DataFrame:
    return rows.join(coefs.select("series_id", "intercepto", "coef"), "series_id")


def evaluate(daily: DataFrame, cfg: TrendConfig = TrendConfig()) -> DataFrame:
    """Metrics on the last fifth after fitting on the rows before."""
    rows = prepared(daily)
    test = _joined(rows.where(~F.col("is_train")), fit_trend(rows.where("is_train"), cfg))
    pairs = test.select("series_id", F.greatest("cantidad", F.lit(0.0)).alias("real"),
                        F.expm1(_log_prediction(cfg)).alias("prediccion"))
    return error_metrics(pairs, ["series_id"])


def fitted(daily: DataFrame, cfg: TrendConfig = TrendConfig()) -> DataFrame:
    """All a forecast needs, one row per series: range, coefficients, residual quantiles."""
    rows = prepared(daily)
    coefs = fit_trend(rows, cfg)
    tail = (1 - cfg.interval) / 2
    residuals = _joined(rows, coefs).select(
        "series_id", "inicio", "fin", "dias", "intercepto", "coef",
        (F.col("logy") - _log_prediction(cfg)).alias("r"))
    # One residual per series and day, so the exact percentile works on a bounded group.
    return residuals.groupBy("series_id").agg(
        F.max("fin").alias("ultima_fecha"), F.max("inicio").alias("inicio"),
        F.max("dias").alias("dias"), F.max("intercepto").alias("intercepto"),
        F.max("coef").alias("coef"), F.percentile("r", F.array(F.lit(tail), F.lit(1 - tail)))
        .alias("q"))


def predict(daily: DataFrame, horizonte: int, cfg: TrendConfig = TrendConfig()) -> DataFrame:
    return ahead(fitted(daily, cfg), horizonte, cfg)


def ahead(points: DataFrame, horizonte: int, cfg: TrendConfig = TrendConfig()) -> DataFrame:
    """Days after the last observed day from the rows of ``fitted``."""
    days = horizon_days(points, horizonte).withColumn("_l", _log_prediction(cfg))

    def level(shift: Column) -> Column:
        return F.greatest(F.lit(0.0), F.expm1(F.col("_l") + shift))

    return days.select(
        "series_id", "paso", "fecha", level(F.lit(0.0)).alias("prediccion"),
        level(F.get("q", F.lit(0))).alias("limite_inferior"),
        level(F.get("q", F.lit(1))).alias("limite_superior"))


def components(daily: DataFrame, cfg: TrendConfig = TrendConfig()) -> DataFrame:
    """Trend level and the relative effect of the year and the week on each day."""
    rows = prepared(daily)
    df = _joined(rows, fit_trend(rows, cfg))
    terms = _terms(cfg, F.col("fecha"))
    at, parts = 0, {}
    for name, cols in terms.items():
        parts[name] = dot(cols, start=at)
        at += len(cols)
    return df.select("series_id", "fecha",
                     F.expm1(F.col("intercepto") + parts["trend"]).alias("trend"),
                     F.expm1(parts["yearly"]).alias("yearly"),
                     F.expm1(parts["weekly"]).alias("weekly"))


def importance(daily: DataFrame) -> DataFrame:
    """Fixed component shares, one row per series long enough for the model."""
    n = daily.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array(*[F.struct(F.lit(k).alias("feature"), F.lit(v).alias("importance"))
                      for k, v in COMPONENT_SHARES.items()])
    return n.where(F.col("n") >= MIN_ROWS).select("series_id", F.inline(pairs))
