"""Models by name. A strategy is a function ``(daily, horizonte, **settings)`` that returns
(predictions, metrics) for every series."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import forecast, seasonal_ar, short_series, trees, trend_season
from .features import MIN_USABLE, feature_rows, temporal_split

Result = tuple[DataFrame, DataFrame]
_STRATEGIES: dict[str, tuple[str, Callable[..., Result]]] = {}


def register(name: str, label: str, run: Callable[..., Result]) -> None:
    _STRATEGIES[name] = (label, run)


def available() -> list[str]:
    return list(_STRATEGIES)


def labels() -> dict[str, str]:
    return {name: label for name, (label, _) in _STRATEGIES.items()}


def get(name: str) -> Callable[..., Result]:
    if name not in _STRATEGIES:
        raise KeyError(f"model {name} is not registered; available: {', '.join(available())}")
    return _STRATEGIES[name][1]


def settings_of(name: str) -> list[str]:
    """Names of the settings that a model's function spells out."""
    return list(inspect.signature(get(name)).parameters)[2:]


def run(name: str, daily: DataFrame, horizonte: int = 30, **settings) -> Result:
    return get(name)(daily, horizonte, **settings)


def with_fallback(daily: DataFrame, few: DataFrame, pred: DataFrame, metrics: DataFrame,
                  horizonte: int) -> Result:
    """Add the short-series fallback for the series in ``few``."""
    stats = short_series.short_stats(daily.join(few, "series_id", "left_semi"))
    names = ["series_id", *forecast.METRICS]
    return (pred.unionByName(short_series.short_forecast(stats, horizonte)),
            metrics.select(*names).unionByName(short_series.short_metrics(stats).select(*names)))


def _linear(daily, horizonte, mode="reference", refit=False, recursive=False) -> Result:
    return forecast.linear_forecast(daily, horizonte, mode, refit, recursive)


def _trees(kind: str):
    def run_trees(daily, horizonte, mode="reference", **settings) -> Result:
        split = materialise(temporal_split(feature_rows(daily, mode)))
        model = trees.fit_trees(split, replace(trees.CONFIGS[kind], **settings))
        few = split.where(F.col("is_last") & (F.col("m") < MIN_USABLE)).select("series_id")
        return with_fallback(daily, few, trees.predict(split, model, horizonte),
                             trees.evaluate(split, model), horizonte)
    return run_trees


def _few_rows(daily: DataFrame, least: int) -> DataFrame:
    n = daily.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") < least).select("series_id")


def _trend(daily, horizonte, **settings) -> Result:
    cfg = trend_season.TrendConfig(**settings)
    daily = materialise(daily)
    return with_fallback(daily, _few_rows(daily, trend_season.MIN_ROWS),
                         trend_season.predict(daily, horizonte, cfg),
                         trend_season.evaluate(daily, cfg), horizonte)


def _seasonal_ar(daily, horizonte) -> Result:
    daily = materialise(daily)
    return with_fallback(daily, _few_rows(daily, seasonal_ar.MIN_ROWS),
                         seasonal_ar.predict(daily, horizonte),
                         seasonal_ar.evaluate(daily), horizonte)


def _short(daily, horizonte) -> Result:
    daily = materialise(daily)
    stats = short_series.short_stats(daily)
    return (short_series.short_forecast(stats, horizonte),
            short_series.short_metrics(stats).select("series_id", *forecast.METRICS))


register("random_forest", "Random Forest", _trees("random_forest"))
register("gradient_boosting", "Gradient Boosting", _trees("gradient_boosting"))
register("linear", "Ridge Regression", _linear)
register("xgboost", "Boosted trees, regularised", _trees("xgboost"))
register("prophet", "Trend and season", _trend)
register("arima", "Seasonal autoregression", _seasonal_ar)
register("short", "Mean and slope", _short)

