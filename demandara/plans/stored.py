"""Fit, store and load any registered model.

Linear models and pooled ensembles predict from the history they are given; models of single series
hold their own last state and predict the days after their training. Series too short for a model are
stored with the figures of the short-series fallback.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import registry, ridge, seasonal_ar, short_series, trees, trend_season
from .boosting import Boosted
from .features import MIN_USABLE, feature_rows, temporal_split

MODELS = ("linear", "short", "prophet", "arima", *trees.CONFIGS)


def _few(daily: DataFrame, least: int) -> DataFrame:
    n = daily.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    few = n.where(F.col("n") < least).select("series_id")
    return short_series.short_stats(daily.join(few, "series_id", "left_semi"))


def save(store: registry.ModelStore, daily: DataFrame, modelo: str = "linear", run_id: str | None = None,
         overwrite: bool = False, horizonte: int = 30, **settings) -> str:
    """Fit ``modelo`` on every series and store it with metadata; returns the run's id."""
    if modelo not in MODELS:
        raise ValueError(f"no store for {modelo}; there is one for {', '.join(MODELS)}")
    daily, tables, ml, features = materialise(daily), {}, None, None
    if modelo == "linear":
        mode, alpha = settings.get("mode", "reference"), float(settings.get("alpha", 1.0))
        split = materialise(temporal_split(feature_rows(daily, mode)))
        coefs = materialise(ridge.fit_ridge(split, alpha))
        models = coefs.join(split.where("is_last").select("series_id", "media"), "series_id")
        metrics, features, settings = ridge.evaluate(split, coefs), ridge.FEATURES, {"mode": mode, "alpha": alpha}
    elif modelo == "short":
        models = materialise(short_series.short_stats(daily))
        metrics = short_series.short_metrics(models)
    elif modelo == "prophet":
        cfg = trend_season.TrendConfig(**settings)
        models, metrics = trend_season.fitted(daily, cfg), trend_season.evaluate(daily, cfg)
        tables["cortas"] = _few(daily, trend_season.MIN_ROWS)
    elif modelo == "arima":
        models = seasonal_ar.saved_points(daily)
        metrics = seasonal_ar.evaluate(daily)
        tables["cortas"] = _few(daily, seasonal_ar.MIN_ROWS)
    else:
        mode = settings.pop("mode", "reference")
        split = materialise(temporal_split(feature_rows(daily, mode)))
        fitted = trees.fit_trees(split, replace(trees.CONFIGS[modelo], **settings))
        metrics, features, settings = trees.evaluate(split, fitted), trees.TREE_FEATURES, settings | {"mode": mode}
        models = split.where(F.col("is_last") & (F.col("m") >= MIN_USABLE)).select("series_id", "n", "media")
        if isinstance(fitted, Boosted):
            tables["arboles"] = fitted.table(daily.sparkSession)
        else:
            ml = fitted
        few = split.where(F.col("is_last") & (F.col("m") < MIN_USABLE)).select("series_id")
        tables["cortas"] = short_series.short_stats(daily.join(few, "series_id", "left_semi"))
    meta = registry.metadata_rows(metrics, daily, modelo, features=features, params=settings, horizonte=horizonte)
    return store.save(meta, models, run_id, overwrite, modelo=modelo, settings=settings, tables=tables, ml=ml)


def predict(store: registry.ModelStore, run_id: str, daily: DataFrame, horizonte: int = 30) -> DataFrame:
    """Days ahead of every stored series."""
    entry = store.manifest(run_id)
    modelo, settings = entry["modelo"], entry["ajustes"]
    models = store.load(run_id)
    if modelo == "short":
        return short_series.short_forecast(models, horizonte)
    if modelo == "linear":
        split = temporal_split(feature_rows(daily, settings.get("mode", "reference")))
        points = ridge.start_points(split).drop("media").join(models.select("series_id", "media"), "series_id")
        return ridge.predict(points, models.drop("media"), horizonte)
    if modelo == "prophet":
        pred = trend_season.ahead(models, horizonte, trend_season.TrendConfig(**settings))
    elif modelo == "arima":
        pred = seasonal_ar.predict_points(models, horizonte)
    else:
        split = materialise(temporal_split(feature_rows(daily, settings["mode"])).join(
            models.select("series_id"), "series_id", "left_semi"))
        fitted = (Boosted.from_table(store.load_table(run_id, "arboles")) if "arboles" in entry["tablas"]
                  else store.load_ml(run_id))
        pred = trees.predict(split, fitted, horizonte)
    return pred.unionByName(short_series.short_forecast(store.load_table(run_id, "cortas"), horizonte))
