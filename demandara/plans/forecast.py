"""Forecast of all series, intervals, figures and the mass-forecast table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bands import r2_band, trend_word
from ..functions.calendar import short_weekday
from ..session import materialise
from . import ridge
from .features import MIN_USABLE, feature_rows, temporal_split
from .recursive import recent_values
from .short_series import short_forecast, short_metrics, short_stats

# Normal factors by confidence level, and the one for any other level.
Z_LEVELS = {0.80: 1.28, 0.85: 1.44, 0.90: 1.645, 0.95: 1.96, 0.99: 2.576}
Z_OTHER = 1.96
METRICS = ["mae", "rmse", "r2", "mape"]


def linear_forecast(daily: DataFrame, horizonte: int = 30, mode: str = "reference",
                    refit: bool = False, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(predictions, metrics) of every series: the linear model where at least 5 usable
    rows exist, the short-series fallback elsewhere. ``recursive`` rebuilds the features of each
    day ahead from the days predicted before it (for ``mode="causal"``)."""
    split = materialise(temporal_split(feature_rows(daily, mode)))
    coefs = materialise(ridge.fit_ridge(split, refit=refit))
    points = ridge.start_points(split)
    few = split.where(F.col("m") < MIN_USABLE).select("series_id", "fecha", "cantidad")
    stats = short_stats(few)
    values = recent_values(split) if recursive else None
    pred = ridge.predict(points, coefs, horizonte, values=values).unionByName(
        short_forecast(stats, horizonte))
    metrics = (ridge.evaluate(split, coefs).withColumn("modelo", F.lit("linear"))
               .unionByName(short_metrics(stats).select("series_id", *METRICS)
                            .withColumn("modelo", F.lit("short"))))
    return pred, metrics


def intervals_by_level(pred: DataFrame, metrics: DataFrame,
                       nivel: float = 0.95) -> DataFrame:
    """Band of half the normal factor times the series' MAE; the lower end is at least 0."""
    z = Z_LEVELS.get(nivel, Z_OTHER)
    half = F.col("mae") * (z * 0.5)
    return (pred.drop("limite_inferior", "limite_superior")
            .join(metrics.select("series_id", "mae"), "series_id")
            .withColumns({"limite_inferior": F.greatest(F.lit(0.0), F.col("prediccion") - half),
                          "limite_superior": F.col("prediccion") + half})
            .drop("mae"))


def intervals_by_spread(pred: DataFrame, nivel: float = 0.95) -> DataFrame:
    """Band from the spread of the predictions themselves (0.3 of the normal factor)."""
    z = {k: v for k, v in Z_LEVELS.items() if k != 0.85}.get(nivel, Z_OTHER)
    half = F.stddev_samp("prediccion").over(W.partitionBy("series_id")) * (z * 0.3)
    return pred.withColumn("_h", half).withColumns({
        "limite_inferior": F.greatest(F.lit(0.0), F.col("prediccion") - F.col("_h")),
        "limite_superior": F.col("prediccion") + F.col("_h")}).drop("_h")


def forecast_kpis(pred: DataFrame, daily: DataFrame, metrics: DataFrame) -> DataFrame:
    """Total and mean demand ahead, change against history, precision and reading aids."""
    hist = daily.groupBy("series_id").agg(F.avg("cantidad").alias("promedio_historico"))
    ahead = pred.groupBy("series_id").agg(
        F.sum("prediccion").alias("demanda_total"),
        F.avg("prediccion").alias("promedio_prediccion"))
    out = ahead.join(hist, "series_id").join(
        metrics.select("series_id", "r2", "mae"), "series_id")
    before = F.col("promedio_historico")
    trend = F.when(before > 0, F.try_divide(
        (F.col("promedio_prediccion") - before) * 100, F.when(before > 0, before)))
    return out.withColumns({
        "tendencia": trend,
        "tendencia_texto": trend_word(F.coalesce(trend, F.lit(0.0))),
        "precision": F.when(F.col("r2") > 0, F.col("r2")),
        "precision_texto": r2_band(F.col("r2"), "resumen")})


def prediction_rows(pred: DataFrame) -> DataFrame:
    """Report rows: ISO date text and short week-day name."""
    return pred.select(
        "series_id", F.date_format("fecha", "yyyy-MM-dd").alias("fecha"), "prediccion",
        "limite_inferior", "limite_superior",
        short_weekday(F.col("fecha")).alias("dia_semana"))


def mass_forecast(codes: DataFrame, daily: DataFrame, horizonte: int = 30,
                  mode: str = "reference", modelo: str = "linear", **settings) -> DataFrame:
    """One row per material: total demand ahead, R2, MAE and a status, by any named model.

    ``codes`` has ``codigo`` and ``descripcion`` for every material wanted; a material
    without history gets 'Sin datos', one whose numbers cannot be computed gets an error
    status, so no task fails for a single bad series. There is no cap on materials.
    """
    from . import strategies  # its models are built on this module

    if "mode" in strategies.settings_of(modelo):
        settings["mode"] = mode
    return mass_table(codes, *strategies.run(modelo, daily, horizonte, **settings))


def mass_table(codes: DataFrame, pred: DataFrame, metrics: DataFrame) -> DataFrame:
    """The mass-forecast table from any model's predictions and metrics."""
    total = pred.groupBy("series_id").agg(F.sum("prediccion").alias("_total"))
    # Every series with history has metrics, so they also tell which materials have none.
    res = metrics.select("series_id", "r2", "mae").join(total, "series_id", "left")
    out = codes.join(res, codes["codigo"] == res["series_id"], "left")
    bad = F.col("_total").isNull() | F.isnan("_total") | F.col("mae").isNull()
    status = (F.when(F.col("series_id").isNull(), "Sin datos")
              .when(bad, "Error: sin resultado").otherwise("OK"))
    out = out.withColumn("estado", status)
    ok = F.col("estado") == "OK"

    def figure(col: str, places: int):
        return F.when(ok, F.bround(col, places)).otherwise(0.0)

    return out.select(
        "codigo", F.substring(F.coalesce("descripcion", "codigo"), 1, 50)
        .alias("descripcion"), figure("_total", 0).alias("demanda_total"),
        figure("r2", 3).alias("r2"), figure("mae", 1).alias("mae"), "estado")


def mass_kpis(result: DataFrame) -> DataFrame:
    ok = F.col("estado") == "OK"
    return result.agg(
        F.count(F.lit(1)).alias("materiales"),
        F.sum("demanda_total").alias("demanda_total"),
        F.count_if(ok).alias("procesados"),
        F.coalesce(F.avg(F.when(ok, F.col("r2"))) * 100, F.lit(0.0)).alias("precision"),
        F.count_if(F.col("estado") == "Sin datos").alias("sin_datos"),
        F.count_if(F.col("estado").contains("Error")).alias("con_error"))
