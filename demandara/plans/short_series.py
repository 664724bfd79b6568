"""Fallback for short series: mean plus a damped slope, band from the deviation.

Everything is a grouped aggregate and column arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import horizon_days
from ..operators.windows import recent_slope

DAMPING = 0.1
BAND = 1.5


def short_stats(daily: DataFrame) -> DataFrame:
    """Mean, sample deviation, slope and last date of each series."""
    stats = daily.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("cantidad").alias("media"),
        F.stddev_samp("cantidad").alias("std"), F.max("fecha").alias("ultima_fecha"))
    return stats.join(recent_slope(daily), "series_id")


def has_spread() -> Column:
    return F.coalesce(F.col("std") > 0, F.lit(False))


def short_metrics(stats: DataFrame) -> DataFrame:
    """Nominal metrics of the fallback, from mean and deviation only."""
    mean, std = F.col("media"), F.col("std")
    cv = F.when(mean > 0, F.try_divide(std, mean)).otherwise(0.5)
    return stats.withColumns({
        "mae": F.when(has_spread(), std * 0.8).otherwise(mean * 0.2),
        "rmse": F.when(has_spread(), std).otherwise(mean * 0.25),
        "r2": F.coalesce(F.greatest(F.lit(0.0), 1 - cv), F.lit(0.0)),
        "mape": F.when(cv.isNotNull(), F.least(cv * 100, F.lit(50.0)))})


def short_forecast(stats: DataFrame, horizonte: int) -> DataFrame:
    days = horizon_days(stats, horizonte)
    pred = F.greatest(F.lit(0.0), F.col("media") + F.col("tendencia") * F.col("paso") * DAMPING)
    half = BAND * F.when(has_spread(), F.col("std")).otherwise(F.col("media") * 0.2)
    return days.select(
        "series_id", "paso", "fecha", pred.alias("prediccion"),
        F.greatest(F.lit(0.0), pred - half).alias("limite_inferior"),
        (pred + half).alias("limite_superior"))
