"""Demand aggregates. Every per-series window elsewhere starts from ``daily_demand``,
which leaves at most one row per series and calendar day: that bounds the size of any
window group however many raw rows a hot material has, because the sums combine before
the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import MONTH_LABELS, WEEKDAY_LABELS, add_calendar, week_label
from ..sources.scans import consumption_window


def finite(quantity: Column) -> Column:
    """As a double; null for what is no finite number."""
    value = quantity.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def daily_demand(rows: DataFrame, series: str = "codigo", fecha: str = "fecha",
                 cantidad: str = "cantidad") -> DataFrame:
    """(series_id, fecha, cantidad): total per day; a day with only nulls counts 0.

    Quantities that are no finite number count as null.
    """
    qty = finite(F.col(cantidad))
    return (rows.where(F.col(series).isNotNull() & F.col(fecha).isNotNull())
            .groupBy(F.col(series).alias("series_id"), F.col(fecha).alias("fecha"))
            .agg(F.coalesce(F.sum(qty), F.lit(0.0)).alias("cantidad")))


def fill_missing_days(daily: DataFrame) -> DataFrame:
    """Add the days without rows between the first and last day of each series, as 0."""
    days = (daily.groupBy("series_id")
            .agg(F.min("fecha").alias("a"), F.max("fecha").alias("b"))
            .select("series_id", F.explode(F.sequence("a", "b")).alias("fecha")))
    return (days.join(daily, ["series_id", "fecha"], "left")
            .select("series_id", "fecha", F.coalesce("cantidad", F.lit(0.0)).alias("cantidad")))


def monthly_average(consumo: DataFrame, dias: int = 90, by_plant: bool = False,
                    **filters) -> DataFrame:
    """Consumption of the last ``dias`` days divided by ``dias``/30, per material."""
    keys = ["codigo", "centro"] if by_plant else ["codigo"]
    window = consumption_window(consumo, dias=dias, **filters)
    return window.groupBy(*keys).agg(
        (F.sum("cantidad") / F.lit(dias / 30)).alias("consumo_mensual"))


def weekly_trend(consumo: DataFrame, dias: int = 180, iso_year: bool = False) -> DataFrame:
    window = consumption_window(consumo, dias=dias)
    return (window.groupBy("codigo", week_label(F.col("fecha"), iso_year).alias("periodo"))
            .agg(F.sum("cantidad").alias("consumo")))


def _pattern(daily: DataFrame, key, labels: list[str], first: int) -> DataFrame:
    """Mean per calendar slot and series; empty slots give null.

    Slots come from unfolding one aggregated row per series, so no join is needed.
    """
    means = [F.avg(F.when(key == i + first, F.col("cantidad"))) for i in range(len(labels))]
    slots = F.array(*[F.struct(F.lit(i + first).alias("numero"), F.lit(label).alias("etiqueta"),
                               m.alias("promedio"))
                      for i, (label, m) in enumerate(zip(labels, means))])
    return (daily.groupBy("series_id").agg(slots.alias("slots"))
            .select("series_id", F.inline("slots")))


def weekday_pattern(daily: DataFrame) -> DataFrame:
    return _pattern(daily, F.weekday("fecha"), WEEKDAY_LABELS, 0)


def month_pattern(daily: DataFrame) -> DataFrame:
    """Mean per month, labelled by the month number; months without data are left out."""
    return _pattern(daily, F.month("fecha"), MONTH_LABELS, 1).where("promedio is not null")


def ml_prep(consumo: DataFrame, dias: int = 365) -> DataFrame:
    """Daily totals of the last year with their basic calendar."""
    daily = daily_demand(consumption_window(consumo, dias=dias))
    return add_calendar(daily).select(
        "series_id", "fecha", "cantidad", "dia_semana", "dia_mes", "mes", "trimestre",
        "es_fin_mes")


def demand_stats(rows: DataFrame, key: str = "codigo") -> DataFrame:
    """Mean, sample deviation and variation of the quantities per material, over rows."""
    stats = rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("cantidad").alias("n"), F.avg("cantidad").alias("media"),
        F.stddev_samp("cantidad").alias("desviacion"))
    cv = F.when(F.col("media") > 0, F.try_divide("desviacion", "media")).otherwise(0.0)
    return stats.withColumn("cv", cv)
