"""Calendar features. Week days count from Monday = 0, weeks are ISO weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short week-day and month names used in reports.
WEEKDAY_LABELS = ["Lun", "Mar", "Mie", "Jue", "Vie", "Sab", "Dom"]
MONTH_LABELS = ["Ene", "Feb", "Mar", "Abr", "May", "Jun",
                "Jul", "Ago", "Sep", "Oct", "Nov", "Dic"]

MODEL_CALENDAR = ["dia_semana", "dia_mes", "mes", "trimestre", "mes_sin", "mes_cos",
                  "dia_sin", "dia_cos", "es_fin_mes", "es_inicio_mes"]


def _flag(c: Column) -> Column:
    return c.cast("int")


def _cycle(c: Column, period: int, name: str) -> dict[str, Column]:
    angle = F.lit(2.0) * F.pi() * c / F.lit(period)
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def calendar_columns(fecha: Column, consistent_flags: bool = True) -> dict[str, Column]:
    """Calendar of a date.

    ``consistent_flags=False`` gives the flags used at prediction time: month end from
    day 28 on, month start up to day 3.
    """
    day = F.dayofmonth(fecha)
    if consistent_flags:
        end, start = fecha == F.last_day(fecha), day == 1
    else:
        end, start = day >= 28, day <= 3
    return {
        "dia_semana": F.weekday(fecha),
        "dia_mes": day,
        "mes": F.month(fecha),
        "trimestre": F.quarter(fecha),
        "semana_ano": F.weekofyear(fecha),
        "es_fin_mes": _flag(end),
        "es_inicio_mes": _flag(start),
    }


def calendar_extended(fecha: Column) -> dict[str, Column]:
    return {
        "dia_ano": F.dayofyear(fecha),
        "es_fin_semana": _flag(F.weekday(fecha) >= 5),
        "dias_hasta_fin_mes": F.datediff(F.last_day(fecha), fecha),
    }


def cyclic_columns(fecha: Column, with_week: bool = False) -> dict[str, Column]:
    cols = {**_cycle(F.month(fecha), 12, "mes"), **_cycle(F.weekday(fecha), 7, "dia")}
    if with_week:
        cols.update(_cycle(F.weekofyear(fecha), 52, "semana"))
    return cols


def add_calendar(df: DataFrame, fecha: str = "fecha", *, extended: bool = False,
                 consistent_flags: bool = True) -> DataFrame:
    """Add the model calendar; ``extended`` adds day of year, week-end and week cycles."""
    f = F.col(fecha)
    cols = {**calendar_columns(f, consistent_flags), **cyclic_columns(f, extended)}
    if extended:
        cols.update(calendar_extended(f))
    return df.withColumns(cols)


def short_weekday(fecha: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in WEEKDAY_LABELS]), F.weekday(fecha) + 1)


def week_label(fecha: Column, iso_year: bool = False) -> Column:
    """``year-Www``. By default the calendar year stands beside the ISO week number, so the
    last days of December may read as week 1 of the closing year."""
    year = F.extract(F.lit("YEAROFWEEK"), fecha) if iso_year else F.year(fecha)
    return F.concat(year.cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(fecha).cast("string"), 2, "0"))
