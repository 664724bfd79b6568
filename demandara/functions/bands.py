"""Reading aids: bands for R2, MAE, MAPE, quality and trend, and coverage text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds and names of the R2 scales, best first. ``strict`` scales
# require a value above the bound, the others at least the bound.
R2_SCALES = {
    "panel": (False, [(0.9, "excelente"), (0.8, "muy_buena"), (0.7, "buena"),
                      (0.5, "moderada"), (0.3, "baja")], "muy_baja"),
    "informe": (False, [(0.9, "excelente"), (0.7, "buena"), (0.5, "moderada")],
                "mejorable"),
    "comparacion": (True, [(0.8, "excelente"), (0.6, "buena"), (0.4, "moderada")], "baja"),
    "seleccion": (True, [(0.9, "excelente"), (0.7, "buena"), (0.5, "moderada")],
                  "limitada"),
    "resumen": (True, [(0.7, "alta"), (0.4, "moderada")], "baja"),
}

# Upper bounds (exclusive) of the error scales, best first.
MAE_ABSOLUTE = ([(10, "bajo"), (50, "moderado")], "alto")
MAE_RELATIVE = ([(5, "excelente"), (10, "muy_bueno"), (20, "aceptable")], "alto")
MAPE_SCALE = ([(10, "excelente"), (20, "muy_bueno"), (30, "aceptable"),
               (50, "mejorable")], "insuficiente")

# Lower bounds (inclusive) of the quality scales, best first.
QUALITY_REPORT = [(90, "excelente"), (70, "buena"), (50, "aceptable")]
QUALITY_PANEL = [(80, "excelente"), (60, "aceptable")]


def _descending(c: Column, steps, last: str, strict: bool = False) -> Column:
    out = None
    for bound, name in steps:
        cond = c > bound if strict else c >= bound
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(last)


def _ascending(c: Column, steps, last: str) -> Column:
    out = None
    for bound, name in steps:
        out = F.when(c < bound, name) if out is None else out.when(c < bound, name)
    return out.otherwise(last)


def r2_band(c: Column, scale: str) -> Column:
    strict, steps, last = R2_SCALES[scale]
    return _descending(c, steps, last, strict)


def mae_band(mae: Column, mean: Column | None = None) -> Column:
    absolute = _ascending(mae, *MAE_ABSOLUTE)
    if mean is None:
        return absolute
    relative = _ascending(F.try_divide(mae, mean) * 100, *MAE_RELATIVE)
    return F.when(mean.isNull() | (mean == 0), absolute).otherwise(relative)


def mape_band(c: Column) -> Column:
    return _ascending(c, *MAPE_SCALE)


def quality_band(c: Column, scale: str = "informe") -> Column:
    if scale == "informe":
        return _descending(c, QUALITY_REPORT, "insuficiente")
    return _descending(c, QUALITY_PANEL, "revisar")


def trend_pct(new: Column, old: Column) -> Column:
    """Change in percent; null where there is nothing to compare with."""
    return F.try_divide((new - old) * 100.0, F.when(old != 0, old))


def trend_direction(new: Column, old: Column) -> Column:
    pct = trend_pct(new, old)
    return F.when(pct > 0, "up").when(pct < 0, "down").otherwise("stable")


def trend_text(new: Column, old: Column) -> Column:
    pct = trend_pct(new, old)
    return (F.when(pct > 0, F.format_string("+%.1f%%", pct))
            .when(pct < 0, F.format_string("%.1f%%", pct)).otherwise("0%"))


def trend_word(pct: Column) -> Column:
    return F.when(pct > 5, "alza").when(pct < -5, "baja").otherwise("estable")


def coverage_label(days: Column) -> Column:
    """Days of cover as text: hours, days, months or years."""
    return (F.when(days.isNull() | (days == float("inf")), "∞")
            .when(days < 1, F.format_string("%dh", (days * 24).try_cast("int")))
            .when(days < 30, F.format_string("%dd", days.try_cast("int")))
            .when(days < 365, F.format_string("%.1fm", days / 30))
            .otherwise(F.format_string("%.1fa", days / 365)))


def stability(mae_std: Column, mae_mean: Column, limit: float = 0.5) -> Column:
    """Stable when the spread of MAE stays below ``limit`` times its mean."""
    return F.coalesce(F.try_divide(mae_std, F.when(mae_mean != 0, mae_mean)) < limit,
                      F.lit(True))
