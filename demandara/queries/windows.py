"""Queries: window features, baselines, calendar columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import windows as win
from . import fixtures as fx
from .registry import query, re, rounded

W = "PARTITION BY series_id ORDER BY fecha"


def _rows(k: int) -> str:
    return f"OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def _lag(k: int, col: str = "cantidad") -> str:
    return f"lag({col}, {k}) OVER ({W})"


@query("w01_lags", f"""
  SELECT series_id, fecha, cantidad, {_lag(1)} AS cantidad_lag_1,
         CASE WHEN n >= 7 THEN {_lag(7)} END AS cantidad_lag_7,
         CASE WHEN n >= 35 THEN {_lag(14)} END AS cantidad_lag_14,
         CASE WHEN n >= 35 THEN {_lag(30)} END AS cantidad_lag_30
  FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM serie_part)""",
       ("serie_part",))
def w01(spark, sf):
    return win.lag_features(fx.serie_part(spark, sf))


@query("w02_lags_extended", "SELECT series_id, fecha, cantidad, "
       + ", ".join(f"{_lag(k)} AS cantidad_lag_{k}" for k in win.EXTENDED_LAGS)
       + " FROM serie_part", ("serie_part",))
def w02(spark, sf):
    return win.lag_features_extended(fx.serie_part(spark, sf))


@query("w03_rolling_mean", f"""
  SELECT series_id, fecha, cantidad, {re(f'avg(cantidad) {_rows(7)}', 'cantidad_ma_7')},
         {re(f'avg(cantidad) {_rows(30)}', 'cantidad_ma_30')} FROM serie_part""",
       ("serie_part",))
def w03(spark, sf):
    return rounded(win.rolling_mean(fx.serie_part(spark, sf)), "cantidad_ma_7",
                   "cantidad_ma_30")


@query("w04_rolling_std", f"""
  SELECT series_id, fecha, cantidad,
         {re(f'stddev_samp(cantidad) {_rows(7)}', 'cantidad_std_7')} FROM serie_part""",
       ("serie_part",))
def w04(spark, sf):
    return rounded(win.rolling_std(fx.serie_part(spark, sf)), "cantidad_std_7")


@query("w05_rolling_extended", "SELECT series_id, fecha, cantidad, " + ", ".join(
    re(f"CASE WHEN n >= {k} THEN {fn}(cantidad) {_rows(k)} END", f"cantidad_{name}_{k}")
    for k in win.EXTENDED_WINDOWS for fn, name in (("avg", "ma"), ("stddev_samp", "std")))
    + " FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM serie_part)",
    ("serie_part",))
def w05(spark, sf):
    out = win.rolling_extended(fx.serie_part(spark, sf))
    return rounded(out, *[f"cantidad_{n}_{k}" for n in ("ma", "std")
                          for k in win.EXTENDED_WINDOWS])


@query("w06_diff", f"""
  SELECT series_id, fecha, cantidad, d AS cantidad_diff,
         cantidad - {_lag(7)} AS cantidad_diff_7, d - {_lag(1, 'd')} AS cantidad_accel
  FROM (SELECT *, cantidad - {_lag(1)} AS d FROM serie_part)""", ("serie_part",))
def w06(spark, sf):
    return win.differences(fx.serie_part(spark, sf))


def _ewm(span: int) -> str:
    r = 1 - 2 / (span + 1)
    return (f"CASE WHEN max(a.n) >= {span} THEN sum(b.cantidad * pow({r!r}, a.i - b.i)) "
            f"/ sum(pow({r!r}, a.i - b.i)) END")


@query("w07_ewma", f"""
  SELECT a.series_id, a.fecha, any_value(a.cantidad) AS cantidad, """
       + ", ".join(re(_ewm(s), f"cantidad_ewma_{s}") for s in win.EXTENDED_WINDOWS)
       + """ FROM num a JOIN num b ON a.series_id = b.series_id AND b.i <= a.i
  GROUP BY a.series_id, a.fecha""", ("serie_part",), {"num": f"""
  SELECT *, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY series_id) AS n
  FROM serie_part"""})
def w07(spark, sf):
    return rounded(win.ewma(fx.serie_part(spark, sf)),
                   *[f"cantidad_ewma_{s}" for s in win.EXTENDED_WINDOWS])


@query("w07_ewma_long_series", """
  SELECT a.series_id, a.fecha, any_value(a.cantidad) AS cantidad, """
       + ", ".join(re(_ewm(s), f"cantidad_ewma_{s}") for s in win.EXTENDED_WINDOWS)
       + """ FROM num a JOIN num b ON a.series_id = b.series_id AND b.i <= a.i
  GROUP BY a.series_id, a.fecha""", ("serie_brand",), {"num": f"""
  SELECT *, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY series_id) AS n
  FROM serie_brand"""})
def w07_long(spark, sf):
    return rounded(win.ewma(fx.serie_brand(spark, sf)),
                   *[f"cantidad_ewma_{s}" for s in win.EXTENDED_WINDOWS])


@query("w09_gap_detection", f"""
  SELECT series_id, inicio, fin FROM (
    SELECT series_id, lag(fecha) OVER ({W}) AS inicio, fecha AS fin FROM serie_part)
  WHERE date_diff('day', inicio, fin) > 7""", ("serie_part",))
def w09(spark, sf):
    return win.find_gaps(fx.serie_part(spark, sf))


@query("w10_duplicate_dates", """
  SELECT codigo AS series_id, count(fecha) - count(DISTINCT fecha) AS duplicados
  FROM brand_rows GROUP BY codigo""", ("brand_rows",))
def w10(spark, sf):
    return win.duplicate_dates(fx.brand_rows(spark, sf))


@query("w11_first_per_group", """
  SELECT * FROM mrp QUALIFY row_number() OVER (
    PARTITION BY codigo ORDER BY centro, almacen, sector) = 1""", ("mrp",))
def w11(spark, sf):
    from ..operators.joins import first_row_per_group
    from ..sources.scans import mrp_scan
    return first_row_per_group(mrp_scan(fx.mrp(spark, sf)), ["codigo"],
                               ["centro", "almacen", "sector"])


BASELINE = {"base_pred": f"""
  SELECT series_id, fecha, cantidad, n, p1 AS pred_naive,
         CASE WHEN n <= 7 THEN p1 ELSE p7 END AS pred_seasonal,
         CASE WHEN n <= 7 THEN p1 ELSE pm END AS pred_ma
  FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n, {_lag(1)} AS p1,
               {_lag(7)} AS p7,
               avg(cantidad) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS pm
        FROM SERIE)""", "base_err": """
  SELECT series_id, count(*) AS n, avg(abs(cantidad - pred_naive)) AS naive_mae,
         avg(abs(cantidad - pred_seasonal)) AS seasonal_mae,
         avg(abs(cantidad - pred_ma)) AS ma_mae
  FROM base_pred GROUP BY series_id"""}


def baseline_views(serie: str) -> dict[str, str]:
    return {k: v.replace("SERIE", serie) for k, v in BASELINE.items()}


def _baseline(key: str, column: str):
    @query(key, f"SELECT series_id, {re(column, column)} FROM base_err", ("serie_part",),
           baseline_views("serie_part"))
    def run(spark, sf):
        return rounded(win.baseline_errors(fx.serie_part(spark, sf))
                       .select("series_id", column), column)
    return run


w13 = _baseline("w13_naive_baseline", "naive_mae")
w14 = _baseline("w14_seasonal_naive", "seasonal_mae")
w15 = _baseline("w15_moving_avg_baseline", "ma_mae")

BEST_SQL = """
  SELECT series_id, CASE WHEN naive_mae IS NULL THEN NULL
    WHEN naive_mae <= seasonal_mae AND naive_mae <= ma_mae THEN 'naive'
    WHEN seasonal_mae <= ma_mae THEN 'seasonal' ELSE 'ma' END AS mejor_baseline
  FROM base_err"""


@query("w16_best_baseline", BEST_SQL, ("serie_part",), baseline_views("serie_part"))
def w16(spark, sf):
    return win.baseline_errors(fx.serie_part(spark, sf)).select("series_id",
                                                                "mejor_baseline")


@query("w12_rank_models", """
  SELECT series_id, modelo, round_even(mae, 4)::DOUBLE AS mae, row_number() OVER (
    PARTITION BY series_id ORDER BY round_even(mae, 4), modelo) AS posicion
  FROM (SELECT series_id, 'naive' AS modelo, naive_mae AS mae FROM base_err
        UNION ALL SELECT series_id, 'seasonal', seasonal_mae FROM base_err
        UNION ALL SELECT series_id, 'ma', ma_mae FROM base_err)""",
       ("serie_brand",), baseline_views("serie_brand"))
def w12(spark, sf):
    err = win.baseline_errors(fx.serie_brand(spark, sf))
    long = err.select("series_id", F.inline(F.array(*[
        F.struct(F.lit(m).alias("modelo"), F.bround(f"{m}_mae", 4).alias("mae"))
        for m in ("naive", "seasonal", "ma")])))
    return win.rank_models(long)


@query("w17_series_last", f"""
  SELECT series_id, fecha, cantidad, {re('ma', 'cantidad_ma_7')} FROM (
    SELECT *, avg(cantidad) {_rows(7)} AS ma FROM serie_part)
  QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY fecha DESC) = 1""",
       ("serie_part",))
def w17(spark, sf):
    feats = win.rolling_mean(fx.serie_part(spark, sf), (7,))
    return rounded(win.series_last(feats), "cantidad_ma_7")


SLOPE_SQL = f"""
  SELECT series_id, CASE WHEN max(n) >= 3
           THEN (arg_max(cantidad, fecha) - arg_min(cantidad, fecha)) / count(*) ELSE 0 END
           AS tendencia
  FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n,
               row_number() OVER (PARTITION BY series_id ORDER BY fecha DESC) AS r
        FROM SERIE) WHERE r <= 7 GROUP BY series_id"""


@query("w18_recent_slope", f"SELECT series_id, {re('tendencia', 'tendencia')} FROM pend",
       ("serie_part",), {"pend": SLOPE_SQL.replace("SERIE", "serie_part")})
def w18(spark, sf):
    return rounded(win.recent_slope(fx.serie_part(spark, sf)), "tendencia")


CAL = """isodow(fecha) - 1 AS dia_semana, day(fecha) AS dia_mes, month(fecha) AS mes,
         quarter(fecha) AS trimestre, week(fecha) AS semana_ano"""


@query("c02_calendar", f"""
  SELECT series_id, fecha, {CAL}, CAST(fecha = last_day(fecha) AS INT) AS es_fin_mes,
         CAST(day(fecha) = 1 AS INT) AS es_inicio_mes FROM serie_part""", ("serie_part",))
def c02(spark, sf):
    df = fx.serie_part(spark, sf)
    return df.select("series_id", "fecha", *[
        c.alias(n) for n, c in calendar.calendar_columns(F.col("fecha")).items()])


@query("c03_calendar_extended", """
  SELECT series_id, fecha, dayofyear(fecha) AS dia_ano,
         CAST(isodow(fecha) >= 6 AS INT) AS es_fin_semana,
         date_diff('day', fecha, last_day(fecha)) AS dias_hasta_fin_mes FROM serie_part""",
       ("serie_part",))
def c03(spark, sf):
    df = fx.serie_part(spark, sf)
    return df.select("series_id", "fecha", *[
        c.alias(n) for n, c in calendar.calendar_extended(F.col("fecha")).items()])


CYCLES = {"mes": ("month(fecha)", 12), "dia": ("(isodow(fecha) - 1)", 7),
          "semana": ("week(fecha)", 52)}


@query("c04_cyclic_encoding", "SELECT series_id, fecha, " + ", ".join(
    re(f"{fn}(2 * pi() * {e} / {p})", f"{n}_{fn}", 6)
    for n, (e, p) in CYCLES.items() for fn in ("sin", "cos")) + " FROM serie_part",
    ("serie_part",))
def c04(spark, sf):
    cols = calendar.cyclic_columns(F.col("fecha"), with_week=True)
    return fx.serie_part(spark, sf).select("series_id", "fecha", *[
        # adding 0.0 turns the -0.0 of rounded tiny sines into 0.0
        (F.bround(c, 6) + F.lit(0.0)).alias(n) for n, c in cols.items()])


@query("c05_prediction_calendar", f"""
  SELECT series_id, fecha, {CAL}, CAST(day(fecha) >= 28 AS INT) AS es_fin_mes,
         CAST(day(fecha) <= 3 AS INT) AS es_inicio_mes FROM serie_part""", ("serie_part",))
def c05(spark, sf):
    cols = calendar.calendar_columns(F.col("fecha"), consistent_flags=False)
    return fx.serie_part(spark, sf).select("series_id", "fecha", *[
        c.alias(n) for n, c in cols.items()])
