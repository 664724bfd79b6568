"""Queries: features, models and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import features as feat
from ..plans import forecast, ridge, seasonal_ar, short_series, trees, trend_season
from ..plans.recursive import recent_values
from ..session import materialise
from . import fixtures as fx
from .registry import query, re, rounded
from .windows import SLOPE_SQL, _lag, _rows

MATRIX = {"filas_n": """
  SELECT *, count(*) OVER (PARTITION BY series_id) AS n,
         avg(cantidad) OVER (PARTITION BY series_id) AS media,
         row_number() OVER (PARTITION BY series_id ORDER BY fecha) AS rn FROM serie_part""",
          "caracteristicas": f"""
  SELECT *, isodow(fecha) - 1 AS dia_semana, day(fecha) AS dia_mes, month(fecha) AS mes,
         quarter(fecha) AS trimestre, sin(2 * pi() * month(fecha) / 12) AS mes_sin,
         cos(2 * pi() * month(fecha) / 12) AS mes_cos,
         sin(2 * pi() * (isodow(fecha) - 1) / 7) AS dia_sin,
         cos(2 * pi() * (isodow(fecha) - 1) / 7) AS dia_cos,
         CAST(fecha = last_day(fecha) AS INT) AS es_fin_mes,
         CAST(day(fecha) = 1 AS INT) AS es_inicio_mes, {_lag(1)} AS cantidad_lag_1,
         CASE WHEN n >= 7 THEN {_lag(7)} END AS cantidad_lag_7,
         CASE WHEN n >= 35 THEN {_lag(14)} END AS cantidad_lag_14,
         CASE WHEN n >= 35 THEN {_lag(30)} END AS cantidad_lag_30,
         avg(cantidad) {_rows(7)} AS cantidad_ma_7,
         CASE WHEN n >= 30 THEN avg(cantidad) {_rows(30)} END AS cantidad_ma_30,
         stddev_samp(cantidad) {_rows(7)} AS cantidad_std_7,
         cantidad - {_lag(1)} AS cantidad_diff,
         CASE WHEN n >= 35 THEN 30 WHEN n >= 7 THEN 7 ELSE 1 END AS largo
  FROM filas_n""", "usables": """
  SELECT *, rn - largo AS u, n - largo AS m FROM caracteristicas WHERE rn > largo""",
          "partes": """
  SELECT *, u > m - n_test AS is_test, m < 4 OR u <= m - n_test AS is_train
  FROM (SELECT *, CASE WHEN m < 4 THEN 1 ELSE CAST(ceil(m * greatest(
          least(0.2::DOUBLE, (m - 3) / m::DOUBLE), 1 / m::DOUBLE)) AS INT) END AS n_test
        FROM usables)"""}


@query("m01_feature_matrix", "SELECT series_id, fecha, cantidad, "
       + ", ".join(re(c, c, 6) if c.startswith("cantidad_") or c[-3:] in ("sin", "cos") else c
                   for c in feat.FEATURES) + " FROM usables", ("serie_part",), MATRIX)
def m01(spark, sf):
    df = feat.feature_rows(fx.serie_part(spark, sf)).where("usable")
    return df.select("series_id", "fecha", "cantidad", *[
        (F.bround(c, 6) + F.lit(0.0)).alias(c)
        if c.startswith("cantidad_") or c[-3:] in ("sin", "cos") else F.col(c)
        for c in feat.FEATURES])


@query("m02_temporal_split", """
  SELECT series_id, fecha, u, m, is_train, is_test FROM partes""", ("serie_part",), MATRIX)
def m02(spark, sf):
    df = feat.temporal_split(feat.feature_rows(fx.serie_part(spark, sf)))
    return df.where("usable").select("series_id", "fecha", "u", "m", "is_train", "is_test")


@query("m04_scale", f"""
  SELECT series_id, feature, {re('avg(v)', 'media')},
         {re("CASE WHEN stddev_pop(v) > 1e-9 THEN stddev_pop(v) ELSE 1 END", 'escala')}
  FROM (UNPIVOT (SELECT series_id, COLUMNS(c -> c IN ({", ".join(repr(c) for c in feat.FEATURES)}))::DOUBLE
                 FROM partes WHERE is_train)
        ON COLUMNS(* EXCLUDE (series_id)) INTO NAME feature VALUE v)
  GROUP BY series_id, feature""".replace("c -> c", "lambda c: c"), ("serie_part",), MATRIX)
def m04(spark, sf):
    split = feat.temporal_split(feat.feature_rows(fx.serie_part(spark, sf)))
    out = rounded(feat.train_scale(split), "media", "escala")
    return out.withColumn("media", F.col("media") + F.lit(0.0))


SHORT = {"pend": SLOPE_SQL.replace("SERIE", "serie_part"), "est": """
  SELECT series_id, count(*) AS n, avg(cantidad) AS media, stddev_samp(cantidad) AS std,
         max(fecha) AS ultima, any_value(tendencia) AS tendencia
  FROM serie_part JOIN pend USING (series_id) GROUP BY series_id"""}
SHORT_METRICS_SQL = f"""
  SELECT series_id, {re('CASE WHEN std > 0 THEN std * 0.8 ELSE media * 0.2 END', 'mae')},
         {re('CASE WHEN std > 0 THEN std ELSE media * 0.25 END', 'rmse')},
         {re('coalesce(greatest(0, 1 - cv), 0)', 'r2')}, {re('least(cv * 100, 50)', 'mape')}
  FROM (SELECT *, CASE WHEN media > 0 THEN std / media ELSE 0.5 END AS cv FROM est)"""


@query("m03_short_series_metrics", SHORT_METRICS_SQL, ("serie_part",), SHORT)
def m03_metrics(spark, sf):
    out = short_series.short_metrics(short_series.short_stats(fx.serie_part(spark, sf)))
    return rounded(out.select("series_id", *forecast.METRICS), *forecast.METRICS)


def short_forecast(spark, sf, horizonte=30):
    return short_series.short_forecast(
        short_series.short_stats(fx.serie_part(spark, sf)), horizonte)


BANDS = ["prediccion", "limite_inferior", "limite_superior"]


@query("m03_short_series_fallback", f"""
  SELECT series_id, paso, CAST(ultima + to_days(CAST(paso AS INT)) AS DATE) AS fecha,
         {re('p', 'prediccion', 6)}, {re('greatest(0, p - h)', 'limite_inferior', 6)},
         {re('p + h', 'limite_superior', 6)}
  FROM (SELECT *, greatest(0, media + tendencia * paso * 0.1) AS p,
               1.5 * CASE WHEN std > 0 THEN std ELSE media * 0.2 END AS h
        FROM est, range(1, 31) r(paso))""", ("serie_part",), SHORT)
def m03(spark, sf):
    return rounded(short_forecast(spark, sf), *BANDS, places=6)


@query("m05_ridge_coefficients")
def m05(spark, sf):
    _, coefs = ridge.train(fx.serie_part(spark, sf))
    return coefs.select("series_id", "n_train", "intercepto", "coef")


@query("m05_ridge_test_metrics")
def m05_metrics(spark, sf):
    split, coefs = ridge.train(fx.serie_part(spark, sf))
    return ridge.evaluate(split, coefs)


@query("m05_ridge_causal")
def m05_causal(spark, sf):
    split, coefs = ridge.train(fx.serie_brand(spark, sf), mode="causal")
    return ridge.evaluate(split, coefs)


@query("m13_predict_ml")
def m13(spark, sf):
    split, coefs = ridge.train(fx.serie_part(spark, sf))
    return ridge.predict(ridge.start_points(split), coefs, 30)


@query("m13_predict_recursive")
def m13_recursive(spark, sf):
    split, coefs = ridge.train(fx.serie_part(spark, sf), mode="causal")
    return ridge.predict(ridge.start_points(split), coefs, 30, values=recent_values(split))


@query("m14_intervals_by_level", f"""
  SELECT series_id, paso, {re('p', 'prediccion', 6)},
         {re('greatest(0, p - 0.8225 * mae)', 'limite_inferior', 6)},
         {re('p + 0.8225 * mae', 'limite_superior', 6)}
  FROM (SELECT *, greatest(0, media + tendencia * paso * 0.1) AS p,
               CASE WHEN std > 0 THEN std * 0.8 ELSE media * 0.2 END AS mae
        FROM est, range(1, 31) r(paso))""", ("serie_part",), SHORT)
def m14(spark, sf):
    stats = short_series.short_stats(fx.serie_part(spark, sf))
    out = forecast.intervals_by_level(short_series.short_forecast(stats, 30),
                                      short_series.short_metrics(stats), 0.90)
    return rounded(out.drop("fecha"), *BANDS, places=6)


@query("m15_intervals_ui", f"""
  SELECT series_id, paso, {re('p', 'prediccion', 6)},
         {re('greatest(0, p - 0.588 * s)', 'limite_inferior', 6)},
         {re('p + 0.588 * s', 'limite_superior', 6)}
  FROM (SELECT *, stddev_samp(p) OVER (PARTITION BY series_id) AS s FROM (
          SELECT *, greatest(0, media + tendencia * paso * 0.1) AS p
          FROM est, range(1, 31) r(paso)))""", ("serie_part",), SHORT)
def m15(spark, sf):
    out = forecast.intervals_by_spread(short_forecast(spark, sf), 0.95)
    return rounded(out.drop("fecha"), *BANDS, places=6)


@query("p15_prediction_rows", f"""
  SELECT series_id, strftime(ultima + to_days(CAST(paso AS INT)), '%Y-%m-%d') AS fecha,
         {re('p', 'prediccion')}, {re('greatest(0, p - h)', 'limite_inferior')},
         {re('p + h', 'limite_superior')},
         ['Lun','Mar','Mie','Jue','Vie','Sab','Dom']
           [isodow(ultima + to_days(CAST(paso AS INT)))] AS dia_semana
  FROM (SELECT *, greatest(0, media + tendencia * paso * 0.1) AS p,
               1.5 * CASE WHEN std > 0 THEN std ELSE media * 0.2 END AS h
        FROM est, range(1, 8) r(paso))""", ("serie_part",), SHORT)
def p15(spark, sf):
    return rounded(forecast.prediction_rows(short_forecast(spark, sf, 7)), *BANDS)


@query("m16_feature_importance")
def m16(spark, sf):
    return ridge.importance(ridge.train(fx.serie_part(spark, sf))[1])


@query("l02_top_features")
def l02(spark, sf):
    total = ridge.importance(ridge.train(fx.serie_brand(spark, sf))[1]).groupBy(
        "feature").agg(F.avg("importance").alias("importance"))
    return total.orderBy(F.desc("importance"), "feature").limit(8)


def mass_result(spark, sf):
    codes = fx.materiales(spark, sf).select("codigo", "descripcion")
    return forecast.mass_forecast(codes, fx.serie_part(spark, sf), 30)


@query("m19_mass_forecast")
def m19(spark, sf):
    return mass_result(spark, sf)


MASS = {**SHORT, "masivo": f"""
  SELECT c.codigo, substr(c.descripcion, 1, 50) AS descripcion,
         coalesce(round_even(total, 0), 0)::DOUBLE AS demanda_total,
         coalesce(round_even(r2, 3), 0)::DOUBLE AS r2,
         coalesce(round_even(mae, 1), 0)::DOUBLE AS mae,
         CASE WHEN total IS NULL THEN 'Sin datos' ELSE 'OK' END AS estado
  FROM (SELECT codigo, descripcion FROM materiales
        UNION ALL SELECT 'sin-' || codigo, descripcion FROM materiales WHERE activo = 0) c
  LEFT JOIN (
    SELECT series_id, sum(greatest(0, media + tendencia * paso * 0.1)) AS total,
           any_value(coalesce(greatest(0, 1 - CASE WHEN media > 0 THEN std / media
                                              ELSE 0.5 END), 0)) AS r2,
           any_value(CASE WHEN std > 0 THEN std * 0.8 ELSE media * 0.2 END) AS mae
    FROM est, range(1, 31) r(paso) GROUP BY series_id) f ON c.codigo = f.series_id"""}


def short_mass(spark, sf):
    """Mass table from the short-series fallback for every series."""
    cat = fx.materiales(spark, sf)
    ghost = cat.where("activo = 0").select(F.concat(F.lit("sin-"), "codigo").alias("codigo"),
                                           "descripcion")
    codes = cat.select("codigo", "descripcion").unionByName(ghost)
    daily = fx.serie_part(spark, sf)
    stats = short_series.short_stats(daily)
    return forecast.mass_table(codes, short_series.short_forecast(stats, 30),
                               short_series.short_metrics(stats))


@query("m19_mass_forecast_short", "SELECT * FROM masivo", ("serie_part", "materiales"), MASS)
def m19_short(spark, sf):
    return short_mass(spark, sf)


@query("l07_mass_sort", "SELECT codigo, demanda_total, estado FROM masivo ORDER BY codigo",
       ("serie_part", "materiales"), MASS)
def l07(spark, sf):
    return short_mass(spark, sf).orderBy("codigo").select("codigo", "demanda_total", "estado")


@query("a11_mass_kpis", f"""
  SELECT count(*) AS materiales, sum(demanda_total) AS demanda_total,
         count(*) FILTER (estado = 'OK') AS procesados,
         {re("100 * avg(r2) FILTER (estado = 'OK')", 'precision')},
         count(*) FILTER (estado = 'Sin datos') AS sin_datos,
         count(*) FILTER (estado LIKE '%Error%') AS con_error
  FROM masivo""", ("serie_part", "materiales"), MASS)
def a11(spark, sf):
    return rounded(forecast.mass_kpis(short_mass(spark, sf)), "precision")


KPIS = ["demanda_total", "promedio_prediccion", "promedio_historico", "tendencia", "r2",
        "mae", "precision"]


@query("m20_forecast_kpis", f"""
  SELECT series_id, {re('total', 'demanda_total')}, {re('total / 30', 'promedio_prediccion')},
         {re('media', 'promedio_historico')}, {re('t', 'tendencia')}, {re('r', 'r2')},
         {re('e', 'mae')},
         CASE WHEN t > 5 THEN 'alza' WHEN t < -5 THEN 'baja' ELSE 'estable' END
           AS tendencia_texto,
         {re('CASE WHEN r > 0 THEN r END', 'precision')},
         CASE WHEN r > 0.7 THEN 'alta' WHEN r > 0.4 THEN 'moderada' ELSE 'baja' END
           AS precision_texto
  FROM (SELECT *, (total / 30 - media) * 100 / nullif(media, 0) AS t FROM (
      SELECT series_id, any_value(media) AS media,
             sum(greatest(0, media + tendencia * paso * 0.1)) AS total,
             any_value(greatest(0, 1 - std / media)) AS r, any_value(std * 0.8) AS e
      FROM est, range(1, 31) x(paso) GROUP BY series_id))""", ("serie_part",), SHORT)
def m20(spark, sf):
    daily = fx.serie_part(spark, sf)
    stats = short_series.short_stats(daily)
    out = forecast.forecast_kpis(short_series.short_forecast(stats, 30), daily,
                                 short_series.short_metrics(stats))
    return rounded(out, *KPIS)


def _tree_split(spark, sf, series=fx.serie_brand):
    return feat.temporal_split(feat.feature_rows(series(spark, sf)))


def _tree_query(key: str, name: str, series=fx.serie_brand):
    @query(key)
    def run(spark, sf):
        split = materialise(_tree_split(spark, sf, series))
        return trees.predict(split, trees.fit_trees(split, name), 30)
    return run


m06 = _tree_query("m06_random_forest", "random_forest")
m07 = _tree_query("m07_gradient_boosting", "gradient_boosting")
m08 = _tree_query("m08_boosted_regularised", "xgboost", fx.serie_part)


@query("m06_forest_test_metrics")
def m06_metrics(spark, sf):
    split = _tree_split(spark, sf)
    return trees.evaluate(split, trees.fit_trees(split, "random_forest"))


@query("m16_forest_importance")
def m16_trees(spark, sf):
    return trees.importance(trees.fit_trees(_tree_split(spark, sf), "random_forest"), spark)


@query("m09_trend_seasonality")
def m09(spark, sf):
    return trend_season.predict(fx.serie_brand(spark, sf), 30)


@query("m09_trend_test_metrics")
def m09_metrics(spark, sf):
    return trend_season.evaluate(fx.serie_part(spark, sf))


@query("m10_components")
def m10(spark, sf):
    return trend_season.components(fx.serie_brand(spark, sf))


@query("m11_seasonal_ar")
def m11(spark, sf):
    return seasonal_ar.predict(fx.serie_part(spark, sf), 30)


@query("m11_seasonal_ar_test_metrics")
def m11_metrics(spark, sf):
    return seasonal_ar.evaluate(fx.serie_brand(spark, sf))


@query("m12_diagnostics")
def m12(spark, sf):
    return seasonal_ar.diagnostics(seasonal_ar.fit_all(fx.serie_part(spark, sf)))


@query("m16_order_importance")
def m16_order(spark, sf):
    return seasonal_ar.importance(seasonal_ar.fit_all(fx.serie_part(spark, sf)))


@query("m16_component_importance", """
  SELECT series_id, f.feature, f.importance::DOUBLE AS importance
  FROM (SELECT series_id FROM serie_part GROUP BY series_id HAVING count(*) >= 10),
       (VALUES ('Estacionalidad Anual', 0.35), ('Estacionalidad Semanal', 0.30),
               ('Tendencia', 0.35)) f(feature, importance)""", ("serie_part",))
def m16_components(spark, sf):
    return trend_season.importance(fx.serie_part(spark, sf))
