"""Queries: error measures, back-tests, cross-validation, model choice, whole runs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import joins
from ..operators.windows import baseline_errors, baseline_predictions
from ..plans import backtest as bt
from ..plans import crossval, features, flow, metrics, trees
from . import fixtures as fx
from .joins import SHIFTED, part_rows, shifted_forecast
from .registry import query, re, rounded
from .windows import BEST_SQL, baseline_views

PAIRS = {**baseline_views("serie_part"), "pares": """
  SELECT series_id, CASE WHEN cantidad <= 10 THEN 0 ELSE cantidad END AS real,
         pred_ma AS prediccion FROM base_pred WHERE pred_ma IS NOT NULL"""}


def pairs(spark, sf):
    df = baseline_predictions(fx.serie_part(spark, sf)).where("pred_ma is not null")
    return df.select("series_id", F.when(F.col("cantidad") <= 10, 0.0)
                     .otherwise(F.col("cantidad")).alias("real"),
                     F.col("pred_ma").alias("prediccion"))


def _metrics_sql(mape: str, source: str = "pares") -> str:
    return f"""
  SELECT series_id, {re('avg(abs(prediccion - real))', 'mae')},
         {re('sqrt(avg((prediccion - real) ** 2))', 'rmse')},
         {re('''CASE WHEN count(*) <= 1 OR var_pop(real) = 0 THEN 0
                ELSE 1 - sum((prediccion - real) ** 2) / (var_pop(real) * count(*)) END''',
             'r2')},
         {re(f'100 * avg({mape})', 'mape')}
  FROM {source} GROUP BY series_id"""


METRIC_NAMES = ["mae", "rmse", "r2", "mape"]


@query("e01_metrics_train", _metrics_sql("abs((prediccion - real) / (real + 1))"),
       ("serie_part",), PAIRS)
def e01(spark, sf):
    return rounded(metrics.error_metrics(pairs(spark, sf), ["series_id"]), *METRIC_NAMES)


@query("e02_metrics_cv", _metrics_sql("abs((prediccion - real) / nullif(real, 0))"),
       ("serie_part",), PAIRS)
def e02(spark, sf):
    return rounded(metrics.error_metrics(pairs(spark, sf), ["series_id"], "sin_ceros"),
                   *METRIC_NAMES)


COMPARED = {**SHIFTED, "cruce": """
  SELECT p.series_id, CAST(p.fecha AS DATE) AS fecha, prediccion, s.cantidad AS real
  FROM prevision p JOIN serie_part s ON p.series_id = s.series_id AND p.fecha = s.fecha"""}


def compared(spark, sf):
    return joins.forecast_vs_actual(shifted_forecast(spark, sf), part_rows(spark, sf))


@query("e04_metrics_compare", f"""
  SELECT series_id, count(*) AS n_dias, {re('avg(abs(prediccion - real))', 'mae', 2)},
         {re('avg(abs(prediccion - real) / real) * 100', 'mape', 2)},
         {re('sqrt(avg((prediccion - real) ** 2))', 'rmse', 2)},
         {re('''CASE WHEN var_pop(real) = 0 THEN 0 ELSE
                1 - sum((prediccion - real) ** 2) / (var_pop(real) * count(*)) END''', 'r2', 4)}
  FROM cruce GROUP BY series_id""", ("serie_part",), COMPARED)
def e04(spark, sf):
    return metrics.compare_with_history(compared(spark, sf))


@query("e04_daily_errors", f"""
  SELECT series_id, fecha, prediccion, real, abs(prediccion - real) AS error,
         {re('abs(prediccion - real) / real * 100', 'error_pct')} FROM cruce""",
       ("serie_part",), COMPARED)
def e04_days(spark, sf):
    return rounded(metrics.daily_errors(compared(spark, sf)), "error_pct")


CUTS = {"limites": """SELECT series_id, max(fecha) AS mx, count(*) AS n FROM serie_brand
                      GROUP BY series_id""",
        "candidatos": """SELECT series_id, CAST(mx - to_days(CAST(30 + 30 * i AS INT)) AS DATE)
                           AS corte FROM limites, range(0, 5) r(i) WHERE n >= 90""",
        "cortes": """
  SELECT series_id, corte, n_train,
         row_number() OVER (PARTITION BY series_id ORDER BY corte) AS orden
  FROM (SELECT c.series_id, corte, count(*) FILTER (fecha < corte) AS n_train
        FROM candidatos c JOIN serie_brand s ON s.series_id = c.series_id
        GROUP BY c.series_id, corte)
  WHERE n_train >= 60"""}
VALIDATION = {**CUTS, "entrenamiento": """
  SELECT c.series_id, corte, cantidad, fecha, count(*) OVER k AS n,
         row_number() OVER (PARTITION BY c.series_id, corte ORDER BY fecha DESC) AS r
  FROM cortes c JOIN serie_brand s ON s.series_id = c.series_id AND fecha < corte
  WINDOW k AS (PARTITION BY c.series_id, corte)""", "ajuste": """
  SELECT series_id, corte, avg(cantidad) AS media,
         CASE WHEN max(n) >= 3 THEN (arg_max(cantidad, fecha) FILTER (r <= 7)
           - arg_min(cantidad, fecha) FILTER (r <= 7)) / count(*) FILTER (r <= 7) ELSE 0 END
           AS tendencia
  FROM entrenamiento GROUP BY series_id, corte""", "recorrido": """
  SELECT series_id, 'short' AS modelo, corte, n_train, dia, fecha, real,
         greatest(0, media + tendencia * dia * 0.1) AS prediccion
  FROM (SELECT c.series_id, c.corte, n_train, fecha, cantidad AS real, row_number() OVER (
                 PARTITION BY c.series_id, c.corte ORDER BY fecha) AS dia
        FROM cortes c JOIN serie_brand s ON s.series_id = c.series_id AND fecha >= corte
             AND fecha < corte + INTERVAL 30 DAY) JOIN ajuste USING (series_id, corte)""",
              "pasos": """
  SELECT series_id, modelo, corte, min(fecha) AS fecha_inicio_test,
         max(fecha) AS fecha_fin_test, max(n_train) AS n_train, count(*) AS n_test,
         avg(abs(prediccion - real)) AS mae, sqrt(avg((prediccion - real) ** 2)) AS rmse,
         100 * avg(abs(prediccion - real) / real) AS mape,
         CASE WHEN var_pop(real) = 0 THEN 0
              ELSE 1 - sum((prediccion - real) ** 2) / (var_pop(real) * count(*)) END AS r2
  FROM recorrido GROUP BY ALL"""}


@query("e05_cut_dates", "SELECT * FROM cortes", ("serie_brand",), CUTS)
def e05(spark, sf):
    return bt.cut_dates(fx.serie_brand(spark, sf))


@query("j11_walk_forward_split", """
  SELECT c.series_id, corte, CASE WHEN fecha < corte THEN 'train' ELSE 'test' END AS parte,
         count(*) AS filas, min(fecha) AS desde, max(fecha) AS hasta
  FROM cortes c JOIN serie_brand s ON s.series_id = c.series_id
   AND fecha < corte + INTERVAL 30 DAY GROUP BY ALL""", ("serie_brand",), CUTS)
def j11(spark, sf):
    daily = fx.serie_brand(spark, sf)
    split = joins.walk_forward_split(daily, bt.cut_dates(daily), 30)
    return split.groupBy("series_id", "corte", "parte").agg(
        F.count(F.lit(1)).alias("filas"), F.min("fecha").alias("desde"),
        F.max("fecha").alias("hasta"))


def short_walk(spark, sf):
    return bt.walk_forward(fx.serie_brand(spark, sf), "short")


@query("e06_walk_forward", f"""
  SELECT series_id, modelo, corte, n_train, dia, fecha, real, {re('prediccion', 'prediccion')}
  FROM recorrido""", ("serie_brand",), VALIDATION)
def e06(spark, sf):
    return rounded(short_walk(spark, sf), "prediccion")


@query("e06_walk_forward_linear")
def e06_linear(spark, sf):
    return bt.walk_forward(fx.serie_brand(spark, sf), "linear")


STEP_FLOATS = ["mae", "rmse", "mape", "r2"]


@query("e03_metrics_backtest", "SELECT series_id, modelo, corte, fecha_inicio_test, "
       "fecha_fin_test, n_train, n_test, " + ", ".join(re(c, c) for c in STEP_FLOATS)
       + " FROM pasos", ("serie_brand",), VALIDATION)
def e03(spark, sf):
    return rounded(bt.step_metrics(short_walk(spark, sf)), *STEP_FLOATS)


@query("e09_period_metrics", "SELECT series_id, modelo, corte, n_train, n_test, "
       + ", ".join(re(c, c) for c in STEP_FLOATS) + " FROM pasos", ("serie_brand",),
       VALIDATION)
def e09(spark, sf):
    return rounded(bt.period_metrics(bt.step_metrics(short_walk(spark, sf))), *STEP_FLOATS)


AGG = {"mae_mean": "avg(mae)", "mae_std": "stddev_pop(mae)", "mae_min": "min(mae)",
       "mae_max": "max(mae)", "rmse_mean": "avg(rmse)", "rmse_std": "stddev_pop(rmse)",
       "mape_mean": "avg(mape)", "mape_std": "stddev_pop(mape)", "r2_mean": "avg(r2)",
       "r2_std": "stddev_pop(r2)"}


@query("e07_backtest_aggregate", "SELECT series_id, modelo, "
       + ", ".join(re(v, k) for k, v in AGG.items()) + ", count(*) AS n_pasos_exitosos, "
       "coalesce(stddev_pop(mae) / nullif(avg(mae), 0) < 0.5, true) AS es_estable "
       "FROM pasos GROUP BY series_id, modelo", ("serie_brand",), VALIDATION)
def e07(spark, sf):
    return rounded(bt.aggregate_steps(bt.step_metrics(short_walk(spark, sf))), *AGG)


@query("e08_stability", """
  SELECT series_id, coalesce(s / nullif(m, 0) < 0.5, true) AS es_estable,
         r >= 0.7 AND coalesce(s * 100 / nullif(m, 0), 0) < 30 AS estable_pantalla
  FROM (SELECT series_id, avg(mae) AS m, stddev_pop(mae) AS s, avg(r2) AS r FROM pasos
        GROUP BY series_id)""", ("serie_brand",), VALIDATION)
def e08(spark, sf):
    agg = bt.aggregate_steps(bt.step_metrics(short_walk(spark, sf)))
    return bt.report_stability(agg).select("series_id", "es_estable", "estable_pantalla")


@query("e10_pred_vs_real", f"""
  SELECT series_id, modelo, corte, dia, {re('prediccion', 'prediccion')}, real,
         {re('abs(prediccion - real)', 'error')},
         {re('coalesce(abs(prediccion - real) / nullif(real, 0) * 100, 0)', 'error_pct')}
  FROM recorrido""", ("serie_brand",), VALIDATION)
def e10(spark, sf):
    return rounded(bt.predictions_vs_actuals(short_walk(spark, sf)), "prediccion", "error",
                   "error_pct")


@query("e11_compare_models")
def e11(spark, sf):
    return bt.compare_models(fx.serie_brand(spark, sf),
                             ["linear", "short", "naive", "prophet", "arima"])


@query("e06_walk_forward_trend")
def e06_trend(spark, sf):
    return bt.walk_forward(fx.serie_brand(spark, sf), "prophet")


@query("e06_walk_forward_seasonal_ar")
def e06_seasonal_ar(spark, sf):
    return bt.walk_forward(fx.serie_brand(spark, sf), "arima")


@query("e06_walk_forward_forest")
def e06_forest(spark, sf):
    return bt.walk_forward(fx.serie_brand(spark, sf), "random_forest", mode="causal",
                           trees=20, depth=5)


@query("e12_fold_table", """
  SELECT series_id, f AS fold, CAST(m - (5 - f) * (m // 6) AS INT) AS n_train,
         CAST(m // 6 AS INT) AS n_test
  FROM (SELECT series_id, count(*) - 30 AS m FROM serie_part GROUP BY series_id
        HAVING count(*) - 30 >= 10), range(0, 5) r(f)""", ("serie_part",))
def e12_folds(spark, sf):
    feats = features.feature_rows(fx.serie_part(spark, sf), lags="full")
    return crossval.fold_table(feats)


@query("e12_temporal_cv")
def e12(spark, sf):
    return crossval.temporal_cv(fx.serie_brand(spark, sf))


@query("e13_search_ridge")
def e13(spark, sf):
    return crossval.search_alpha(fx.serie_brand(spark, sf), "ridge")


@query("e13_search_lasso")
def e13_lasso(spark, sf):
    return crossval.search_alpha(fx.serie_brand(spark, sf), "lasso")


@query("e14_evaluate_params")
def e14(spark, sf):
    return crossval.evaluate_settings(fx.serie_brand(spark, sf), "ridge", {"alpha": 10.0})


SMALL = {"random_forest": replace(trees.CONFIGS["random_forest"], trees=20, depth=5),
         "gradient_boosting": replace(trees.CONFIGS["gradient_boosting"], trees=10, depth=3)}


@query("e15_auto_select")
def e15(spark, sf):
    return crossval.auto_select(fx.serie_brand(spark, sf), configs=SMALL)


@query("e20_baselines", f"""
  SELECT series_id, n, {re('naive_mae', 'naive_mae')}, {re('seasonal_mae', 'seasonal_mae')},
         {re('ma_mae', 'ma_mae')}, mejor_baseline,
         {re('(naive_mae - ma_mae) / nullif(naive_mae, 0) * 100', 'mejora_pct')}
  FROM base_err JOIN ({BEST_SQL}) USING (series_id)""", ("serie_brand",),
       baseline_views("serie_brand"))
def e20(spark, sf):
    err = baseline_errors(fx.serie_brand(spark, sf))
    better = F.try_divide((F.col("naive_mae") - F.col("ma_mae")) * 100,
                          F.when(F.col("naive_mae") > 0, F.col("naive_mae")))
    return rounded(err.withColumn("mejora_pct", better), "naive_mae", "seasonal_mae", "ma_mae",
                   "mejora_pct")


def run(spark, sf):
    return flow.run_forecast(fx.brand_rows(spark, sf),
                             flow.ForecastConfig(backtest=True, remover_outliers=True))


@query("m21_forecast_run")
def m21(spark, sf):
    r = flow.run_forecast(fx.consumo_rows(spark, sf).select("codigo", "fecha", "cantidad"))
    return r.estado.join(r.metricas, "series_id", "left")


@query("m21_forecast_run_predictions")
def m21_pred(spark, sf):
    return run(spark, sf).predicciones


@query("m21_forecast_run_backtest")
def m21_backtest(spark, sf):
    return run(spark, sf).backtest
