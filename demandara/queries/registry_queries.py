"""Queries: model registry and model store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import baseline_predictions
from ..plans import flow, registry
from ..plans.metrics import error_metrics
from ..sources import sinks
from . import fixtures as fx
from .registry import query, re
from .windows import baseline_views

NOW = "2024-01-20 00:00:00"


def models(spark, sf) -> DataFrame:
    """One metadata row per brand and baseline, trained on a day set by the brand."""
    daily = fx.serie_brand(spark, sf)
    df = baseline_predictions(daily)
    long = df.select("series_id", F.col("cantidad").alias("real"), F.inline(F.array(*[
        F.struct(F.lit(m).alias("modelo"), F.col(f"pred_{m}").alias("prediccion"))
        for m in ("naive", "seasonal", "ma")]))).where("prediccion is not null")
    scores = error_metrics(long, ["series_id", "modelo"])
    scores = scores.withColumns({c: F.bround(c, 6) for c in ("mae", "rmse", "r2", "mape")})
    day = F.split_part("series_id", F.lit("#"), F.lit(2)).try_cast("int")
    trained = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(day)
    out = None
    for m in ("naive", "seasonal", "ma"):
        part = registry.metadata_rows(scores.where(F.col("modelo") == m), daily, m,
                                      trained_at=trained)
        out = part if out is None else out.unionByName(part)
    return out


META = {**baseline_views("serie_brand"), "modelos": """
  SELECT series_id || '-' || modelo AS model_id, series_id AS material,
         modelo AS modelo_tipo, CAST(TIMESTAMP '2024-01-01' + to_days(
           CAST(split_part(series_id, '#', 2) AS INT)) AS TIMESTAMP) AS fecha_entrenamiento,
         round_even(avg(abs(p - cantidad)), 6)::DOUBLE AS mae,
         round_even(sqrt(avg((p - cantidad) ** 2)), 6)::DOUBLE AS rmse,
         round_even(1 - sum((p - cantidad) ** 2) / (var_pop(cantidad) * count(*)), 6)::DOUBLE
           AS r2, any_value(n) AS n_muestras
  FROM (SELECT series_id, n, cantidad, 'naive' AS modelo, pred_naive AS p FROM base_pred
        UNION ALL SELECT series_id, n, cantidad, 'seasonal', pred_seasonal FROM base_pred
        UNION ALL SELECT series_id, n, cantidad, 'ma', pred_ma FROM base_pred)
  WHERE p IS NOT NULL GROUP BY series_id, modelo"""}
VIEWS = ("serie_brand",)


@query("l05_registry_list", """
  SELECT model_id, material, modelo_tipo, strftime(fecha_entrenamiento, '%Y-%m-%d') AS fecha,
         round_even(mae, 4)::DOUBLE AS mae, round_even(r2, 4)::DOUBLE AS r2, n_muestras
  FROM modelos WHERE modelo_tipo = 'ma'
  ORDER BY fecha_entrenamiento DESC, model_id LIMIT 20""", VIEWS, META)
def l05(spark, sf):
    out = registry.list_models(models(spark, sf), modelo_tipo="ma", limite=20)
    return out.select("model_id", "material", "modelo_tipo",
                      F.date_format("fecha_entrenamiento", "yyyy-MM-dd").alias("fecha"),
                      F.bround("mae", 4).alias("mae"), F.bround("r2", 4).alias("r2"),
                      "n_muestras")


BEST = """SELECT material, arg_min(model_id, (CASE WHEN mae > 0 THEN mae ELSE 'inf'::DOUBLE END,
            model_id)) AS model_id FROM modelos GROUP BY material"""


@query("l06_best_model", f"""
  SELECT m.material, m.model_id AS mejor_mae, r.model_id AS mejor_r2
  FROM ({BEST}) m JOIN (SELECT material, arg_min(model_id, (-r2, model_id)) AS model_id
                        FROM modelos GROUP BY material) r USING (material)""", VIEWS, META)
def l06(spark, sf):
    meta = models(spark, sf)
    by_mae = registry.best_models(meta, "mae").withColumnRenamed("model_id", "mejor_mae")
    by_r2 = registry.best_models(meta, "r2").withColumnRenamed("model_id", "mejor_r2")
    return by_mae.join(by_r2, "material")


@query("a13_registry_stats", """
  SELECT modelo_tipo, count(*) AS por_tipo, (SELECT count(*) FROM modelos) AS n_modelos,
         (SELECT count(DISTINCT material) FROM modelos) AS n_materiales
  FROM modelos GROUP BY modelo_tipo""", VIEWS, META)
def a13(spark, sf):
    return registry.registry_stats(models(spark, sf))


@query("e17_registry_metadata", f"""
  SELECT model_id, material, modelo_tipo, n_muestras, {re('mae', 'mae')}, {re('r2', 'r2')},
         '1.0' AS version, 'Modelo para ' || material || ' - Horizonte 30 días' AS descripcion
  FROM modelos""", VIEWS, META)
def e17(spark, sf):
    return models(spark, sf).select(
        "model_id", "material", "modelo_tipo", "n_muestras",
        F.bround(F.col("metricas")["mae"], 4).alias("mae"),
        F.bround(F.col("metricas")["r2"], 4).alias("r2"), "version", "descripcion")


@query("e18_compare_saved", """
  SELECT *, CASE
      WHEN mejor_mae = mejor_rmse AND (mejor_r2 IS NULL OR mejor_mae = mejor_r2)
        THEN 'El modelo ' || mejor_mae || ' es el mejor en todas las métricas.'
      WHEN mejor_mae = mejor_r2
        THEN 'Recomendado: ' || mejor_mae || ' (mejor en MAE y R²).'
      ELSE concat_ws(' ', 'Por precisión (MAE): ' || mejor_mae || '.',
                     'Por ajuste (R²): ' || mejor_r2 || '.') END AS recomendacion
  FROM (SELECT material, count(*) AS n_modelos,
               CASE WHEN min(mae) > 0 THEN arg_min(model_id, (mae, model_id)) END AS mejor_mae,
               CASE WHEN min(rmse) > 0 THEN arg_min(model_id, (rmse, model_id)) END
                 AS mejor_rmse,
               CASE WHEN max(r2) > 0 THEN arg_min(model_id, (-r2, model_id)) END AS mejor_r2
        FROM modelos GROUP BY material)""", VIEWS, META)
def e18(spark, sf):
    return registry.compare_saved(models(spark, sf), ["material"])


@query("e19_purge_old", f"""
  SELECT model_id, material FROM modelos
  WHERE fecha_entrenamiento < TIMESTAMP '{NOW}' - INTERVAL 7 DAY
    AND model_id NOT IN (SELECT model_id FROM ({BEST}))""", VIEWS, META)
def e19(spark, sf):
    now = F.lit(NOW).cast("timestamp")
    return registry.old_models(models(spark, sf), 7, now=now).select("model_id", "material")


def _saved(spark, sf, modelo="linear"):
    store = registry.ModelStore(spark, sinks.scratch_folder(spark))
    daily = fx.serie_part(spark, sf)
    return store, flow.save_run(store, daily, modelo=modelo), daily


@query("s16_model_store")
def s16(spark, sf):
    store, run_id, _ = _saved(spark, sf)
    return store.run_metadata(run_id).select("model_id", "material", "modelo_tipo",
                                             "n_muestras", "rango_datos")


@query("m22_predict_from_saved")
def m22(spark, sf):
    store, run_id, daily = _saved(spark, sf)
    return flow.predict_from_saved(store, run_id, daily)


@query("m22_predict_from_saved_orders")
def m22_orders(spark, sf):
    store, run_id, daily = _saved(spark, sf, "arima")
    return flow.predict_from_saved(store, run_id, daily)


@query("s14_sink_report_tables")
def s14(spark, sf):
    from .models import short_forecast
    from ..plans.short_series import short_metrics, short_stats
    path = sinks.scratch_folder(spark)
    daily = fx.serie_part(spark, sf)
    written = sinks.write_report(path, "r1", short_forecast(spark, sf),
                                 short_metrics(short_stats(daily)), historico=daily)
    return spark.read.parquet(written["metricas"])
