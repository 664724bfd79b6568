"""Queries: demand aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import demand, quality
from ..session import ensure_checkpoint_dir
from ..streaming.daily import merge_batch, read_kept
from . import fixtures as fx
from .joins import CONSUMO_90, PEDIDOS_AGG, part_rows  # noqa: F401
from .registry import query, re, rounded


@query("a01_daily_demand", "SELECT * FROM serie_part", ("serie_part",))
def a01(spark, sf):
    return demand.daily_demand(part_rows(spark, sf), "series_id")


@query("a01_daily_demand_filled", """
  SELECT d.series_id, d.fecha, coalesce(s.cantidad, 0) AS cantidad
  FROM (SELECT series_id, CAST(unnest(generate_series(CAST(min(fecha) AS TIMESTAMP),
               CAST(max(fecha) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS fecha
        FROM serie_brand GROUP BY series_id) d
  LEFT JOIN serie_brand s ON d.series_id = s.series_id AND d.fecha = s.fecha""",
       ("serie_brand",))
def a01_filled(spark, sf):
    return demand.fill_missing_days(fx.serie_brand(spark, sf))


@query("a01_daily_demand_kept", """
  SELECT event_type AS series_id, CAST(ts AS DATE) AS fecha,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS cantidad
  FROM events GROUP BY ALL""")
def a01_kept(spark, sf):
    """All events in two batches that share their days; the second one comes twice."""
    rows = fx.table(spark, sf, "events").select(
        F.col("event_type").alias("codigo"), "ts",
        F.round(F.col("value") * 100).cast("long").alias("cantidad"))
    path = f"{ensure_checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}"
    first = F.pmod(F.hash("ts", "cantidad"), F.lit(2)) == 0
    for lote, part in ((0, rows.where(first)), (1, rows.where(~first)), (1, rows.where(~first))):
        merge_batch(part, lote, path)
    return read_kept(spark, path)


@query("a02_monthly_average", f"SELECT codigo, {re('consumo_mensual', 'consumo_mensual')} "
       "FROM mensual", ("consumo",), {"mensual": CONSUMO_90})
def a02(spark, sf):
    return rounded(demand.monthly_average(fx.consumo(spark, sf)), "consumo_mensual")


@query("a03_weekly_trend", """
  SELECT codigo, year(fecha)::VARCHAR || '-W' || lpad(week(fecha)::VARCHAR, 2, '0') AS periodo,
         sum(cantidad) AS consumo
  FROM consumo WHERE fecha >= (SELECT max(fecha) FROM consumo) - INTERVAL 180 DAY
  GROUP BY ALL""", ("consumo",))
def a03(spark, sf):
    return demand.weekly_trend(fx.consumo(spark, sf))


@query("a03_weekly_trend_iso_year", """
  SELECT codigo, isoyear(fecha)::VARCHAR || '-W' || lpad(week(fecha)::VARCHAR, 2, '0')
           AS periodo, sum(cantidad) AS consumo
  FROM consumo WHERE fecha >= (SELECT max(fecha) FROM consumo) - INTERVAL 730 DAY
  GROUP BY ALL""", ("consumo",))
def a03_iso(spark, sf):
    return demand.weekly_trend(fx.consumo(spark, sf), dias=730, iso_year=True)


@query("a04_weekday_pattern", f"""
  SELECT s.series_id, d.numero, d.etiqueta, {re('p', 'promedio')}
  FROM (SELECT DISTINCT series_id FROM serie_part) s
  CROSS JOIN (VALUES (0,'Lun'),(1,'Mar'),(2,'Mie'),(3,'Jue'),(4,'Vie'),(5,'Sab'),(6,'Dom'))
    d(numero, etiqueta)
  LEFT JOIN (SELECT series_id, isodow(fecha) - 1 AS numero, avg(cantidad) AS p
             FROM serie_part GROUP BY ALL) m
    ON s.series_id = m.series_id AND d.numero = m.numero""", ("serie_part",))
def a04(spark, sf):
    return rounded(demand.weekday_pattern(fx.serie_part(spark, sf)), "promedio")


@query("a05_month_pattern", f"""
  SELECT series_id, month(fecha) AS numero,
         ['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic']
           [month(fecha)] AS etiqueta, {re('avg(cantidad)', 'promedio')}
  FROM serie_part GROUP BY series_id, month(fecha)""", ("serie_part",))
def a05(spark, sf):
    return rounded(demand.month_pattern(fx.serie_part(spark, sf)), "promedio")


@query("a09_completeness", f"""
  SELECT columna, {re('100.0 * c / n', 'completitud')}, n - c AS faltantes,
         CASE WHEN 100.0 * c / n < 50 THEN 'error' WHEN 100.0 * c / n < 80 THEN 'warning' END
           AS severidad
  FROM (SELECT 'codigo' AS columna, count(codigo) AS c, count(*) AS n FROM huecos
        UNION ALL SELECT 'fecha', count(fecha), count(*) FROM huecos
        UNION ALL SELECT 'sector', count(sector), count(*) FROM huecos
        UNION ALL SELECT 'cantidad', count(cantidad), count(*) FROM huecos)""",
       ("base",), {"huecos": """
  SELECT codigo, fecha, CASE WHEN p_size > 12 THEN p_type END AS sector,
         CASE WHEN l_quantity > 30 THEN l_quantity END AS cantidad FROM base"""})
def a09(spark, sf):
    rows = fx.base(spark, sf).select(
        "codigo", "fecha", F.when(F.col("p_size") > 12, F.col("p_type")).alias("sector"),
        F.when(F.col("l_quantity") > 30, F.col("l_quantity")).alias("cantidad"))
    return rounded(quality.completeness(rows), "completitud")


@query("a10_quantity_stats", f"""
  SELECT codigo, count(*) AS n, min(stock_actual) AS minimo, max(stock_actual) AS maximo,
         {re('avg(stock_actual)', 'media')}, {re('stddev_samp(stock_actual)', 'std')},
         sum(stock_actual) AS suma, count(*) FILTER (stock_actual = 0) AS ceros,
         count(*) FILTER (stock_actual < 0) AS negativos, 0 AS nulos,
         {re('median(stock_actual)', 'mediana')}
  FROM stock GROUP BY codigo""", ("stock",))
def a10(spark, sf):
    rows = fx.stock(spark, sf).select(F.col("material").alias("codigo"),
                                      F.col("stock").alias("cantidad"))
    return rounded(quality.quantity_stats(rows, ["codigo"]), "media", "std", "mediana")


@query("a14_demand_stats", f"""
  SELECT codigo, count(cantidad) AS n, {re('avg(cantidad)', 'media')},
         {re('stddev_samp(cantidad)', 'desviacion')},
         {re('CASE WHEN avg(cantidad) > 0 THEN stddev_samp(cantidad) / avg(cantidad) ELSE 0 END', 'cv')}
  FROM consumo GROUP BY codigo""", ("consumo",))
def a14(spark, sf):
    return rounded(demand.demand_stats(fx.consumo_rows(spark, sf)), "media", "desviacion",
                   "cv")


@query("m18_ml_prep", """
  SELECT codigo AS series_id, fecha, sum(cantidad) AS cantidad, isodow(fecha) - 1 AS dia_semana,
         day(fecha) AS dia_mes, month(fecha) AS mes, quarter(fecha) AS trimestre,
         CAST(fecha = last_day(fecha) AS INT) AS es_fin_mes
  FROM consumo WHERE fecha >= (SELECT max(fecha) FROM consumo) - INTERVAL 365 DAY
  GROUP BY codigo, fecha""", ("consumo",))
def m18(spark, sf):
    return demand.ml_prep(fx.consumo(spark, sf))
