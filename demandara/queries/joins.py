"""Queries: joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import demand, joins
from ..sources import scans
from . import fixtures as fx
from .registry import query, re, rounded

CONSUMO_90 = """SELECT codigo, sum(cantidad) / 3.0 AS consumo_mensual FROM consumo
  WHERE fecha >= (SELECT max(fecha) FROM consumo) - INTERVAL 90 DAY GROUP BY codigo"""
PEDIDOS_AGG = """SELECT codigo, centro, sum(saldo_pendiente) AS cantidad_en_pedido,
  count(DISTINCT pedido) AS pedidos_activos, min(fecha_entrega) AS proxima_entrega
  FROM abiertos GROUP BY codigo, centro"""


def _stock_dia(spark, sf):
    return scans.stock_latest_day(fx.stock(spark, sf)).select(
        "codigo", "centro", "almacen", "stock_actual", "stock_seguridad", "punto_pedido",
        "stock_maximo", "consumo_mensual")


@query("j01_stock_mrp", """
  SELECT s.codigo, s.centro, s.almacen, s.stock_actual, sector,
         coalesce(stock_seguridad, 0) AS stock_seguridad,
         coalesce(punto_pedido, 0) AS punto_pedido, coalesce(stock_maximo, 0) AS stock_maximo
  FROM stock_dia s LEFT JOIN mrp m USING (codigo, centro, almacen)""", ("stock_dia", "mrp"))
def j01(spark, sf):
    return joins.with_mrp(_stock_dia(spark, sf), scans.mrp_scan(fx.mrp(spark, sf))).drop(
        "consumo_mensual")


@query("j02_stock_mrp_plant", """
  SELECT s.codigo, s.centro, s.almacen, s.stock_actual,
         coalesce(stock_seguridad, 0) AS stock_seguridad,
         coalesce(punto_pedido, 0) AS punto_pedido, coalesce(stock_maximo, 0) AS stock_maximo
  FROM stock_dia s LEFT JOIN mrp m ON s.codigo = m.codigo AND s.centro = m.centro""",
       ("stock_dia", "mrp"))
def j02(spark, sf):
    return joins.with_mrp_by_plant(
        _stock_dia(spark, sf), scans.mrp_scan(fx.mrp(spark, sf))).drop("consumo_mensual")


@query("j02_stock_mrp_plant_dedupe", """
  SELECT s.codigo, s.centro, s.almacen, s.stock_actual,
         coalesce(stock_seguridad, 0) AS stock_seguridad,
         coalesce(punto_pedido, 0) AS punto_pedido, coalesce(stock_maximo, 0) AS stock_maximo
  FROM stock_dia s LEFT JOIN (SELECT * FROM mrp QUALIFY row_number() OVER (
      PARTITION BY codigo, centro ORDER BY almacen) = 1) m
    ON s.codigo = m.codigo AND s.centro = m.centro""", ("stock_dia", "mrp"))
def j02_dedupe(spark, sf):
    return joins.with_mrp_by_plant(
        _stock_dia(spark, sf), scans.mrp_scan(fx.mrp(spark, sf)), dedupe=True).drop(
            "consumo_mensual")


@query("j03_stock_consumption", f"""
  SELECT s.codigo, s.centro, s.almacen, s.stock_actual,
         {re('coalesce(consumo_mensual, 0)', 'consumo_mensual')}
  FROM stock_dia s LEFT JOIN mensual USING (codigo)""",
       ("stock_dia", "consumo"), {"mensual": CONSUMO_90})
def j03(spark, sf):
    monthly = demand.monthly_average(fx.consumo(spark, sf))
    out = joins.with_consumption(_stock_dia(spark, sf), monthly)
    return rounded(out, "consumo_mensual").drop("stock_seguridad", "punto_pedido",
                                                "stock_maximo")


@query("j04_stock_orders", """
  SELECT s.codigo, s.centro, s.almacen, s.stock_actual,
         coalesce(cantidad_en_pedido, 0) AS cantidad_en_pedido,
         coalesce(pedidos_activos, 0) AS pedidos_activos, proxima_entrega
  FROM stock_dia s LEFT JOIN agregado USING (codigo, centro)""",
       ("stock_dia", "abiertos"), {"agregado": PEDIDOS_AGG})
def j04(spark, sf):
    orders = joins.orders_by_material(scans.open_orders(fx.pedidos(spark, sf)))
    return joins.with_open_orders(_stock_dia(spark, sf), orders).drop(
        "stock_seguridad", "punto_pedido", "stock_maximo", "consumo_mensual")


@query("j05_catalogue_first_mrp", """
  SELECT c.codigo, c.descripcion, c.costo_unitario, sector, stock_seguridad, punto_pedido,
         stock_maximo
  FROM (SELECT codigo, descripcion, precio_usd AS costo_unitario FROM materiales
        WHERE activo = 1) c
  LEFT JOIN (SELECT * FROM mrp QUALIFY row_number() OVER (
      PARTITION BY codigo ORDER BY centro, almacen, sector) = 1) USING (codigo)""",
       ("materiales", "mrp"))
def j05(spark, sf):
    catalogue = scans.catalogue_scan(fx.materiales(spark, sf)).select(
        "codigo", "descripcion", "costo_unitario")
    return joins.catalogue_first_mrp(catalogue, scans.mrp_scan(fx.mrp(spark, sf)))


@query("j06_code_in_list", """
  SELECT * FROM mrp WHERE codigo IN (
    SELECT codigo FROM materiales WHERE descripcion ILIKE '%blue%')""",
       ("materiales", "mrp"))
def j06(spark, sf):
    codes = fx.materiales(spark, sf).where(F.col("descripcion").ilike("%blue%"))
    return joins.mrp_for_codes(scans.mrp_scan(fx.mrp(spark, sf)), codes)


SHIFTED = {"prevision": """
  SELECT series_id, fecha + INTERVAL 7 DAY AS fecha, cantidad AS prediccion
  FROM serie_part"""}


def shifted_forecast(spark, sf):
    """A forecast to compare with: each day takes the quantity of seven days before."""
    return fx.serie_part(spark, sf).select(
        "series_id", F.date_add("fecha", 7).alias("fecha"),
        F.col("cantidad").alias("prediccion"))


def part_rows(spark, sf):
    """Raw quantity rows per part, several per day."""
    li = fx.table(spark, sf, "lineitem")
    return li.select(F.col("l_partkey").cast("string").alias("series_id"),
                     F.to_date("l_shipdate").alias("fecha"),
                     F.col("l_quantity").alias("cantidad"))


@query("j07_forecast_vs_actual", """
  SELECT p.series_id, CAST(p.fecha AS DATE) AS fecha, prediccion, s.cantidad AS real
  FROM prevision p JOIN serie_part s ON p.series_id = s.series_id AND p.fecha = s.fecha""",
       ("serie_part",), SHIFTED)
def j07(spark, sf):
    return joins.forecast_vs_actual(shifted_forecast(spark, sf), part_rows(spark, sf))


@query("j08_common_dates", """
  SELECT series_id, CAST(fecha AS DATE) AS fecha, prediccion FROM prevision
  WHERE EXISTS (SELECT 1 FROM serie_part s WHERE s.series_id = prevision.series_id
                AND s.fecha = prevision.fecha)""", ("serie_part",), SHIFTED)
def j08(spark, sf):
    return joins.at_common_dates(shifted_forecast(spark, sf), fx.serie_part(spark, sf))


@query("u03_common_dates", """
  SELECT series_id, CAST(fecha AS DATE) AS fecha FROM prevision
  INTERSECT SELECT series_id, fecha FROM serie_part""", ("serie_part",), SHIFTED)
def u03(spark, sf):
    return joins.common_dates(shifted_forecast(spark, sf), fx.serie_part(spark, sf))


EQUIVALENTS_SQL = """
  SELECT material_original AS buscado, material_equivalente AS codigo FROM equivalencias
  UNION ALL
  SELECT material_equivalente, material_original FROM equivalencias"""


@query("j09_equivalents", EQUIVALENTS_SQL, ("equivalencias",))
def j09(spark, sf):
    codes = fx.materiales(spark, sf).select("codigo")
    return joins.equivalents(codes, fx.equivalencias(spark, sf))


@query("u02_concat_equivalents", """
  SELECT buscado, count(*) AS equivalentes, min(codigo) AS primero FROM (
    SELECT material_original AS buscado, material_equivalente AS codigo FROM equivalencias
    UNION ALL
    SELECT material_equivalente, material_original FROM equivalencias) GROUP BY buscado""",
       ("equivalencias",))
def u02(spark, sf):
    return j09(spark, sf).groupBy("buscado").agg(
        F.count(F.lit(1)).alias("equivalentes"), F.min("codigo").alias("primero"))


@query("j10_horizon_expand", """
  SELECT series_id, ultima AS ultima_fecha, p.paso,
         CAST(ultima + to_days(CAST(p.paso AS INT)) AS DATE) AS fecha
  FROM (SELECT series_id, max(fecha) AS ultima FROM serie_part GROUP BY series_id),
       range(1, 31) p(paso)""", ("serie_part",))
def j10(spark, sf):
    last = fx.serie_part(spark, sf).groupBy("series_id").agg(
        F.max("fecha").alias("ultima_fecha"))
    return joins.horizon_days(last, 30)
