"""Queries: scans, ingestion, sinks, projections, filters and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, quality
from ..sources import ingest, scans, search, sinks
from . import fixtures as fx
from .registry import query, re, rounded

DEFAULTS = ("0.0 AS stock_seguridad, 0.0 AS punto_pedido, 0.0 AS stock_maximo, "
            "0.0 AS consumo_mensual, 14 AS lead_time")


@query("s01_stock_scan", f"""
  SELECT codigo, descripcion, centro, centro_descripcion, almacen, stock_actual,
         costo_unitario, valor_inventario, unidad_medida, grupo_articulos,
         grupo_descripcion, proveedor, proveedor_descripcion, ubicacion, critico,
         inmovilizado, fecha_datos, {DEFAULTS}
  FROM stock WHERE stock_actual > 0""", ("stock",))
def s01(spark, sf):
    return scans.stock_scan(fx.stock(spark, sf), solo_con_stock=True)


@query("s02_stock_latest_day", f"""
  SELECT codigo, centro, almacen, descripcion, stock_actual,
         {re('costo_unitario', 'costo_unitario')}, {re('valor_inventario', 'valor_inventario')},
         unidad_medida, grupo_articulos, proveedor, critico, {DEFAULTS}
  FROM stock_dia""", ("stock_dia",))
def s02(spark, sf):
    return rounded(scans.stock_latest_day(fx.stock(spark, sf)), "costo_unitario",
                   "valor_inventario")


@query("s03_consumption_window", """
  SELECT * FROM consumo
  WHERE fecha >= (SELECT max(fecha) FROM consumo) - INTERVAL 365 DAY""", ("consumo",))
def s03(spark, sf):
    return scans.consumption_window(fx.consumo(spark, sf), dias=365)


@query("s04_catalogue_scan", """
  SELECT codigo, descripcion, descripcion_larga, grupo_articulos, unidad_medida,
         precio_usd AS costo_unitario, activo FROM materiales WHERE activo = 1""",
       ("materiales",))
def s04(spark, sf):
    return scans.catalogue_scan(fx.materiales(spark, sf))


@query("s05_equivalence_scan", """
  SELECT * FROM equivalencias
  WHERE material_original = (SELECT min(material_original) FROM equivalencias)
     OR material_equivalente = (SELECT min(material_original) FROM equivalencias)""",
       ("equivalencias",))
def s05(spark, sf):
    eq = fx.equivalencias(spark, sf)
    return scans.equivalence_scan(eq, eq.agg(F.min("material_original")).scalar())


@query("s06_mrp_scan", "SELECT * FROM mrp", ("mrp",))
def s06(spark, sf):
    return scans.mrp_scan(fx.mrp(spark, sf))


@query("s07_open_orders", "SELECT * FROM abiertos", ("abiertos",))
def s07(spark, sf):
    return scans.open_orders(fx.pedidos(spark, sf))


CRUDO_TYPED = """
  SELECT coalesce(try_strptime(fecha, '%-d/%-m/%Y'), try_strptime(fecha, '%Y-%m-%d')) AS f,
         nullif(trim(codigosap), '') AS codigo,
         CASE WHEN length(centro) >= 4 THEN centro ELSE lpad(centro, 4, '0') END AS centro,
         CASE WHEN length(almacen) >= 4 THEN almacen ELSE lpad(almacen, 4, '0') END AS almacen,
         TRY_CAST(cantidad AS DOUBLE) AS q, coalesce(descripcion, '') AS descripcion
  FROM crudo"""


@query("s08_ingest_consumption", """
  SELECT CAST(f AS DATE) AS fecha, codigo, centro, almacen, q AS cantidad, descripcion
  FROM tipado WHERE f IS NOT NULL AND codigo IS NOT NULL AND q IS NOT NULL""",
       ("crudo",), {"tipado": CRUDO_TYPED})
def s08_rows(spark, sf):
    return ingest.ingest_consumption(fx.consumo_crudo(spark, sf)).clean


@query("s08_ingest_findings", """
  SELECT count(*) AS filas, count(*) - count(f) AS fechas_invalidas,
         count(*) - count(codigo) AS sin_codigo, count(*) - count(q) AS cantidades_no_numericas,
         count(*) FILTER (q < 0) AS cantidades_negativas,
         count(*) FILTER (f IS NULL OR codigo IS NULL OR q IS NULL) AS filas_eliminadas,
         count(*) FILTER (f IS NOT NULL AND codigo IS NOT NULL AND q IS NOT NULL)
           AS filas_validas,
         count(f) = count(*) AND count(q) = count(*) AND count(*) FILTER (q < 0) = 0 AS exito,
         count(*) FILTER (f IS NOT NULL AND codigo IS NOT NULL AND q IS NOT NULL) < 10
           AS pocos_datos
  FROM tipado""", ("crudo",), {"tipado": CRUDO_TYPED})
def s08_findings(spark, sf):
    return ingest.ingest_consumption(fx.consumo_crudo(spark, sf)).findings


@query("s08_ingest_quarantine", """
  SELECT fecha_texto, codigo, centro, almacen, cantidad_texto, descripcion
  FROM (SELECT *, fecha AS fecha_texto, cantidad AS cantidad_texto,
               coalesce(try_strptime(fecha, '%-d/%-m/%Y'), try_strptime(fecha, '%Y-%m-%d')) AS f,
               TRY_CAST(cantidad AS DOUBLE) AS q
        FROM (SELECT fecha, nullif(trim(codigosap), '') AS codigo,
                     CASE WHEN length(centro) >= 4 THEN centro
                          ELSE lpad(centro, 4, '0') END AS centro,
                     CASE WHEN length(almacen) >= 4 THEN almacen
                          ELSE lpad(almacen, 4, '0') END AS almacen,
                     cantidad, coalesce(descripcion, '') AS descripcion FROM crudo))
  WHERE f IS NULL OR codigo IS NULL OR q IS NULL""", ("crudo",))
def s08_quarantine(spark, sf):
    bad = ingest.ingest_consumption(fx.consumo_crudo(spark, sf)).quarantine
    return bad.select("fecha_texto", "codigo", "centro", "almacen", "cantidad_texto",
                      "descripcion")


@query("s09_ingest_materials", """
  SELECT trim(codigo) AS codigo, descripcion, unidad_medida, grupo_articulos AS grupo
  FROM materiales""", ("materiales",))
def s09(spark, sf):
    raw = fx.materiales(spark, sf).select(
        F.concat(F.lit(" "), "codigo").alias("CodigoSAP"), F.col("descripcion").alias(
            "Descripcion "), F.col("unidad_medida").alias("Unidad_Medida"),
        F.col("grupo_articulos").alias("Grupo"))
    return ingest.ingest_materials(raw)


@query("s11_ingest_summary", """
  SELECT count(*) AS total_registros, count(DISTINCT codigo) AS materiales_unicos,
         count(DISTINCT centro) AS centros_unicos, count(DISTINCT almacen) AS almacenes_unicos,
         CAST(min(f) AS DATE) AS fecha_inicio, CAST(max(f) AS DATE) AS fecha_fin,
         date_diff('day', min(f), max(f)) AS dias_datos
  FROM tipado WHERE f IS NOT NULL AND codigo IS NOT NULL AND q IS NOT NULL""",
       ("crudo",), {"tipado": CRUDO_TYPED})
def s11(spark, sf):
    return ingest.ingest_consumption(fx.consumo_crudo(spark, sf)).summary


@query("s12_table_counts", """
  SELECT 'sap_stock' AS tabla, count(*) AS filas FROM stock
  UNION ALL SELECT 'sap_consumo_historico', count(*) FROM consumo
  UNION ALL SELECT 'sap_pedidos_sap', count(*) FROM pedidos
  UNION ALL SELECT 'sap_materiales_bbdd', count(*) FROM mrp
  UNION ALL SELECT 'catalogo_materiales', count(*) FROM materiales
  UNION ALL SELECT 'equivalencias', count(*) FROM equivalencias""",
       ("stock", "consumo", "pedidos", "mrp", "materiales", "equivalencias"))
def s12(spark, sf):
    return scans.table_counts({
        "sap_stock": fx.stock(spark, sf), "sap_consumo_historico": fx.consumo(spark, sf),
        "sap_pedidos_sap": fx.pedidos(spark, sf), "sap_materiales_bbdd": fx.mrp(spark, sf),
        "catalogo_materiales": fx.materiales(spark, sf),
        "equivalencias": fx.equivalencias(spark, sf)})


@query("p01_series_filter", """
  SELECT codigo, fecha, min(descripcion) AS descripcion, min(centro) AS centro,
         min(almacen) AS almacen, sum(cantidad) AS cantidad
  FROM consumo GROUP BY codigo, fecha""", ("consumo",))
def p01(spark, sf):
    return scans.series_rows(fx.consumo_rows(spark, sf), centro="Todos")


@query("p02_search_catalogue", """
  SELECT codigo, descripcion, precio_usd AS costo_unitario FROM materiales
  WHERE codigo ILIKE '%blue%' OR descripcion ILIKE '%blue%'
  ORDER BY codigo LIMIT 20""", ("materiales",))
def p02(spark, sf):
    return search.search_catalogue(fx.materiales(spark, sf), " BLUE; ")


@query("p03_search_with_mrp", """
  SELECT c.*, m.codigo IS NOT NULL AS tiene_mrp, m.sector,
         CAST(m.stock_seguridad AS INT) AS ss, CAST(m.punto_pedido AS INT) AS pp,
         CAST(m.stock_maximo AS INT) AS sm
  FROM (SELECT codigo, descripcion, descripcion_larga, grupo_articulos, unidad_medida,
               precio_usd FROM materiales
        WHERE activo = 1 AND (codigo ILIKE '%r_d%' OR descripcion ILIKE '%r_d%')
        ORDER BY codigo LIMIT 20) c
  LEFT JOIN (SELECT * FROM mrp QUALIFY row_number() OVER (
               PARTITION BY codigo ORDER BY centro, almacen, sector) = 1) m
    ON c.codigo = m.codigo""", ("materiales", "mrp"))
def p03(spark, sf):
    hits = search.search_with_mrp(fx.materiales(spark, sf),
                                  scans.mrp_scan(fx.mrp(spark, sf)), "r_d")
    return hits.select("*", "mrp_info.*").drop("mrp_info")


@query("p04_search_in_history", """
  SELECT min(codigo) AS codigo,
         substr((SELECT descripcion FROM hallados ORDER BY codigo, descripcion LIMIT 1), 1, 45)
           AS descripcion,
         count(DISTINCT codigo) AS coincidencias
  FROM hallados""", ("consumo",), {"hallados": """
  SELECT * FROM consumo WHERE regexp_matches(codigo, '1[0-4]', 'i')"""})
def p04(spark, sf):
    return search.search_history(fx.consumo_rows(spark, sf), "1[0-4]")


@query("p05_distinct_plants", "SELECT DISTINCT centro FROM stock", ("stock",))
def p05(spark, sf):
    return scans.distinct_plants(fx.stock(spark, sf))


@query("p06_distinct_warehouses", """
  SELECT DISTINCT almacen FROM consumo WHERE centro = '0003'""", ("consumo",))
def p06(spark, sf):
    return scans.distinct_warehouses(fx.consumo_rows(spark, sf), "0003")


@query("p07_distinct_groups", """
  SELECT DISTINCT grupo_articulos AS codigo, grupo_descripcion AS descripcion FROM stock""",
       ("stock",))
def p07(spark, sf):
    return scans.distinct_groups(fx.stock(spark, sf))


@query("p08_filter_values", """
  SELECT DISTINCT columna, trim(valor) AS valor FROM (
    SELECT 'centro' AS columna, centro AS valor FROM unido
    UNION ALL SELECT 'almacen', almacen FROM unido
    UNION ALL SELECT 'sector', sector FROM unido
    UNION ALL SELECT 'proveedor', proveedor FROM unido)
  WHERE valor IS NOT NULL AND lower(trim(valor)) NOT IN ('', 'nan', 'none')""",
       ("stock_dia", "mrp"), {"unido": """
  SELECT s.centro, s.almacen, m.sector, s.proveedor FROM stock_dia s LEFT JOIN mrp m
  USING (codigo, centro, almacen)"""})
def p08(spark, sf):
    from ..operators.joins import with_mrp
    board = with_mrp(scans.stock_latest_day(fx.stock(spark, sf)),
                     scans.mrp_scan(fx.mrp(spark, sf)))
    return scans.filter_values(board)


@query("p09_material_options", """
  SELECT codigo || ' - ' || substr(min(descripcion), 1, 40) AS label, codigo AS value,
         sum(cantidad) AS cantidad
  FROM consumo GROUP BY codigo""", ("consumo",))
def p09(spark, sf):
    return scans.material_options(fx.consumo_rows(spark, sf))


@query("p11_drop_incomplete", """
  SELECT count(*) AS filas,
         count(*) FILTER (fecha IS NULL OR codigosap IS NULL OR descripcion IS NULL)
           AS eliminadas FROM crudo""", ("crudo",))
def p11(spark, sf):
    from ..sources.schemas import lower_names
    return cleaning.incomplete_count(lower_names(fx.consumo_crudo(spark, sf)),
                                     ["fecha", "codigosap", "descripcion"])


@query("p12_numeric_clean", """
  SELECT codigosap, almacen, greatest(coalesce(TRY_CAST(cantidad AS DOUBLE), 0), 0)
           AS cantidad FROM crudo""", ("crudo",))
def p12(spark, sf):
    from ..sources.schemas import lower_names
    raw = lower_names(fx.consumo_crudo(spark, sf)).select("codigosap", "almacen", "cantidad")
    return cleaning.numeric_clean(raw, ["cantidad"], 0.0, clip_negative=True)


@query("p13_remove_outliers", """
  SELECT codigo, fecha, cantidad FROM event_rows JOIN (
    SELECT codigo, quantile_cont(cantidad, 0.25) AS q1, quantile_cont(cantidad, 0.75) AS q3
    FROM event_rows GROUP BY codigo) USING (codigo)
  WHERE cantidad BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""", ("event_rows",))
def p13(spark, sf):
    flagged = quality.flag_iqr(fx.event_rows(spark, sf), ["codigo"], "cantidad")
    return cleaning.remove_outliers(flagged).select("codigo", "fecha", "cantidad")


HOLES = {"huecos": """SELECT series_id, fecha,
  CASE WHEN dayofmonth(fecha) <= 4 THEN NULL ELSE cantidad END AS cantidad
  FROM serie_part"""}


def _with_holes(spark, sf):
    return fx.serie_part(spark, sf).withColumn(
        "cantidad", F.when(F.dayofmonth("fecha") > 4, F.col("cantidad")))


@query("p14_impute_median", f"""
  SELECT series_id, fecha, {re('coalesce(cantidad, median(cantidad) OVER (PARTITION BY series_id))', 'cantidad')}
  FROM huecos""", ("serie_part",), HOLES)
def p14_median(spark, sf):
    out = cleaning.impute(_with_holes(spark, sf), "cantidad", "median", ["series_id"])
    return rounded(out, "cantidad")


@query("p14_impute_mean", f"""
  SELECT series_id, fecha, {re('coalesce(cantidad, avg(cantidad) OVER ())', 'cantidad')}
  FROM huecos""", ("serie_part",), HOLES)
def p14_mean(spark, sf):
    return rounded(cleaning.impute(_with_holes(spark, sf), "cantidad", "mean"), "cantidad")


@query("p14_impute_ffill", """
  SELECT series_id, fecha, last_value(cantidad IGNORE NULLS) OVER (
    PARTITION BY series_id ORDER BY fecha
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cantidad FROM huecos""",
       ("serie_part",), HOLES)
def p14_ffill(spark, sf):
    return cleaning.impute(_with_holes(spark, sf), "cantidad", "ffill", ["series_id"])


@query("p14_impute_bfill", """
  SELECT series_id, fecha, first_value(cantidad IGNORE NULLS) OVER (
    PARTITION BY series_id ORDER BY fecha
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS cantidad FROM huecos""",
       ("serie_part",), HOLES)
def p14_bfill(spark, sf):
    return cleaning.impute(_with_holes(spark, sf), "cantidad", "bfill", ["series_id"])


@query("l03_material_cap", """
  SELECT codigo FROM consumo GROUP BY codigo ORDER BY min(fecha), codigo LIMIT 50""",
       ("consumo",))
def l03(spark, sf):
    return scans.material_cap(fx.consumo_rows(spark, sf), 50, position=F.col("fecha"))


@query("s13_sink_csv")
def s13(spark, sf):
    from .models import short_forecast
    return sinks.round_trip_csv(short_forecast(spark, sf))


@query("s15_sink_mass_result")
def s15(spark, sf):
    from .models import mass_result
    return sinks.round_trip_csv(sinks.mass_headers(mass_result(spark, sf)))
