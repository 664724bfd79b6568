"""Queries: alert board, summaries, policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import demand, inventory, joins
from ..sources import scans
from . import fixtures as fx
from .joins import CONSUMO_90, PEDIDOS_AGG
from .registry import query, re, rounded

BOARD_VIEWS = ("stock_dia", "mrp", "consumo", "abiertos")
BOARD = {"mensual": CONSUMO_90, "agregado": PEDIDOS_AGG, "unido": """
  SELECT s.*, m.sector, coalesce(m.stock_seguridad, 0) AS ss0,
         coalesce(m.punto_pedido, 0) AS pp0, coalesce(m.stock_maximo, 0) AS sm0,
         coalesce(c.consumo_mensual, 0) AS consumo_mensual,
         coalesce(c.consumo_mensual, 0) / 30 AS consumo_diario,
         coalesce(p.cantidad_en_pedido, 0) AS cantidad_en_pedido,
         coalesce(p.pedidos_activos, 0) AS pedidos_activos, p.proxima_entrega
  FROM stock_dia s LEFT JOIN mrp m USING (codigo, centro, almacen)
  LEFT JOIN mensual c USING (codigo) LEFT JOIN agregado p USING (codigo, centro)""",
         "estimado": """
  SELECT * EXCLUDE (ss0, pp0, sm0),
         CASE WHEN pp0 = 0 AND consumo_mensual > 0 THEN consumo_diario * 14 ELSE ss0 END
           AS stock_seguridad,
         CASE WHEN pp0 = 0 AND consumo_mensual > 0
              THEN consumo_diario * 14 + consumo_diario * 14 ELSE pp0 END AS punto_pedido,
         CASE WHEN pp0 = 0 AND consumo_mensual > 0
              THEN (consumo_diario * 14 + consumo_diario * 14) * 2 ELSE sm0 END AS stock_maximo
  FROM unido""", "tablero": """
  SELECT *, CASE WHEN stock_actual > stock_maximo AND stock_maximo > 0 THEN 'sobre_maximo'
              WHEN stock_actual > stock_seguridad AND stock_actual <= punto_pedido
                   AND punto_pedido > 0 THEN 'bajo_punto_pedido'
              WHEN stock_actual > 0 AND stock_actual <= stock_seguridad
                   AND stock_seguridad > 0 THEN 'bajo_seguridad'
              WHEN stock_actual <= 0 THEN 'quiebre' ELSE 'normal' END AS estado,
         least(CASE WHEN consumo_diario > 0 THEN stock_actual / consumo_diario ELSE 0 END, 365)
           AS dias_stock,
         stock_actual + cantidad_en_pedido AS stock_proyectado,
         CAST(punto_pedido > 0 AS INT) AS tiene_mrp, 14 AS lead_time
  FROM estimado"""}
FLOATS = ["costo_unitario", "valor_inventario", "consumo_mensual", "consumo_diario",
          "stock_seguridad", "punto_pedido", "stock_maximo", "dias_stock"]
BOARD_SELECT = ("SELECT * REPLACE (" + ", ".join(re(c, c) for c in FLOATS) + ") FROM tablero")


def board(spark, sf, **kw):
    return inventory.alert_board(fx.stock(spark, sf), fx.mrp(spark, sf),
                                 fx.consumo(spark, sf), fx.pedidos(spark, sf), **kw)


@query("a12_alert_board", BOARD_SELECT, BOARD_VIEWS, BOARD)
def a12(spark, sf):
    return rounded(board(spark, sf), *FLOATS)


@query("l04_alert_trim", """
  SELECT codigo, centro, almacen, estado, tiene_mrp FROM tablero
  ORDER BY CASE WHEN estado <> 'normal' THEN 0 WHEN tiene_mrp = 1 THEN 1 ELSE 2 END,
           valor_inventario DESC, codigo, centro, almacen LIMIT 500""", BOARD_VIEWS, BOARD)
def l04(spark, sf):
    return board(spark, sf, limite=500).select("codigo", "centro", "almacen", "estado",
                                               "tiene_mrp")


@query("u01_concat_priority", """
  SELECT CASE WHEN estado <> 'normal' THEN 0 WHEN tiene_mrp = 1 THEN 1 ELSE 2 END AS grupo,
         codigo, centro, almacen, estado FROM tablero""", BOARD_VIEWS, BOARD)
def u01(spark, sf):
    return inventory.priority_union(board(spark, sf)).select(
        "grupo", "codigo", "centro", "almacen", "estado")


@query("c01_stock_state", """
  SELECT estado, tiene_mrp, count(*) AS filas FROM tablero GROUP BY ALL""",
       BOARD_VIEWS, BOARD)
def c01(spark, sf):
    return board(spark, sf).groupBy("estado", "tiene_mrp").agg(
        F.count(F.lit(1)).alias("filas"))


@query("i06_estimated_parameters", f"""
  SELECT codigo, centro, almacen, {re('stock_seguridad', 'stock_seguridad')},
         {re('punto_pedido', 'punto_pedido')}, {re('stock_maximo', 'stock_maximo')}
  FROM estimado WHERE sector IS NULL""", BOARD_VIEWS, BOARD)
def i06(spark, sf):
    df = board(spark, sf).where("sector IS NULL").select(
        "codigo", "centro", "almacen", "stock_seguridad", "punto_pedido", "stock_maximo")
    return rounded(df, "stock_seguridad", "punto_pedido", "stock_maximo")


SUMMARY_SQL = f"""
  SELECT count(*) AS total_materiales, count(*) AS total_registros_stock,
         {re('sum(valor_inventario)', 'valor_total_inventario', 2)},
         count(DISTINCT centro) AS centros_unicos, count(DISTINCT almacen) AS almacenes_unicos,
         count(*) FILTER (s > 0) AS materiales_con_stock,
         count(*) FILTER (s <= 0) AS materiales_sin_stock,
         count(*) FILTER (s <= 0) AS quiebres,
         count(*) FILTER (s > 0 AND s <= ss AND ss > 0) AS bajo_stock_seguridad,
         count(*) FILTER (s > ss AND s <= pp AND pp > 0) AS bajo_punto_pedido,
         count(*) FILTER (s > sm AND sm > 0) AS sobre_stock_maximo,
         (SELECT count(*) FROM mrp) AS materiales_con_mrp
  FROM (SELECT d.centro, d.almacen, valor_inventario, stock_actual AS s,
               coalesce(stock_seguridad, 0) AS ss, coalesce(punto_pedido, 0) AS pp,
               coalesce(stock_maximo, 0) AS sm
        FROM stock_dia d LEFT JOIN mrp m ON d.codigo = m.codigo AND d.centro = m.centro)"""


@query("a06_inventory_summary", SUMMARY_SQL, ("stock_dia", "mrp"))
def a06(spark, sf):
    return rounded(inventory.inventory_summary(fx.stock(spark, sf), fx.mrp(spark, sf)),
                   "valor_total_inventario", places=2)


@query("a07_orders_summary", """
  SELECT count(DISTINCT pedido) AS total_pedidos, count(*) AS total_posiciones,
         sum(saldo_pendiente) AS cantidad_pendiente,
         count(DISTINCT proveedor) AS proveedores_unicos FROM abiertos""", ("abiertos",))
def a07(spark, sf):
    return inventory.orders_summary(fx.pedidos(spark, sf))


@query("a08_orders_by_material", "SELECT * FROM agregado", ("abiertos",),
       {"agregado": PEDIDOS_AGG})
def a08(spark, sf):
    return joins.orders_by_material(scans.open_orders(fx.pedidos(spark, sf)))


@query("l01_top_value", f"""
  SELECT codigo, descripcion, centro, stock_actual,
         {re('valor_inventario', 'valor_inventario', 2)}
  FROM (SELECT * FROM stock_dia ORDER BY round(valor_inventario, 2) DESC, codigo, centro,
        almacen LIMIT 10)""", ("stock_dia",))
def l01(spark, sf):
    return rounded(inventory.top_value(fx.stock(spark, sf)), "valor_inventario", places=2)


Z95 = inventory.service_factor(0.95)
STATS = {"st": """SELECT codigo, avg(cantidad) AS m, stddev_samp(cantidad) AS s
                  FROM consumo GROUP BY codigo"""}


@query("i01_safety_stock", f"""
  SELECT codigo, {re('m', 'demanda_diaria_promedio', 2)}, {re('s', 'desviacion_demanda', 2)},
         {re('CASE WHEN m > 0 THEN s / m ELSE 0 END', 'coeficiente_variacion', 3)},
         {re(f'{Z95!r} * s * sqrt(14)', 'stock_seguridad_optimo', 0)},
         {re(f'm * 14 + {Z95!r} * s * sqrt(14)', 'punto_reorden_optimo', 0)},
         {re('CASE WHEN m > 0 THEN sqrt(2 * (m * 365) * 50 / 0.2) ELSE 0 END', 'eoq_sugerido', 0)},
         0.95 AS nivel_servicio, 14 AS lead_time_dias
  FROM st""", ("consumo",), STATS)
def i01(spark, sf):
    return inventory.safety_stock(fx.consumo_rows(spark, sf))


ABC = {"tot": """SELECT codigo, round(sum(cantidad * costo), 2) AS valor_total,
                   stddev_samp(cantidad) / nullif(avg(cantidad), 0) AS cv
                 FROM (SELECT codigo, l_quantity AS cantidad, p_retailprice AS costo FROM base)
                 GROUP BY codigo""",
       "acum": """SELECT *, least(100, 100 * sum(valor_total) OVER (
                    ORDER BY valor_total DESC, codigo
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                    / sum(valor_total) OVER ()) AS pct FROM tot""",
       "clases": """SELECT codigo, valor_total, cv, pct,
                      CASE WHEN pct <= 0 THEN 'nan' WHEN pct <= 80 THEN 'A'
                           WHEN pct <= 95 THEN 'B' ELSE 'C' END AS clase_abc,
                      CASE WHEN cv IS NULL THEN 'nan' WHEN cv <= 0.5 THEN 'X'
                           WHEN cv <= 1 THEN 'Y' ELSE 'Z' END AS clase_xyz FROM acum"""}


def classified_input(spark, sf):
    b = fx.base(spark, sf)
    return b.groupBy("codigo").agg(
        F.round(F.sum(F.col("l_quantity") * F.col("p_retailprice")), 2).alias("valor_total"),
        F.try_divide(F.stddev_samp("l_quantity"), F.avg("l_quantity"))
        .alias("coeficiente_variacion"))


@query("w08_cumulative_share", f"""
  SELECT codigo, valor_total, {re('pct', 'porcentaje_acumulado')} FROM acum""",
       ("base",), ABC)
def w08(spark, sf):
    out = inventory.cumulative_share(classified_input(spark, sf))
    return rounded(out, "porcentaje_acumulado").select("codigo", "valor_total",
                                                       "porcentaje_acumulado")


@query("i02_abc", "SELECT clase_abc, count(*) AS materiales FROM clases GROUP BY ALL",
       ("base",), ABC)
def i02(spark, sf):
    return inventory.abc_xyz(classified_input(spark, sf)).groupBy("clase_abc").agg(
        F.count(F.lit(1)).alias("materiales"))


@query("i03_xyz", "SELECT codigo, clase_xyz FROM clases", ("base",), ABC)
def i03(spark, sf):
    df = classified_input(spark, sf)
    return df.select("codigo", inventory.xyz_class(F.col("coeficiente_variacion"))
                     .alias("clase_xyz"))


@query("i04_abc_xyz", """
  SELECT codigo, clase_abc, clase_xyz, clase_abc || clase_xyz AS clase_abc_xyz FROM clases""",
       ("base",), ABC)
def i04(spark, sf):
    return inventory.abc_xyz(classified_input(spark, sf)).select(
        "codigo", "clase_abc", "clase_xyz", "clase_abc_xyz")


def _sql_policies() -> str:
    def lit(v):
        return str(v) if isinstance(v, float) else "'" + v + "'"
    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in inventory.POLICIES)


@query("i05_policy_lookup", f"""
  SELECT codigo, clase_abc || clase_xyz AS clase_abc_xyz,
         coalesce(descripcion, 'Sin clasificación') AS descripcion,
         coalesce(metodo, 'Por definir') AS metodo_reposicion, nivel AS nivel_servicio,
         revision, stock AS stock_seguridad, coalesce(prioridad, 'Por evaluar') AS prioridad
  FROM clases LEFT JOIN (VALUES {_sql_policies()})
       p(clase, descripcion, metodo, nivel, revision, stock, prioridad)
    ON clase_abc || clase_xyz = p.clase""", ("base",), ABC)
def i05(spark, sf):
    classes = inventory.abc_xyz(classified_input(spark, sf)).select("codigo",
                                                                    "clase_abc_xyz")
    return inventory.policy_lookup(classes)
