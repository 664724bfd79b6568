"""Alert board, summaries and inventory policy."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scans import mrp_scan, open_orders, stock_latest_day
from .demand import demand_stats, monthly_average
from .joins import (orders_by_material, with_consumption, with_mrp, with_mrp_by_plant,
                    with_open_orders)
from .prefix import running_total

LEAD_TIME = 14
DAYS_PER_MONTH = 30
MAX_DAYS_OF_STOCK = 365.0

# Order cost and yearly holding share of the order-quantity formula.
ORDER_COST = 50
HOLDING_SHARE = 0.2

# Replenishment policy by class (class, description, method, service level,
# review, safety-stock level, priority).
POLICIES = [
    ("AX", "Alto valor, demanda estable", "Punto de reorden fijo",
     0.99, "Continua", "Bajo", "Crítica"),
    ("AY", "Alto valor, demanda variable", "Punto de reorden con revisión periódica",
     0.97, "Semanal", "Medio", "Alta"),
    ("AZ", "Alto valor, demanda errática", "Bajo pedido o consignación",
     0.95, "Continua con forecast", "Alto", "Alta"),
    ("BX", "Valor medio, demanda estable", "Punto de reorden",
     0.95, "Semanal", "Bajo", "Media"),
    ("BY", "Valor medio, demanda variable", "Revisión periódica",
     0.93, "Quincenal", "Medio", "Media"),
    ("BZ", "Valor medio, demanda errática", "Bajo pedido",
     0.90, "Mensual", "Alto", "Media-Baja"),
    ("CX", "Bajo valor, demanda estable", "Lote económico (EOQ)",
     0.90, "Mensual", "Mínimo", "Baja"),
    ("CY", "Bajo valor, demanda variable", "Revisión periódica",
     0.85, "Mensual", "Medio", "Baja"),
    ("CZ", "Bajo valor, demanda errática", "Eliminar o bajo pedido",
     0.80, "Trimestral", "Evaluar eliminación", "Muy Baja"),
]
# Policy for a class that is not in the table.
NO_POLICY = {"descripcion": "Sin clasificación", "metodo_reposicion": "Por definir",
             "prioridad": "Por evaluar"}
POLICY_SCHEMA = ("clase string, descripcion string, metodo_reposicion string, "
                 "nivel_servicio double, revision string, stock_seguridad string, "
                 "prioridad string")


def stock_state(stock: Column, ss: Column, pp: Column, sm: Column) -> Column:
    """State of a stock row; over maximum wins over every other state."""
    return (F.when((stock > sm) & (sm > 0), "sobre_maximo")
            .when((stock > ss) & (stock <= pp) & (pp > 0), "bajo_punto_pedido")
            .when((stock > 0) & (stock <= ss) & (ss > 0), "bajo_seguridad")
            .when(stock <= 0, "quiebre")
            .otherwise("normal"))


def add_state(df: DataFrame) -> DataFrame:
    return df.withColumn("estado", stock_state(F.col("stock_actual"), F.col("stock_seguridad"),
                                               F.col("punto_pedido"), F.col("stock_maximo")))


def estimate_parameters(df: DataFrame, lead_time: int = LEAD_TIME) -> DataFrame:
    """Where no order point is set but there is consumption: safety stock of 14 days,
    order point of lead time plus safety stock, maximum of twice the order point."""
    daily = F.col("consumo_diario")
    missing = (F.col("punto_pedido") == 0) & (F.col("consumo_mensual") > 0)
    ss = daily * 14
    pp = daily * lead_time + ss
    return df.withColumns({
        "stock_seguridad": F.when(missing, ss).otherwise(F.col("stock_seguridad")),
        "punto_pedido": F.when(missing, pp).otherwise(F.col("punto_pedido")),
        "stock_maximo": F.when(missing, pp * 2).otherwise(F.col("stock_maximo"))})


def alert_board(stock: DataFrame, mrp: DataFrame, consumo: DataFrame, pedidos: DataFrame,
                *, limite: int | None = None, solo_relevantes: bool = True,
                dias_consumo: int = 90, consumption_by_plant: bool = False) -> DataFrame:
    """The alert table: last stock day, parameters, consumption, open orders, state, cover.

    The whole table by default; ``limite`` trims to a report of the most relevant rows.
    """
    df = with_mrp(stock_latest_day(stock), mrp_scan(mrp))
    df = with_consumption(df, monthly_average(consumo, dias_consumo, consumption_by_plant),
                          consumption_by_plant)
    df = with_open_orders(df, orders_by_material(open_orders(pedidos)))
    df = df.withColumns({
        "consumo_diario": F.col("consumo_mensual") / DAYS_PER_MONTH,
        "lead_time": F.lit(LEAD_TIME)})
    df = add_state(estimate_parameters(df))
    cover = F.when(F.col("consumo_diario") > 0,
                   F.try_divide("stock_actual", "consumo_diario")).otherwise(0.0)
    df = df.withColumns({
        "dias_stock": F.least(cover, F.lit(MAX_DAYS_OF_STOCK)),
        "stock_proyectado": F.col("stock_actual") + F.col("cantidad_en_pedido"),
        "tiene_mrp": (F.col("punto_pedido") > 0).cast("int")})
    return df if limite is None else trim_alerts(df, limite, solo_relevantes)


def trim_alerts(board: DataFrame, limite: int, solo_relevantes: bool = True) -> DataFrame:
    """First ``limite`` rows: alerts, then normal rows with parameters, then by value."""
    by_value = [F.desc("valor_inventario"), "codigo", "centro", "almacen"]
    if not solo_relevantes:
        return board.orderBy(*by_value).limit(limite)
    priority = (F.when(F.col("estado") != "normal", 0)
                .when(F.col("tiene_mrp") == 1, 1).otherwise(2))
    return (board.withColumn("prioridad", priority)
            .orderBy("prioridad", *by_value).limit(limite).drop("prioridad"))


def priority_union(board: DataFrame) -> DataFrame:
    """The three groups of the board as a bag union, marked with their order."""
    normal = F.col("estado") == "normal"
    has_mrp = F.col("tiene_mrp") == 1
    parts = [board.where(~normal), board.where(normal & has_mrp),
             board.where(normal & ~has_mrp)]
    marked = [p.withColumn("grupo", F.lit(i)) for i, p in enumerate(parts)]
    return marked[0].unionByName(marked[1]).unionByName(marked[2])


def inventory_summary(stock: DataFrame, mrp: DataFrame, dedupe: bool = False) -> DataFrame:
    """One row of inventory figures. Counts run over the rows after joining parameters by
    material and plant, so a material with several parameter rows counts several times
    unless ``dedupe`` is set."""
    params = mrp_scan(mrp)
    df = with_mrp_by_plant(stock_latest_day(stock), params, dedupe)
    s, ss = F.col("stock_actual"), F.col("stock_seguridad")
    pp, sm = F.col("punto_pedido"), F.col("stock_maximo")
    n_mrp = params.agg(F.count(F.lit(1))).scalar()
    return df.agg(
        F.count(F.lit(1)).alias("total_materiales"),
        F.count(F.lit(1)).alias("total_registros_stock"),
        F.sum("valor_inventario").alias("valor_total_inventario"),
        F.countDistinct("centro").alias("centros_unicos"),
        F.countDistinct("almacen").alias("almacenes_unicos"),
        F.count_if(s > 0).alias("materiales_con_stock"),
        F.count_if(s <= 0).alias("materiales_sin_stock"),
        F.count_if(s <= 0).alias("quiebres"),
        F.count_if((s > 0) & (s <= ss) & (ss > 0)).alias("bajo_stock_seguridad"),
        F.count_if((s > ss) & (s <= pp) & (pp > 0)).alias("bajo_punto_pedido"),
        F.count_if((s > sm) & (sm > 0)).alias("sobre_stock_maximo"),
    ).withColumn("materiales_con_mrp", n_mrp)


def orders_summary(pedidos: DataFrame) -> DataFrame:
    return open_orders(pedidos).agg(
        F.countDistinct("pedido").alias("total_pedidos"),
        F.count(F.lit(1)).alias("total_posiciones"),
        F.coalesce(F.sum("saldo_pendiente"), F.lit(0.0)).alias("cantidad_pendiente"),
        F.countDistinct("proveedor").alias("proveedores_unicos"))


def top_value(stock: DataFrame, limite: int = 10) -> DataFrame:
    return (stock_latest_day(stock)
            .orderBy(F.desc("valor_inventario"), "codigo", "centro", "almacen").limit(limite)
            .select("codigo", "descripcion", "centro", "stock_actual", "valor_inventario"))


def service_factor(nivel_servicio: float) -> float:
    return NormalDist().inv_cdf(nivel_servicio)


def safety_stock(rows: DataFrame, nivel_servicio: float = 0.95,
                 lead_time: int = 14, stats: DataFrame | None = None) -> DataFrame:
    """Safety stock, reorder point and order quantity per material."""
    st = stats if stats is not None else demand_stats(rows)
    mean, sd = F.col("media"), F.col("desviacion")
    ss = F.lit(service_factor(nivel_servicio)) * sd * F.lit(float(lead_time) ** 0.5)
    eoq = F.when(mean * 365 > 0, F.sqrt(2 * (mean * 365) * ORDER_COST / HOLDING_SHARE)
                 ).otherwise(0.0)
    return st.select(
        "codigo",
        F.bround(mean, 2).alias("demanda_diaria_promedio"),
        F.bround(sd, 2).alias("desviacion_demanda"),
        F.bround("cv", 3).alias("coeficiente_variacion"),
        F.bround(ss, 0).alias("stock_seguridad_optimo"),
        F.bround(mean * lead_time + ss, 0).alias("punto_reorden_optimo"),
        F.bround(eoq, 0).alias("eoq_sugerido"),
        F.lit(nivel_servicio).alias("nivel_servicio"),
        F.lit(lead_time).alias("lead_time_dias"))


def xyz_class(cv: Column) -> Column:
    return F.when(cv.isNull(), "nan").when(cv <= 0.5, "X").when(cv <= 1.0, "Y").otherwise("Z")


def abc_class(share: Column) -> Column:
    """Class of a running share in percent; shares over 100 by rounding count as 100."""
    s = F.least(share, F.lit(100.0))
    return (F.when(s.isNull() | (s <= 0), "nan").when(s <= 80, "A")
            .when(s <= 95, "B").otherwise("C"))


def cumulative_share(df: DataFrame, key: str = "codigo",
                     value: str = "valor_total") -> DataFrame:
    """Running share of the total, largest value first, without a one-task sort."""
    out = running_total(df, value, [F.desc(value), F.asc(key)], "valor_acumulado",
                        "_gran_total")
    share = F.try_divide("valor_acumulado", F.col("_gran_total")) * 100
    return out.withColumn("porcentaje_acumulado", share).drop("_gran_total")


def abc_xyz(df: DataFrame) -> DataFrame:
    """Classes of (codigo, valor_total, coeficiente_variacion)."""
    out = cumulative_share(df)
    out = out.withColumns({"clase_abc": abc_class(F.col("porcentaje_acumulado")),
                           "clase_xyz": xyz_class(F.col("coeficiente_variacion"))})
    return out.withColumn("clase_abc_xyz", F.concat("clase_abc", "clase_xyz"))


def policy_lookup(classes: DataFrame, column: str = "clase_abc_xyz") -> DataFrame:
    """Policy of each row's class; the nine-row table has a fixed size, so it is broadcast."""
    spark = classes.sparkSession
    table = F.broadcast(spark.createDataFrame(POLICIES, POLICY_SCHEMA))
    out = classes.join(table, classes[column] == table["clase"], "left").drop("clase")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in NO_POLICY.items()})
