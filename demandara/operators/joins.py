"""Joins between stock, replenishment parameters, consumption and purchase orders.

No side is broadcast by hand: Spark broadcasts a side when its size statistics (or AQE's
measured size) are under the threshold, and otherwise shuffles, splitting skewed keys.
Large fact sides are aggregated to their join key before they are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PLACE = ["codigo", "centro", "almacen"]
PARAMETERS = ["stock_seguridad", "punto_pedido", "stock_maximo"]


def _zero_if_null(*names):
    return [F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names]


def with_mrp(stock: DataFrame, mrp: DataFrame) -> DataFrame:
    """Parameters by material, plant and warehouse; missing ones become 0, the sector
    stays null."""
    left = stock.drop(*PARAMETERS)
    joined = left.join(mrp.select(*PLACE, "sector", *PARAMETERS), PLACE, "left")
    return joined.select(*left.columns, "sector", *_zero_if_null(*PARAMETERS))


def with_mrp_by_plant(stock: DataFrame, mrp: DataFrame, dedupe: bool = False) -> DataFrame:
    """Parameters by material and plant only: a stock row repeats for every warehouse that
    has parameters there. ``dedupe`` keeps the first warehouse instead."""
    params = mrp.select("codigo", "centro", "almacen", *PARAMETERS)
    if dedupe:
        params = params.groupBy("codigo", "centro").agg(
            *[F.min_by(c, "almacen").alias(c) for c in PARAMETERS])
    else:
        params = params.drop("almacen")
    left = stock.drop(*PARAMETERS)
    joined = left.join(params, ["codigo", "centro"], "left")
    return joined.select(*left.columns, *_zero_if_null(*PARAMETERS))


def with_consumption(stock: DataFrame, monthly: DataFrame,
                     by_plant: bool = False) -> DataFrame:
    """Monthly consumption by material (every plant gets the company figure), or by
    material and plant."""
    keys = ["codigo", "centro"] if by_plant else ["codigo"]
    left = stock.drop("consumo_mensual")
    joined = left.join(monthly.select(*keys, "consumo_mensual"), keys, "left")
    return joined.select(*left.columns, *_zero_if_null("consumo_mensual"))


def orders_by_material(pedidos: DataFrame) -> DataFrame:
    return pedidos.groupBy("codigo", "centro").agg(
        F.sum("saldo_pendiente").alias("cantidad_en_pedido"),
        F.countDistinct("pedido").alias("pedidos_activos"),
        F.min("fecha_entrega").alias("proxima_entrega"))


def with_open_orders(stock: DataFrame, orders: DataFrame) -> DataFrame:
    """Open orders of the material in the plant, repeated for each of its warehouses."""
    joined = stock.join(orders, ["codigo", "centro"], "left")
    return joined.select(
        *stock.columns, *_zero_if_null("cantidad_en_pedido"),
        F.coalesce("pedidos_activos", F.lit(0)).alias("pedidos_activos"),
        "proxima_entrega")


def first_mrp_per_code(mrp: DataFrame) -> DataFrame:
    """First replenishment row of each material by plant and warehouse.

    An aggregate over a struct, so the choice combines before the shuffle.
    """
    rest = ["sector", *PARAMETERS]
    order = F.struct("centro", "almacen", *rest)
    first = mrp.groupBy("codigo").agg(F.min_by(F.struct("centro", "almacen", *rest), order)
                                      .alias("r"))
    return first.select("codigo", "r.*")


def first_row_per_group(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """General form with a ranking window; Spark prunes each group before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def catalogue_first_mrp(catalogo: DataFrame, mrp: DataFrame) -> DataFrame:
    first = first_mrp_per_code(mrp).select("codigo", "sector", *PARAMETERS)
    return catalogo.join(first, "codigo", "left")


def mrp_for_codes(mrp: DataFrame, codes: DataFrame) -> DataFrame:
    return mrp.join(codes.select("codigo"), "codigo", "left_semi")


def common_dates(pred: DataFrame, real: DataFrame) -> DataFrame:
    """(series, date) pairs that both sides have."""
    key = ["series_id", "fecha"]
    return pred.select(*key).intersect(real.select(*key))


def at_common_dates(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``df`` whose (series, date) also appears in ``other``."""
    key = ["series_id", "fecha"]
    return df.join(other.select(*key), key, "left_semi")


def forecast_vs_actual(pred: DataFrame, real: DataFrame) -> DataFrame:
    """Predictions beside the day's total actual quantity, where both exist."""
    daily = real.groupBy("series_id", "fecha").agg(F.sum("cantidad").alias("real"))
    return (pred.select("series_id", "fecha", "prediccion")
            .join(daily, ["series_id", "fecha"], "inner"))


def equivalents(codes: DataFrame, equivalencias: DataFrame) -> DataFrame:
    """Counterparts of each code, from either side of the pair table.

    Two equi-joins and a bag union; an OR join would be a nested loop.
    """
    wanted = codes.select(F.col("codigo").alias("buscado"))
    forward = (equivalencias.join(wanted, F.col("material_original") == F.col("buscado"))
               .select("buscado", F.col("material_equivalente").alias("codigo")))
    backward = (equivalencias.where("material_original <> material_equivalente")
                .join(wanted, F.col("material_equivalente") == F.col("buscado"))
                .select("buscado", F.col("material_original").alias("codigo")))
    return forward.unionByName(backward)


def horizon_days(last_dates: DataFrame, horizonte: int) -> DataFrame:
    """Days 1..H after ``ultima_fecha`` of each row, with their number ``paso``."""
    steps = F.sequence(F.lit(1), F.lit(horizonte))
    return (last_dates.withColumn("paso", F.explode(steps))
            .withColumn("fecha", F.date_add("ultima_fecha", F.col("paso"))))


def walk_forward_split(serie: DataFrame, cuts: DataFrame, ventana: int) -> DataFrame:
    """Rows of each cut marked as train (before the cut) or test (inside its window).

    The series side has at most one row per day, the cut side at most ``n_pasos`` rows per
    series; an equi-join on the series with the range as a residual condition.
    """
    limit = F.date_add("corte", ventana)
    return (serie.join(cuts.select("series_id", "corte"), "series_id")
            .where(F.col("fecha") < limit)
            .withColumn("parte", F.when(F.col("fecha") < F.col("corte"), "train")
                        .otherwise("test")))
