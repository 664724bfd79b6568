"""Table scans with their filters, and small lookup lists.

Filters are plain column predicates so they reach the Parquet scan. Orderings are only
applied where a limit needs them or the caller asks for one (``ordered=True``): a total
order of a large table is a shuffle nobody should pay for by default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import normalised

DEFAULT_LEAD_TIME = 14
STOCK_KEYS = ["codigo", "centro", "almacen"]

# Texts that mean "no value" in filter lists.
BLANK_WORDS = ["", "nan", "none"]


def _equal(df: DataFrame, **filters) -> DataFrame:
    for column, value in filters.items():
        if value is not None and value != "Todos":
            df = df.where(F.col(column) == value)
    return df


def _planning_defaults(df: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return df.withColumns({
        "stock_seguridad": zero, "punto_pedido": zero, "stock_maximo": zero,
        "consumo_mensual": zero, "lead_time": F.lit(DEFAULT_LEAD_TIME)})


def stock_scan(stock: DataFrame, *, centro: str | None = None, almacen: str | None = None,
               grupo_articulos: str | None = None, solo_con_stock: bool = False,
               limite: int | None = None, ordered: bool = False) -> DataFrame:
    """Stock rows with optional filters; planning columns start at their defaults."""
    df = _equal(stock, centro=centro, almacen=almacen, grupo_de_articulos=grupo_articulos)
    if solo_con_stock:
        df = df.where(F.col("stock") > 0)
    df = normalised(df, "stock")
    if limite or ordered:
        df = df.orderBy(F.desc("valor_inventario"), *STOCK_KEYS, "fecha_datos",
                        "stock_actual", "proveedor")
    if limite:
        df = df.limit(limite)
    return _planning_defaults(df)


def stock_latest_day(stock: DataFrame) -> DataFrame:
    """Snapshot of the last day in the table, one row per material, plant and warehouse.

    The last day is a scalar subquery, so a table partitioned by ``dia`` reads one
    partition only.
    """
    last = stock.agg(F.max("dia")).scalar()
    df = normalised(stock.where(F.col("dia") == last), "stock")
    df = df.groupBy(*STOCK_KEYS).agg(
        F.max("descripcion").alias("descripcion"),
        F.sum("stock_actual").alias("stock_actual"),
        F.avg("costo_unitario").alias("costo_unitario"),
        F.sum("valor_inventario").alias("valor_inventario"),
        F.max("unidad_medida").alias("unidad_medida"),
        F.max("grupo_articulos").alias("grupo_articulos"),
        F.max("proveedor").alias("proveedor"),
        F.max("critico").alias("critico"))
    return _planning_defaults(df)


def consumption_window(consumo: DataFrame, *, material: str | None = None,
                       centro: str | None = None, dias: int = 365,
                       ordered: bool = False) -> DataFrame:
    """Consumption of the last ``dias`` days, counted back from the newest date of the
    whole table (today when the table is empty)."""
    newest = F.coalesce(consumo.agg(F.max("fecha")).scalar(), F.current_date())
    df = consumo.where(F.col("fecha") >= F.date_sub(newest, dias))
    df = normalised(_equal(df, material=material, centro=centro), "consumo_historico")
    return df.orderBy("fecha", "codigo") if ordered else df


def catalogue_scan(materiales: DataFrame, *, activos: bool = True,
                   grupo_articulos: str | None = None) -> DataFrame:
    df = materiales.where(F.col("activo") == 1) if activos else materiales
    return normalised(_equal(df, grupo_articulos=grupo_articulos), "materiales")


def equivalence_scan(equivalencias: DataFrame, material: str | None = None) -> DataFrame:
    if material is None:
        return equivalencias
    return equivalencias.where((F.col("material_original") == material)
                               | (F.col("material_equivalente") == material))


def mrp_scan(mrp: DataFrame, centro: str | None = None) -> DataFrame:
    return normalised(_equal(mrp, centro=centro), "materiales_bbdd")


def open_orders(pedidos: DataFrame, centro: str | None = None,
                ordered: bool = False) -> DataFrame:
    """Order positions with an open quantity."""
    df = normalised(_equal(pedidos.where(F.col("saldo_pend") > 0), centro=centro),
                    "pedidos_sap")
    return df.orderBy("fecha_entrega", "pedido", "posicion_pedido") if ordered else df


def table_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """Row count of every table in one job; an absent table counts 0."""
    parts = []
    for name, df in tables.items():
        if df is None:
            df = SparkSession.active().range(0)
        parts.append(df.agg(F.count(F.lit(1)).alias("filas"))
                     .select(F.lit(name).alias("tabla"), "filas"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def readable(read):
    """Run a table reader; a table that cannot be found gives None."""
    from pyspark.errors import AnalysisException
    try:
        return read()
    except AnalysisException:
        return None


def distinct_plants(df: DataFrame, ordered: bool = True) -> DataFrame:
    out = df.select("centro").distinct()
    return out.orderBy("centro") if ordered else out


def distinct_warehouses(df: DataFrame, centro: str | None = None) -> DataFrame:
    return _equal(df, centro=centro).select("almacen").distinct().orderBy("almacen")


def distinct_groups(stock: DataFrame) -> DataFrame:
    return (stock.select(F.col("grupo_de_articulos").alias("codigo"),
                         F.col("gpo_articulos_descripcion").alias("descripcion"))
            .distinct().orderBy("codigo", "descripcion"))


def filter_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per (column, value): the non-blank values a user may filter by.

    One pass over the table: rows are first reduced to distinct combinations of the filter
    columns inside each task, then unfolded.
    """
    columns = [c for c in (columns or ["centro", "almacen", "sector", "proveedor"])
               if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("columna"),
                               F.trim(F.col(c).cast("string")).alias("valor"))
                      for c in columns])
    return (df.select(*columns).distinct()
            .select(F.inline(pairs))
            .where(F.col("valor").isNotNull() & ~F.lower("valor").isin(BLANK_WORDS))
            .distinct())


def series_rows(consumo: DataFrame, *, codigo: str | None = None,
                centro: str | None = None, almacen: str | None = None) -> DataFrame:
    """Daily consumption per material; text columns keep the first value of the day
    (smallest, so the result does not depend on file order)."""
    df = _equal(consumo, codigo=codigo, centro=centro, almacen=almacen)
    first = [F.min(c).alias(c) for c in ("descripcion", "centro", "almacen")]
    return df.groupBy("codigo", "fecha").agg(*first, F.sum("cantidad").alias("cantidad"))


def material_options(consumo: DataFrame) -> DataFrame:
    """Materials with their label, most consumed first."""
    desc = F.substring(F.coalesce("descripcion", F.lit("")), 1, 40)
    return (consumo.where(F.col("codigo").isNotNull()).groupBy("codigo")
            .agg(F.min("descripcion").alias("descripcion"),
                 F.sum("cantidad").alias("cantidad"))
            .select(F.when(F.length(desc) > 0, F.concat_ws(" - ", "codigo", desc))
                    .otherwise(F.col("codigo")).alias("label"),
                    F.col("codigo").alias("value"), "cantidad")
            .orderBy(F.desc("cantidad"), "value"))


def material_cap(consumo: DataFrame, limite: int | None = None, *,
                 position: Column | None = None) -> DataFrame:
    """Distinct materials, the first ``limite`` by ``position`` (default: by code).

    ``limite`` is the report's own size and holds as given; jobs over all series leave it off.
    """
    position = F.col("codigo") if position is None else position
    codes = (consumo.where(F.col("codigo").isNotNull()).groupBy("codigo")
             .agg(F.min(position).alias("_pos")))
    if limite is not None:
        codes = codes.orderBy("_pos", "codigo").limit(limite)
    return codes.select("codigo")
