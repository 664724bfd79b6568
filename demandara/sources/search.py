"""Catalogue and history searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import like_pattern, search_term
from ..operators.joins import first_mrp_per_code


def _matches(term: str, escape: bool):
    pattern = like_pattern(term, escape)
    return F.col("codigo").ilike(pattern) | F.col("descripcion").ilike(pattern)


def search_catalogue(materiales: DataFrame, termino: str, limite: int = 20) -> DataFrame:
    """Code or description contains the term; the report shows the first ``limite``."""
    term = search_term(termino) if termino and len(termino) <= 100 else ""
    hits = materiales.where(_matches(term, True)) if term else materiales.where(F.lit(False))
    return (hits.select("codigo", "descripcion",
                        F.col("precio_usd").alias("costo_unitario"))
            .orderBy("codigo").limit(limite))


def search_with_mrp(materiales: DataFrame, mrp: DataFrame, termino: str,
                    limite: int = 20, escape: bool = False) -> DataFrame:
    """Active materials matching the term, with their first replenishment row.

    With ``escape=False`` the signs ``%`` and ``_`` in the term act as wildcards. ``mrp`` carries
    operator names (see ``mrp_scan``).
    """
    if not termino or len(termino) < 3:
        found = materiales.where(F.lit(False))
    else:
        found = materiales.where((F.col("activo") == 1) & _matches(termino, escape))
    found = found.orderBy("codigo").limit(limite)
    rows = mrp.join(found.select("codigo").distinct(), "codigo", "left_semi")
    first = first_mrp_per_code(rows).select(
        "codigo", "sector", *[F.coalesce(F.col(c).try_cast("int"), F.lit(0)).alias(a)
                              for c, a in (("stock_seguridad", "ss"), ("punto_pedido", "pp"),
                                           ("stock_maximo", "sm"))])
    has = F.col("sector").isNotNull()
    return (found.join(first, "codigo", "left")
            .select("codigo", "descripcion", "descripcion_larga", "grupo_articulos",
                    "unidad_medida", "precio_usd", has.alias("tiene_mrp"),
                    F.when(has, F.struct("sector", "ss", "pp", "sm")).alias("mrp_info")))


def search_history(consumo: DataFrame, patron: str) -> DataFrame:
    """First material whose code matches the pattern, and how many materials match."""
    hits = consumo.where(F.col("codigo").rlike("(?i)" + patron))
    return hits.agg(
        F.min("codigo").alias("codigo"),
        F.substring(F.min_by("descripcion", F.struct("codigo", "descripcion")), 1, 45)
        .alias("descripcion"),
        F.countDistinct("codigo").alias("coincidencias"))
