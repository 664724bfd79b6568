"""Registry of runnable queries: key -> Spark callable and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import with_views

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    key: str
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(key: str, sql: str | None = None, views: tuple[str, ...] = (),
          extra: dict[str, str] | None = None):
    """Register a query. ``sql`` runs behind WITH clauses for ``views`` and ``extra``."""
    def register(run: Run) -> Run:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = Query(key, run, with_views(sql, *views, extra=extra) if sql else None)
        return run
    return register


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    """Round the named columns half-even, as the SQL twin does with ``round_even``."""
    return df.withColumns({c: F.bround(c, places) for c in columns})


def re(expr: str, name: str, places: int = 4) -> str:
    """SQL text: half-even rounding under a name."""
    return f"CAST(round_even({expr}, {places}) AS DOUBLE) AS {name}"
