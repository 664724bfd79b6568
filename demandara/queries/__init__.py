"""Every operator as a query over the given tables."""

from . import (demand, evaluation, inventory, joins, models, quality,  # noqa: F401
               registry_queries, scans, scalars, windows)
from .registry import QUERIES

__all__ = ["QUERIES"]
