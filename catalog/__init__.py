"""Registered queries over the given tables, each beside the SQL that must give the same rows."""

from . import views
from . import demand, forecasts, intake, models, products, sellers, series, streams  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "views"]
