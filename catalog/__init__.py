"""Registered queries: each a library call over the given tables with an SQL twin."""

from catalog.registry import ORACLES, QUERIES  # noqa: F401
from catalog import blooms, forecasts, grids, lags, series, warnings_  # noqa: F401
