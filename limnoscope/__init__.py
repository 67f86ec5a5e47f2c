"""Depth-resolved lake monitoring as Spark DataFrame operators.

Every operator takes and returns DataFrames and is keyed by ``site_id`` (or the
``keys`` argument), so one call serves one station or a hundred thousand.
"""
