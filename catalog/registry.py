"""How a query is registered.

A query names its output columns once, as ``name:type`` with type ``s`` (text),
``d`` (double, rounded to 6 decimals, by way of 9 so that sums in another order
do not part at a half, and lifted off an exact half, which engines round differently) or ``i`` (64-bit integer); both the Spark
result and the SQL result are brought to that form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.views import BASE_SQL, Views

#: Less than what nine decimals tell apart: moves no value but those on a half.
TIE = 1e-10

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _fields(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def finish(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _fields(spec):
        c = F.col(name)
        if kind == "d":
            c = F.round(F.round(c.cast("double"), 9) + F.lit(TIE), 6) + F.lit(0.0)
        elif kind == "i":
            c = c.cast("bigint")
        else:
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def finish_sql(sql: str, spec: str, ctes: str = "", recursive: bool = False) -> str:
    cols = []
    for name, kind in _fields(spec):
        c = f'"{name}"'
        if kind == "d":
            c = f"round(round(CAST({c} AS DOUBLE), 9) + {TIE:.11f}, 6) + 0.0"
        elif kind == "i":
            c = f"CAST({c} AS BIGINT)"
        else:
            c = f"CAST({c} AS VARCHAR)"
        cols.append(f'{c} AS "{name}"')
    parts = [BASE_SQL.strip()] + ([ctes.strip()] if ctes else [])
    return (f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(parts) + ",\nresult AS (\n" + sql.strip() + "\n)\nSELECT "
            + ", ".join(cols) + " FROM result")


def query(name: str, spec: str, sql: str | None = None, ctes: str = "", recursive: bool = False):
    """Register ``fn(views) -> DataFrame`` under ``name``; without ``sql`` it has no twin."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(Views(spark, sf_dir)), spec)
        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = finish_sql(sql, spec, ctes, recursive)
        return fn
    return register
