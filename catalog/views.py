"""Lake readings as views over the given star-schema tables, in Spark and in SQL.

``readings``/``weather`` come from line items and orders (daily over several
years, seven depths); ``fast``/``fast_weather`` come from the event stream
(irregular times within 30 days).  The number of stations grows with the
supplier table, so the work grows with the data.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnoscope.operators.grid import coarsen, day_means
from limnoscope.operators.ingest import profile_from_raw, standard_table
from limnoscope.schema import WEATHER_MEASURES, depth_column

DEPTHS7 = (0.5, 1.0, 1.5, 2.5, 3.0, 5.0, 10.0)
SUPPLIERS_PER_SITE = 50


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def n_sites(self):
        """Number of stations as a scalar subquery (no job when the view is built)."""
        n = F.ceil(F.count(F.lit(1)) / F.lit(float(SUPPLIERS_PER_SITE)))
        return self.table("supplier").agg(F.greatest(F.lit(1), n).cast("bigint")).scalar()

    def _site(self, number):
        return F.lpad((number % self.n_sites).cast("string"), 4, "0").alias("site_id")

    @staticmethod
    def _depth(index):
        return F.get(F.array(*[F.lit(d) for d in DEPTHS7]), index.cast("int")).alias("depth")

    @cached_property
    def readings(self) -> DataFrame:
        c = F.col
        return self.table("lineitem").select(
            self._site(c("l_suppkey")), c("l_shipdate").alias("timestamp"),
            self._depth(c("l_linenumber") - 1),
            (F.lit(10.0) + c("l_discount") * 100).alias("water_temp"),
            c("l_quantity").alias("total_conc"), (c("l_quantity") * c("l_tax")).alias("cyano_conc"))

    @cached_property
    def weather(self) -> DataFrame:
        c = F.col
        price = c("o_totalprice")
        return self.table("orders").select(
            self._site(c("o_custkey")), c("o_orderdate").alias("timestamp"),
            (price / 70003).alias("wind_speed"), (c("o_orderkey") % 360).cast("double").alias("wind_dir"),
            (c("o_custkey") % 30 + 1000).cast("double").alias("pressure"),
            (price / 30011 + 5).alias("air_temp"), (c("o_orderkey") % 60 + 40).cast("double").alias("humidity"),
            F.when(c("o_orderstatus") == "F", price / 90007).otherwise(0.0).alias("rainfall"))

    @cached_property
    def fast(self) -> DataFrame:
        c = F.col
        depth = self._depth(c("user_id") % 7)
        rows = self.table("events").filter(c("event_type") != "signup").select(
            c("event_id"), c("event_type"), self._site(F.floor(c("user_id") / 7)), c("ts").alias("timestamp"),
            depth, c("value").alias("total_conc"), (c("event_id") % 29 / 10.3).alias("_t"))
        return rows.withColumn("water_temp", F.lit(18.0) - c("depth") * 0.5 + c("_t")).drop("_t")

    @cached_property
    def fast_weather(self) -> DataFrame:
        c = F.col
        e = c("event_id")
        return self.table("events").filter(c("event_type") == "signup").select(
            self._site(F.floor(c("user_id") / 7)), c("ts").alias("timestamp"),
            (e % 50 / 10.0).alias("wind_speed"), (e * 7 % 360).cast("double").alias("wind_dir"),
            (e % 21 + 1000).cast("double").alias("pressure"), (e % 13 + 15).cast("double").alias("air_temp"),
            (e % 40 + 50).cast("double").alias("humidity"), (c("value") / 10).alias("rainfall"))

    # --- gridded forms ----------------------------------------------------
    @cached_property
    def cells(self) -> DataFrame:
        return day_means(self.readings, ["water_temp", "total_conc", "cyano_conc"])

    @cached_property
    def standard(self) -> DataFrame:
        return standard_table(self.readings, self.weather)

    @cached_property
    def daily(self) -> DataFrame:
        """Complete days: seven depths and the weather."""
        return coarsen(profile_from_raw(self.readings, self.weather, DEPTHS7), step_days=1)

    @cached_property
    def fast_standard(self) -> DataFrame:
        return standard_table(self.fast, self.fast_weather)

    @cached_property
    def fast_wide(self) -> DataFrame:
        return profile_from_raw(self.fast, self.fast_weather, DEPTHS7)


# ------------------------------------------------------------------ SQL twins
def per_depth(expr: str, sep: str = ", ", depths=DEPTHS7) -> str:
    """Repeat ``expr`` for every depth; ``{d}`` is the depth, ``{t}``/``{c}`` the column names."""
    return sep.join(expr.format(d=f"CAST({d} AS DOUBLE)", t=depth_column("temp", d), c=depth_column("conc", d))
                    for d in depths)


TEMP_COLS = [depth_column("temp", d) for d in DEPTHS7]
CONC_COLS = [depth_column("conc", d) for d in DEPTHS7]
WIDE_COLS = [*TEMP_COLS, *CONC_COLS, *WEATHER_MEASURES, "delta_T", "thermo_grad"]


def floor_sql(ts: str, hours: int) -> str:
    return f"(date_trunc('day', {ts}) + INTERVAL 1 HOUR * (CAST(floor(hour({ts}) / {hours}.0) AS INTEGER) * {hours}))"


def _depth_sql(index: str) -> str:
    return f"([{', '.join(f'CAST({d} AS DOUBLE)' for d in DEPTHS7)}])[{index} + 1]"


def _grad_sql() -> str:
    steps = [f"({b} - {a}) / {db - da}" for a, b, da, db in
             zip(TEMP_COLS, TEMP_COLS[1:], DEPTHS7, DEPTHS7[1:])]
    return f"greatest(0.0, {', '.join(steps)})"


def _wide_sql(source: str, at: str) -> str:
    """Complete wide rows of a standard table in SQL."""
    return f"""SELECT *, {TEMP_COLS[0]} - {TEMP_COLS[-1]} AS "delta_T", {_grad_sql()} AS thermo_grad FROM (
    SELECT site_id, {at}, {per_depth('avg(CASE WHEN depth = {d} THEN water_temp END) AS {t}')},
      {per_depth('avg(CASE WHEN depth = {d} THEN total_conc END) AS {c}')},
      {', '.join(f'min({w}) AS {w}' for w in WEATHER_MEASURES)}
    FROM {source} GROUP BY site_id, {at})
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*TEMP_COLS, *CONC_COLS, *WEATHER_MEASURES])}"""


_W = ", ".join(WEATHER_MEASURES)
_AVG_W = ", ".join(f"avg({w}) AS {w}" for w in WEATHER_MEASURES)

BASE_SQL = f"""
sites AS (SELECT greatest(1, CAST(ceil(count(*) / {SUPPLIERS_PER_SITE}.0) AS BIGINT)) AS k FROM supplier),
readings AS (
  SELECT lpad(CAST(l_suppkey % k AS VARCHAR), 4, '0') AS site_id, l_shipdate AS ts,
    CAST(l_shipdate AS DATE) AS day, {_depth_sql('l_linenumber - 1')} AS depth,
    10.0::DOUBLE + 100 * l_discount AS water_temp, l_quantity AS total_conc, l_quantity * l_tax AS cyano_conc
  FROM lineitem, sites),
weather AS (
  SELECT lpad(CAST(o_custkey % k AS VARCHAR), 4, '0') AS site_id, o_orderdate AS ts,
    CAST(o_orderdate AS DATE) AS day, o_totalprice / 70003 AS wind_speed, CAST(o_orderkey % 360 AS DOUBLE) AS wind_dir,
    CAST(1000 + o_custkey % 30 AS DOUBLE) AS pressure, 5 + o_totalprice / 30011 AS air_temp,
    CAST(40 + o_orderkey % 60 AS DOUBLE) AS humidity,
    CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 90007 ELSE 0 END AS rainfall
  FROM orders, sites),
fast AS (
  SELECT event_id, event_type, lpad(CAST((user_id // 7) % k AS VARCHAR), 4, '0') AS site_id, ts,
    {_depth_sql('CAST(user_id % 7 AS INTEGER)')} AS depth, value AS total_conc,
    18.0::DOUBLE - 0.5 * {_depth_sql('CAST(user_id % 7 AS INTEGER)')} + (event_id % 29) / 10.3::DOUBLE AS water_temp
  FROM events, sites WHERE event_type <> 'signup'),
fast_weather AS (
  SELECT lpad(CAST((user_id // 7) % k AS VARCHAR), 4, '0') AS site_id, ts,
    (event_id % 50) / 10.0::DOUBLE AS wind_speed, CAST(event_id * 7 % 360 AS DOUBLE) AS wind_dir,
    CAST(1000 + event_id % 21 AS DOUBLE) AS pressure, CAST(15 + event_id % 13 AS DOUBLE) AS air_temp,
    CAST(50 + event_id % 40 AS DOUBLE) AS humidity, value / 10 AS rainfall
  FROM events, sites WHERE event_type = 'signup'),
cells AS (
  SELECT site_id, day, depth, avg(water_temp) AS water_temp, avg(total_conc) AS total_conc,
    avg(cyano_conc) AS cyano_conc, count(*) AS n FROM readings GROUP BY ALL),
weather_days AS (SELECT site_id, day, {_AVG_W} FROM weather GROUP BY ALL),
standard_days AS (
  SELECT c.*, {', '.join('w.' + m for m in WEATHER_MEASURES)} FROM cells c LEFT JOIN weather_days w USING (site_id, day)),
daily AS ({_wide_sql('standard_days', 'day')}),
fast_weather_cells AS (
  SELECT site_id, {floor_sql('ts', 3)} AS cell, {_AVG_W} FROM fast_weather GROUP BY ALL),
fast_weather_axis AS (
  SELECT site_id, unnest(generate_series(lo, hi, INTERVAL 3 HOUR)) AS cell FROM (
    SELECT site_id, min(cell) AS lo, max(cell) AS hi FROM fast_weather_cells GROUP BY site_id)),
fast_weather_grid AS (
  SELECT a.site_id, a.cell, {', '.join('w.' + m for m in WEATHER_MEASURES)}
  FROM fast_weather_axis a LEFT JOIN fast_weather_cells w USING (site_id, cell)),
fast_standard AS (
  SELECT event_id, site_id, cell, depth, water_temp, total_conc, {_W} FROM (
    SELECT r.*, {', '.join('w.' + m for m in WEATHER_MEASURES)},
      row_number() OVER (PARTITION BY r.event_id ORDER BY abs(epoch(w.cell) - epoch(r.cell)), w.cell) AS rn
    FROM (SELECT *, {floor_sql('ts', 3)} AS cell FROM fast) r
    LEFT JOIN fast_weather_grid w ON w.site_id = r.site_id
      AND w.cell BETWEEN r.cell - INTERVAL 3 HOUR AND r.cell + INTERVAL 3 HOUR) WHERE rn = 1),
fast_wide AS ({_wide_sql('fast_standard', 'cell')})
"""
