"""Regridding and reshaping.

This is where raw readings become small: every later per-station window works
on grid rows, whose number per station is bounded by the calendar and not by
the number of readings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from limnoscope.functions.columns import finite_or_null, floor_to_days, floor_to_grid, mean
from limnoscope.schema import DEPTHS, KEYS, WEATHER_MEASURES, depth_column


def cell_means(readings: DataFrame, measures: Sequence[str], hours: int = 3,
               ts: str = "timestamp", keys: Sequence[str] = KEYS, by_depth: bool = True) -> DataFrame:
    """Mean per (station, grid cell, depth); hash aggregation with partial sums."""
    group = [*keys, "cell"] + (["depth"] if by_depth else [])
    return (readings.withColumn("cell", floor_to_grid(ts, hours))
            .filter(F.col("cell").isNotNull())
            .groupBy(*group).agg(*[mean(m).alias(m) for m in measures]))


def day_means(readings: DataFrame, measures: Sequence[str], ts: str = "timestamp",
              keys: Sequence[str] = KEYS, by_depth: bool = True) -> DataFrame:
    """Mean per (station, day, depth) straight from the readings."""
    group = [*keys, "day"] + (["depth"] if by_depth else [])
    return (readings.withColumn("day", F.to_date(ts)).filter(F.col("day").isNotNull())
            .groupBy(*group).agg(*[mean(m).alias(m) for m in measures]))


def profile_table(standard: DataFrame, depths: Sequence[float] = DEPTHS, hours: int = 3,
                  measures: dict[str, str] | None = None,
                  weather: Sequence[str] = WEATHER_MEASURES, ts: str = "timestamp",
                  keys: Sequence[str] = KEYS, complete: bool = True) -> DataFrame:
    """Wide table: one row per grid cell with a column per depth and measure.

    Cell means, the pivot and the weather of the cell are one conditional
    aggregation and therefore one shuffle.  All rows of a cell carry the same
    weather, so any of them may supply it.  ``complete`` drops rows with a gap.
    """
    measures = measures or {"temp": "water_temp", "conc": "total_conc"}
    aggs = [
        mean(F.when(F.col("depth") == F.lit(float(d)), F.col(source))).alias(depth_column(name, d))
        for name, source in measures.items() for d in depths
    ]
    aggs += [F.min(finite_or_null(c)).alias(c) for c in weather]
    wide = (standard.withColumn("cell", floor_to_grid(ts, hours)).filter(F.col("cell").isNotNull())
            .groupBy(*keys, "cell").agg(*aggs))
    if "temp" in measures:
        from limnoscope.operators.profile import with_stratification
        wide = with_stratification(wide, depths)
    return wide.dropna(how="any") if complete else wide


def coarsen(wide: DataFrame, step_hours: int | None = None, step_days: int | None = None,
            cell: str = "cell", keys: Sequence[str] = KEYS, complete: bool = True) -> DataFrame:
    """Mean of cell means on a coarser grid, incomplete rows dropped.

    Steps of several days are counted from the station's first day.
    """
    values = [c for c in wide.columns if c not in (*keys, cell)]
    means = [F.avg(c).alias(c) for c in values]
    if step_hours:
        out = (wide.withColumn("_step", floor_to_grid(cell, step_hours))
               .groupBy(*keys, "_step").agg(*means).withColumnRenamed("_step", cell))
    elif step_days == 1:
        out = wide.withColumn("day", F.to_date(cell)).groupBy(*keys, "day").agg(*means)
    else:
        out = (wide.withColumn("_first", F.to_date(F.min(cell).over(W.partitionBy(*keys))))
               .withColumn("day", floor_to_days(F.to_date(cell), "_first", step_days))
               .groupBy(*keys, "day").agg(*means))
    return out.dropna(how="any") if complete else out


def daily_table(standard: DataFrame, depths: Sequence[float] = DEPTHS, **options) -> DataFrame:
    """Three-hourly wide table averaged per day: the input of the daily protocol."""
    return coarsen(profile_table(standard, depths, **options), step_days=1)


def unpivot_depths(wide: DataFrame, prefix: str, depths: Sequence[float],
                   ids: Sequence[str], value: str) -> DataFrame:
    """Per-depth columns back to rows (depth, value)."""
    cells = F.array(*[
        F.struct(F.lit(float(d)).alias("depth"), F.col(depth_column(prefix, d)).alias(value))
        for d in depths
    ])
    return wide.select(*ids, F.inline(cells))


def unpivot_columns(df: DataFrame, columns: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Measure columns to rows (variable, value)."""
    return df.unpivot([F.col(c) for c in ids], [F.col(c) for c in columns], "variable", "value")


def select_depths(readings: DataFrame, depths: Sequence[float]) -> DataFrame:
    return readings.filter(F.col("depth").isin([float(d) for d in depths]))


def slice_days(df: DataFrame, start=None, end=None, day: str = "day") -> DataFrame:
    """Half-open slice ``start <= day < end``; a plain filter, so it is pushed down."""
    if start is not None:
        df = df.filter(F.col(day) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(day) < F.lit(end))
    return df
