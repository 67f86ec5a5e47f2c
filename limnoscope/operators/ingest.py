"""Raw tables to the standard long table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from limnoscope.functions.columns import coerce_double, coerce_timestamp, finite_or_null, floor_to_grid, mean, pad_site_id
from limnoscope.operators.align import asof_filled_grid
from limnoscope.operators.grid import unpivot_columns
from limnoscope.schema import EPS, HEADER_NAMES, KEYS, NUMERIC_COLUMNS, WEATHER_MEASURES


def rename_headers(df: DataFrame, names: dict[str, str] = HEADER_NAMES) -> DataFrame:
    """Drop every ``_x``/``_y`` of a header, then translate it."""
    return df.toDF(*[names.get(c.replace("_x", "").replace("_y", ""),
                               c.replace("_x", "").replace("_y", "")) for c in df.columns])


def coerce_types(df: DataFrame, numeric: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """Numbers to double (null when they do not parse or are NaN), time to timestamp, padded ids.

    :func:`unreadable_times` counts the times that are lost.
    """
    casts = {c: coerce_double(c) for c in numeric if c in df.columns}
    if "timestamp" in df.columns and dict(df.dtypes)["timestamp"] == "string":
        casts["timestamp"] = coerce_timestamp("timestamp")
    if "site_id" in df.columns:
        casts["site_id"] = pad_site_id("site_id")
    return df.withColumns(casts)


def unreadable_times(raw: DataFrame, ts: str = "timestamp") -> DataFrame:
    """One row: ``n_rows``, and the rows whose time text is there but fits no known form (``n_unreadable``)."""
    lost = F.col(ts).isNotNull() & coerce_timestamp(ts).isNull()
    return raw.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(lost, 1)).alias("n_unreadable"))


def weather_cells(weather: DataFrame, hours: int = 3, keys: Sequence[str] = KEYS,
                  measures: Sequence[str] = WEATHER_MEASURES, ts: str = "timestamp",
                  fill_bins: bool = False) -> DataFrame:
    """Weather means on the grid; with ``fill_bins`` also the empty cells between a
    station's first and last one, as nulls."""
    have = [c for c in measures if c in weather.columns]
    cells = (weather.withColumn("cell", floor_to_grid(ts, hours)).filter(F.col("cell").isNotNull())
             .groupBy(*keys, "cell").agg(*[mean(c).alias(c) for c in have]))
    if not fill_bins:
        return cells
    from limnoscope.operators.align import complete_axis
    return complete_axis(cells, "cell", F.make_dt_interval(F.lit(0), F.lit(hours)), keys)


def standard_table(readings: DataFrame, weather: DataFrame, hours: int = 3, tolerance: int = 1,
                   keys: Sequence[str] = KEYS,
                   measures: Sequence[str] = WEATHER_MEASURES) -> DataFrame:
    """Readings floored to the grid with the nearest weather cell attached.

    Weather counts as resampled to every cell of its span: a reading in a cell
    without weather gets nulls, not a neighbour's values.  ``tolerance`` counts
    the grid steps by which readings may lie outside the span.
    """
    have = [c for c in measures if c in weather.columns]
    gridded = readings.withColumn("timestamp", floor_to_grid("timestamp", hours))
    cells = weather_cells(weather, hours, keys, have)
    return asof_filled_grid(gridded, cells, have, step_hours=hours, tolerance=tolerance,
                            left_ts="timestamp", right_ts="cell", keys=keys)


def profile_from_raw(readings: DataFrame, weather: DataFrame, depths: Sequence[float], hours: int = 3,
                     tolerance: int = 1, measures: dict[str, str] | None = None, ts: str = "timestamp",
                     keys: Sequence[str] = KEYS, complete: bool = True) -> DataFrame:
    """The wide table of :func:`grid.profile_table` without the row-level standard table.

    Readings are averaged first, with partial sums on the map side, and the
    weather is attached to grid cells: the raw readings are never shuffled.
    """
    from limnoscope.operators.grid import profile_table

    wide = profile_table(readings, depths, hours, measures, weather=(), ts=ts, keys=keys, complete=complete)
    have = [c for c in WEATHER_MEASURES if c in weather.columns]
    cells = weather_cells(weather, hours, keys, have)
    out = asof_filled_grid(wide, cells, have, step_hours=hours, tolerance=tolerance, left_ts="cell",
                           right_ts="cell", keys=keys)
    return out.dropna(how="any") if complete else out


def to_float32(df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """Storage precision of the standard table; computation stays in double.

    Depth is a key, not a measure: it keeps its precision, or 0.1 would not be found again.
    """
    return df.withColumns({c: F.col(c).cast("float") for c in columns if c in df.columns and c != "depth"})


def train_cut(df: DataFrame, ts: str, train_frac: float = 0.7,
              keys: Sequence[str] = KEYS) -> DataFrame:
    """Time up to which rows belong to the first ``train_frac`` of a station.

    Counting rows per time first makes this a window over distinct times, so a
    station with very many readings costs no more than its calendar.  Gives
    ``cut`` (the time in which the row quota ends), ``take`` (rows of that time
    still inside the quota) and ``n_train``.
    """
    per_time = df.groupBy(*keys, F.col(ts).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy(*keys)
    run = group.orderBy("_t").rowsBetween(W.unboundedPreceding, 0)
    quota = F.floor(F.sum("_n").over(group) * F.lit(train_frac))
    counted = per_time.select(*keys, "_t", "_n", F.sum("_n").over(run).alias("_upto"),
                              quota.alias("n_train"))
    return (counted.filter((F.col("_upto") >= F.col("n_train"))
                           & (F.col("_upto") - F.col("_n") < F.col("n_train")))
            .select(*keys, F.col("_t").alias("cut"),
                    (F.col("n_train") - F.col("_upto") + F.col("_n")).alias("take"), "n_train"))


def norm_stats(df: DataFrame, columns: Sequence[str], ts: str = "timestamp",
               train_frac: float = 0.7, tie: Sequence[str] = ("depth",),
               keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean and sample standard deviation of each column over the train prefix.

    The prefix is the first ``train_frac`` of the rows by time; rows of the one
    time in which the quota ends are taken in ``tie`` order, equal ones in the
    order of their values, so the result does not depend on partitioning.
    """
    cut = train_cut(df, ts, train_frac, keys)
    marked = df.join(cut, list(keys)).filter(F.col(ts) <= F.col("cut"))
    whole = marked.filter(F.col(ts) < F.col("cut")).select(*keys, *columns)
    edge_order = W.partitionBy(*keys).orderBy(*tie, *[c for c in columns if c not in tie])
    edge = (marked.filter(F.col(ts) == F.col("cut"))
            .withColumn("_rn", F.row_number().over(edge_order))
            .filter(F.col("_rn") <= F.col("take")).select(*keys, *columns))
    rows = unpivot_columns(whole.unionByName(edge), columns, keys).withColumn("value", finite_or_null(F.col("value").cast("double")))
    return (rows.groupBy(*keys, "variable")
            .agg(F.avg("value").alias("mean"), (F.stddev_samp("value") + F.lit(EPS)).alias("std"),
                 F.count("value").alias("n"))
            .filter(F.col("n") > 0))


def standardise(df: DataFrame, stats: DataFrame, columns: Sequence[str],
                keys: Sequence[str] = KEYS) -> DataFrame:
    """Z-score each column with the station's fitted statistics (long form)."""
    wide = stats.groupBy(*keys).agg(
        *[F.max(F.when(F.col("variable") == c, F.col("mean"))).alias(f"_m_{c}") for c in columns],
        *[F.max(F.when(F.col("variable") == c, F.col("std"))).alias(f"_s_{c}") for c in columns])
    out = df.join(wide, list(keys))
    return (out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in columns})
            .drop(*[f"_{k}_{c}" for c in columns for k in "ms"]))
