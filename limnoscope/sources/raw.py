"""Raw tables: one file or directory per depth, weather, river observations, events."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnoscope.operators.ingest import coerce_types, rename_headers
from limnoscope.schema import EVENTS, OBSERVATIONS, WATER_MEASURES, WEATHER_MEASURES

_DEPTH_NAME = re.compile(r"(\d+(?:\.\d+)?)m(?:\.[A-Za-z]\w*)*$")


def depth_of(path: str) -> float:
    """Depth in a name such as ``0.5m`` or ``0.5m.csv.gz``."""
    found = _DEPTH_NAME.search(path.rstrip("/").rsplit("/", 1)[-1])
    if not found:
        raise ValueError(f"no depth in the name of {path}")
    return float(found.group(1))


def depth_paths(spark: SparkSession, root: str) -> list[str]:
    """Entries of ``root`` named after a depth, on any file system Spark can reach."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(root)
    entries = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = [e.getPath().toString() for e in entries]
    return sorted((n for n in names if _DEPTH_NAME.search(n.rsplit("/", 1)[-1])), key=depth_of)


def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        # Text columns: numbers are coerced afterwards, so one bad cell is a null.
        reader = reader.option("header", True).option("inferSchema", False)
    return reader.load(path)


def read_depth_tables(spark: SparkSession, source: str | Iterable[str], fmt: str = "csv") -> DataFrame:
    """Union of the per-depth tables with ``depth`` taken from their names.

    ``source`` is a directory holding them or their paths.  A depth column inside
    a table is dropped.  Tables may lack columns others have.  There are as many
    tables as sensor depths (twenty or so), each of any size.
    """
    paths = depth_paths(spark, source) if isinstance(source, str) else list(source)
    frames = []
    for path in paths:
        df = rename_headers(_read(spark, path, fmt))
        if "depth" in df.columns:
            df = df.drop("depth")
        frames.append(df.withColumn("depth", F.lit(depth_of(path))))
    if not frames:
        raise ValueError("no depth tables found")
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return coerce_types(union, ("depth", *WATER_MEASURES))


def read_weather(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The weather table; rows without a readable time are dropped."""
    df = coerce_types(rename_headers(_read(spark, path, fmt)), WEATHER_MEASURES)
    return df.filter(F.col("timestamp").isNotNull())


def read_observations(spark: SparkSession, path: str, sort: bool = False) -> DataFrame:
    """Multi-station observations from (gzipped) CSV.

    A gzipped file is read by one task; rewrite it to Parquet once before heavy
    use.  ``sort`` range-partitions by station and time, so a station with very
    many rows still spreads over partitions.
    """
    df = spark.read.schema(OBSERVATIONS).option("header", True).csv(path)
    return (df.repartitionByRange("site_id", "datetime").sortWithinPartitions("site_id", "datetime")
            if sort else df)


def event_table(spark: SparkSession, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A fixed list of (site_id, first day, last day) with numbered events."""
    df = spark.createDataFrame([tuple(r) for r in rows], "site_id string, start string, end string")
    return number_events(df.withColumns({c: F.col(c).cast("date") for c in ("start", "end")}))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event list from JSON lines with site_id, start, end."""
    return number_events(spark.read.schema(EVENTS).json(path))


def number_events(events: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    from pyspark.sql import Window as W

    order = W.partitionBy(*keys).orderBy("start", "end")
    return events.withColumn("event_id", F.row_number().over(order)).select(*keys, "event_id", "start", "end")
