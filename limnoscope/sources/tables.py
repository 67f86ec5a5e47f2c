"""The library's own tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from limnoscope.operators.ingest import to_float32


def write_standard(df: DataFrame, path: str, mode: str = "overwrite", max_rows: int = 5_000_000) -> None:
    """Standard long table as Parquet, one directory per station.

    Rows are spread by ranges of (station, time), whose bounds follow from where
    the rows are, so a station with a third of all rows is written by a third of
    the tasks; files are cut at ``max_rows``.
    """
    spread = to_float32(df).repartitionByRange("site_id", "timestamp")
    (spread.write.mode(mode).option("maxRecordsPerFile", max_rows)
     .partitionBy("site_id").parquet(path))


def read_standard(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Standard table; only the named columns are read from the files.

    Station ids are text: the schema names them so, because a directory name
    such as ``0902``, ``1e3`` or ``12.0`` would be read back as a number.
    """
    inferred = spark.read.parquet(path).schema
    schema = T.StructType([T.StructField("site_id", T.StringType()) if f.name == "site_id" else f for f in inferred])
    df = spark.read.schema(schema).parquet(path)
    return df.select(*columns) if columns else df


def write_stats(stats: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Normalisation statistics, a few rows per station, as JSON lines."""
    stats.write.mode(mode).json(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("site_id string, variable string, mean double, std double, n long").json(path)


def write_metrics(metrics: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Tidy metric rows."""
    metrics.write.mode(mode).format(fmt).save(path)
