"""Raw readings and weather to the stored standard table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from limnoscope.operators.ingest import coerce_types, norm_stats, standard_table
from limnoscope.schema import NUMERIC_COLUMNS
from limnoscope.sources.tables import read_standard, write_standard, write_stats


def build_standard(spark: SparkSession, readings: DataFrame, weather: DataFrame, out_dir: str,
                   train_frac: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Align, type, write ``standard`` and ``norm_stats`` under ``out_dir``.

    The statistics are taken from the written table, so the raw inputs are read once.
    """
    table = coerce_types(standard_table(readings, weather))
    path, stats_path = f"{out_dir.rstrip('/')}/standard", f"{out_dir.rstrip('/')}/norm_stats"
    write_standard(table, path)
    stored = read_standard(spark, path)
    columns = [c for c in NUMERIC_COLUMNS if c in stored.columns]
    doubles = stored.select("site_id", "timestamp", *[stored[c].cast("double").alias(c) for c in columns])
    stats = norm_stats(doubles, columns, train_frac=train_frac)
    write_stats(stats, stats_path)
    return stored, stats
