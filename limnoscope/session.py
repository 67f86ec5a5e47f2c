"""Session settings the operators are written for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "limnoscope", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` overrides any setting.

    On a cluster leave ``master`` unset (spark-submit supplies it) and size
    ``spark.sql.shuffle.partitions`` to two or three times the core count:
    adaptive execution coalesces what is too many and splits skewed joins.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int | str | None = None, **conf) -> SparkSession:
    """Local session for tests and the benchmark: as many shuffle partitions as cores."""
    cores = str(cores or os.cpu_count() or 8)
    return build_session(
        master=f"local[{cores}]",
        **{"spark.sql.shuffle.partitions": cores, "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false", **conf},
    )


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the reliable checkpoint folder and read from there.

    Iterative fits cut their lineage here, so that a lost executor costs one round at
    most. The folder is the one the cluster names in ``spark.checkpoint.dir``; only a
    local session gets a folder of its own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)
