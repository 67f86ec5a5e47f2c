"""Isotonic calibration of many groups at once.

Probabilities are collapsed to distinct values with map-side sums. Chunks of neighbouring
values are pooled to increasing blocks where they are; then blocks of neighbouring chunks
are joined and pooled again, in rounds that halve the number of chunks. Pooling what is
already pooled gives the curve of all values, so no task sees the rows of a group, and
nothing passes the driver. A curve has at most one block per distinct probability, which
``decimals`` bounds (10**decimals + 1).
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from limnoscope.session import settled

CHUNK = 256
#: A block's first and last probability, the sum of its outcomes and their number.
BLOCK = ("_lo", "_hi", "_s", "_n")


def _pool(blocks: pa.Table) -> pa.Table:
    """Blocks with increasing means, by pooling neighbours that violate the order; one pass over a stack.

    The blocks of one chunk, or of two to be joined, with its keys in the columns before.
    """
    stack = []
    for lo, hi, s, n in sorted(zip(*[blocks[c].to_pylist() for c in BLOCK])):
        while stack and stack[-1][2] * n >= s * stack[-1][3]:
            before = stack.pop()
            lo, s, n = before[0], s + before[2], n + before[3]
        stack.append((lo, hi, s, n))
    same = blocks.drop_columns(list(BLOCK)).take([0] * len(stack))
    for name, values in zip(BLOCK, zip(*stack)):
        same = same.append_column(name, pa.array(values, pa.float64()))
    return same


def _pooled(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of keys and a block, pooled inside each key; a task holds the blocks of one key at a time."""
    rows = blocks.select(*keys, *BLOCK)
    return rows.groupBy(*keys).applyInArrow(_pool, rows.schema)


def isotonic_curves(rows: DataFrame, p: str, outcome: str, by: Sequence[str], decimals: int = 6, chunk: int = CHUNK) -> DataFrame:
    """One row per group: ``blocks`` (lo, hi, value), increasing in all three.

    A group whose probabilities or outcomes are all alike gets its mean outcome, kept
    off 0 and 1 by a millionth. Rows without a probability or outcome do not count.
    """
    by = list(by)
    at = F.round(F.col(p).cast("double"), decimals).alias("_p")
    y = F.col(outcome).cast("double")
    points = (rows.filter(F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")) & y.isNotNull())
              .groupBy(*by, at).agg(F.sum(y).alias("_s"), F.count(F.lit(1)).cast("double").alias("_n")))
    # Parts of the value range, then chunks of each part: order-preserving, of bounded size.
    parts = points.repartitionByRange(*by, "_p").withColumn("_part", F.spark_partition_id())
    place = F.row_number().over(W.partitionBy(*by, "_part").orderBy("_p")) - 1
    chunks = parts.select(*by, "_part", F.floor(place / F.lit(chunk)).cast("int").alias("_c"),
                          F.col("_p").alias("_lo"), F.col("_p").alias("_hi"), "_s", "_n")
    number = F.dense_rank().over(W.partitionBy(*by).orderBy("_part", "_c")) - 1
    pooled = settled(_pooled(chunks, [*by, "_part", "_c"]).select(*by, number.alias("_i"), *BLOCK))
    last = pooled.agg(F.max("_i")).first()[0] or 0
    while last:
        pooled = settled(_pooled(pooled.withColumn("_i", F.floor(F.col("_i") / F.lit(2)).cast("int")), [*by, "_i"]))
        last //= 2
    pooled = pooled.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(c[1:]) for c in BLOCK]))).alias("b"))
    total = F.aggregate("b", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n")),
                        lambda a, x: F.struct((a["s"] + x["s"]).alias("s"), (a["n"] + x["n"]).alias("n")))
    flat = (F.get("b", F.lit(0))["lo"] == F.element_at("b", -1)["hi"]) | (F.col("_t.s") == 0) | (F.col("_t.s") == F.col("_t.n"))
    mean = F.least(F.greatest(F.col("_t.s") / F.col("_t.n"), F.lit(1e-6)), F.lit(1.0 - 1e-6))
    curve = F.transform("b", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), F.when(F.col("_flat"), F.col("_mean")).otherwise(x["s"] / x["n"]).alias("value")))
    return (pooled.withColumn("_t", total).withColumns({"_flat": flat, "_mean": mean})
            .select(*by, curve.alias("blocks"), F.col("_t.n").cast("long").alias("n_fitted")))


def apply_isotonic(rows: DataFrame, curves: DataFrame, p: str, by: Sequence[str], decimals: int = 6, name: str = "p_calibrated") -> DataFrame:
    """``rows`` with the curve's value at ``p``: constant on a block, linear between blocks, held flat beyond the ends.

    Rows of groups without a curve get null.
    """
    x = F.round(F.col(p).cast("double"), decimals)
    below = F.element_at(F.filter("blocks", lambda b: b["lo"] <= F.col("_x")), -1)
    above = F.get(F.filter("blocks", lambda b: b["hi"] >= F.col("_x")), F.lit(0))
    lo, hi = F.col("_below"), F.col("_above")
    between = lo["value"] + (hi["value"] - lo["value"]) * (F.col("_x") - lo["hi"]) / (hi["lo"] - lo["hi"])
    value = (F.when(lo.isNull(), hi["value"]).when(hi.isNull(), lo["value"])
             .when(lo["lo"] == hi["lo"], lo["value"]).otherwise(between))
    # A filter without a match has no last element.
    last_below = F.when(F.get("blocks", F.lit(0))["lo"] <= F.col("_x"), below)
    return (rows.join(curves.select(*by, "blocks"), list(by), "left").withColumn("_x", x)
            .withColumns({"_below": last_below, "_above": above}).withColumn(name, F.when(F.col("_x").isNotNull(), value))
            .drop("blocks", "_x", "_below", "_above"))
