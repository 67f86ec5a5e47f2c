"""Order-preserving slices of groups of any size.

Work that needs an order (ranks, running counts, the neighbour before) is done slice by
slice, and what a slice needs from those before it is one row per slice. Cuts between
slices are quantiles of the group's own values, from a mergeable sketch with partial
states before the shuffle, so slices hold about equally many rows however the values
lie. Slices need no exact cuts: any cuts give the same results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from limnoscope.functions.columns import as_col
from limnoscope.session import settled

#: About how many rows a slice of a large group has; groups up to this size are one slice.
ROWS_A_SLICE = 200_000
MOST_SLICES = 10_000


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` where nulls equal nulls; the left side's key columns stay."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"_right_{k}"])
    return left.join(renamed, cond, how).drop(*[f"_right_{k}" for k in keys])


def sliced(rows: DataFrame, at, keys: Sequence[str], rows_a_slice: int | None = None, name: str = "_slice") -> DataFrame:
    """``rows`` with a slice number that never decreases with the numeric ``at`` inside a group.

    ``rows`` should be stored or settled, as they are read three times. Equal values of
    ``at`` share a slice, rows without one are in slice 0. The largest group's size decides
    how many cuts are taken; a smaller group has fewer slices.
    """
    size, keys, x = rows_a_slice or ROWS_A_SLICE, list(keys), as_col(at).cast("double")
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    n = min(MOST_SLICES, math.ceil(most / size))
    if n <= 1:
        return rows.withColumn(name, F.lit(0))
    probs = F.array(*[F.lit(i / n) for i in range(1, n)])
    cuts = settled(rows.groupBy(*keys).agg(F.approx_percentile(x, probs, F.lit(20 * n)).alias("_slice_cuts"), F.count(F.lit(1)).alias("_slice_rows")))
    below = F.size(F.filter("_slice_cuts", lambda c: c < x))
    wanted = F.least(F.lit(n), F.ceil(F.col("_slice_rows") / F.lit(size)))
    number = F.floor(F.when(x.isNotNull() & F.col("_slice_cuts").isNotNull(), below).otherwise(0) * wanted / F.lit(n)).cast("int")
    return join_keys(rows, cuts, keys).withColumn(name, number).drop("_slice_cuts", "_slice_rows")


def numbered(rows: DataFrame, at, keys: Sequence[str], order: Sequence[str], name: str = "_pos", total: str = "_n",
             rows_a_slice: int | None = None) -> DataFrame:
    """``rows`` (stored or settled) with their position from 0 in ``order`` and the size of their group.

    ``at`` is numeric and never decreases in ``order``. Positions are counted inside slices;
    the rows of the slices before come from one row per slice.
    """
    keys = list(keys)
    parts = sliced(rows, at, keys, rows_a_slice)
    place = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order)) - 1
    counts = parts.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    whole = W.partitionBy(*keys)
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*keys, "_slice", before.alias("_before"), F.sum("_c").over(whole).alias(total))
    return (join_keys(parts.withColumn("_place", place), counts, [*keys, "_slice"])
            .withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_slice", "_before", "_place"))


def known_around(rows: DataFrame, at: str, keys: Sequence[str], known: dict[str, Column], strict: bool = False,
                 rows_a_slice: int | None = None) -> DataFrame:
    """``rows`` (stored or settled) with, for each entry of ``known``, ``_prev_<name>`` and ``_next_<name>``.

    These are the nearest non-null values of the expression at or before, and at or after,
    the row in the order of the numeric column ``at``; with ``strict`` the row itself does
    not count. Rows of one instant see each other (without ``strict``). Slices are searched
    on their own; one row per slice carries its first and last known value to the others.
    """
    keys = list(keys)
    parts = sliced(rows, at, keys, rows_a_slice).withColumns({f"_k_{name}": c for name, c in known.items()})
    inside = W.partitionBy(*keys, "_slice")
    up, down = inside.orderBy(at), inside.orderBy(F.col(at).desc())
    up, down = ((w.rowsBetween(W.unboundedPreceding, -1) if strict else w.rangeBetween(W.unboundedPreceding, W.currentRow)) for w in (up, down))
    ends = parts.groupBy(*keys, "_slice").agg(
        *[F.max_by(f"_k_{n}", F.when(F.col(f"_k_{n}").isNotNull(), F.col(at))).alias(f"_l_{n}") for n in known],
        *[F.min_by(f"_k_{n}", F.when(F.col(f"_k_{n}").isNotNull(), F.col(at))).alias(f"_f_{n}") for n in known])
    whole = W.partitionBy(*keys)
    before, after = whole.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1), whole.orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*keys, "_slice", *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_b_{n}") for n in known],
                       *[F.last(f"_f_{n}", ignorenulls=True).over(after).alias(f"_a_{n}") for n in known])
    parts = parts.withColumns({f"_prev_{n}": F.last(f"_k_{n}", ignorenulls=True).over(up) for n in known}
                              | {f"_next_{n}": F.last(f"_k_{n}", ignorenulls=True).over(down) for n in known})
    out = join_keys(parts, ends, [*keys, "_slice"]).withColumns(
        {f"_prev_{n}": F.coalesce(f"_prev_{n}", f"_b_{n}") for n in known} | {f"_next_{n}": F.coalesce(f"_next_{n}", f"_a_{n}") for n in known})
    return out.drop("_slice", *[f"_{c}_{n}" for c in "kba" for n in known])
