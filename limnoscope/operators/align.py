"""As-of joins, axis completion and gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnoscope.functions.columns import as_col, hours_between
from limnoscope.operators.slices import join_keys, known_around, numbered
from limnoscope.schema import KEYS
from limnoscope.session import settled


def asof_nearest_grid(left: DataFrame, right: DataFrame, columns: Sequence[str], *,
                      step_hours: int, tolerance: int = 1, left_ts: str = "timestamp",
                      right_ts: str = "cell", keys: Sequence[str] = KEYS) -> DataFrame:
    """Nearest right cell within ``tolerance`` steps when both sides sit on one grid.

    Each right cell is copied to the ``2 * tolerance + 1`` cells it may serve and
    the nearest is kept per cell (the earlier one on a tie, nulls included), so
    what remains is an equi join on (station, cell): a station that owns a third
    of the rows is spread over its cells.
    """
    keys = list(keys)
    offsets = F.explode(F.array(*[F.lit(i) for i in range(-tolerance, tolerance + 1)]))
    served = (right.withColumn("_off", offsets)
              .withColumn("_cell", F.col(right_ts)
                          + F.make_dt_interval(F.lit(0), F.col("_off") * F.lit(step_hours))))
    # _off > 0: the source lies before the served cell, which wins a tie.
    rank = F.struct(F.abs("_off"), -F.col("_off"))
    nearest = served.groupBy(*keys, "_cell").agg(
        F.min_by(F.struct(*columns), rank).alias("_m"))
    nearest = nearest.select(*keys, F.col("_cell").alias("_rt"),
                             *[F.col(f"_m.{c}").alias(c) for c in columns])
    return _left_equi(left, nearest, left_ts, columns, keys)


def _left_equi(left: DataFrame, right: DataFrame, left_ts: str, columns: Sequence[str],
               keys: Sequence[str]) -> DataFrame:
    """Left join on the keys and ``left_ts`` = ``_rt``, key columns kept once."""
    named = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_rt", *columns)
    cond = F.col(left_ts) == F.col("_rt")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    return left.join(named, cond, "left").select(*left.columns, *columns)


def asof_filled_grid(left: DataFrame, cells: DataFrame, columns: Sequence[str], *, step_hours: int,
                     tolerance: int = 1, left_ts: str = "timestamp", right_ts: str = "cell",
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """As :func:`asof_nearest_grid` for a right side that stands for a filled axis.

    Between a station's first and last cell every cell exists, an absent one as
    nulls, so the nearest cell is the equal one and only ``tolerance`` cells
    beyond either end borrow the end's values.  Those few rows are added and the
    rest is one equi join on (station, cell); the axis itself is never built.
    """
    keys = list(keys)
    values = F.struct(*columns)
    ends = cells.groupBy(*keys).agg(
        F.min(right_ts).alias("_lo"), F.max(right_ts).alias("_hi"),
        F.min_by(values, right_ts).alias("_first"), F.max_by(values, right_ts).alias("_last"))

    def beyond(end, sign, i):
        return F.struct((F.col(end) + F.make_dt_interval(F.lit(0), F.lit(sign * i * step_hours))).alias("_rt"),
                        F.col("_first" if sign < 0 else "_last").alias("_m"))

    steps = range(1, tolerance + 1)
    extra = F.array(*[beyond("_lo", -1, i) for i in steps], *[beyond("_hi", 1, i) for i in steps])
    right = cells.select(*keys, F.col(right_ts).alias("_rt"), *columns)
    if tolerance:
        right = right.unionByName(ends.select(*keys, F.inline(extra))
                                  .select(*keys, "_rt", *[F.col(f"_m.{c}").alias(c) for c in columns]))
    return _left_equi(left, right, left_ts, columns, keys)


def asof_nearest(left: DataFrame, right: DataFrame, columns: Sequence[str], *,
                 tolerance_hours: float, left_ts: str = "timestamp", right_ts: str = "timestamp",
                 keys: Sequence[str] = KEYS, matched: str = "matched_at",
                 rows_a_slice: int | None = None) -> DataFrame:
    """Nearest right row within a tolerance at arbitrary times, ties to the earlier.

    Only the distinct instants of both sides are put in order, in slices of bounded size
    that carry their last and first right row to each other; a station, or a station's
    day, that owns a third of all rows is cut like any other.  The matches are joined back
    to the left rows by instant.  Of several right rows at one instant the first by value
    is used.
    """
    keys = list(keys)
    payload = F.struct(F.col(right_ts).alias("_rt"), *[F.col(c) for c in columns])
    one = (right.filter(F.col(right_ts).isNotNull())
           .groupBy(*keys, F.col(right_ts).alias("_t")).agg(F.min(payload).alias("_p")))
    asked = left.filter(F.col(left_ts).isNotNull()).groupBy(*keys, F.col(left_ts).alias("_t")).agg(F.lit(True).alias("_asked"))
    both = asked.unionByName(one, allowMissingColumns=True)
    both = settled(both.withColumn("_at", seconds_of("_t")))
    near = known_around(both, "_at", keys, {"p": F.col("_p")}, rows_a_slice=rows_a_slice).filter("_asked")
    prev, following = F.col("_prev_p"), F.col("_next_p")
    back = hours_between("_t", prev["_rt"])
    ahead = hours_between(following["_rt"], "_t")
    pick = (F.when(back.isNotNull() & (back <= tolerance_hours) & (ahead.isNull() | (back <= ahead)), prev)
            .when(ahead.isNotNull() & (ahead <= tolerance_hours), following))
    matches = near.select(*keys, "_t", pick.alias("_m")).filter(F.col("_m").isNotNull())
    rows = join_keys(left.withColumn("_t", F.col(left_ts)), matches, [*keys, "_t"])
    return rows.select(*left.columns, F.col("_m._rt").alias(matched), *[F.col(f"_m.{c}").alias(c) for c in columns])


def seconds_of(ts) -> Column:
    """A date or timestamp as seconds, a number in the same order."""
    return as_col(ts).cast("timestamp").cast("double")


#: Grid times of one array at most, when an axis is completed.
AXIS_BLOCK = 4096


def complete_axis(df: DataFrame, ts: str, step: Column | str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every grid time between a station's first and last one; new rows hold nulls.

    ``step`` is a day-time interval.  The axis is made in blocks, so a stray far time makes
    many rows but no long array.
    """
    keys = list(keys)
    step = F.expr(step) if isinstance(step, str) else step
    epoch = F.lit("1970-01-01").cast("timestamp")
    micros = F.unix_micros(epoch + step)
    n = F.floor((F.unix_micros(F.col("_hi").cast("timestamp")) - F.unix_micros(F.col("_lo").cast("timestamp"))) / micros)
    spans = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi")).filter(F.col("_lo").isNotNull())
    blocks = spans.select(*keys, "_lo", n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(n / F.lit(AXIS_BLOCK)))).alias("_b"))
    first = F.col("_b") * AXIS_BLOCK
    axis = (blocks.select(*keys, "_lo", F.explode(F.sequence(first, F.least(first + (AXIS_BLOCK - 1), F.col("_n")))).alias("_i"))
            .select(*keys, (F.col("_lo") + step * F.col("_i")).cast(df.schema[ts].dataType).alias(ts)))
    return axis.join(df, [*keys, ts], "left")


def interpolate_time(df: DataFrame, columns: Sequence[str], ts: str = "cell",
                     keys: Sequence[str] = KEYS, limit: int | None = None, rows_a_slice: int | None = None) -> DataFrame:
    """Linear interpolation in time.

    Without ``limit`` both ends are held flat.  With ``limit`` only the first
    ``limit`` rows of a gap are filled, forward only, and the last value is held
    after the end; nothing is filled before the first value.

    All columns are filled in one pass over slices of a station's rows; each slice carries
    its first and last known values to the others.
    """
    rows = settled(df.withColumn("_at", seconds_of(ts)))
    if limit is not None:
        rows = settled(numbered(rows, "_at", keys, [ts], "_pos", "_size", rows_a_slice))
    position = F.col("_pos") if limit is not None else F.lit(0).cast("long")
    known = {f"c{i}": F.when(F.col(c).isNotNull() & ~F.isnan(c), F.struct(F.col(c).alias("v"), F.col(ts).alias("t"), position.alias("p")))
             for i, c in enumerate(columns)}
    out = known_around(rows, "_at", keys, known, rows_a_slice=rows_a_slice)
    filled = {}
    for i, c in enumerate(columns):
        a, b = F.col(f"_prev_c{i}"), F.col(f"_next_c{i}")
        share = hours_between(ts, a["t"]) / hours_between(b["t"], a["t"])
        inner = F.when(a["t"] == b["t"], a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * share)
        if limit is None:
            filled[c] = (F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(inner))
        else:
            near = F.col("_pos") - a["p"] <= limit
            filled[c] = F.when(near & b.isNull(), a["v"]).when(near, inner)
    return out.withColumns(filled).select(*df.columns)


def fill_forward(df: DataFrame, columns: Sequence[str], ts: str = "cell",
                 keys: Sequence[str] = KEYS, rows_a_slice: int | None = None) -> DataFrame:
    """Carry the last value forward; the head takes the first value there is."""
    rows = settled(df.withColumn("_at", seconds_of(ts)))
    out = known_around(rows, "_at", keys, {f"c{i}": F.col(c) for i, c in enumerate(columns)}, rows_a_slice=rows_a_slice)
    return out.withColumns({c: F.coalesce(f"_prev_c{i}", f"_next_c{i}") for i, c in enumerate(columns)}).select(*df.columns)


def join_sparse(df: DataFrame, sparse: DataFrame, columns: Sequence[str],
                on: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Left join of a series with gaps; what is missing becomes ``fill``."""
    return (df.join(sparse.select(*on, *columns), list(on), "left")
            .withColumns({c: F.coalesce(as_col(c), F.lit(fill)) for c in columns}))
