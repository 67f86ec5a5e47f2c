"""Rolling-origin evaluation of the baseline forecasts, all stations and windows in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnoscope.functions.columns import quantiles_from_target, to_target
from limnoscope.operators.forecast import train_changes, window_quantiles
from limnoscope.operators.grid import coarsen
from limnoscope.operators.metrics import score_rows, skill, summary_lattice
from limnoscope.operators.windows import assign_windows, by_horizon, supervised_windows, target_scale
from limnoscope.schema import HORIZON, LOOK_BACK, QUANTILE_LEVELS


def window_samples(daily: DataFrame, target: str = "conc_0_5", look_back: int = LOOK_BACK,
                   horizon: int = HORIZON, carry: Sequence[str] = (), **protocol) -> DataFrame:
    """Daily rows to forecast samples of every rolling window."""
    rows = assign_windows(daily.select("site_id", "day", target, *carry), **protocol)
    return supervised_windows(rows, target, look_back=look_back, horizon=horizon, carry=carry)


def member_forecasts(daily: DataFrame, target: str = "conc_0_5",
                     levels: Sequence[float] = QUANTILE_LEVELS, look_back: int = LOOK_BACK,
                     horizon: int = HORIZON, **protocol) -> DataFrame:
    """Test-part quantile forecasts of three members: change of the train part,
    change of the same month, and month climatology of the origin's month."""
    rows = assign_windows(daily.select("site_id", "day", target), **protocol)
    # One shuffle by window, which the samples and both sets of quantiles start from.
    rows = rows.repartition("site_id", "window_id")
    samples = supervised_windows(rows, target, look_back=look_back, horizon=horizon)
    ids = ["site_id", "window_id"]
    changes = window_quantiles(samples.filter("is_train"), F.col("delta"), "origin", levels).select(
        *ids, F.col("whole").alias("_change"), F.col("months").alias("_change_months"))
    climate = window_quantiles(rows.filter("is_train_row"), F.array(target), "day", levels).select(
        *ids, F.col("whole").alias("_clim"), F.col("months").alias("_clim_months"))
    # Rows of one window meet its row of quantiles before horizons and members become rows.
    test = samples.filter(~F.col("is_train")).join(climate, ids, "left").join(changes, ids, "left")
    month = F.month("origin") - 1
    clim = F.coalesce(F.get(F.get("_clim_months", month), F.lit(0)), F.get("_clim", F.lit(0)))

    def of_horizon(h):
        change = F.get("_change", h - 1)
        return F.struct(h.alias("h"), F.get("y", h - 1).alias("y_h"), change.alias("change"),
                        F.coalesce(F.get(F.get("_change_months", month), h - 1), change).alias("month_change"))

    each = F.transform(F.sequence(F.lit(1), F.lit(horizon)), of_horizon)
    test = test.select(*ids, "origin", "cur", clim.alias("_clim"), F.inline(each))

    def ahead(change):
        return F.transform(change, lambda v: v + F.col("cur"))

    members = F.array(*[F.struct(F.lit(m).alias("member"), q.alias("q")) for m, q in (
        ("change", ahead(F.col("change"))), ("month_change", ahead(F.col("month_change"))),
        ("climatology", F.col("_clim")))])
    return test.select(*ids, "origin", "h", "cur", "y_h", F.inline(members))


def restored_forecast(samples_h: DataFrame, kind: str, levels: Sequence[float] = QUANTILE_LEVELS,
                      ids: Sequence[str] = ("site_id", "window_id")) -> DataFrame:
    """Quantile forecast made on a transformed and scaled target and brought back: test rows with ``q`` in concentration.

    The forecast of a horizon is the train part's quantiles of the target in units of the
    window's scale; :func:`columns.quantiles_from_target` undoes scale and transform with
    each row's current value.
    """
    ids = list(ids)
    scaled = samples_h.join(target_scale(samples_h, kind, ids).select(*ids, "scale"), ids).withColumn("_t", to_target(kind, "cur", "y_h") / F.col("scale"))
    p = F.array(*[F.lit(float(v)) for v in levels])
    fitted = scaled.filter("is_train").groupBy(*ids, "h").agg(F.percentile("_t", p).alias("_q"))
    test = scaled.filter(~F.col("is_train")).join(fitted, [*ids, "h"])
    return test.withColumn("q", quantiles_from_target(kind, "cur", F.col("_q"), F.col("scale"))).drop("_t", "_q")


def skill_by_grid(wide: DataFrame, grids: dict[str, tuple[int, int, int]], target: str = "conc_0_5",
                  levels: Sequence[float] = QUANTILE_LEVELS, cell: str = "cell", **protocol) -> DataFrame:
    """CRPS of the change forecast and of persistence per grid, window and horizon, and the skill in percent.

    ``grids`` names a grid by its step in hours, look-back and horizon in steps; ``wide`` is
    on the finest one. Windows are cut by calendar day on every grid, so that equal windows
    and equal lead times (``lead_hours``) can be compared.
    """
    out = None
    for grid, (step, look_back, horizon) in grids.items():
        rows = coarsen(wide.select("site_id", cell, target), step_hours=step, cell=cell).withColumn("day", F.to_date(cell))
        samples = supervised_windows(assign_windows(rows, **protocol), target, ts=cell, look_back=look_back, horizon=horizon)
        long = by_horizon(samples)
        change, _ = train_changes(long, levels)
        test = long.filter(~F.col("is_train")).join(change, ["site_id", "window_id", "h"])
        scored = score_rows(test.withColumn("q", F.transform("change", lambda v: v + F.col("cur"))), levels)
        part = scored.groupBy("site_id", "window_id", "h").agg(
            F.avg("crps").alias("crps"), F.avg("crps_persist").alias("crps_persist"), F.count(F.lit(1)).alias("n"))
        part = part.select(F.lit(grid).alias("grid"), "*", (F.col("h") * step).alias("lead_hours"), skill("crps", "crps_persist").alias("skill"))
        out = part if out is None else out.unionByName(part)
    return out


def rolling_report(daily: DataFrame, target: str = "conc_0_5",
                   levels: Sequence[float] = QUANTILE_LEVELS, **options) -> DataFrame:
    """Window, member, horizon and overall summaries of the member forecasts."""
    return summary_lattice(score_rows(member_forecasts(daily, target, levels, **options), levels))
