"""Baseline forecasts, scores, calibration."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.series import LEVEL_SQL, SAMPLE_SQL, TARGET, cdf_sql, samples, windows
from catalog.views import floor_sql
from limnoscope.functions.scores import (
    crps_energy, crps_gaussian, crps_pinball, crps_quantiles, pinball, pit, prob_up_gaussian,
    quantile_at, sorted_quantiles, with_prob_up,
)
from limnoscope.operators.conformal import (
    adjusted_intervals, calibrate, calibrate_seasonal, calibrate_weighted, previous_year_block, season_pool,
)
from limnoscope.operators.features import window_stats
from limnoscope.operators.forecast import (
    after_train, autoregression, boosted_peak, boosted_quantiles, boosted_trees, change_quantiles, climatology,
    feature_ablation, level_classifier, month_quantiles, persistence, ridge_forecast,
)
from limnoscope.operators.isotonic import apply_isotonic, isotonic_curves
from limnoscope.operators.labels import class_weights, warning_levels
from limnoscope.operators.logistic import state_probability
from limnoscope.operators.metrics import (
    best_threshold, calibration_table, class_recall, class_summary, day_blocks,
    direction_rates, errors, evaluation_units, expected_calibration_error,
    interval_summary, member_range, pit_histogram, probability_summary, quantile_ensemble,
    score_rows, skill, summary_lattice,
)
from limnoscope.operators.ranks import roc_auc
from limnoscope.operators.windows import assign_windows, by_horizon, supervised_windows
from limnoscope.plans.rolling import member_forecasts, restored_forecast, skill_by_grid
from limnoscope.schema import QUANTILE_LEVELS, STRIDE_DAYS, TEST_DAYS
from limnoscope.session import settled

IDS = ("site_id", "window_id")
LEVELS = QUANTILE_LEVELS
_L = "[" + ", ".join(str(p) for p in LEVELS) + "]"
_L3 = (0.1, 0.5, 0.9)


def shifted(q: str, by: str) -> str:
    """SQL list of ``q`` with ``by`` added to each of its nine entries, at nine decimals."""
    return "[" + ", ".join(f"round({q}[{i}] + {by}, 9)" for i in range(1, len(LEVELS) + 1)) + "]"


MEMBER_SQL = SAMPLE_SQL + f""",
qa AS (SELECT site_id, window_id, h, quantile_cont(delta_h, {_L}) AS qa FROM sl WHERE is_train GROUP BY ALL),
qm AS (SELECT site_id, window_id, h, month(origin) AS m, quantile_cont(delta_h, {_L}) AS qm FROM sl WHERE is_train
  GROUP BY ALL HAVING count(*) >= 5),
ca AS (SELECT site_id, window_id, quantile_cont(conc_0_5, {_L}) AS ca FROM win WHERE is_train_row GROUP BY ALL),
cm AS (SELECT site_id, window_id, month(day) AS m, quantile_cont(conc_0_5, {_L}) AS cm FROM win WHERE is_train_row
  GROUP BY ALL HAVING count(*) >= 5),
test AS (SELECT * REPLACE (round(y_h, 9) AS y_h) FROM sl WHERE NOT is_train),
fc AS (SELECT t.site_id, t.window_id, t.origin, t.h, t.cur, t.y_h, {shifted('qa', 'cur')} AS q, 'change' AS member
    FROM test t JOIN qa USING (site_id, window_id, h)
  UNION ALL SELECT t.site_id, t.window_id, t.origin, t.h, t.cur, t.y_h, {shifted('coalesce(qm, qa)', 'cur')} AS q, 'month_change'
    FROM test t JOIN qa USING (site_id, window_id, h) LEFT JOIN qm ON qm.site_id = t.site_id AND qm.window_id = t.window_id
      AND qm.h = t.h AND qm.m = month(t.origin)
  UNION ALL SELECT t.site_id, t.window_id, t.origin, t.h, t.cur, t.y_h, list_transform(coalesce(cm, ca), lambda x: round(x, 9)) AS q, 'climatology'
    FROM test t JOIN ca USING (site_id, window_id) LEFT JOIN cm ON cm.site_id = t.site_id AND cm.window_id = t.window_id
      AND cm.m = month(t.origin))"""


def crps_sql(name: str, source: str, levels=LEVELS, q: str = "q", y: str = "y_h") -> str:
    """CTE ``name``: ``source`` plus ``crps``, the squared distance of two distribution functions.

    The forecast's function is linear between its quantiles and continues its outer
    pieces to 0 and 1. A piece from (left, low) to (right, high) is cut at y; below y
    its height counts, above y what it lacks to 1, each as width * (a² + ab + b²) / 3.
    The area between a piece's ends and y, at the ends' heights, joins the pieces; it
    cancels unless quantiles are tied. A tied piece rises at slope 1 from its place.
    """
    n = len(levels)
    low_tail = f"{q}[1] - ({q}[2] - {q}[1]) * {levels[0] / (levels[1] - levels[0])}"
    high_tail = f"{q}[{n}] + ({q}[{n}] - {q}[{n - 1}]) * {(1 - levels[-1]) / (levels[-1] - levels[-2])}"
    places = ", ".join([low_tail, *(f"{q}[{i}]" for i in range(1, n + 1)), high_tail])
    heights = [0.0, *levels, 1.0]
    pieces = ", ".join(f"{{'low': {heights[i]}::DOUBLE, 'high': {heights[i + 1]}::DOUBLE, 'lft': x[{i + 1}], 'rgt': x[{i + 2}]}}" for i in range(n + 1))
    return f"""
{name}_x AS MATERIALIZED (SELECT *, row_number() OVER () AS rid, [{places}] AS x FROM (SELECT * REPLACE (list_sort({q}) AS {q}) FROM {source})),
{name}_p AS (SELECT rid, y, low, high, lft, CASE WHEN abs(far - lft) < 1e-12 * (high - low) THEN lft + high - low ELSE far END AS rgt
  FROM (SELECT rid, y, piece.low, piece.high, piece.lft, piece.rgt AS far FROM (SELECT rid, {y} AS y, unnest([{pieces}]) AS piece FROM {name}_x))),
{name}_c AS (SELECT *, low + (high - low) * (cut - lft) / (rgt - lft) AS mid FROM (SELECT *, least(greatest(y, lft), rgt) AS cut FROM {name}_p)),
{name}_a AS (SELECT rid, sum((cut - lft) * (low * low + low * mid + mid * mid) / 3
    + (rgt - cut) * ((1 - mid) * (1 - mid) + (1 - mid) * (1 - high) + (1 - high) * (1 - high)) / 3
    + CASE WHEN lft >= y THEN (1 - low) * (1 - low) * (lft - y) ELSE -low * low * (y - lft) END
    - CASE WHEN rgt >= y THEN (1 - high) * (1 - high) * (rgt - y) ELSE -high * high * (y - rgt) END) AS area FROM {name}_c GROUP BY rid),
{name} AS (SELECT o.*, greatest(CASE WHEN x[{n + 2}] - x[1] < 1e-9 THEN abs({y} - {q}[{(n + 1) // 2}]) ELSE area END, 0.0) AS crps
  FROM {name}_x o JOIN {name}_a USING (rid))"""


SCORED_SQL = MEMBER_SQL + "," + crps_sql("scored0", "fc") + """,
scored AS (SELECT *, abs(y_h - cur) AS crps_persist, CASE WHEN y_h BETWEEN q[2] AND q[8] THEN 1.0 ELSE 0.0 END AS covered,
    q[8] - q[2] AS width, pow(y_h - q[5], 2) AS sq_err FROM scored0)"""


def members(v):
    """Forecasts at nine decimals, so that a value on a quantile is on it in SQL too."""
    return member_forecasts(v.daily, TARGET).withColumns({
        "q": F.transform("q", lambda x: F.round(x, 9)), "y_h": F.round("y_h", 9)})


def scored(v):
    return score_rows(members(v), LEVELS)


_QCOLS = " ".join(f"q{i}:d" for i in range(1, 10))


@query("member_forecasts", f"site_id:s window_id:i member:s origin:s h:i cur:d y_h:d {_QCOLS}",
       "SELECT *, " + ", ".join(f"q[{i}] AS q{i}" for i in range(1, 10)) + " FROM fc", ctes=MEMBER_SQL)
def _(v):
    return members(v).withColumns({f"q{i}": F.get("q", F.lit(i - 1)) for i in range(1, 10)})


@query("crps_by_origin", "site_id:s window_id:i member:s origin:s crps:d crps_persist:d covered:d width:d sq_err:d",
       """SELECT site_id, window_id, member, origin, avg(crps) AS crps, avg(crps_persist) AS crps_persist, avg(covered) AS covered,
            avg(width) AS width, avg(sq_err) AS sq_err FROM scored GROUP BY ALL""", ctes=SCORED_SQL)
def _(v):
    return scored(v).groupBy(*IDS, "member", "origin").agg(
        *[F.avg(c).alias(c) for c in ("crps", "crps_persist", "covered", "width", "sq_err")])


@query("crps_three_levels", "site_id:s window_id:i h:i crps:d crps_approx:d n:i",
       """SELECT site_id, window_id, h, avg(crps) AS crps, avg(pb) AS crps_approx, count(*) AS n FROM (
            SELECT *, 2.0 / 3 * (""" + " + ".join(f"greatest({p} * (y_h - q[{i + 1}]), ({p} - 1) * (y_h - q[{i + 1}]))" for i, p in enumerate(_L3))
       + ") AS pb FROM c3) GROUP BY ALL", ctes=MEMBER_SQL + """,
three AS (SELECT site_id, window_id, origin, h, cur, y_h, [q[2], q[5], q[8]] AS q FROM fc WHERE member = 'change'),""" + crps_sql("c3", "three", _L3))
def _(v):
    rows = members(v).filter(F.col("member") == "change").withColumn(
        "q3", F.array(*[quantile_at("q", LEVELS, p) for p in _L3]))
    rows = rows.withColumns({"crps_": crps_quantiles(sorted_quantiles("q3"), _L3, "y_h"), "pb": crps_pinball("q3", _L3, "y_h")})
    return rows.groupBy(*IDS, "h").agg(F.avg("crps_").alias("crps"), F.avg("pb").alias("crps_approx"), F.count(F.lit(1)).alias("n"))


@query("other_scores", "site_id:s member:s h:i energy:d pinball_sum:d pit_mean:d gaussian:d n:i",
       f"""SELECT site_id, member, h, avg(near / 9 - spread / 81 / 2) AS energy, avg(pb) AS pinball_sum, avg(pit) AS pit_mean,
             avg(sd * (z * ({cdf_sql('z')} * 2 - 1) + 2 * exp(-0.5 * z * z) / sqrt(2 * pi()) - 1 / sqrt(pi()))) AS gaussian, count(*) AS n
           FROM (SELECT *, (y_h - q[5]) / greatest(sd, 1e-6) AS z FROM (SELECT *, greatest((q[8] - q[2]) / 2.563, 1e-6) AS sd, """
       + " + ".join(f"abs(q[{i}] - y_h)" for i in range(1, 10)) + " AS near, "
       + " + ".join(f"2 * abs(q[{i}] - q[{j}])" for i in range(1, 10) for j in range(i + 1, 10)) + " AS spread, "
       + " + ".join(f"greatest({p} * (y_h - q[{i + 1}]), ({p} - 1) * (y_h - q[{i + 1}]))" for i, p in enumerate(LEVELS)) + " AS pb, ("
       + " + ".join(f"(CASE WHEN q[{i}] < y_h THEN 1.0 WHEN q[{i}] = y_h THEN 0.5 ELSE 0.0 END)" for i in range(1, 10))
       + ") / 9 AS pit FROM fc)) GROUP BY ALL", ctes=MEMBER_SQL)
def _(v):
    rows = members(v)
    sd = F.greatest((quantile_at("q", LEVELS, 0.9) - quantile_at("q", LEVELS, 0.1)) / 2.563, F.lit(1e-6))
    rows = rows.withColumns({"e": crps_energy("q", "y_h"), "p": pinball("q", LEVELS, "y_h"), "t": pit("q", "y_h"),
                             "g": crps_gaussian(quantile_at("q", LEVELS, 0.5), sd, "y_h")})
    return rows.groupBy("site_id", "member", "h").agg(
        F.avg("e").alias("energy"), F.avg("p").alias("pinball_sum"), F.avg("t").alias("pit_mean"),
        F.avg("g").alias("gaussian"), F.count(F.lit(1)).alias("n"))


@query("pit_histogram", "site_id:s member:s bin:i n:i pit_mean:d",
       """SELECT site_id, member, least(floor(pit * 10), 9) AS bin, count(*) AS n, avg(pit) AS pit_mean FROM (SELECT *, ("""
       + " + ".join(f"(CASE WHEN q[{i}] < y_h THEN 1.0 WHEN q[{i}] = y_h THEN 0.5 ELSE 0.0 END)" for i in range(1, 10))
       + ")::DOUBLE / 9 AS pit FROM fc) GROUP BY ALL", ctes=MEMBER_SQL)
def _(v):
    return pit_histogram(members(v).withColumn("pit", pit("q", "y_h")), by=("site_id", "member"))


@query("persistence_crps", "site_id:s window_id:i h:i crps_persist:d n:i",
       "SELECT site_id, window_id, h, avg(abs(y_h - cur)) AS crps_persist, count(*) AS n FROM sl WHERE NOT is_train GROUP BY ALL", ctes=SAMPLE_SQL)
def _(v):
    rows = persistence(by_horizon(samples(v)).filter(~F.col("is_train")))
    return rows.withColumn("c", crps_quantiles("q", LEVELS, "y_h")).groupBy(*IDS, "h").agg(
        F.avg("c").alias("crps_persist"), F.count(F.lit(1)).alias("n"))


@query("climatology_forecast", "site_id:s window_id:i h:i crps:d rmse_mean:d n:i",
       "SELECT site_id, window_id, h, avg(crps) AS crps, sqrt(avg(pow(y_h - mean, 2))) AS rmse_mean, count(*) AS n FROM cc GROUP BY ALL",
       ctes=SAMPLE_SQL + """, ma AS (SELECT site_id, window_id, quantile_cont(conc_0_5, [0.1, 0.5, 0.9]) AS qa, avg(conc_0_5) AS aa FROM win WHERE is_train_row GROUP BY ALL),
mm AS (SELECT site_id, window_id, month(day) AS m, quantile_cont(conc_0_5, [0.1, 0.5, 0.9]) AS qm, avg(conc_0_5) AS am FROM win WHERE is_train_row GROUP BY ALL HAVING count(*) >= 5),
cj AS (SELECT t.*, coalesce(qm, qa) AS q, coalesce(am, aa) AS mean FROM sl t JOIN ma USING (site_id, window_id)
  LEFT JOIN mm ON mm.site_id = t.site_id AND mm.window_id = t.window_id AND mm.m = month(t.origin) WHERE NOT is_train),""" + crps_sql("cc", "cj", _L3))
def _(v):
    rows = windows(v)
    test = by_horizon(supervised_windows(rows, TARGET)).filter(~F.col("is_train"))
    fc = climatology(test, month_quantiles(rows.filter("is_train_row"), TARGET), target_day="origin")
    e = F.col("y_h") - F.col("mean")
    return fc.withColumn("c", crps_quantiles("q", _L3, "y_h")).groupBy(*IDS, "h").agg(
        F.avg("c").alias("crps"), F.sqrt(F.avg(e * e)).alias("rmse_mean"), F.count(F.lit(1)).alias("n"))


_UNITS = """units AS (SELECT site_id, window_id, member, avg(crps) AS crps, avg(crps_persist) AS cp, avg(covered) AS coverage, avg(width) AS width,
    sqrt(avg(sq_err)) AS rmse, (avg(crps_persist) - avg(crps)) / avg(crps_persist) * 100 AS skill, count(*) AS n_rows FROM scored GROUP BY ALL),
units_h AS (SELECT site_id, window_id, member, h, avg(crps) AS crps, avg(crps_persist) AS cp, avg(covered) AS coverage, sqrt(avg(sq_err)) AS rmse,
    CASE WHEN avg(crps_persist) <> 0 THEN (avg(crps_persist) - avg(crps)) / avg(crps_persist) * 100 END AS skill FROM scored GROUP BY ALL)"""
_AGG = """avg(crps) AS crps_mean, stddev_pop(crps) AS crps_std, avg(cp) AS crps_persist, avg(skill) AS mean_skill, avg(coverage) AS coverage_mean,
  avg(rmse) AS rmse_mean, count(*) AS n_units, (avg(cp) - avg(crps)) / avg(cp) * 100 AS skill_of_means"""


@query("rolling_report", "site_id:s level:s part:s crps_mean:d crps_std:d crps_persist:d mean_skill:d skill_of_means:d coverage_mean:d rmse_mean:d n_units:i",
       f"""SELECT site_id, 'window' AS level, CAST(window_id AS VARCHAR) AS part, {_AGG} FROM units GROUP BY ALL
           UNION ALL SELECT site_id, 'member', member, {_AGG} FROM units GROUP BY ALL
           UNION ALL SELECT site_id, 'overall', 'all', {_AGG} FROM units GROUP BY site_id
           UNION ALL SELECT site_id, 'horizon', CAST(h AS VARCHAR), {_AGG} FROM units_h GROUP BY site_id, h""", ctes=SCORED_SQL + "," + _UNITS)
def _(v):
    return summary_lattice(scored(v))


@query("window_skill", "site_id:s window_id:i member:s crps:d crps_persist:d skill:d coverage:d width:d rmse:d n_rows:i",
       "SELECT *, cp AS crps_persist FROM units", ctes=SCORED_SQL + "," + _UNITS)
def _(v):
    return evaluation_units(scored(v), [*IDS, "member"])


@query("member_range", "site_id:s window_id:i best_crps:d avg_crps:d worst_crps:d best_rmse:d avg_rmse:d best_coverage:d avg_coverage:d",
       """SELECT site_id, window_id, min(crps) AS best_crps, avg(crps) AS avg_crps, max(crps) AS worst_crps, min(rmse) AS best_rmse, avg(rmse) AS avg_rmse,
            max(coverage) AS best_coverage, avg(coverage) AS avg_coverage FROM units GROUP BY ALL""", ctes=SCORED_SQL + "," + _UNITS)
def _(v):
    return member_range(evaluation_units(scored(v), [*IDS, "member"]), IDS)


ENSEMBLE_SQL = MEMBER_SQL + """,
ens0 AS (SELECT site_id, window_id, origin, h, [""" + ", ".join(f"avg(q[{i}])" for i in range(1, 10)) + """] AS q, min(y_h) AS y_h, min(cur) AS cur,
    count(*) AS n_members FROM fc GROUP BY site_id, window_id, origin, h)"""


@query("quantile_ensemble", "site_id:s window_id:i h:i crps:d coverage:d rmse:d skill:d n:i",
       """SELECT site_id, window_id, h, avg(crps) AS crps, avg(CASE WHEN y_h BETWEEN q[2] AND q[8] THEN 1.0 ELSE 0.0 END) AS coverage,
            sqrt(avg(pow(y_h - q[5], 2))) AS rmse, CASE WHEN avg(abs(y_h - cur)) <> 0 THEN (avg(abs(y_h - cur)) - avg(crps)) / avg(abs(y_h - cur)) * 100 END AS skill,
            count(*) AS n FROM ens GROUP BY ALL""", ctes=ENSEMBLE_SQL + "," + crps_sql("ens", "ens0"))
def _(v):
    ens = score_rows(quantile_ensemble(members(v), 9, [*IDS, "origin", "h"]), LEVELS)
    return ens.groupBy(*IDS, "h").agg(
        F.avg("crps").alias("crps"), F.avg("covered").alias("coverage"), F.sqrt(F.avg("sq_err")).alias("rmse"),
        F.avg("crps_persist").alias("cp"), F.count(F.lit(1)).alias("n")).withColumn("skill", skill("crps", "cp"))


@query("interval_coverage", "site_id:s member:s h:i coverage:d width:d n:i",
       """SELECT site_id, member, h, avg(CASE WHEN y_h BETWEEN q[2] AND q[8] THEN 1.0 ELSE 0.0 END) AS coverage, avg(q[8] - q[2]) AS width,
            count(*) AS n FROM fc GROUP BY ALL""", ctes=MEMBER_SQL)
def _(v):
    rows = members(v)
    lo, hi = quantile_at("q", LEVELS, 0.1), quantile_at("q", LEVELS, 0.9)
    return interval_summary(rows.withColumns({"covered": F.col("y_h").between(lo, hi).cast("double"), "width": hi - lo}),
                            ["site_id", "member", "h"])


@query("errors_by_horizon", "site_id:s member:s h:i rmse:d mae:d n:i",
       "SELECT site_id, member, h, sqrt(avg(pow(y_h - q[5], 2))) AS rmse, avg(abs(y_h - q[5])) AS mae, count(*) AS n FROM fc GROUP BY ALL", ctes=MEMBER_SQL)
def _(v):
    return errors(members(v), quantile_at("q", LEVELS, 0.5), "y_h", ["site_id", "member", "h"])


@query("layer_errors", "site_id:s depth:d rmse:d mae:d n:i",
       """SELECT site_id, depth, sqrt(avg(pow(total_conc - prev, 2))) AS rmse, avg(abs(total_conc - prev)) AS mae, count(*) AS n FROM (
            SELECT *, lag(total_conc) OVER (PARTITION BY site_id, depth ORDER BY day) AS prev FROM cells) WHERE prev IS NOT NULL GROUP BY ALL""")
def _(v):
    prev = F.lag("total_conc").over(W.partitionBy("site_id", "depth").orderBy("day"))
    return errors(v.cells.withColumn("prev", prev).filter(F.col("prev").isNotNull()), "prev", "total_conc", ["site_id", "depth"])


@query("day_blocks", "site_id:s day_ahead:i crps:d n_steps:i",
       """SELECT site_id, (h - 1) // 3 + 1 AS day_ahead, avg(c) AS crps, count(*) AS n_steps FROM (
            SELECT site_id, h, avg(abs(y_h - cur)) AS c FROM sl WHERE NOT is_train GROUP BY ALL) GROUP BY ALL""", ctes=SAMPLE_SQL)
def _(v):
    per_h = by_horizon(samples(v)).filter(~F.col("is_train")).groupBy("site_id", "h").agg(
        F.avg(F.abs(F.col("y_h") - F.col("cur"))).alias("crps"))
    return day_blocks(per_h, "crps", ["site_id"], steps_per_day=3)


# ------------------------------------------------------ probability of a rise
def _pchip_sql() -> str:
    """P(rise) from q10, q50, q90 of the change: normal, linear and monotone cubic."""
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    def seg(make):
        return ("CASE " + " ".join(f"WHEN x{i} <= 0 THEN {make(i)}" for i in (3, 2, 1)) + f" ELSE {make(0)} END")
    t = seg(lambda i: f"CASE WHEN x{i + 1} > x{i} THEN -x{i} / (x{i + 1} - x{i}) ELSE 0.0 END")
    lin = seg(lambda i: f"{probs[i]} + t * {probs[i + 1] - probs[i]}")
    def slope(i):
        # secants with a guard for tied knots
        sl = f"({probs[i] - probs[i - 1]} / nullif(x{i} - x{i - 1}, 0))"
        sr = f"({probs[i + 1] - probs[i]} / nullif(x{i + 1} - x{i}, 0))"
        w1 = f"(2 * (x{i} - x{i - 1}) + (x{i + 1} - x{i}))"
        w2 = f"((x{i} - x{i - 1}) + 2 * (x{i + 1} - x{i}))"
        den = f"(coalesce({w1} / {sl}, 0) + coalesce({w2} / {sr}, 0))"
        return f"CASE WHEN abs({den}) < 1e-12 THEN 0.0 ELSE ({w1} + {w2}) / {den} END"
    d = {1: "d1", 2: "d2", 3: "d3"}
    def cubic(i):
        h = f"(x{i + 1} - x{i})"
        left = str(probs[1]) if i == 0 else f"{h} * {d[i]}"
        right = str(probs[4] - probs[3]) if i == 3 else f"{h} * {d[i + 1]}"
        return (f"(2*t*t*t - 3*t*t + 1) * {probs[i]} + (t*t*t - 2*t*t + t) * {left}"
                f" + (3*t*t - 2*t*t*t) * {probs[i + 1]} + (t*t*t - t*t) * {right}")
    edge = "CASE WHEN x0 >= 0 THEN 0.0 WHEN x4 <= 0 THEN 1.0 ELSE least(greatest({0}, 0.0), 1.0) END"
    z = "(CASE WHEN sg > 1e-9 THEN x2 / greatest(sg, 1e-12) WHEN x2 > 0 THEN 5.0 WHEN x2 < 0 THEN -5.0 ELSE 0.0 END)"
    return f"""up AS (SELECT *, least(greatest({cdf_sql('z')}, 1e-6), 1 - 1e-6) AS p_gauss, 1 - ({edge.format(lin)}) AS p_linear,
    1 - (CASE WHEN x3 - x1 < 1e-9 THEN CASE WHEN x2 > 1e-9 THEN 0.0 WHEN x2 < -1e-9 THEN 1.0 ELSE 0.5 END ELSE {edge.format(seg(cubic))} END) AS p_monotone
  FROM (SELECT *, {t} AS t, {slope(1)} AS d1, {slope(2)} AS d2, {slope(3)} AS d3, {z} AS z FROM (
    SELECT *, x1 - (x2 - x1) / 4 AS x0, x3 + (x3 - x2) / 4 AS x4, (x3 - x1) / 2.563 AS sg FROM (
      SELECT site_id, window_id, origin, h, member, y_h - cur AS delta_h, CASE WHEN y_h > cur THEN 1 ELSE 0 END AS rise,
        q[2] - cur AS x1, q[5] - cur AS x2, q[8] - cur AS x3 FROM fc))))"""


UP_SQL = MEMBER_SQL + "," + _pchip_sql()


def rises(v):
    rows = members(v)
    low, mid, high = (quantile_at("q", LEVELS, p) - F.col("cur") for p in _L3)
    rows = rows.withColumns({"d10": low, "d50": mid, "d90": high, "delta_h": F.col("y_h") - F.col("cur"),
                             "rise": (F.col("y_h") > F.col("cur")).cast("int")})
    return with_prob_up(rows.withColumn("p_gauss", prob_up_gaussian("d10", "d50", "d90")), "d10", "d50", "d90")


@query("rise_probability", "site_id:s window_id:i member:s origin:s h:i p_gauss:d p_linear:d p_monotone:d rise:i", "SELECT * FROM up", ctes=UP_SQL)
def _(v):
    return rises(v)


@query("rise_scores", "site_id:s h:i accuracy:d brier:d n:i",
       """SELECT site_id, h, avg(CASE WHEN (p_monotone > 0.5) = (rise = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, avg(pow(p_monotone - rise, 2)) AS brier,
            count(*) AS n FROM up GROUP BY ALL""", ctes=UP_SQL)
def _(v):
    return probability_summary(rises(v), "p_monotone", "rise", ["site_id", "h"])


_BINS = """bins AS (SELECT site_id, h, least(greatest(floor(p_gauss * 10), 0), 9) AS bin, count(*) AS n, avg(p_gauss) AS p_mean,
    avg(rise) AS observed FROM up GROUP BY ALL)"""


@query("calibration_table", "site_id:s h:i bin:i n:i p_mean:d observed:d", "SELECT * FROM bins", ctes=UP_SQL + "," + _BINS)
def _(v):
    return calibration_table(rises(v), "p_gauss", "rise", ["site_id", "h"])


@query("calibration_error", "site_id:s h:i ece:d n:i", "SELECT site_id, h, sum(n * abs(p_mean - observed)) / sum(n) AS ece, sum(n) AS n FROM bins GROUP BY ALL",
       ctes=UP_SQL + "," + _BINS)
def _(v):
    return expected_calibration_error(calibration_table(rises(v), "p_gauss", "rise", ["site_id", "h"]), ["site_id", "h"])


@query("roc_auc", "site_id:s member:s h:i n_pos:i n_neg:i auc:d",
       """SELECT site_id, member, h, sum(rise) AS n_pos, sum(1 - rise) AS n_neg,
            CASE WHEN sum(rise) > 0 AND sum(1 - rise) > 0 THEN (sum(rise * r) - sum(rise) * (sum(rise) + 1) / 2.0) / (sum(rise) * sum(1 - rise)) END AS auc
          FROM (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY site_id, member, h, p) - 1) / 2.0 AS r FROM (SELECT *, round(p_gauss, 6) AS p FROM up)
            WINDOW w AS (PARTITION BY site_id, member, h ORDER BY p)) GROUP BY ALL""", ctes=UP_SQL)
def _(v):
    return roc_auc(rises(v).withColumn("p_gauss", F.round("p_gauss", 6)), "p_gauss", "rise", ["site_id", "member", "h"])


# A threshold is tuned on the test parts of windows that end before the last window's
# test begins, and judged on that one.
CLEAR_WINDOWS = -(-TEST_DAYS // STRIDE_DAYS)


def tuned_and_judged(rows):
    newest = rows.withColumn("_w", F.max("window_id").over(W.partitionBy("site_id")))
    return (newest.filter(F.col("window_id") <= F.col("_w") - CLEAR_WINDOWS).drop("_w"),
            newest.filter(F.col("window_id") == F.col("_w")).drop("_w"))


@query("best_threshold", "site_id:s h:i tau:d tuned_accuracy:d n_tuned:i accuracy:d n:i",
       f"""SELECT site_id, h, tau, tuned_accuracy, n_tuned, avg(CASE WHEN (p_gauss > tau) = (rise = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM (
            SELECT site_id, h, tau, ok / n AS tuned_accuracy, n AS n_tuned FROM (
              SELECT site_id, h, tau, sum(CASE WHEN (p_gauss > tau) = (rise = 1) THEN 1 ELSE 0 END) AS ok, count(*) AS n
              FROM (SELECT up.* FROM up JOIN newest USING (site_id) WHERE window_id <= nw - {CLEAR_WINDOWS}),
                (SELECT 0.02::DOUBLE + 0.01::DOUBLE * i AS tau FROM range(97) r(i)) GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY site_id, h ORDER BY ok DESC, tau) = 1)
          JOIN (SELECT up.site_id, up.h, up.p_gauss, up.rise FROM up JOIN newest USING (site_id) WHERE window_id = nw) USING (site_id, h)
          GROUP BY ALL""", ctes=UP_SQL + ", newest AS (SELECT site_id, max(window_id) AS nw FROM up GROUP BY site_id)")
def _(v):
    tune, judge = tuned_and_judged(rises(v))
    best = best_threshold(tune, "p_gauss", "rise", ["site_id", "h"]).withColumnsRenamed({"accuracy": "tuned_accuracy", "n": "n_tuned"})
    right = ((F.col("p_gauss") > F.col("tau")) == (F.col("rise") == 1)).cast("double")
    return (judge.join(best, ["site_id", "h"]).groupBy("site_id", "h", "tau", "tuned_accuracy", "n_tuned")
            .agg(F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("n")))


@query("direction_rates", "site_id:s window_id:i h:i up_rate:d constant_accuracy:d n:i",
       """SELECT site_id, window_id, h, avg(CASE WHEN delta_h > 0 THEN 1.0 ELSE 0.0 END) AS up_rate,
            greatest(avg(CASE WHEN delta_h > 0 THEN 1.0 ELSE 0.0 END), 1 - avg(CASE WHEN delta_h > 0 THEN 1.0 ELSE 0.0 END)) AS constant_accuracy,
            count(*) AS n FROM sl WHERE NOT is_train GROUP BY ALL""", ctes=SAMPLE_SQL)
def _(v):
    return direction_rates(by_horizon(samples(v)).filter(~F.col("is_train")), [*IDS, "h"])


# The twin takes each point's value from the definition: the highest, over starts at or
# before it, of the lowest mean over ends at or after it.
_ISO_SQL = UP_SQL + f""", newest AS (SELECT site_id, max(window_id) AS nw FROM up GROUP BY site_id),
tune AS (SELECT site_id, h, round(p_gauss, 3) AS p, rise FROM up JOIN newest USING (site_id) WHERE window_id <= nw - {CLEAR_WINDOWS}),
pts AS (SELECT *, row_number() OVER w AS i, sum(s) OVER w AS cs, sum(n) OVER w AS cn FROM (
  SELECT site_id, h, p, sum(rise)::DOUBLE AS s, count(*)::DOUBLE AS n FROM tune GROUP BY ALL) WINDOW w AS (PARTITION BY site_id, h ORDER BY p)),
flat AS (SELECT site_id, h, min(p) = max(p) OR sum(s) = 0 OR sum(s) = sum(n) AS flat, least(greatest(sum(s) / sum(n), 1e-6), 1 - 1e-6) AS mean FROM pts GROUP BY ALL),
ends AS (SELECT a.site_id, a.h, a.i AS a, b.i AS b, min((b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)) OVER (PARTITION BY a.site_id, a.h, a.i ORDER BY b.i DESC) AS low
  FROM pts a JOIN pts b ON a.site_id = b.site_id AND a.h = b.h AND a.i <= b.i),
iso AS (SELECT p.site_id, p.h, p.p, CASE WHEN any_value(flat) THEN any_value(mean) ELSE max(low) END AS f FROM ends e
  JOIN pts p ON p.site_id = e.site_id AND p.h = e.h AND p.i = e.b JOIN flat g ON g.site_id = p.site_id AND g.h = p.h GROUP BY ALL),
judge AS (SELECT up.site_id, up.h, round(p_gauss, 3) AS p, rise FROM up JOIN newest USING (site_id) WHERE window_id = nw),
low_ AS (SELECT j.*, i.p AS p0, i.f AS f0 FROM judge j ASOF LEFT JOIN iso i ON i.site_id = j.site_id AND i.h = j.h AND j.p >= i.p),
both_ AS (SELECT l.*, i.p AS p1, i.f AS f1 FROM low_ l ASOF LEFT JOIN iso i ON i.site_id = l.site_id AND i.h = l.h AND l.p <= i.p),
told AS (SELECT site_id, h, rise, CASE WHEN p0 IS NULL THEN f1 WHEN p1 IS NULL THEN f0 WHEN p1 = p0 THEN f0 ELSE f0 + (f1 - f0) * (p - p0) / (p1 - p0) END AS c FROM both_)"""


@query("isotonic_calibration", "site_id:s h:i accuracy:d brier:d n:i",
       "SELECT site_id, h, avg(CASE WHEN (round(c, 9) > 0.5) = (rise = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, avg(pow(round(c, 9) - rise, 2)) AS brier, count(*) AS n FROM told GROUP BY ALL",
       ctes=_ISO_SQL)
def _(v):
    """One curve per station and horizon, at three decimals of the probability."""
    ids = ["site_id", "h"]
    tune, judge = tuned_and_judged(settled(rises(v).select(*IDS, "h", "p_gauss", "rise")))
    curves = isotonic_curves(tune, "p_gauss", "rise", ids, decimals=3)
    out = apply_isotonic(judge, curves, "p_gauss", ids, decimals=3)
    return probability_summary(out.withColumn("p_calibrated", F.round("p_calibrated", 9)), "p_calibrated", "rise", ids)


# --------------------------------------------------- transformed targets, grids
_KIND_SQL = {"abs_delta": ("y_h - cur", "cur + {t}"), "rel_delta": ("(y_h - cur) / greatest(cur, 1.0)", "cur + greatest(cur, 1.0) * {t}"),
             "log_ratio": ("ln(1 + y_h) - ln(1 + cur)", "exp(ln(1 + cur) + {t}) - 1"), "abs_log": ("ln(1 + y_h)", "exp({t}) - 1")}
_RESTORE_SQL = SAMPLE_SQL + ", targets AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS kind, *, {make} AS t FROM sl" for k, (make, _) in _KIND_SQL.items()) + f"""),
scales AS (SELECT kind, site_id, window_id, stddev_pop(t) + 1e-8 AS scale FROM targets WHERE is_train GROUP BY ALL),
fitted AS (SELECT kind, site_id, window_id, h, quantile_cont(t / scale, {list(_L3)}) AS tq FROM targets JOIN scales USING (kind, site_id, window_id) WHERE is_train GROUP BY ALL),
back AS (SELECT t.*, list_transform(tq, lambda v: CASE kind """ + " ".join(
    f"WHEN '{k}' THEN {undo.format(t='(v * scale)')}" for k, (_, undo) in _KIND_SQL.items()) + """ END) AS q
  FROM targets t JOIN fitted USING (kind, site_id, window_id, h) JOIN scales USING (kind, site_id, window_id) WHERE NOT is_train)"""


@query("restored_quantiles", "kind:s site_id:s window_id:i h:i q10:d q50:d q90:d mae:d n:i",
       "SELECT kind, site_id, window_id, h, avg(q[1]) AS q10, avg(q[2]) AS q50, avg(q[3]) AS q90, avg(abs(y_h - q[2])) AS mae, count(*) AS n FROM back GROUP BY ALL",
       ctes=_RESTORE_SQL)
def _(v):
    """Quantiles forecast on four transformed, scaled targets, back in concentration."""
    long = settled(by_horizon(samples(v)))
    out = None
    for kind in _KIND_SQL:
        rows = restored_forecast(long, kind, _L3).withColumn("kind", F.lit(kind))
        part = rows.groupBy("kind", *IDS, "h").agg(
            *[F.avg(F.get("q", F.lit(i))).alias(n) for i, n in enumerate(("q10", "q50", "q90"))],
            F.avg(F.abs(F.col("y_h") - F.get("q", F.lit(1)))).alias("mae"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


# Thirty days of readings: windows of twenty train and five test days, three apart.
_GRIDS = {"3h": (3, 16, 8), "12h": (12, 4, 2), "1D": (24, 2, 1)}
_SHORT = {"train_days": 20, "test_days": 5, "stride_days": 3}


def _grid_sql():
    parts, last = [], []
    for g, (step, t, h) in _GRIDS.items():
        n = g.lower()
        parts.append(f"""g{n} AS (SELECT site_id, {floor_sql('cell', step)} AS ts_, avg(conc_0_5) AS c FROM fast_wide GROUP BY ALL),
s{n} AS (SELECT site_id, min(CAST(ts_ AS DATE)) AS d0, greatest(0, CAST(floor((date_diff('day', min(CAST(ts_ AS DATE)), max(CAST(ts_ AS DATE))) - 20) / 3.0) AS BIGINT) + 1) AS nw FROM g{n} GROUP BY site_id),
w{n} AS (SELECT g.*, CAST(w AS INTEGER) AS window_id, date_diff('day', d0, CAST(ts_ AS DATE)) < 3 * w + 20 AS tr FROM g{n} g JOIN s{n} USING (site_id),
  (SELECT unnest(range((SELECT max(nw) FROM s{n}))) AS w) r WHERE w < nw AND date_diff('day', d0, CAST(ts_ AS DATE)) >= 3 * w AND date_diff('day', d0, CAST(ts_ AS DATE)) < 3 * w + 25),
p{n} AS (SELECT *, row_number() OVER o - 1 AS p, count(*) OVER (PARTITION BY site_id, window_id) AS n, sum(CAST(tr AS INTEGER)) OVER (PARTITION BY site_id, window_id) AS ntr,
  {', '.join(f'lead(c, {k}) OVER o AS y{k}' for k in range(1, h + 1))} FROM w{n} WINDOW o AS (PARTITION BY site_id, window_id ORDER BY ts_)),
l{n} AS (SELECT site_id, window_id, c AS cur, p - {t - 1} < greatest(0, ntr - {t + h - 1}) AS is_train, unnest([{', '.join(f"{{'h': {k}, 'y': y{k}}}" for k in range(1, h + 1))}]) AS z
  FROM p{n} WHERE p - {t - 1} >= 0 AND p - {t - 1} < n - {t + h})""")
        last.append(f"SELECT '{g}' AS grid, {step} AS step, site_id, window_id, cur, is_train, z.h AS h, z.y AS y_h FROM l{n}")
    parts.append("every AS (" + " UNION ALL ".join(last) + ")")
    parts.append(f"""chg AS (SELECT grid, site_id, window_id, h, quantile_cont(y_h - cur, {list(LEVELS)}) AS dq FROM every WHERE is_train GROUP BY ALL),
gfc AS (SELECT e.*, list_transform(dq, lambda v: v + cur) AS q FROM every e JOIN chg USING (grid, site_id, window_id, h) WHERE NOT is_train)""")
    return ", ".join(parts) + "," + crps_sql("gs", "gfc")


@query("skill_by_grid", "grid:s site_id:s window_id:i h:i lead_hours:i crps:d crps_persist:d skill:d n:i",
       """SELECT *, CASE WHEN crps_persist <> 0 THEN 100 * (crps_persist - crps) / crps_persist END AS skill FROM (
            SELECT grid, site_id, window_id, h, h * step AS lead_hours, avg(crps) AS crps, avg(abs(y_h - cur)) AS crps_persist, count(*) AS n FROM gs GROUP BY ALL)""",
       ctes=_grid_sql())
def _(v):
    return skill_by_grid(v.fast_wide, _GRIDS, TARGET, **_SHORT)


# ------------------------------------------------------------------ conformal
# Calibration pool: the change forecasts of all windows whose test part ends before the
# last window's begins; groups are (station, horizon) over many windows.
POOL_SQL = MEMBER_SQL + f""",
pool0 AS (SELECT site_id, window_id, origin, h, y_h, q[2] AS q10, q[5] AS q50, q[8] AS q90, month(origin) AS m, year(origin) AS yr FROM fc WHERE member = 'change'),
lastw AS (SELECT site_id, max(window_id) AS lw FROM pool0 GROUP BY site_id),
calp AS (SELECT p.* FROM pool0 p JOIN lastw USING (site_id) WHERE window_id <= lw - {CLEAR_WINDOWS}),
testp AS (SELECT p.* FROM pool0 p JOIN lastw USING (site_id) WHERE window_id = lw),
centre AS (SELECT site_id, CAST(floor(median(m)) AS INTEGER) AS c, min(yr) AS ty FROM testp WHERE h = 1 GROUP BY site_id),
cal AS (SELECT c.*, centre.c AS centre FROM calp c JOIN centre USING (site_id)),
sides AS (SELECT site_id, h, m, centre, yr, unnest([{{'s': 'abs50', 'v': abs(y_h - q50)}}, {{'s': 'symabs', 'v': greatest(q10 - y_h, y_h - q90)}},
    {{'s': 'low', 'v': greatest(q10 - y_h, 0.0)}}, {{'s': 'up', 'v': greatest(y_h - q90, 0.0)}}]) AS z FROM cal),
sc AS (SELECT site_id, h, m, centre, yr, z.s AS side, z.v AS score FROM sides)"""


def pool(v):
    """Change forecasts with ``is_test`` for each station's last window and ``is_cal`` for those
    that end before its test part, and that window's centre month and year on every row."""
    rows = change_quantiles(by_horizon(samples(v))).filter(~F.col("is_train")).select(
        *IDS, "origin", "h", "y_h", "cur", *[quantile_at("q", LEVELS, p).alias(n) for p, n in zip(_L3, ("q10", "q50", "q90"))],
        F.month("origin").alias("month"), F.year("origin").alias("year"))
    site = W.partitionBy("site_id")
    newest = F.max("window_id").over(site)
    rows = rows.withColumns({"is_test": F.col("window_id") == newest, "is_cal": F.col("window_id") <= newest - CLEAR_WINDOWS})
    first = F.col("is_test") & (F.col("h") == 1)
    return rows.withColumns({
        "centre_month": F.floor(F.percentile(F.when(first, F.col("month")), F.lit(0.5)).over(site)).cast("int"),
        "test_year": F.min(F.when(first, F.col("year"))).over(site)})


def cal_pool(v):
    return pool(v).filter("is_cal")


def _kth(source: str, alpha: float, sides: str) -> str:
    return f"""SELECT site_id, h, {', '.join(f"max(CASE WHEN side = '{s}' THEN score END) AS adj_{s}" for s in sides.split())}, max(n) AS n_scores FROM (
      SELECT *, row_number() OVER (PARTITION BY site_id, h, side ORDER BY score) AS rk, count(*) OVER (PARTITION BY site_id, h, side) AS n FROM {source})
      WHERE rk = greatest(1, least(CAST(ceil((n + 1) * (1.0::DOUBLE - {alpha})) AS BIGINT), n)) GROUP BY ALL"""


@query("conformal_adjustment", "site_id:s h:i adj_abs50:d adj_symabs:d adj_low:d adj_up:d n_scores:i",
       _kth("sc", 0.2, "abs50 symabs low up"), ctes=POOL_SQL)
def _(v):
    return calibrate(cal_pool(v), 0.2, ["site_id", "h"])


@query("conformal_coverage", "site_id:s method:s coverage:d width:d n:i",
       " UNION ALL ".join(f"""SELECT site_id, '{m}' AS method, avg(CASE WHEN y_h BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) AS coverage, avg(hi - lo) AS width,
           count(*) AS n FROM (SELECT *, {lo} AS lo, {hi} AS hi FROM testp JOIN adj USING (site_id, h)) GROUP BY site_id""" for m, lo, hi in (
           ("raw", "q10", "q90"), ("abs50", "q50 - adj_abs50", "q50 + adj_abs50"),
           ("symabs", "least(q10 - adj_symabs, q50)", "greatest(q90 + adj_symabs, q50)"), ("cqr", "least(q10 - adj_low, q50)", "greatest(q90 + adj_up, q50)"))),
       ctes=POOL_SQL + ", adj AS (" + _kth("sc", 0.2, "abs50 symabs low up") + ")")
def _(v):
    rows = pool(v)
    adjustment = calibrate(rows.filter("is_cal"), 0.2, ["site_id", "h"])
    out = adjusted_intervals(rows.filter("is_test").join(adjustment, ["site_id", "h"]))
    return interval_summary(out.withColumns({
        "covered": F.col("y_h").between(F.col("lower"), F.col("upper")).cast("double"),
        "width": F.col("upper") - F.col("lower")}), ["site_id", "method"])


@query("weighted_conformal", "site_id:s h:i adj_low:d adj_up:d n_scores:i",
       """SELECT site_id, h, max(CASE WHEN side = 'low' THEN a END) AS adj_low, max(CASE WHEN side = 'up' THEN a END) AS adj_up, max(n) AS n_scores FROM (
            SELECT site_id, h, side, min(score) FILTER (WHERE cw >= 0.8::DOUBLE * tw OR rn = n) AS a, max(n) AS n FROM (
              SELECT *, sum(w) OVER (PARTITION BY site_id, h, side ORDER BY score) AS cw, sum(w) OVER (PARTITION BY site_id, h, side) AS tw,
                row_number() OVER (PARTITION BY site_id, h, side ORDER BY score) AS rn, count(*) OVER (PARTITION BY site_id, h, side) AS n FROM (
                SELECT *, exp(-pow(least(abs(m - centre) % 12, 12 - abs(m - centre) % 12), 2) / 2.0) AS w FROM sc WHERE side IN ('low', 'up')))
            GROUP BY ALL) GROUP BY site_id, h""", ctes=POOL_SQL)
def _(v):
    return calibrate_weighted(cal_pool(v), 0.2, ["site_id", "h"])


@query("season_pool_conformal", "site_id:s h:i adj_low:d adj_up:d n_scores:i", _kth("near", 0.2, "low up"),
       ctes=POOL_SQL + ", near AS (SELECT * FROM sc WHERE side IN ('low', 'up') AND least(abs(m - centre) % 12, 12 - abs(m - centre) % 12) <= 1)")
def _(v):
    return calibrate(season_pool(cal_pool(v)), 0.2, ["site_id", "h"], sides=("low", "up"))


@query("season_regression_conformal", "site_id:s h:i adj_low:d adj_up:d n_scores:i",
       """SELECT site_id, h, max(CASE WHEN side = 'low' THEN a END) AS adj_low, max(CASE WHEN side = 'up' THEN a END) AS adj_up, max(n) AS n_scores FROM (
            SELECT r.site_id, r.h, r.side, r.n, r.rest + s.lv AS a FROM (
              SELECT *, row_number() OVER (PARTITION BY site_id, h, side ORDER BY rest) AS rk, count(*) OVER (PARTITION BY site_id, h, side) AS n FROM rest) r
            JOIN smooth s ON s.site_id = r.site_id AND s.h = r.h AND s.side = r.side AND s.m = r.centre
            WHERE rk = greatest(1, least(CAST(ceil((n + 1) * (1.0::DOUBLE - 0.2)) AS BIGINT), n))) GROUP BY site_id, h""",
       ctes=POOL_SQL + """, two AS (SELECT * FROM sc WHERE side IN ('low', 'up')),
mean_all AS (SELECT site_id, h, side, avg(score) AS a FROM two GROUP BY ALL),
mean_m AS (SELECT site_id, h, side, m, avg(score) AS a FROM two GROUP BY ALL),
full_m AS (SELECT x.site_id, x.h, x.side, CAST(r.m AS INTEGER) AS m, coalesce(y.a, x.a) AS a FROM mean_all x CROSS JOIN range(1, 13) r(m)
  LEFT JOIN mean_m y ON y.site_id = x.site_id AND y.h = x.h AND y.side = x.side AND y.m = r.m),
smooth AS (SELECT f.site_id, f.h, f.side, f.m, 0.25 * p.a + 0.5 * f.a + 0.25 * n.a AS lv FROM full_m f
  JOIN full_m p ON p.site_id = f.site_id AND p.h = f.h AND p.side = f.side AND p.m = (f.m + 10) % 12 + 1
  JOIN full_m n ON n.site_id = f.site_id AND n.h = f.h AND n.side = f.side AND n.m = f.m % 12 + 1),
rest AS (SELECT t.*, t.score - s.lv AS rest FROM two t JOIN smooth s USING (site_id, h, side, m))""")
def _(v):
    return calibrate_seasonal(cal_pool(v), 0.2, ["site_id", "h"])


@query("held_out_season", "site_id:s h:i kept:i held:i",
       """SELECT site_id, h, count(*) FILTER (WHERE NOT held) AS kept, count(*) FILTER (WHERE held) AS held FROM (
            SELECT *, least(abs(m - centre.c) % 12, 12 - abs(m - centre.c) % 12) <= 1 AND yr = ty - 1 AS held FROM calp JOIN centre USING (site_id)) GROUP BY ALL""",
       ctes=POOL_SQL)
def _(v):
    kept, held = previous_year_block(cal_pool(v), "month", "centre_month", "year", "test_year")
    ids = ["site_id", "h"]
    return (kept.groupBy(*ids).agg(F.count(F.lit(1)).alias("kept"))
            .join(held.groupBy(*ids).agg(F.count(F.lit(1)).alias("held")), ids, "left").na.fill(0, ["held"]))


# ------------------------------------------------------------- learned baselines
FEATURES = ("conc_0_5_last", "conc_0_5_mean", "conc_0_5_std", "conc_0_5_change")
MORE = ("air_temp_mean", "delta_T", "thermo_grad")


def featured(v):
    """Samples with look-back statistics of the window's own rows."""
    rows = assign_windows(v.daily.select("site_id", "day", TARGET, "air_temp", "delta_T", "thermo_grad"))
    rows = window_stats(rows, [TARGET, "air_temp"], "day", keys=IDS)
    return supervised_windows(rows, TARGET, carry=(*FEATURES, *MORE, "train_end"))


@query("ridge_errors", "site_id:s window_id:i h:i rmse:d mae:d n:i")
def _(v):
    rows = ridge_forecast(by_horizon(featured(v)), FEATURES).filter(~F.col("is_train"))
    return errors(rows, "pred", "y_h", [*IDS, "h"])


@query("feature_ablation", "site_id:s window_id:i arm:s rmse:d mae:d n:i")
def _(v):
    return feature_ablation(by_horizon(featured(v)), {"base": FEATURES, "with_stratification": (*FEATURES, "delta_T", "thermo_grad"),
                                                      "all": (*FEATURES, *MORE)})


_ORDER = 48
# The twin solves the same normal equations by the same recursion, on lists: ``a`` is the
# prediction polynomial, ``e`` its error, ``x`` the coefficients of each horizon.
_AR_SQL = f"""ar0 AS (SELECT site_id, day, conc_0_5 AS v, row_number() OVER (PARTITION BY site_id ORDER BY day) - 1 AS i,
    count(*) OVER (PARTITION BY site_id) - {_ORDER + 7} AS n FROM daily),
ar AS (SELECT *, CAST(floor(n * 0.7::DOUBLE) AS BIGINT) AS ntr, CAST(floor(n * 0.15::DOUBLE) AS BIGINT) AS nva FROM ar0 WHERE n >= 3),
arm AS (SELECT site_id, avg(v) AS mu FROM ar WHERE i < ntr + {_ORDER + 6} GROUP BY site_id),
arx AS (SELECT ar.*, v - mu AS x, mu FROM ar JOIN arm USING (site_id)),
arr AS (SELECT site_id, list(s ORDER BY k) AS r FROM (SELECT a.site_id, a.i - b.i AS k, sum(a.x * b.x) AS s FROM arx a JOIN arx b
    ON a.site_id = b.site_id AND b.i <= a.i AND a.i - b.i < {_ORDER + 7} WHERE a.i < a.ntr + {_ORDER + 6} GROUP BY ALL) GROUP BY site_id),
lev AS (
  SELECT site_id, 0 AS m, [1.0::DOUBLE] AS a, r[1] AS e, list_transform(range(1, 8), lambda h: [r[h + 1] / r[1]]) AS x FROM arr
  UNION ALL
  SELECT site_id, m + 1, a2, e2, list_transform(range(1, 8), lambda h: list_transform(range(0, m + 2), lambda i:
      coalesce(x[h][i + 1], 0.0) + (r[h + m + 2] - list_sum(list_transform(range(0, m + 1), lambda j: x[h][j + 1] * r[m + 2 - j]))) / e2 * a2[m + 2 - i]))
  FROM (SELECT *, e * (1 - k * k) AS e2, list_transform(range(0, m + 2), lambda i: coalesce(a[i + 1], 0.0) + k * coalesce(a[m + 2 - i], 0.0)) AS a2
    FROM (SELECT lev.*, r, -list_sum(list_transform(range(0, m + 1), lambda i: a[i + 1] * r[m + 2 - i])) / e AS k FROM lev JOIN arr USING (site_id) WHERE m < {_ORDER - 1}))),
phi AS (SELECT site_id, h, j, x[h][j + 1] AS b FROM lev, range(1, 8) hh(h), range(0, {_ORDER}) jj(j) WHERE m = {_ORDER - 1}),
arp AS (SELECT t.site_id, t.i, h, any_value(t.mu) + sum(b * q.x) AS pred FROM arx t JOIN phi USING (site_id) JOIN arx q ON q.site_id = t.site_id AND q.i = t.i - j
  WHERE t.i - {_ORDER - 1} >= t.ntr + t.nva AND t.i - {_ORDER - 1} < t.n GROUP BY ALL)"""


@query("autoregression_errors", "site_id:s h:i rmse:d mae:d n:i",
       "SELECT p.site_id, p.h, sqrt(avg(pow(y.v - pred, 2))) AS rmse, avg(abs(y.v - pred)) AS mae, count(*) AS n FROM arp p JOIN ar y ON y.site_id = p.site_id AND y.i = p.i + p.h GROUP BY ALL",
       ctes=_AR_SQL, recursive=True)
def _(v):
    rows = autoregression(v.daily.select("site_id", "day", TARGET), TARGET, "day", order=_ORDER, horizon=7)
    return errors(rows, "pred", "y_h", ["site_id", "h"])


@query("boosted_tree_errors", "site_id:s window_id:i h:i rmse:d mae:d n:i")
def _(v):
    out = after_train(boosted_trees(featured(v), (*FEATURES, *MORE)))
    pairs = F.posexplode(F.arrays_zip(F.col("y").alias("y"), F.col("pred").alias("p"))).alias("_h", "_p")
    rows = out.select(*IDS, pairs).select(*IDS, (F.col("_h") + 1).alias("h"), F.col("_p.y").alias("y_h"), F.col("_p.p").alias("pred"))
    return errors(rows, "pred", "y_h", [*IDS, "h"])


@query("boosted_peak_errors", "site_id:s window_id:i rmse:d mae:d n:i")
def _(v):
    return errors(after_train(boosted_peak(featured(v), (*FEATURES, *MORE))), "pred_peak", "peak", IDS)


@query("boosted_quantile_scores", "site_id:s window_id:i h:i crps:d coverage:d n:i")
def _(v):
    out = after_train(boosted_quantiles(featured(v), (*FEATURES, *MORE), _L3, trees=8))
    pairs = F.posexplode(F.arrays_zip(F.col("y").alias("y"), F.col("q").alias("q"))).alias("_h", "_p")
    rows = out.select(*IDS, "cur", pairs).select(*IDS, "cur", (F.col("_h") + 1).alias("h"), F.col("_p.y").alias("y_h"), F.col("_p.q").alias("q"))
    scored = score_rows(rows, _L3)
    return scored.groupBy(*IDS, "h").agg(F.avg("crps").alias("crps"), F.avg("covered").alias("coverage"), F.count(F.lit(1)).alias("n"))


def _weights(labelled):
    return class_weights(labelled.filter("is_train"), balanced=True)


@query("level_classifier", "site_id:s window_id:i accuracy:d ordinal_rmse:d n:i")
def _(v):
    labelled = settled(warning_levels(featured(v)))
    out = level_classifier(labelled, (*FEATURES, *MORE), _weights(labelled))
    return class_summary(after_train(out), "level", "predicted", IDS)


@query("model_windows", "site_id:s window_id:i n_train:i n_scored:i last_fitted:s first_origin:s level:i n_level:i weight:d",
       """SELECT c.*, l.level, l.n AS n_level, l.weight FROM (
            SELECT site_id, window_id, count(*) FILTER (WHERE is_train) AS n_train, count(*) FILTER (WHERE NOT is_train AND origin >= train_end) AS n_scored,
              max(target_end) FILTER (WHERE is_train) AS last_fitted, min(origin) FILTER (WHERE NOT is_train AND origin >= train_end) AS first_origin
            FROM (SELECT *, lead(day, 7) OVER (PARTITION BY site_id, window_id ORDER BY day) AS target_end, day AS origin, p - 29 AS sample, p - 29 < greatest(0, ntr - 36) AS is_train
              FROM pos) WHERE sample >= 0 AND sample < n - 37 GROUP BY ALL) c
          JOIN (SELECT site_id, window_id, l AS level, n, sum(n) OVER (PARTITION BY site_id, window_id) / (4.0::DOUBLE * (n + 1)) AS weight FROM (
            SELECT site_id, window_id, l, count(*) FILTER (WHERE level = l) AS n FROM levels, range(4) r(l) WHERE is_train GROUP BY ALL)) l USING (site_id, window_id)""",
       ctes=LEVEL_SQL)
def _(v):
    """What the models of every window are fitted on and judged on, and the weights of the levels."""
    rows = windows(v).withColumn("target_end", F.lead("day", 7).over(W.partitionBy(*IDS).orderBy("day")))
    labelled = warning_levels(supervised_windows(rows, TARGET, carry=("train_end", "target_end")))
    judged = ~F.col("is_train") & (F.col("origin") >= F.col("train_end"))
    counts = labelled.groupBy(*IDS).agg(
        F.count_if("is_train").alias("n_train"), F.count_if(judged).alias("n_scored"),
        F.max(F.when(F.col("is_train"), F.col("target_end"))).alias("last_fitted"),
        F.min(F.when(judged, F.col("origin"))).alias("first_origin"))
    return counts.join(_weights(labelled).withColumnRenamed("n", "n_level"), list(IDS))


_NAIVE = LEVEL_SQL + """,
naive AS (SELECT l.*, CAST(l.cur > c1 AS INTEGER) + CAST(l.cur > c2 AS INTEGER) + CAST(l.cur > c3 AS INTEGER) AS predicted
  FROM levels l JOIN cuts USING (site_id, window_id) WHERE NOT is_train)"""


def _naive(v):
    rows = warning_levels(samples(v)).filter(~F.col("is_train"))
    return rows.withColumn("predicted", F.size(F.filter("cuts", lambda c: c < F.col("cur"))))


@query("level_summary", "site_id:s window_id:i accuracy:d ordinal_rmse:d n:i",
       """SELECT site_id, window_id, avg(CASE WHEN level = predicted THEN 1.0 ELSE 0.0 END) AS accuracy, sqrt(avg(pow(level - predicted, 2))) AS ordinal_rmse,
            count(*) AS n FROM naive GROUP BY ALL""", ctes=_NAIVE)
def _(v):
    return class_summary(_naive(v), "level", "predicted", IDS)


@query("level_recall", "site_id:s level:i recall:d n:i",
       "SELECT site_id, level, avg(CASE WHEN level = predicted THEN 1.0 ELSE 0.0 END) AS recall, count(*) AS n FROM naive GROUP BY ALL", ctes=_NAIVE)
def _(v):
    return class_recall(_naive(v), "level", "predicted", ["site_id"])


@query("state_probability", "site_id:s window_id:i p_mean:d observed:d n:i")
def _(v):
    # the label of the stratified state: over the median of the window's train part
    rows = featured(v)
    limit = F.percentile(F.when(F.col("is_train"), F.col("delta_T")), F.lit(0.5)).over(W.partitionBy(*IDS))
    rows = settled(rows.withColumn("stratified", (F.col("delta_T") > limit).cast("int")))
    out = after_train(state_probability(rows, (*FEATURES, "air_temp_mean"), label="stratified"))
    return out.groupBy(*IDS).agg(F.avg("p").alias("p_mean"), F.avg(F.col("stratified").cast("double")).alias("observed"), F.count(F.lit(1)).alias("n"))


@query("month_change_forecast", "site_id:s window_id:i h:i rmse:d mae:d n:i",
       "SELECT site_id, window_id, h, sqrt(avg(pow(y_h - q[5], 2))) AS rmse, avg(abs(y_h - q[5])) AS mae, count(*) AS n FROM fc WHERE member = 'month_change' GROUP BY ALL",
       ctes=MEMBER_SQL)
def _(v):
    rows = change_quantiles(by_horizon(samples(v)), by_month=True).filter(~F.col("is_train"))
    return errors(rows, quantile_at("q", LEVELS, 0.5), "y_h", [*IDS, "h"])
