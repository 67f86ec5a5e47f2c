"""Rolling windows, supervised samples, labels and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from limnoscope.functions.columns import from_target, to_target
from limnoscope.operators.features import (
    detrend, difference, site_history, slow_features, trend_features, window_stats,
)
from limnoscope.operators.labels import bloom_state, class_weights, stratified, warning_levels
from limnoscope.operators.metrics import errors, histogram
from limnoscope.operators.windows import (
    assign_windows, by_horizon, delta_scale, first_days, rolling_anchors, supervised_windows,
    window_norm_stats,
)
from limnoscope.functions.scores import crps_gaussian

T, H = 30, 7
TARGET = "conc_0_5"

#: Number of windows whose train part ends on or before the last day.
N_WINDOWS_SQL = "greatest(0, CAST(floor((date_diff('day', min(day), max(day)) - 730) / 45.0) AS BIGINT) + 1) AS nw"


def window_numbers_sql(source: str) -> str:
    return f"(SELECT unnest(range((SELECT max(nw) FROM {source}))) AS w)"


WIN_SQL = f"""
d0s AS (SELECT site_id, min(day) AS d0, {N_WINDOWS_SQL} FROM daily GROUP BY site_id),
win AS (SELECT d.*, CAST(w AS INTEGER) AS window_id, d0 + CAST(45 * w + 730 AS INTEGER) AS train_end,
    d0 + CAST(45 * w + 820 AS INTEGER) AS test_end, d.day < d0 + CAST(45 * w + 730 AS INTEGER) AS is_train_row
  FROM daily d JOIN d0s USING (site_id), {window_numbers_sql("d0s")} r
  WHERE w < nw AND date_diff('day', d0, d.day) >= 45 * w AND date_diff('day', d0, d.day) < 45 * w + 820),
pos AS (SELECT *, row_number() OVER (PARTITION BY site_id, window_id ORDER BY day) - 1 AS p,
    count(*) OVER (PARTITION BY site_id, window_id) AS n,
    sum(CAST(is_train_row AS INTEGER)) OVER (PARTITION BY site_id, window_id) AS ntr FROM win)"""
SAMPLE_SQL = WIN_SQL + """,
samp AS (SELECT *, sample < n_train AS is_train FROM (
  SELECT site_id, window_id, day AS origin, p - 29 AS sample, conc_0_5 AS cur, delta_T, """ + ", ".join(
    f"lead(conc_0_5, {h}) OVER (PARTITION BY site_id, window_id ORDER BY day) AS y{h}" for h in range(1, H + 1)) + """,
    n - 37 AS n_samples, greatest(0, ntr - 36) AS n_train FROM pos) WHERE sample >= 0 AND sample < n_samples),
sl AS (""" + " UNION ALL ".join(
    f"SELECT site_id, window_id, origin, sample, cur, n_train, is_train, {h} AS h, y{h} AS y_h, y{h} - cur AS delta_h FROM samp"
    for h in range(1, H + 1)) + ")"
WIN_SQL, SAMPLE_SQL = WIN_SQL.strip(), SAMPLE_SQL.strip()


def windows(v, *carry):
    return assign_windows(v.daily.select("site_id", "day", TARGET, *carry))


def samples(v, *carry):
    return supervised_windows(windows(v, *carry), TARGET, look_back=T, horizon=H, carry=carry)


@query("rolling_anchors", "site_id:s window_id:i start:s train_end:s test_end:s",
       """SELECT site_id, w AS window_id, d0 + CAST(45 * w AS INTEGER) AS "start", d0 + CAST(45 * w + 730 AS INTEGER) AS train_end,
            d0 + CAST(45 * w + 820 AS INTEGER) AS test_end FROM d0s, """ + window_numbers_sql("d0s") + " r WHERE w < nw", ctes=WIN_SQL)
def _(v):
    return rolling_anchors(first_days(v.daily))


@query("rolling_anchors_published", "site_id:s window_id:i start:s train_end:s test_end:s",
       """SELECT site_id, w AS window_id, d0 + CAST(45 * w AS INTEGER) AS "start", d0 + CAST(45 * w + 730 AS INTEGER) AS train_end,
            d0 + CAST(45 * w + 820 AS INTEGER) AS test_end FROM d0s, range(17) r(w)""", ctes=WIN_SQL)
def _(v):
    return rolling_anchors(first_days(v.daily), n_windows=17)


@query("rolling_windows", "site_id:s window_id:i n_rows:i n_train_rows:i first_day:s last_day:s",
       """SELECT site_id, window_id, count(*) AS n_rows, sum(CAST(is_train_row AS INTEGER)) AS n_train_rows,
            min(day) AS first_day, max(day) AS last_day FROM win GROUP BY ALL""", ctes=WIN_SQL)
def _(v):
    return windows(v).groupBy("site_id", "window_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("is_train_row").cast("int")).alias("n_train_rows"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"))


_YS = " ".join(f"y{h}:d" for h in range(1, H + 1))


@query("supervised_windows", f"site_id:s window_id:i origin:s sample:i cur:d {_YS} n_samples:i n_train:i is_train:i",
       "SELECT *, CAST(is_train AS INTEGER) AS is_train_i FROM samp".replace("*, CAST(is_train AS INTEGER) AS is_train_i", "* REPLACE (CAST(is_train AS INTEGER) AS is_train)"),
       ctes=SAMPLE_SQL)
def _(v):
    s = samples(v)
    return s.withColumns({f"y{h}": F.get("y", F.lit(h - 1)) for h in range(1, H + 1)}
                         | {"is_train": F.col("is_train").cast("int")})


@query("sample_history", "site_id:s origin:s sample:i hist_len:i hist_first:d hist_last:d hist_sum:d",
       """SELECT site_id, day AS origin, p - 29 AS sample, 30 AS hist_len, lag(conc_0_5, 29) OVER w AS hist_first, conc_0_5 AS hist_last,
            sum(conc_0_5) OVER (PARTITION BY site_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS hist_sum
          FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY day) - 1 AS p, count(*) OVER (PARTITION BY site_id) AS n FROM daily)
          WINDOW w AS (PARTITION BY site_id ORDER BY day) QUALIFY p >= 29 AND p - 29 < n - 37""")
def _(v):
    s = supervised_windows(v.daily.select("site_id", "day", TARGET), TARGET, keys=("site_id",), train_row=None,
                           look_back=T, horizon=H, history=(TARGET,))
    hist = F.col("conc_0_5_hist")
    return s.select("site_id", "origin", "sample", F.size(hist).alias("hist_len"), F.get(hist, F.lit(0)).alias("hist_first"),
                    F.get(hist, F.lit(T - 1)).alias("hist_last"),
                    F.aggregate(hist, F.lit(0.0), lambda a, x: a + x).alias("hist_sum"))


@query("window_norm_stats", "site_id:s window_id:i variable:s mean:d std:d n:i",
       " UNION ALL ".join(f"""SELECT site_id, window_id, '{c}' AS variable, avg({c}) AS mean, stddev_samp({c}) + 1e-8 AS std, count(*) AS n
           FROM win WHERE is_train_row GROUP BY ALL""" for c in (TARGET, "temp_0_5", "air_temp")), ctes=WIN_SQL)
def _(v):
    return window_norm_stats(windows(v, "temp_0_5", "air_temp"), [TARGET, "temp_0_5", "air_temp"])


@query("delta_scale", "site_id:s window_id:i delta_scale:d n_deltas:i",
       """SELECT site_id, window_id, stddev_pop(delta_h) + 1e-8 AS delta_scale, count(*) AS n_deltas FROM sl WHERE is_train GROUP BY ALL""",
       ctes=SAMPLE_SQL)
def _(v):
    return delta_scale(samples(v))


LEVEL_SQL = SAMPLE_SQL + """,
peaks AS (SELECT *, greatest(y1, y2, y3, y4, y5, y6, y7) AS peak FROM samp),
cuts AS (SELECT site_id, window_id, quantile_cont(peak, 0.75) AS c1, quantile_cont(peak, 0.9) AS c2, quantile_cont(peak, 0.97) AS c3
  FROM peaks WHERE is_train GROUP BY ALL),
levels AS (SELECT p.*, CAST(peak > c1 AS INTEGER) + CAST(peak > c2 AS INTEGER) + CAST(peak > c3 AS INTEGER) AS level
  FROM peaks p JOIN cuts USING (site_id, window_id))"""


@query("warning_levels", "site_id:s window_id:i origin:s peak:d level:i", "SELECT * FROM levels", ctes=LEVEL_SQL)
def _(v):
    return warning_levels(samples(v))


@query("class_weights", "site_id:s window_id:i level:i n:i weight:d",
       """SELECT site_id, window_id, l AS level, n, 4.0 / (n + 1) / sum(1.0::DOUBLE / (n + 1)) OVER (PARTITION BY site_id, window_id) AS weight FROM (
            SELECT site_id, window_id, l, count(*) FILTER (WHERE level = l) AS n FROM levels, range(4) r(l) WHERE is_train GROUP BY ALL)""",
       ctes=LEVEL_SQL)
def _(v):
    return class_weights(warning_levels(samples(v)).filter("is_train"))


@query("balanced_weights", "site_id:s window_id:i level:i n:i weight:d",
       """SELECT site_id, window_id, l AS level, n, total / (4.0 * (n + 1)) AS weight FROM (
            SELECT site_id, window_id, l, count(*) FILTER (WHERE level = l) AS n, count(*) AS total FROM levels, range(4) r(l) WHERE is_train GROUP BY ALL)""",
       ctes=LEVEL_SQL)
def _(v):
    return class_weights(warning_levels(samples(v)).filter("is_train"), balanced=True)


@query("stratified_label", "site_id:s window_id:i day:s delta_T:d strat_threshold:d strat:i",
       """SELECT site_id, window_id, day, "delta_T", thr AS strat_threshold, CASE WHEN "delta_T" > thr THEN 1 ELSE 0 END AS strat
          FROM pos JOIN (SELECT site_id, window_id, median("delta_T") AS thr FROM pos WHERE p < floor(n * 0.7::DOUBLE) GROUP BY ALL) USING (site_id, window_id)""",
       ctes=WIN_SQL)
def _(v):
    return stratified(windows(v, "delta_T"))


@query("bloom_in_windows", "site_id:s window_id:i n_days:i bloom_days:i band_q:d",
       """SELECT l.site_id, l.window_id, count(*) AS n_days, count(*) FILTER (WHERE band > bq AND n_layers >= 2) AS bloom_days, max(bq) AS band_q
          FROM wlayers l LEFT JOIN wband USING (site_id, window_id, day) JOIN wbq USING (site_id, window_id) GROUP BY ALL""",
       ctes=f"""c0 AS (SELECT site_id, min(day) AS d0, {N_WINDOWS_SQL} FROM cells GROUP BY site_id),
wc AS (SELECT c.*, CAST(w AS INTEGER) AS window_id, c.day < d0 + CAST(45 * w + 730 AS INTEGER) AS tr FROM cells c JOIN c0 USING (site_id), {window_numbers_sql("c0")} r
  WHERE w < nw AND date_diff('day', d0, c.day) >= 45 * w AND date_diff('day', d0, c.day) < 45 * w + 820),
wband AS (SELECT site_id, window_id, day, max(tr) AS tr, median(total_conc) AS band FROM wc WHERE depth BETWEEN 0.5 AND 3.0 GROUP BY ALL),
wbq AS (SELECT site_id, window_id, quantile_cont(band, 0.75) AS bq FROM wband WHERE tr GROUP BY ALL),
wlq AS (SELECT site_id, window_id, depth, quantile_cont(total_conc, 0.75) AS lq FROM wc WHERE tr AND depth BETWEEN 0.5 AND 5.0 GROUP BY ALL),
wlayers AS (SELECT site_id, window_id, day, count(*) FILTER (WHERE total_conc > lq) AS n_layers FROM wc JOIN wlq USING (site_id, window_id, depth) GROUP BY ALL)""")
def _(v):
    rows = assign_windows(v.cells.select("site_id", "day", "depth", "total_conc"))
    state = bloom_state(rows, quantile=0.75, min_layers=2, keys=("site_id", "window_id"), fit=F.col("is_train_row"))
    return state.groupBy("site_id", "window_id").agg(
        F.count(F.lit(1)).alias("n_days"), F.sum("bloom").alias("bloom_days"), F.max("band_q").alias("band_q"))


_KINDS = ("abs_delta", "rel_delta", "log_ratio", "abs_log")


@query("target_transforms", "site_id:s window_id:i origin:s h:i " + " ".join(f"{k}:d {k}_back:d" for k in _KINDS),
       """SELECT site_id, window_id, origin, h, y_h - cur AS abs_delta, y_h AS abs_delta_back, (y_h - cur) / greatest(cur, 1.0) AS rel_delta,
            y_h AS rel_delta_back, ln(1 + y_h) - ln(1 + cur) AS log_ratio, y_h AS log_ratio_back, ln(1 + y_h) AS abs_log, y_h AS abs_log_back
          FROM sl WHERE NOT is_train""", ctes=SAMPLE_SQL)
def _(v):
    long = by_horizon(samples(v)).filter(~F.col("is_train"))
    out = long.withColumns({k: to_target(k, "cur", "y_h") for k in _KINDS})
    return out.withColumns({f"{k}_back": from_target(k, "cur", k) for k in _KINDS})


@query("known_start_errors", "site_id:s h:i rmse:d mae:d n:i",
       """SELECT site_id, h, sqrt(avg(pow(y_h - CASE WHEN h <= 3 THEN y_h ELSE y3 END, 2))) AS rmse,
            avg(abs(y_h - CASE WHEN h <= 3 THEN y_h ELSE y3 END)) AS mae, count(*) AS n
          FROM sl JOIN (SELECT site_id, window_id, origin, y3 FROM samp) USING (site_id, window_id, origin) WHERE NOT is_train GROUP BY ALL""",
       ctes=SAMPLE_SQL)
def _(v):
    from limnoscope.operators.forecast import known_start
    pairs = F.posexplode(F.arrays_zip(F.col("y"), F.col("pred"))).alias("i", "p")
    rows = known_start(samples(v), 3).filter(~F.col("is_train")).select("site_id", pairs)
    return errors(rows.withColumn("h", F.col("i") + 1), "p.pred", "p.y", ["site_id", "h"])


@query("delta_histogram", "site_id:s bin:i n:i left_edge:d density:d",
       """SELECT site_id, bin, count(*) AS n, any_value(lo) + bin * any_value((hi - lo) / 60.0) AS left_edge,
            count(*) / (any_value(total) * any_value((hi - lo) / 60.0)) AS density FROM (
            SELECT site_id, lo, hi, total, least(floor((z - lo) / ((hi - lo) / 60.0)), 59) AS bin FROM (
              SELECT *, min(z) OVER (PARTITION BY site_id) AS lo, max(z) OVER (PARTITION BY site_id) AS hi, count(*) OVER (PARTITION BY site_id) AS total
              FROM (SELECT site_id, delta_h / scale AS z FROM sl JOIN scale USING (site_id, window_id) WHERE is_train))) GROUP BY site_id, bin""",
       ctes=SAMPLE_SQL + """,
scale AS (SELECT site_id, window_id, stddev_pop(delta_h) + 1e-8 AS scale FROM sl WHERE is_train GROUP BY ALL)""")
def _(v):
    cut = samples(v)
    rows = (by_horizon(cut).filter("is_train").join(delta_scale(cut), ["site_id", "window_id"])
            .select("site_id", (F.col("delta_h") / F.col("delta_scale")).alias("z")))
    return histogram(rows, "z", 60, ["site_id"])


@query("window_features", "site_id:s day:s " + " ".join(f"{c}_{s}:d" for c in (TARGET, "air_temp") for s in ("last", "mean", "std", "change")),
       "SELECT site_id, day, " + ", ".join(
           f"""{c} AS {c}_last, avg({c}) OVER f AS {c}_mean, stddev_pop({c}) OVER f AS {c}_std,
               CASE WHEN p >= 7 THEN {c} - lag({c}, 6) OVER w ELSE 0.0 END AS {c}_change""" for c in (TARGET, "air_temp"))
       + """ FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY day) - 1 AS p FROM daily)
          WINDOW w AS (PARTITION BY site_id ORDER BY day), f AS (PARTITION BY site_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def _(v):
    return window_stats(v.daily, [TARGET, "air_temp"], "day")


@query("window_extremes", "site_id:s at:s conc_0_5_min:d conc_0_5_max:d conc_0_5_std:d conc_0_5_change:d",
       """SELECT site_id, cell AS at, min(conc_0_5) OVER f AS conc_0_5_min, max(conc_0_5) OVER f AS conc_0_5_max, stddev_pop(conc_0_5) OVER f AS conc_0_5_std,
            CASE WHEN p >= 8 THEN conc_0_5 - lag(conc_0_5, 7) OVER w ELSE 0.0 END AS conc_0_5_change
          FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY cell) - 1 AS p FROM fast_wide)
          WINDOW w AS (PARTITION BY site_id ORDER BY cell), f AS (PARTITION BY site_id ORDER BY cell ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def _(v):
    return window_stats(v.fast_wide, [TARGET], "cell", length=24, change=7, extremes=True).withColumn("at", F.col("cell"))


def _slow_sql():
    cols, fills = [], []
    for c, std in ((TARGET, True), ("air_temp", True)):
        for d in (30, 60, 90):
            fr = f"(PARTITION BY site_id ORDER BY day ROWS BETWEEN {d} PRECEDING AND 1 PRECEDING)"
            ok = f"count({c}) OVER {fr} >= {d // 2}"
            cols.append(f"CASE WHEN {ok} THEN avg({c}) OVER {fr} END AS slow_{c}_mean_{d}d")
            cols.append(f"CASE WHEN {ok} THEN regr_slope({c}, p) OVER {fr} / {d}.0 END AS slow_{c}_slope_{d}d")
            fills += [f"slow_{c}_mean_{d}d", f"slow_{c}_slope_{d}d"]
            if std:
                cols.append(f"CASE WHEN {ok} THEN stddev_samp({c}) OVER {fr} END AS slow_{c}_std_{d}d")
                fills.append(f"slow_{c}_std_{d}d")
    inner = f"SELECT site_id, day, {', '.join(cols)} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY day) AS DOUBLE) AS p FROM daily)"
    filled = ", ".join(f"""coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value({c} IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}""" for c in fills)
    return f"SELECT site_id, day, {filled} FROM ({inner})", fills


_SLOW, _SLOW_COLS = _slow_sql()


@query("slow_features", "site_id:s day:s " + " ".join(f"{c}:d" for c in _SLOW_COLS), _SLOW)
def _(v):
    return slow_features(v.daily.select("site_id", "day", TARGET, "air_temp"), [TARGET, "air_temp"], "day",
                         std_columns=(TARGET, "air_temp"))


@query("trend_features", "site_id:s at:s trend_dT:d slope_dT:d d_thermo_grad:d",
       """SELECT site_id, cell AS at, "delta_T" - lag("delta_T", 8) OVER w AS "trend_dT", regr_slope("delta_T", p) OVER f AS "slope_dT",
            thermo_grad - lag(thermo_grad, 8) OVER w AS d_thermo_grad
          FROM (SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY cell) AS DOUBLE) AS p FROM fast_wide)
          WINDOW w AS (PARTITION BY site_id ORDER BY cell), f AS (PARTITION BY site_id ORDER BY cell ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)
          QUALIFY p > 8""")
def _(v):
    return trend_features(v.fast_wide, "cell").withColumn("at", F.col("cell"))


@query("differences", "site_id:s at:s conc_0_5_diff:d conc_0_5_ahead:d",
       """SELECT site_id, cell AS at, conc_0_5 - lag(conc_0_5, 8) OVER w AS conc_0_5_diff, lead(conc_0_5, 8) OVER w - conc_0_5 AS conc_0_5_ahead
          FROM fast_wide WINDOW w AS (PARTITION BY site_id ORDER BY cell)""")
def _(v):
    out = difference(v.fast_wide, [TARGET], 8, "cell")
    return difference(out, [TARGET], 8, "cell", suffix="_ahead", ahead=True).withColumn("at", F.col("cell"))


@query("detrended", "site_id:s day:s residual:d",
       """SELECT site_id, day, conc_0_5 - coalesce(CASE WHEN count(*) OVER c >= 20 THEN median(conc_0_5) OVER c END,
            CASE WHEN count(*) OVER t >= 20 THEN median(conc_0_5) OVER t END, median(conc_0_5) OVER (PARTITION BY site_id)) AS residual FROM daily
          WINDOW c AS (PARTITION BY site_id ORDER BY day ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING),
            t AS (PARTITION BY site_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def _(v):
    return detrend(v.daily.select("site_id", "day", TARGET), TARGET, "day", width=30, min_rows=20)


@query("surface_zscore", "site_id:s day:s surface:d z:d",
       """SELECT site_id, day, total_conc AS surface, (total_conc - avg(total_conc) OVER s) / stddev_samp(total_conc) OVER s AS z
          FROM cells WHERE depth = 0.5 WINDOW s AS (PARTITION BY site_id)""")
def _(v):
    rows = v.cells.filter(F.col("depth") == 0.5).select("site_id", "day", F.col("total_conc").alias("surface"))
    stats = rows.groupBy("site_id").agg(F.avg("surface").alias("m"), F.stddev_samp("surface").alias("s"))
    return rows.join(stats, "site_id").withColumn("z", (F.col("surface") - F.col("m")) / F.col("s"))


A = "0.254829592 -0.284496736 1.421413741 -1.453152027 1.061405429".split()


def cdf_sql(z: str) -> str:
    """Normal distribution function by the same rational approximation."""
    t = f"(1.0 / (1.0 + 0.3275911 * abs({z}) / sqrt(2.0::DOUBLE)))"
    poly = "0.0"
    for a in reversed(A):
        poly = f"(({poly} + ({a})) * {t})"
    tail = f"(0.5 * {poly} * exp(-({z}) * ({z}) / 2.0))"
    return f"(CASE WHEN {z} >= 0 THEN 1.0 - {tail} ELSE {tail} END)"


HISTORY_SQL = """surf AS (SELECT site_id, day, ln(1 + total_conc) AS y FROM cells WHERE depth = 0.5),
hist AS (SELECT *, row_number() OVER w AS p, count(*) OVER (PARTITION BY site_id) AS n, lag(y) OVER w AS mu_persist,
    stddev_samp(y) OVER f AS sd_persist, avg(y) OVER f AS mu0, count(*) OVER m AS mn, avg(y) OVER m AS mm, stddev_samp(y) OVER m AS ms FROM surf
  WINDOW w AS (PARTITION BY site_id ORDER BY day), f AS (PARTITION BY site_id ORDER BY day ROWS BETWEEN 365 PRECEDING AND 1 PRECEDING),
    m AS (PARTITION BY site_id, month(day) ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
history AS (SELECT site_id, day, y, mu_persist, sd_persist, CASE WHEN mn >= 5 AND ms > 1e-3 THEN mm ELSE mu0 END AS mu_clim,
    CASE WHEN mn >= 5 AND ms > 1e-3 THEN ms WHEN sd_persist >= 1e-3 THEN sd_persist ELSE greatest(sd_persist, 1e-2) END AS sd_clim
  FROM hist WHERE n >= 70 AND p > 60)"""


def _history(v):
    surface = v.cells.filter(F.col("depth") == 0.5).select("site_id", "day", F.log1p("total_conc").alias("obs"))
    return site_history(surface, "obs", "day")


@query("site_history", "site_id:s day:s y:d mu_persist:d sd_persist:d mu_clim:d sd_clim:d", "SELECT * FROM history", ctes=HISTORY_SQL)
def _(v):
    return _history(v)


@query("site_history_scores", "site_id:s crps_persist:d crps_clim:d rmse_clim:d n:i",
       f"""SELECT site_id, avg(abs(y - mu_persist)) AS crps_persist,
             avg(sd_clim * (z * ({cdf_sql('z')} * 2 - 1) + 2 * exp(-0.5 * z * z) / sqrt(2 * pi()) - 1 / sqrt(pi()))) AS crps_clim,
             sqrt(avg(pow(y - mu_clim, 2))) AS rmse_clim, count(*) AS n
           FROM (SELECT *, (y - mu_clim) / greatest(sd_clim, 1e-6) AS z FROM history) GROUP BY site_id""", ctes=HISTORY_SQL)
def _(v):
    h = _history(v)
    e = F.col("y") - F.col("mu_clim")
    return h.groupBy("site_id").agg(
        F.avg(F.abs(F.col("y") - F.col("mu_persist"))).alias("crps_persist"),
        F.avg(crps_gaussian("mu_clim", "sd_clim", "y")).alias("crps_clim"), F.sqrt(F.avg(e * e)).alias("rmse_clim"),
        F.count(F.lit(1)).alias("n"))
