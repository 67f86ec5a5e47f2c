"""Ingest, alignment, regridding, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import CONC_COLS, DEPTHS7, TEMP_COLS, WIDE_COLS, floor_sql, per_depth
from limnoscope.functions.columns import coerce_double, coerce_timestamp, floor_to_grid, pad_site_id
from limnoscope.operators.align import (
    asof_nearest, asof_nearest_grid, complete_axis, fill_forward, interpolate_time, join_sparse,
)
from limnoscope.operators.features import standard_scores, with_season, with_wind
from limnoscope.operators.grid import (
    cell_means, coarsen, daily_table, profile_table, select_depths, slice_days, unpivot_depths,
)
from limnoscope.operators.ingest import norm_stats, standardise, weather_cells
from limnoscope.operators.metrics import column_profile, interval_counts, median_interval
from limnoscope.operators.profile import (
    greedy_depths_by_site, stratification, subset_rmse, thermocline,
)
from limnoscope.operators.windows import split_by_position
from limnoscope.schema import WEATHER_MEASURES


@query("typed_columns", "event_id:i site_id:s amount:d not_a_number:d at:s bad_time:s k:d",
       """SELECT event_id, CASE WHEN length(CAST(user_id AS VARCHAR)) < 4 THEN lpad(CAST(user_id AS VARCHAR), 4, '0')
            ELSE CAST(user_id AS VARCHAR) END AS site_id, TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS amount,
            TRY_CAST(event_type AS DOUBLE) AS not_a_number, TRY_CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS at,
            TRY_CAST(event_type AS TIMESTAMP) AS bad_time,
            TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events""")
def _(v):
    c = F.col
    return v.table("events").select(
        "event_id", pad_site_id("user_id").alias("site_id"),
        coerce_double(c("value").cast("string")).alias("amount"),
        coerce_double("event_type").alias("not_a_number"),
        coerce_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("at"),
        coerce_timestamp("event_type").alias("bad_time"),
        coerce_double(F.regexp_extract("props", "([0-9]+)", 1)).alias("k"))


@query("aligned_readings", "event_id:i site_id:s at:s depth:d water_temp:d total_conc:d wind_speed:d wind_dir:d "
       "pressure:d air_temp:d humidity:d rainfall:d", "SELECT *, cell AS at FROM fast_standard")
def _(v):
    return v.fast_standard.withColumn("at", F.col("timestamp"))


@query("standard_days", "site_id:s day:s depth:d n:i conc_sum:d temp_sum:d wind_speed:d air_temp:d rainfall:d",
       """SELECT site_id, day, depth, n, total_conc * n AS conc_sum, water_temp * n AS temp_sum,
            wind_speed, air_temp, rainfall FROM standard_days""")
def _(v):
    return v.standard.groupBy("site_id", F.to_date("timestamp").alias("day"), "depth").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_conc").alias("conc_sum"), F.sum("water_temp").alias("temp_sum"),
        *[F.min(c).alias(c) for c in ("wind_speed", "air_temp", "rainfall")])


@query("nearest_event", "event_id:i site_id:s matched_id:i matched_value:d seconds_off:d",
       """SELECT l.event_id, l.site_id, m.event_id AS matched_id, m.total_conc AS matched_value,
            (epoch_us(m.ts) - epoch_us(l.ts)) / 1e6 AS seconds_off
          FROM (SELECT * FROM fast WHERE event_type = 'error') l
          LEFT JOIN (
            SELECT l2.event_id AS left_id, r.*, row_number() OVER (PARTITION BY l2.event_id
              ORDER BY abs(epoch_us(r.ts) - epoch_us(l2.ts)), r.ts) AS rn
            FROM fast l2 JOIN fast r ON r.site_id = l2.site_id AND r.event_type = 'click' AND l2.event_type = 'error'
              AND r.ts BETWEEN l2.ts - INTERVAL 45 MINUTE AND l2.ts + INTERVAL 45 MINUTE
          ) m ON m.left_id = l.event_id AND m.rn = 1""")
def _(v):
    left = v.fast.filter(F.col("event_type") == "error")
    right = v.fast.filter(F.col("event_type") == "click").select(
        "site_id", "timestamp", F.col("event_id").alias("matched_id"), F.col("total_conc").alias("matched_value"))
    out = asof_nearest(left, right, ["matched_id", "matched_value"], tolerance_hours=0.75)
    return out.withColumn("seconds_off", F.timestamp_diff(
        "MICROSECOND", F.col("timestamp"), F.col("matched_at")) / F.lit(1e6))


@query("nearest_cell", "event_id:i site_id:s wind_speed:d air_temp:d",
       """SELECT event_id, site_id, wind_speed, air_temp FROM (
            SELECT r.event_id, r.site_id, w.wind_speed, w.air_temp,
              row_number() OVER (PARTITION BY r.event_id ORDER BY abs(epoch(w.cell) - epoch(r.cell)), w.cell) AS rn
            FROM (SELECT *, """ + floor_sql('ts', 3) + """ AS cell FROM fast) r
            LEFT JOIN fast_weather_cells w ON w.site_id = r.site_id
              AND w.cell BETWEEN r.cell - INTERVAL 6 HOUR AND r.cell + INTERVAL 6 HOUR) WHERE rn = 1""")
def _(v):
    left = v.fast.withColumn("timestamp", floor_to_grid("timestamp", 3))
    return asof_nearest_grid(left, weather_cells(v.fast_weather), ["wind_speed", "air_temp"], step_hours=3, tolerance=2)


@query("cell_means", "site_id:s at:s depth:d water_temp:d total_conc:d",
       f"""SELECT site_id, {floor_sql('ts', 3)} AS at, depth, avg(water_temp) AS water_temp,
             avg(total_conc) AS total_conc FROM fast GROUP BY ALL""")
def _(v):
    return cell_means(v.fast, ["water_temp", "total_conc"]).withColumn("at", F.col("cell"))


@query("regrid_daily", "site_id:s day:s depth:d water_temp:d total_conc:d cyano_conc:d", "SELECT * FROM cells")
def _(v):
    return v.cells


@query("profile_table", "site_id:s at:s " + " ".join(f"{c}:d" for c in WIDE_COLS),
       "SELECT *, cell AS at FROM fast_wide")
def _(v):
    return profile_table(v.fast_standard, DEPTHS7).withColumn("at", F.col("cell"))


@query("profile_from_raw", "site_id:s at:s " + " ".join(f"{c}:d" for c in WIDE_COLS),
       "SELECT *, cell AS at FROM fast_wide")
def _(v):
    return v.fast_wide.withColumn("at", F.col("cell"))


@query("daily_table", "site_id:s day:s " + " ".join(f"{c}:d" for c in WIDE_COLS), "SELECT * FROM daily")
def _(v):
    return daily_table(v.standard, DEPTHS7)


@query("daily_from_raw", "site_id:s day:s " + " ".join(f"{c}:d" for c in WIDE_COLS), "SELECT * FROM daily")
def _(v):
    return v.daily


_STEP_COLS = ("temp_0_5", "conc_0_5", "conc_10_0", "delta_T", "thermo_grad", "air_temp", "wind_u", "wind_v")
_STEP_AVG = ", ".join(f'avg("{c}") AS "{c}"' for c in _STEP_COLS).replace("conc_10_0", "conc_10")


@query("regrid_steps", "step:s site_id:s at:s temp_0_5:d conc_0_5:d conc_10:d delta_T:d thermo_grad:d "
       "air_temp:d wind_u:d wind_v:d",
       f"""SELECT '12h' AS step, site_id, strftime({floor_sql('cell', 12)}, '%Y-%m-%d %H') AS at, {_STEP_AVG} FROM w GROUP BY ALL
           UNION ALL SELECT '1d', site_id, strftime(cell, '%Y-%m-%d 00') AS at, {_STEP_AVG} FROM w GROUP BY ALL
           UNION ALL SELECT '7d', site_id, strftime(d0 + CAST((CAST(cell AS DATE) - d0) // 7 * 7 AS INTEGER), '%Y-%m-%d 00') AS at, {_STEP_AVG}
             FROM w JOIN (SELECT site_id, CAST(min(cell) AS DATE) AS d0 FROM w GROUP BY site_id) USING (site_id) GROUP BY ALL""",
       ctes="""w AS (SELECT *, wind_speed * cos(radians(wind_dir)) AS wind_u, wind_speed * sin(radians(wind_dir)) AS wind_v
                 FROM fast_wide)""")
def _(v):
    wide = with_wind(v.fast_wide).select("site_id", "cell", *[c.replace("10_0", "10") for c in _STEP_COLS])
    parts = [coarsen(wide, step_hours=12).withColumns({"step": F.lit("12h"), "at": F.date_format("cell", "yyyy-MM-dd HH")}).drop("cell")]
    for days in (1, 7):
        parts.append(coarsen(wide, step_days=days).withColumns(
            {"step": F.lit(f"{days}d"), "at": F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(" 00"))}).drop("day"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("unpivot_profile", "site_id:s depth:d n:i mean_temp:d max_temp:d",
       "SELECT site_id, depth, count(*) AS n, avg(temp) AS mean_temp, max(temp) AS max_temp FROM ("
       + per_depth("SELECT site_id, {d} AS depth, {t} AS temp FROM fast_wide", " UNION ALL ") + ") GROUP BY ALL")
def _(v):
    long = unpivot_depths(v.fast_wide, "temp", DEPTHS7, ["site_id", "cell"], "temp")
    return long.groupBy("site_id", "depth").agg(
        F.count(F.lit(1)).alias("n"), F.avg("temp").alias("mean_temp"), F.max("temp").alias("max_temp"))


@query("stratification", "site_id:s day:s delta_T:d thermo_grad:d n_depths:i",
       """SELECT site_id, day, min_by(water_temp, depth) - max_by(water_temp, depth) AS "delta_T",
            greatest(0.0, coalesce(max(g), 0.0)) AS thermo_grad, count(*) AS n_depths
          FROM (SELECT *, (lead(water_temp) OVER w - water_temp) / (lead(depth) OVER w - depth) AS g FROM cells
                WINDOW w AS (PARTITION BY site_id, day ORDER BY depth)) GROUP BY site_id, day""")
def _(v):
    return stratification(v.cells, ["site_id", "day"])


_RHO = "1000.0 * (1.0 - ({t} + 288.9414) * ({t} - 3.9863) * ({t} - 3.9863) / (508929.2 * ({t} + 68.12963)))"


@query("thermocline", "site_id:s day:s thermo_depth:d n_depths:i",
       """SELECT site_id, day, CASE WHEN max(rng) >= 1.0 AND max(k) >= 3 THEN
              coalesce(max_by(CASE WHEN peak THEN pos END, CASE WHEN peak THEN depth END),
                       arg_max(pos, s * 1e6 - depth * 1e-9)) END AS thermo_depth, max(k) AS n_depths
          FROM (SELECT *, CASE WHEN up > 0 AND dn > 0 THEN
                  z2 * ((mid_dn - mid) / dn) / ((mid_dn - mid) / dn + (mid - mid_up) / up)
                  + depth * ((mid - mid_up) / up) / ((mid_dn - mid) / dn + (mid - mid_up) / up) ELSE mid END AS pos,
                s > greatest(0.15 * mx, 0.1) AND (s_up IS NULL OR up > 0) AND (s_dn IS NULL OR dn > 0) AS peak
              FROM (SELECT *, s - s_up AS up, s - s_dn AS dn FROM (
                  SELECT *, lag(s) OVER w AS s_up, lead(s) OVER w AS s_dn, lag(mid) OVER w AS mid_up,
                    lead(mid) OVER w AS mid_dn, max(s) OVER (PARTITION BY site_id, day) AS mx FROM steps
                  WINDOW w AS (PARTITION BY site_id, day ORDER BY depth)))) GROUP BY site_id, day""",
       ctes=f"""rho AS (SELECT *, {_RHO.format(t='water_temp')} AS rho FROM cells),
         steps AS (SELECT site_id, day, depth, z2, k, rng, (rho2 - rho) / (z2 - depth) AS s, (depth + z2) / 2 AS mid FROM (
            SELECT *, lead(depth) OVER w AS z2, lead(rho) OVER w AS rho2,
              count(*) OVER (PARTITION BY site_id, day) AS k,
              max(water_temp) OVER (PARTITION BY site_id, day) - min(water_temp) OVER (PARTITION BY site_id, day) AS rng
            FROM rho WINDOW w AS (PARTITION BY site_id, day ORDER BY depth)) WHERE z2 IS NOT NULL)""")
def _(v):
    return thermocline(v.cells, ["site_id", "day"])


_GRID_FILL = """axis AS (SELECT site_id, unnest(generate_series(lo, hi, INTERVAL 3 HOUR)) AS cell FROM (
      SELECT site_id, min(cell) AS lo, max(cell) AS hi FROM fast_wide GROUP BY site_id)),
    full_grid AS (SELECT a.site_id, a.cell, """ + ", ".join(f"w.{c}" for c in WIDE_COLS) + """, row_number() OVER (PARTITION BY a.site_id ORDER BY a.cell) AS pos
      FROM axis a LEFT JOIN fast_wide w USING (site_id, cell))"""


def _full_grid(v):
    return complete_axis(v.fast_wide.select("site_id", "cell", *WIDE_COLS), "cell", "INTERVAL 3 HOURS")


@query("interpolated_grid", "site_id:s at:s " + " ".join(f"{c}:d" for c in WIDE_COLS),
       """SELECT site_id, cell AS at, """ + ", ".join(
           f"""CASE WHEN a_{c} IS NULL THEN b_{c}.v WHEN b_{c} IS NULL THEN a_{c}.v WHEN a_{c}.t = b_{c}.t THEN a_{c}.v
               ELSE a_{c}.v + (b_{c}.v - a_{c}.v) * (epoch(cell) - epoch(a_{c}.t)) / (epoch(b_{c}.t) - epoch(a_{c}.t)) END AS {c}"""
           for c in WIDE_COLS) + " FROM (SELECT site_id, cell, " + ", ".join(
           f"""last_value(CASE WHEN {c} IS NOT NULL THEN {{'v': {c}, 't': cell}} END IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY cell
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a_{c},
               first_value(CASE WHEN {c} IS NOT NULL THEN {{'v': {c}, 't': cell}} END IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY cell
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b_{c}"""
           for c in WIDE_COLS) + " FROM full_grid)", ctes=_GRID_FILL)
def _(v):
    filled = interpolate_time(_full_grid(v), WIDE_COLS)
    return filled.withColumn("at", F.col("cell"))


@query("interpolated_limited", "site_id:s at:s conc_0_5:d",
       """SELECT site_id, cell AS at, CASE WHEN a IS NULL OR pos - a.p > 2 THEN NULL WHEN b IS NULL THEN a.v
            WHEN a.p = b.p THEN a.v ELSE a.v + (b.v - a.v) * (pos - a.p) / (b.p - a.p) END AS conc_0_5 FROM (
          SELECT site_id, cell, pos,
            last_value(CASE WHEN conc_0_5 IS NOT NULL THEN {'v': conc_0_5, 'p': pos} END IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY cell
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
            first_value(CASE WHEN conc_0_5 IS NOT NULL THEN {'v': conc_0_5, 'p': pos} END IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY cell
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM full_grid)""", ctes=_GRID_FILL)
def _(v):
    return interpolate_time(_full_grid(v), ["conc_0_5"], limit=2).withColumn("at", F.col("cell"))


@query("filled_forward", "site_id:s at:s conc_0_5:d",
       """SELECT site_id, cell AS at, coalesce(
            last_value(conc_0_5 IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            first_value(conc_0_5 IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY cell ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS conc_0_5
          FROM full_grid""", ctes=_GRID_FILL)
def _(v):
    return fill_forward(_full_grid(v), ["conc_0_5"]).withColumn("at", F.col("cell"))


@query("sparse_fill", "site_id:s day:s depth:d thermo_rain:d total_conc:d",
       """SELECT c.site_id, c.day, c.depth, coalesce(w.rainfall, 0.0) AS thermo_rain, c.total_conc
          FROM cells c LEFT JOIN weather_days w USING (site_id, day)""")
def _(v):
    rain = v.weather.groupBy("site_id", F.to_date("timestamp").alias("day")).agg(F.avg("rainfall").alias("thermo_rain"))
    return join_sparse(v.cells, rain, ["thermo_rain"], ["site_id", "day"])


@query("wind_and_season", "site_id:s day:s wind_u:d wind_v:d wind_sin:d wind_cos:d wind_cross:d season_sin:d season_cos:d",
       """SELECT site_id, day, wind_speed * cos(radians(wind_dir)) AS wind_u, wind_speed * sin(radians(wind_dir)) AS wind_v,
            sin(radians(wind_dir)) AS wind_sin, cos(radians(wind_dir)) AS wind_cos,
            wind_speed * cos(radians(wind_dir)) * conc_0_5 AS wind_cross,
            sin(2 * pi() * dayofyear(day) / 365.25) AS season_sin, cos(2 * pi() * dayofyear(day) / 365.25) AS season_cos FROM daily""")
def _(v):
    rows = with_wind(v.daily, cross="conc_0_5")
    return with_season(rows.withColumn("cell", F.col("day").cast("timestamp_ntz")))


@query("log_scores", "site_id:s day:s conc_0_5:d air_temp:d",
       """SELECT site_id, day, (l - avg(l) OVER s) / (stddev_samp(l) OVER s + 1e-12) AS conc_0_5,
            (air_temp - avg(air_temp) OVER s) / (stddev_samp(air_temp) OVER s + 1e-12) AS air_temp
          FROM (SELECT *, ln(1 + greatest(conc_0_5, 0.0)) AS l FROM daily) WINDOW s AS (PARTITION BY site_id)""")
def _(v):
    return standard_scores(v.daily.select("site_id", "day", "conc_0_5", "air_temp"), ["conc_0_5", "air_temp"], log=["conc_0_5"])


_STAT_COLS = ("water_temp", "total_conc", "wind_speed", "air_temp")
_TRAIN_CELLS = """numbered AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY day, depth) AS rn,
      count(*) OVER (PARTITION BY site_id) AS total FROM standard_days),
    train AS (SELECT * FROM numbered WHERE rn <= floor(total * 0.7::DOUBLE)),
    stats AS (""" + " UNION ALL ".join(
    f"SELECT site_id, '{c}' AS variable, avg({c}) AS mean, stddev_samp({c}) + 1e-8 AS std, count({c}) AS n FROM train GROUP BY site_id"
    for c in _STAT_COLS) + ")"


def _standard_cells(v):
    """Standard table on day cells: one row per (station, day, depth)."""
    return v.standard.groupBy("site_id", F.to_date("timestamp").alias("day"), "depth").agg(
        F.avg("water_temp").alias("water_temp"), F.avg("total_conc").alias("total_conc"),
        *[F.min(c).alias(c) for c in WEATHER_MEASURES])


@query("norm_stats", "site_id:s variable:s mean:d std:d n:i", "SELECT * FROM stats", ctes=_TRAIN_CELLS)
def _(v):
    return norm_stats(_standard_cells(v), _STAT_COLS, ts="day")


@query("standardised", "site_id:s day:s depth:d water_temp:d total_conc:d",
       """SELECT d.site_id, d.day, d.depth, (d.water_temp - t.mean) / t.std AS water_temp, (d.total_conc - c.mean) / c.std AS total_conc
          FROM standard_days d JOIN stats t ON t.site_id = d.site_id AND t.variable = 'water_temp'
          JOIN stats c ON c.site_id = d.site_id AND c.variable = 'total_conc'""", ctes=_TRAIN_CELLS)
def _(v):
    cells = _standard_cells(v)
    return standardise(cells, norm_stats(cells, _STAT_COLS, ts="day"), ["water_temp", "total_conc"])


@query("position_split", "site_id:s day:s part:s",
       """SELECT site_id, day, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train'
            WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS part
          FROM (SELECT site_id, day, row_number() OVER (PARTITION BY site_id ORDER BY day) - 1 AS i,
                count(*) OVER (PARTITION BY site_id) AS n FROM daily)""")
def _(v):
    return split_by_position(v.daily.select("site_id", "day"), "day")


@query("depth_and_date_slice", "site_id:s depth:d n:i total:d",
       """SELECT site_id, depth, count(*) AS n, sum(total_conc) AS total FROM readings
          WHERE depth IN (1.5, 5.0, 10.0) AND day >= DATE '1996-01-01' AND day < DATE '1998-01-01' GROUP BY ALL""")
def _(v):
    rows = select_depths(v.readings, (1.5, 5.0, 10.0)).withColumn("day", F.to_date("timestamp"))
    return slice_days(rows, "1996-01-01", "1998-01-01").groupBy("site_id", "depth").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_conc").alias("total"))


@query("column_profile", "site_id:s variable:s n_rows:i n_values:i mean:d p5:d p50:d p95:d null_share:d",
       " UNION ALL ".join(
           f"""SELECT site_id, '{c}' AS variable, count(*) AS n_rows, count({c}) AS n_values, avg({c}) AS mean,
                 quantile_cont({c}, 0.05) AS p5, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.95) AS p95,
                 1 - count({c}) / count(*) AS null_share FROM fast_standard GROUP BY site_id"""
           for c in ("water_temp", "total_conc", *WEATHER_MEASURES)))
def _(v):
    return column_profile(v.fast_standard, ["water_temp", "total_conc", *WEATHER_MEASURES], ["site_id"])


@query("sampling_interval", "site_id:s median_seconds:d n_intervals:i",
       """SELECT site_id, median(gap) AS median_seconds, count(*) AS n_intervals FROM (
            SELECT site_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY site_id ORDER BY ts))) / 1e6 AS gap FROM fast)
          WHERE gap IS NOT NULL GROUP BY site_id""")
def _(v):
    return median_interval(interval_counts(v.fast, "timestamp"))


@query("table_overview", "n_rows:i n_sites:i n_depths:i first_day:s last_day:s",
       """SELECT count(*) AS n_rows, count(DISTINCT site_id) AS n_sites, count(DISTINCT depth) AS n_depths,
            min(day) AS first_day, max(day) AS last_day FROM readings""")
def _(v):
    return v.readings.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("site_id").alias("n_sites"),
        F.count_distinct("depth").alias("n_depths"), F.to_date(F.min("timestamp")).alias("first_day"),
        F.to_date(F.max("timestamp")).alias("last_day"))


def _rebuild_sql(subset):
    from limnoscope.operators.profile import bracket_weights
    from limnoscope.schema import depth_column
    w = bracket_weights(DEPTHS7, subset)
    hidden = [d for d in DEPTHS7 if d not in subset]
    errs = ["pow(" + " + ".join(f"{x} * {depth_column('temp', o)}" for o, x in zip(sorted(subset), w[d]) if x)
            + f" - {depth_column('temp', d)}, 2)" for d in hidden]
    return f"sqrt(avg({' + '.join(errs)}) / {len(hidden)})"


_SUBSETS = {"even": (0.5, 1.5, 3.0), "deep": (1.5, 5.0, 10.0), "single": (2.5,), "none": ()}


@query("depth_subsets", "site_id:s subset:s rmse:d",
       " UNION ALL ".join(
           f"SELECT site_id, '{n}' AS subset, {_rebuild_sql(s)} AS rmse FROM daily GROUP BY site_id" for n, s in _SUBSETS.items() if s)
       + " UNION ALL SELECT site_id, 'none', sqrt((" + " + ".join(f"var_samp({c})" for c in TEMP_COLS) + f") / {len(TEMP_COLS)}) FROM daily GROUP BY site_id")
def _(v):
    return subset_rmse(v.daily, _SUBSETS, DEPTHS7)


_BUDGET = 5


def _greedy_sql():
    """Errors of all subsets up to the budget, then one greedy step after the other."""
    subsets = [[i for i in range(len(DEPTHS7)) if mask >> i & 1] for mask in range(1, 1 << len(DEPTHS7))]
    scored = [f"SELECT site_id, {sum(1 << i for i in s)} AS mask, {len(s)} AS k, {_rebuild_sql(tuple(DEPTHS7[i] for i in s))} AS rmse FROM daily GROUP BY site_id"
              for s in subsets if len(s) <= _BUDGET]
    ctes = ["subsets AS (" + " UNION ALL ".join(scored) + ")",
            "step1 AS (SELECT site_id, mask, mask AS added, rmse FROM subsets WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY rmse, mask) = 1)"]
    for k in range(2, _BUDGET + 1):
        ctes.append(f"""step{k} AS (SELECT s.site_id, s.mask, s.mask - p.mask AS added, s.rmse FROM subsets s JOIN step{k - 1} p ON p.site_id = s.site_id
            AND s.k = {k} AND s.mask & p.mask = p.mask QUALIFY row_number() OVER (PARTITION BY s.site_id ORDER BY s.rmse, s.mask) = 1)""")
    depth = "CASE added " + " ".join(f"WHEN {1 << i} THEN {d}" for i, d in enumerate(DEPTHS7)) + " END"
    return " UNION ALL ".join(f"SELECT site_id, {k} AS step, {depth} AS depth, rmse FROM step{k}" for k in range(1, _BUDGET + 1)), ", ".join(ctes)


_GREEDY, _GREEDY_CTES = _greedy_sql()


@query("greedy_depths", "site_id:s step:i depth:d rmse:d", _GREEDY, ctes=_GREEDY_CTES)
def _(v):
    return greedy_depths_by_site(v.daily, DEPTHS7, _BUDGET)
