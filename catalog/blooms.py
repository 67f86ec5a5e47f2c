"""Bloom state, events and their surroundings."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from limnoscope.operators.events import (
    before_and_inside, days_by_year, event_context, event_peaks, events, flag_event_rows,
    layer_rise, layer_variation, lead_from_crossing, lead_from_minimum, lead_share, linkage,
    merge_runs, run_summary, runs, runs_by_year, surface_dropout, threshold_sensitivity,
)
from limnoscope.operators.labels import band_median, bloom_state, layer_quantiles
from limnoscope.schema import WEATHER_MEASURES

# Loose thresholds: the given values are independent draws, so a strict state
# (90 % and three layers) hardly ever lasts two days.
LOOSE = {"quantile": 0.75, "min_layers": 2}


def loose_state(v):
    return bloom_state(v.cells, **LOOSE)


def loose_events(v):
    return events(loose_state(v), F.col("bloom") == 1)


def state_sql(quantile: float, layers: int, tag: str) -> str:
    return f"""
band_{tag} AS (SELECT site_id, day, median(total_conc) AS band FROM cells WHERE depth BETWEEN 0.5 AND 3.0 GROUP BY ALL),
band_q_{tag} AS (SELECT site_id, quantile_cont(band, {quantile}) AS band_q FROM band_{tag} GROUP BY site_id),
layer_q_{tag} AS (SELECT site_id, depth, quantile_cont(total_conc, {quantile}) AS layer_q FROM cells
  WHERE depth BETWEEN 0.5 AND 5.0 GROUP BY ALL),
layers_{tag} AS (SELECT c.site_id, c.day, count(*) FILTER (WHERE c.total_conc > l.layer_q) AS n_layers
  FROM cells c JOIN layer_q_{tag} l USING (site_id, depth) GROUP BY ALL),
state_{tag} AS (SELECT l.site_id, l.day, b.band, q.band_q, l.n_layers,
    CASE WHEN b.band > q.band_q AND l.n_layers >= {layers} THEN 1 ELSE 0 END AS bloom
  FROM layers_{tag} l LEFT JOIN band_{tag} b USING (site_id, day) JOIN band_q_{tag} q USING (site_id))"""


def runs_sql(name: str, source: str, flag: str, at: str = "day", keys: str = "site_id") -> str:
    """Runs of ``flag`` over row positions of ``source``."""
    on = ", ".join(keys.split())
    return f"""
{name}_pos AS (SELECT {on}, {at}, {flag} AS on_, row_number() OVER (PARTITION BY {on} ORDER BY {at}) - 1 AS pos FROM {source}),
{name} AS (SELECT {on}, min(pos) AS start_pos, max(pos) + 1 AS end_pos, count(*) AS length, min({at}) AS "start", max({at}) AS "end"
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY {on} ORDER BY pos) AS grp FROM {name}_pos WHERE on_)
  GROUP BY {on}, grp)"""


def events_sql(name: str, run_name: str, gap: int = 1, min_length: int = 2) -> str:
    return f"""
{name}_marked AS (SELECT *, CASE WHEN start_pos - lag(end_pos) OVER (PARTITION BY site_id ORDER BY start_pos) <= {gap} THEN 0 ELSE 1 END AS fresh FROM {run_name}),
{name}_merged AS (SELECT site_id, min(start_pos) AS start_pos, max(end_pos) AS end_pos, min("start") AS "start", max("end") AS "end"
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY site_id ORDER BY start_pos) AS e FROM {name}_marked) GROUP BY site_id, e),
{name} AS (SELECT *, end_pos - start_pos AS n_days, row_number() OVER (PARTITION BY site_id ORDER BY start_pos) AS event_id
  FROM {name}_merged WHERE end_pos - start_pos >= {min_length})"""


LOOSE_STATE = state_sql(0.75, 2, "loose").strip()
LOOSE_EVENTS = ",".join([LOOSE_STATE, runs_sql("run_loose", "state_loose", "bloom = 1"), events_sql("ev", "run_loose")])
STATE_POS = LOOSE_EVENTS + """,
pos_state AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY day) - 1 AS pos FROM state_loose)"""


@query("layer_quantiles", "site_id:s depth:d n:i mean:d max:d p50:d p90:d p95:d p99:d",
       """SELECT site_id, depth, count(*) AS n, avg(total_conc) AS mean, max(total_conc) AS max,
            quantile_cont(total_conc, 0.5) AS p50, quantile_cont(total_conc, 0.9) AS p90,
            quantile_cont(total_conc, 0.95) AS p95, quantile_cont(total_conc, 0.99) AS p99 FROM cells GROUP BY ALL""")
def _(v):
    return layer_quantiles(v.cells)


@query("band_median", "site_id:s day:s band:d", "SELECT * FROM band_loose", ctes=LOOSE_STATE)
def _(v):
    return band_median(v.cells)


@query("bloom_state", "site_id:s day:s band:d band_q:d n_layers:i bloom:i", "SELECT * FROM state_strict",
       ctes=state_sql(0.9, 3, "strict").strip())
def _(v):
    return bloom_state(v.cells)


@query("bloom_state_loose", "site_id:s day:s band:d band_q:d n_layers:i bloom:i", "SELECT * FROM state_loose", ctes=LOOSE_STATE)
def _(v):
    return loose_state(v)


@query("bloom_events", 'site_id:s event_id:i start:s end:s start_pos:i end_pos:i n_days:i', "SELECT * FROM ev", ctes=LOOSE_EVENTS)
def _(v):
    return loose_events(v)


@query("bloom_events_wide_gap", 'site_id:s event_id:i start:s end:s n_days:i', "SELECT * FROM ev8",
       ctes=LOOSE_EVENTS + "," + events_sql("ev8", "run_loose", 8, 3))
def _(v):
    return merge_runs(runs(loose_state(v), F.col("bloom") == 1), gap=8, min_length=3)


@query("run_lengths", "site_id:s n_runs:i p50_length:d p75_length:d p90_length:d max_length:i share_le_1:d share_le_2:d share_ge_3:d",
       """SELECT site_id, count(*) AS n_runs, quantile_cont(length, 0.5) AS p50_length, quantile_cont(length, 0.75) AS p75_length,
            quantile_cont(length, 0.9) AS p90_length, max(length) AS max_length, avg(CAST(length <= 1 AS DOUBLE)) AS share_le_1,
            avg(CAST(length <= 2 AS DOUBLE)) AS share_le_2, avg(CAST(length >= 3 AS DOUBLE)) AS share_ge_3 FROM run_loose GROUP BY site_id""",
       ctes=LOOSE_EVENTS)
def _(v):
    return run_summary(runs(loose_state(v), F.col("bloom") == 1), at_least=(3,))


_ABS = (15.0, 20.0, 25.0, 30.0, 40.0)


@query("threshold_sensitivity", "site_id:s threshold:s threshold_value:d n_above:i runs_ge_1:i runs_ge_2:i runs_ge_3:i runs_ge_5:i",
       """SELECT site_id, threshold, tv AS threshold_value, n_above, """ + ", ".join(
           f"coalesce((SELECT count(*) FROM tr WHERE tr.site_id = b.site_id AND tr.threshold = b.threshold AND tr.length >= {m}), 0) AS runs_ge_{m}"
           for m in (1, 2, 3, 5)) + """ FROM (SELECT site_id, threshold, max(tv) AS tv, count(*) FILTER (WHERE band > tv) AS n_above
            FROM trows GROUP BY ALL) b""",
       ctes=LOOSE_STATE + ", tq AS (" + " UNION ALL ".join(
           [f"SELECT site_id, 'p{p * 100:g}' AS threshold, quantile_cont(band, {p}) AS tv FROM band_loose GROUP BY site_id" for p in (0.9, 0.95, 0.99)]
           + [f"SELECT DISTINCT site_id, 'abs_{a:g}' AS threshold, CAST({a} AS DOUBLE) AS tv FROM band_loose" for a in _ABS]) + """),
         trows AS (SELECT b.site_id, b.day, b.band, t.threshold, t.tv FROM band_loose b JOIN tq t USING (site_id)),"""
       + runs_sql("tr", "trows", "band > tv", keys="site_id threshold"))
def _(v):
    return threshold_sensitivity(band_median(v.cells), "band", absolute=_ABS)


@query("bloom_days_by_year", "site_id:s year:i n_rows:i days:d share:d",
       "SELECT site_id, year(day) AS year, count(*) AS n_rows, sum(bloom) AS days, avg(bloom) AS share FROM state_loose GROUP BY ALL",
       ctes=LOOSE_STATE)
def _(v):
    return days_by_year(loose_state(v), "bloom")


@query("runs_by_year", "site_id:s year:i n_runs:i",
       'SELECT site_id, year("start") AS year, count(*) AS n_runs FROM run_loose WHERE length >= 2 GROUP BY ALL', ctes=LOOSE_EVENTS)
def _(v):
    return runs_by_year(runs(loose_state(v), F.col("bloom") == 1), 2)


@query("layer_linkage", "site_id:s q:d n_surface:i near_mean:d near_ge3:d near_ge5:d deep_mean:d all_mean:d all_ge3:d isolated:d near_ge1:d",
       """SELECT site_id, q, count(*) AS n_surface, avg(near) AS near_mean, avg(CAST(near >= 3 AS DOUBLE)) AS near_ge3,
            avg(CAST(near >= 5 AS DOUBLE)) AS near_ge5, avg(deep) AS deep_mean, avg(alln) AS all_mean,
            avg(CAST(alln >= 3 AS DOUBLE)) AS all_ge3, avg(CAST(near = 0 AS DOUBLE)) AS isolated,
            avg(CAST(near >= 1 AS DOUBLE)) AS near_ge1
          FROM (SELECT c.site_id, q, day, count(*) FILTER (WHERE total_conc > tv AND depth > 0.5 AND depth <= 3.0) AS near,
                  count(*) FILTER (WHERE total_conc > tv AND depth > 3.0) AS deep,
                  count(*) FILTER (WHERE total_conc > tv AND depth > 0.5) AS alln,
                  count(*) FILTER (WHERE total_conc > tv AND depth = 0.5) AS top
                FROM cells c JOIN lq USING (site_id, depth) GROUP BY c.site_id, q, day) WHERE top = 1 GROUP BY site_id, q""",
       ctes="lq AS (" + " UNION ALL ".join(
           f"SELECT site_id, depth, {q}::DOUBLE AS q, quantile_cont(total_conc, {q}) AS tv FROM cells GROUP BY ALL" for q in (0.9, 0.95, 0.99)) + ")")
def _(v):
    return linkage(v.cells)


@query("layer_variation", "site_id:s deep_cv:d surface_cv:d",
       """SELECT site_id, avg(s) FILTER (WHERE depth > 3.0) / avg(m) FILTER (WHERE depth > 3.0) AS deep_cv,
            max(s) FILTER (WHERE depth = 0.5) / max(m) FILTER (WHERE depth = 0.5) AS surface_cv
          FROM (SELECT site_id, depth, stddev_samp(total_conc) AS s, avg(total_conc) AS m FROM cells GROUP BY ALL) GROUP BY site_id""")
def _(v):
    return layer_variation(v.cells)


_DROP = """drops AS (SELECT site_id, day, max(CASE WHEN depth = 0.5 THEN total_conc END) AS surface, median(total_conc) AS band
  FROM cells WHERE depth BETWEEN 0.5 AND 3.0 GROUP BY ALL)"""


@query("surface_dropout", "site_id:s day:s surface:d band:d dropout:i",
       "SELECT *, CASE WHEN surface < 0.5 * band AND band > 15 THEN 1 ELSE 0 END AS dropout FROM drops", ctes=_DROP)
def _(v):
    return surface_dropout(v.cells).withColumn("dropout", F.col("dropout").cast("int"))


@query("dropout_runs", "site_id:s n_runs:i p90_length:d max_length:i",
       "SELECT site_id, count(*) AS n_runs, quantile_cont(length, 0.9) AS p90_length, max(length) AS max_length FROM dr GROUP BY site_id",
       ctes=_DROP + "," + runs_sql("dr", "drops", "coalesce(surface < 0.5 * band AND band > 15, false)"))
def _(v):
    return run_summary(runs(surface_dropout(v.cells), "dropout"))


@query("event_peaks", "site_id:s event_id:i start:s end:s n_days:i peak:d peak_at:s mean_layers:d",
       """SELECT e.site_id, e.event_id, e."start", e."end", e.n_days, max(s.band) AS peak,
            arg_min(s.day, row(-s.band, s.day)) AS peak_at, avg(s.n_layers) AS mean_layers
          FROM ev e JOIN pos_state s ON s.site_id = e.site_id AND s.pos >= e.start_pos AND s.pos < e.end_pos
          GROUP BY ALL HAVING avg(s.n_layers) >= 2""", ctes=STATE_POS)
def _(v):
    state = loose_state(v)
    return event_peaks(state, events(state, F.col("bloom") == 1), "band", "n_layers", min_layers=2)


@query("lead_from_crossing", "site_id:s event_id:i start:s crossed_at:s lead_days:i",
       """SELECT site_id, event_id, "start", max(s0) AS crossed_at, date_diff('day', max(s0), "start") AS lead_days FROM (
            SELECT site_id, event_id, "start", grp, min(day) AS s0, count(*) AS n FROM (
              SELECT a.*, rn - row_number() OVER (PARTITION BY site_id, event_id ORDER BY pos) AS grp FROM (
                SELECT e.site_id, e.event_id, e."start", s.day, s.pos, s.band > q.band_q AS on_,
                  row_number() OVER (PARTITION BY e.site_id, e.event_id ORDER BY s.pos) AS rn
                FROM ev e JOIN pos_state s ON s.site_id = e.site_id AND s.pos >= e.start_pos - 60 AND s.pos < e.start_pos
                JOIN half q ON q.site_id = e.site_id) a WHERE on_) GROUP BY ALL HAVING count(*) >= 3)
          GROUP BY site_id, event_id, "start\"""",
       ctes=STATE_POS + ", half AS (SELECT site_id, quantile_cont(band, 0.5) AS band_q FROM state_loose GROUP BY site_id)")
def _(v):
    state = loose_state(v)
    half = state.groupBy("site_id").agg(F.percentile("band", F.lit(0.5)).alias("half"))
    rows = state.join(half, "site_id")
    out = lead_from_crossing(rows, events(state, F.col("bloom") == 1), "band", "half", look_back=60, sustained=3)
    return out.withColumn("lead_days", F.datediff("start", "crossed_at"))


@query("lead_from_minimum", "site_id:s event_id:i low:d low_at:s at_start:d peak_at:s ratio:d lead_days:i ramp_days:i",
       """SELECT site_id, event_id, low, low_at, at_start, peak_at, at_start / greatest(low, 0.01) AS ratio,
            date_diff('day', low_at, "start") AS lead_days, date_diff('day', "start", peak_at) AS ramp_days FROM (
          SELECT e.site_id, e.event_id, e."start", min(s.band) FILTER (WHERE s.pos < e.start_pos) AS low,
            arg_min(s.day, row(s.band, s.day)) FILTER (WHERE s.pos < e.start_pos) AS low_at,
            max(s.band) FILTER (WHERE s.pos = e.start_pos) AS at_start,
            arg_min(s.day, row(-s.band, s.day)) FILTER (WHERE s.pos >= e.start_pos) AS peak_at
          FROM ev e JOIN pos_state s ON s.site_id = e.site_id AND s.pos >= e.start_pos - 21 AND s.pos < e.end_pos GROUP BY ALL)
          WHERE low IS NOT NULL""", ctes=STATE_POS)
def _(v):
    state = loose_state(v)
    out = lead_from_minimum(state, events(state, F.col("bloom") == 1), "band", look_back=21)
    return out.withColumns({"lead_days": F.datediff("start", "low_at"), "ramp_days": F.datediff("peak_at", "start")})


@query("before_and_inside", "site_id:s event_id:i before_mean:d event_mean:d ratio:d",
       """SELECT site_id, event_id, before_mean, event_mean, event_mean / before_mean AS ratio FROM (
          SELECT e.site_id, e.event_id, avg(s.band) FILTER (WHERE s.pos < e.start_pos) AS before_mean,
            avg(s.band) FILTER (WHERE s.pos >= e.start_pos AND s.pos < e.end_pos - 1) AS event_mean
          FROM ev e JOIN pos_state s ON s.site_id = e.site_id AND s.pos >= e.start_pos - 7 AND s.pos < e.end_pos GROUP BY ALL)
          WHERE before_mean IS NOT NULL""", ctes=STATE_POS)
def _(v):
    state = loose_state(v)
    out = before_and_inside(state, events(state, F.col("bloom") == 1), "band", look_back=7)
    return out.withColumn("ratio", F.col("event_mean") / F.col("before_mean"))


_CTX = (*WEATHER_MEASURES, "delta_T", "thermo_grad")


@query("event_context", "site_id:s variable:s event_mean:d event_p25:d event_p75:d other_mean:d other_p25:d other_p75:d",
       " UNION ALL ".join(f"""SELECT site_id, '{c}' AS variable, {", ".join(
           f"{agg} FILTER (WHERE {cond}) AS {n}_{st}" for n, cond in (("event", "ie"), ("other", "NOT ie"))
           for st, agg in (("mean", f"avg({c})"), ("p25", f"quantile_cont({c}, 0.25)"), ("p75", f"quantile_cont({c}, 0.75)")))}
           FROM ctx GROUP BY site_id""" for c in _CTX),
       ctes=LOOSE_EVENTS + """, ctx AS (SELECT w.*, d."delta_T", d.thermo_grad, EXISTS (SELECT 1 FROM ev e WHERE e.site_id = w.site_id AND w.day BETWEEN e."start" AND e."end") AS ie
         FROM weather_days w JOIN daily d ON d.site_id = w.site_id AND d.day = w.day SEMI JOIN state_loose s ON s.site_id = w.site_id AND s.day = w.day)""")
def _(v):
    state = loose_state(v)
    days = v.weather.groupBy("site_id", F.to_date("timestamp").alias("day")).agg(*[F.avg(c).alias(c) for c in WEATHER_MEASURES])
    # Stratification is known on complete days only.
    days = days.join(v.daily.select("site_id", "day", "delta_T", "thermo_grad"), ["site_id", "day"])
    days = days.join(state.select("site_id", "day"), ["site_id", "day"], "left_semi")
    return event_context(flag_event_rows(days, events(state, F.col("bloom") == 1)), _CTX)


_RISE = LOOSE_EVENTS + """,
lq90 AS (SELECT site_id, depth, quantile_cont(total_conc, 0.9) AS q FROM cells GROUP BY ALL),
hits AS (SELECT e.site_id, e.event_id, c.depth, c.day, e."start" FROM ev e JOIN cells c ON c.site_id = e.site_id
    AND c.day BETWEEN e."start" - 21 AND e."end" JOIN lq90 l ON l.site_id = c.site_id AND l.depth = c.depth AND c.total_conc >= l.q),
rises AS (SELECT site_id, event_id, depth, coalesce(max(CASE WHEN CAST(day AS TIMESTAMP) < CAST("start" AS TIMESTAMP) - INTERVAL 6 HOUR THEN day END),
    min(CASE WHEN CAST(day AS TIMESTAMP) >= CAST("start" AS TIMESTAMP) - INTERVAL 6 HOUR THEN day END)) AS rise_at FROM hits GROUP BY ALL),
leads AS (SELECT r.site_id, r.event_id, r.depth, r.rise_at, CAST(date_diff('day', r.rise_at, s.rise_at) AS DOUBLE) AS lead_days
  FROM rises r LEFT JOIN rises s ON s.site_id = r.site_id AND s.event_id = r.event_id AND s.depth = 0.5)"""


def _rises(v):
    return layer_rise(v.cells, loose_events(v))


@query("layer_rise", "site_id:s event_id:i depth:d rise_day:s lead_days:d", "SELECT *, rise_at AS rise_day FROM leads", ctes=_RISE)
def _(v):
    return _rises(v).withColumn("rise_day", F.to_date("rise_at"))


@query("layer_lead_share", "site_id:s depth:d n_events:i mean_lead_days:d lead_share:d",
       """SELECT site_id, depth, count(*) AS n_events, avg(lead_days) AS mean_lead_days, avg(CAST(lead_days > 0.25 AS DOUBLE)) AS lead_share
          FROM leads WHERE lead_days IS NOT NULL GROUP BY ALL""", ctes=_RISE)
def _(v):
    return lead_share(_rises(v))
