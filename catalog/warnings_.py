"""Early-warning evaluation against bloom events."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.blooms import LOOSE_EVENTS, events_sql, loose_events, loose_state, runs_sql
from catalog.forecasts import FEATURES, MEMBER_SQL, MORE, featured, members
from catalog.registry import query
from catalog.series import N_WINDOWS_SQL, SAMPLE_SQL, TARGET, window_numbers_sql, windows
from limnoscope.operators.events import events, merge_runs, runs
from limnoscope.operators.warning import (
    align_events, at_thresholds, daily_probability, episodes, event_hits,
    events_in_period, false_alarms, lookback_coverage, threshold_rule,
)
from limnoscope.operators.windows import first_days, rolling_anchors
from limnoscope.plans.bloom import learned_probability, rule_warnings, warning_report
from limnoscope.session import settled

THETAS = (0.2, 0.3, 0.4)
LEAD = 30

# Warning probability of an origin: the share of its forecast quantiles (all
# horizons and levels) above the window's train 75 % quantile. Only origins of
# the window's test days count: the first test samples begin before them.
PROB_SQL = MEMBER_SQL + """,
p75 AS (SELECT site_id, window_id, quantile_cont(conc_0_5, 0.75) AS limit_, max(train_end) AS train_end FROM win WHERE is_train_row GROUP BY ALL),
alarm AS (SELECT f.site_id, f.window_id, f.origin AS day, f.member, avg((""" + " + ".join(
    f"(CASE WHEN q[{i}] > limit_ THEN 1.0 ELSE 0.0 END)" for i in range(1, 10)) + """) / 9) AS p
  FROM fc f JOIN p75 USING (site_id, window_id) WHERE f.origin >= train_end GROUP BY ALL),
series AS (SELECT site_id, day, avg(p) AS p, count(*) AS n_windows FROM (
  SELECT site_id, window_id, day, avg(p) AS p FROM alarm GROUP BY ALL) GROUP BY ALL)"""

#: Hits, episodes and false alarms of ``series`` against the events ``ev``.
EVALUATION_SQL = """,
warn AS (SELECT site_id, theta, day, round(p, 9) > theta AS warn FROM series, (SELECT unnest([0.2::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE]) AS theta)),
wpos AS (SELECT *, row_number() OVER (PARTITION BY site_id, theta ORDER BY day) - 1 AS pos FROM warn),
inside AS (SELECT e.* FROM ev e JOIN (SELECT site_id, min(day) AS lo, max(day) AS hi FROM series GROUP BY site_id) USING (site_id) WHERE e."start" BETWEEN lo AND hi),
eps AS (SELECT site_id, theta, min(pos) AS a, max(pos) + 1 AS b, min(day) AS d0, max(day) AS d1, count(*) AS days FROM (
  SELECT *, pos - row_number() OVER (PARTITION BY site_id, theta ORDER BY pos) AS g FROM wpos WHERE warn) GROUP BY site_id, theta, g),
at_ AS (SELECT i.site_id, t.theta, i.event_id, i."start", i."end", (SELECT count(*) FROM wpos w WHERE w.site_id = i.site_id AND w.theta = t.theta AND w.day < i."start") AS i_s
  FROM inside i, (SELECT unnest([0.2::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE]) AS theta) t),
lastw AS (SELECT a.site_id, a.theta, a.event_id, max(w.pos) AS lw FROM at_ a JOIN wpos w ON w.site_id = a.site_id AND w.theta = a.theta
  AND w.warn AND w.pos >= greatest(0, i_s - 30) AND w.pos < i_s GROUP BY ALL),
hits AS (SELECT a.*, lw IS NOT NULL AS hit, date_diff('day', e.d0, a."start") AS lead_days FROM at_ a LEFT JOIN lastw l USING (site_id, theta, event_id)
  LEFT JOIN eps e ON e.site_id = a.site_id AND e.theta = a.theta AND l.lw >= e.a AND l.lw < e.b),
alarms AS (SELECT e.*, NOT EXISTS (SELECT 1 FROM inside i WHERE i.site_id = e.site_id AND e.d1 BETWEEN i."start" AND i."end")
    AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.site_id = e.site_id AND i."start" > e.d1 AND date_diff('day', e.d1, i."start") <= 30) AS false_alarm FROM eps e)"""

WARN_SQL = PROB_SQL + "," + LOOSE_EVENTS + EVALUATION_SQL


def alarm_rows(v):
    """Member probabilities per (station, window, day), for days of the window's test part."""
    limit = windows(v).filter("is_train_row").groupBy("site_id", "window_id").agg(
        F.percentile(TARGET, F.lit(0.75)).alias("limit_"), F.max("train_end").alias("train_end"))
    share = F.aggregate("q", F.lit(0.0), lambda a, x: a + F.when(x > F.col("limit_"), 1.0).otherwise(0.0)) / 9
    return (members(v).join(limit, ["site_id", "window_id"]).filter(F.col("origin") >= F.col("train_end"))
            .groupBy("site_id", "window_id", F.col("origin").alias("day"), "member").agg(F.avg(share).alias("p")))


def series(v):
    """Probabilities are compared at nine decimals, so that sums in another order agree."""
    return daily_probability(alarm_rows(v)).withColumn("p", F.round("p", 9))


@query("daily_probability", "site_id:s day:s p:d n_windows:i", "SELECT * FROM series", ctes=PROB_SQL)
def _(v):
    return daily_probability(alarm_rows(v))


@query("threshold_rule", "site_id:s day:s warn:i",
       "SELECT site_id, day, max(CASE WHEN conc_0_5 > limit_ THEN 1 ELSE 0 END) AS warn FROM win JOIN p75 USING (site_id, window_id) WHERE NOT is_train_row GROUP BY ALL",
       ctes=PROB_SQL)
def _(v):
    return threshold_rule(windows(v), value=TARGET)


@query("warning_episodes", "site_id:s theta:d start:s end:s start_pos:i end_pos:i length:i",
       'SELECT site_id, theta, d0 AS "start", d1 AS "end", a AS start_pos, b AS end_pos, days AS length FROM eps', ctes=WARN_SQL)
def _(v):
    return episodes(at_thresholds(series(v), THETAS))


@query("warning_hits", "site_id:s theta:d event_id:i start:s hit:i lead_days:i",
       "SELECT * REPLACE (CAST(hit AS INTEGER) AS hit) FROM hits", ctes=WARN_SQL)
def _(v):
    s, ev = series(v), loose_events(v)
    hits = event_hits(at_thresholds(s, THETAS), events_in_period(s, ev), THETAS, LEAD)
    return hits.withColumn("hit", F.col("hit").cast("int"))


@query("false_alarms", "site_id:s theta:d start:s end:s days:i false_alarm:i",
       'SELECT site_id, theta, d0 AS "start", d1 AS "end", days, CAST(false_alarm AS INTEGER) AS false_alarm FROM alarms', ctes=WARN_SQL)
def _(v):
    s, ev = series(v), loose_events(v)
    out = false_alarms(at_thresholds(s, THETAS), events_in_period(s, ev), THETAS, LEAD)
    return out.withColumn("false_alarm", F.col("false_alarm").cast("int"))


_REPORT = ("site_id:s theta:d n_days:i n_events:i n_hit:i recall:d lead_median:d lead_mean:d lead_min:i lead_max:i "
           "n_episodes:i false_episodes:i false_days:i false_day_rate:d",
           """SELECT b.site_id, b.theta, n_days, coalesce(n_events, 0) AS n_events, coalesce(n_hit, 0) AS n_hit, n_hit / n_events AS recall, lead_median, lead_mean,
            lead_min, lead_max, coalesce(n_episodes, 0) AS n_episodes, coalesce(fe, 0) AS false_episodes, coalesce(fd, 0) AS false_days,
            coalesce(fd, 0) / n_days AS false_day_rate
          FROM (SELECT site_id, theta, count(*) AS n_days FROM warn GROUP BY ALL) b
          LEFT JOIN (SELECT site_id, theta, count(*) AS n_events, count(*) FILTER (WHERE hit) AS n_hit, median(lead_days) AS lead_median, avg(lead_days) AS lead_mean,
            min(lead_days) AS lead_min, max(lead_days) AS lead_max FROM hits GROUP BY ALL) h USING (site_id, theta)
          LEFT JOIN (SELECT site_id, theta, count(*) AS n_episodes, count(*) FILTER (WHERE false_alarm) AS fe, coalesce(sum(days) FILTER (WHERE false_alarm), 0) AS fd
            FROM alarms GROUP BY ALL) a USING (site_id, theta)""")


@query("warning_report", *_REPORT, ctes=WARN_SQL)
def _(v):
    return warning_report(series(v), loose_events(v), THETAS, LEAD)


# ------------------------------------------------------------- learned probability
#: Members of the ensemble: the look-back of the concentration alone, and with weather and stratification.
MEMBERS = {"concentration": FEATURES, "surroundings": (*FEATURES, *MORE)}


def learned_series(v):
    return learned_probability(featured(v), loose_state(v), MEMBERS)


@query("learned_probability", "site_id:s day:s p:d n_windows:i")
def _(v):
    return learned_series(v)


@query("learned_probability_days", "site_id:s day:s n_windows:i",
       "SELECT site_id, day, count(*) AS n_windows FROM (SELECT site_id, window_id, day, p - 29 AS sample, n, train_end, p - 29 < greatest(0, ntr - 36) AS is_train FROM pos)"
       " WHERE sample >= 0 AND sample < n - 37 AND NOT is_train AND day >= train_end GROUP BY ALL", ctes=SAMPLE_SQL)
def _(v):
    """The days that have a learned probability, and from how many windows."""
    return learned_series(v)


@query("learned_warning_report", _REPORT[0])
def _(v):
    return warning_report(settled(learned_series(v)), loose_events(v), THETAS, LEAD)


_RULE = f"""rule_days AS (SELECT site_id, min(day) AS d0, {N_WINDOWS_SQL} FROM band_loose GROUP BY site_id),
rule_rows AS (SELECT b.*, CAST(w AS INTEGER) AS window_id, b.day < d0 + CAST(45 * w + 730 AS INTEGER) AS tr
  FROM band_loose b JOIN rule_days USING (site_id), {window_numbers_sql("rule_days")} r
  WHERE w < nw AND date_diff('day', d0, b.day) >= 45 * w AND date_diff('day', d0, b.day) < 45 * w + 820),
rule AS (SELECT site_id, day, max(CASE WHEN band > l THEN 1 ELSE 0 END) AS w FROM rule_rows
  JOIN (SELECT site_id, window_id, quantile_cont(band, 0.75) AS l FROM rule_rows WHERE tr GROUP BY ALL) USING (site_id, window_id)
  WHERE NOT tr GROUP BY site_id, day)"""


@query("baseline_rule_report", "site_id:s n_days:i n_episodes:i n_warn:i",
       """SELECT b.site_id, n_days, n_episodes, n_warn FROM (SELECT site_id, count(*) AS n_days FROM rule GROUP BY site_id) b
          JOIN (SELECT site_id, count(*) AS n_episodes, sum(length) AS n_warn FROM rr GROUP BY site_id) USING (site_id)""",
       ctes=LOOSE_EVENTS + "," + _RULE + "," + runs_sql("rr", "rule", "w = 1"))
def _(v):
    rule = rule_warnings(v.cells)
    r = runs(rule, F.col("warn") == 1).groupBy("site_id").agg(
        F.count(F.lit(1)).alias("n_episodes"), F.sum("length").alias("n_warn"))
    return rule.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_days")).join(r, "site_id")


@query("baseline_rule_evaluation", *_REPORT, ctes=LOOSE_EVENTS + "," + _RULE + """,
series AS (SELECT site_id, day, CAST(w AS DOUBLE) AS p FROM rule)""" + EVALUATION_SQL)
def _(v):
    rule = rule_warnings(v.cells).withColumn("p", F.col("warn").cast("double"))
    return warning_report(rule, loose_events(v), THETAS, LEAD)


@query("event_alignment", "site_id:s event_id:i start:s end:s nearest_id:i offset_days:i shared_days:i",
       """SELECT r.site_id, r.event_id, r."start", r."end", d.event_id AS nearest_id, abs(date_diff('day', r."start", d."start")) AS offset_days,
            greatest(0, date_diff('day', greatest(r."start", d."start"), least(r."end", d."end")) + 1) AS shared_days
          FROM ev8 r LEFT JOIN ev d USING (site_id)
          QUALIFY row_number() OVER (PARTITION BY r.site_id, r.event_id ORDER BY abs(date_diff('day', r."start", d."start")), d."start") = 1""",
       ctes=LOOSE_EVENTS + "," + events_sql("ev8", "run_loose", 8, 3))
def _(v):
    found = runs(loose_state(v), F.col("bloom") == 1)
    return align_events(merge_runs(found, gap=8, min_length=3), merge_runs(found))


@query("lookback_coverage", "site_id:s event_id:i start:s covered:d n_days:i",
       """SELECT e.site_id, e.event_id, e."start", avg(CASE WHEN greatest(0, floor((date_diff('day', s.d0, b.day) - 820) / 45.0) + 1)
              <= least(nw - 1, floor((date_diff('day', s.d0, b.day) - 730) / 45.0)) THEN 1.0 ELSE 0.0 END) AS covered, count(*) AS n_days
          FROM ev e JOIN (SELECT site_id, min(day) AS d0, max(day) AS hi, """ + N_WINDOWS_SQL + """ FROM state_loose GROUP BY site_id) s USING (site_id)
          JOIN (SELECT e2.site_id, e2.event_id, unnest(generate_series(e2."start" - 30, e2."start" - 1, INTERVAL 1 DAY))::DATE AS day FROM ev e2) b
            ON b.site_id = e.site_id AND b.event_id = e.event_id AND b.day BETWEEN s.d0 AND s.hi GROUP BY ALL
          UNION ALL SELECT e.site_id, e.event_id, e."start", NULL, NULL FROM ev e JOIN (SELECT site_id, min(day) AS d0 FROM state_loose GROUP BY site_id) s USING (site_id)
          WHERE e."start" <= s.d0""", ctes=LOOSE_EVENTS)
def _(v):
    state = loose_state(v)
    span = state.groupBy("site_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    return lookback_coverage(events(state, F.col("bloom") == 1), rolling_anchors(first_days(state)), span)
