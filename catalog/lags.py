"""Correlation across depths, lags and variables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.series import cdf_sql
from catalog.views import DEPTHS7, WIDE_COLS, per_depth
from limnoscope.operators.features import difference, standard_scores, trend_features, with_season
from limnoscope.operators.grid import coarsen, unpivot_columns
from limnoscope.operators.lags import (
    autocorrelation, benjamini_hochberg, bootstrap_correlation, correlation_by_period,
    correlation_summary, decorrelation_lag, depth_correlation, efold_lag, feature_correlation,
    fisher_p, forced_candidates, lag_bound, lead_scan, partial_correlations, screen_lags,
    spectral_bands, strongest_shift, top_edges,
)
from limnoscope.schema import depth_column

GROUPS = {"top": (0.5, 1.5), "middle": (2.5, 3.0), "deep": (5.0, 10.0)}
_PAIRS = [(a, b) for i, a in enumerate(DEPTHS7) for b in DEPTHS7[i:]]
CORR_SQL = "dc AS (" + " UNION ALL ".join(
    f"SELECT site_id, {a}::DOUBLE AS depth_a, {b}::DOUBLE AS depth_b, corr({depth_column('conc', a)}, {depth_column('conc', b)}) AS corr, count(*) AS n FROM daily GROUP BY site_id"
    for a, b in _PAIRS) + ")"


@query("depth_correlation", "site_id:s depth_a:d depth_b:d corr:d n:i", "SELECT * FROM dc", ctes=CORR_SQL)
def _(v):
    return depth_correlation(v.daily, DEPTHS7)


_GROUP_CASE = "CASE WHEN {0} BETWEEN 0.5 AND 1.5 THEN 'top' WHEN {0} BETWEEN 2.5 AND 3.0 THEN 'middle' ELSE 'deep' END"


@query("correlation_summary", "site_id:s relation:s mean_corr:d n_pairs:i",
       f"""SELECT site_id, 'adjacent' AS relation, avg(corr) AS mean_corr, count(*) AS n_pairs FROM (
             SELECT *, row_number() OVER (PARTITION BY site_id, depth_a ORDER BY depth_b) AS k FROM dc WHERE depth_a < depth_b) WHERE k = 1 GROUP BY site_id
           UNION ALL SELECT site_id, CASE WHEN a = b THEN 'within ' || a ELSE a || ' to ' || b END AS relation, avg(corr), count(*) FROM (
             SELECT *, {_GROUP_CASE.format('depth_a')} AS a, {_GROUP_CASE.format('depth_b')} AS b FROM dc WHERE depth_a < depth_b) GROUP BY ALL""", ctes=CORR_SQL)
def _(v):
    return correlation_summary(depth_correlation(v.daily, DEPTHS7), GROUPS)


@query("correlation_by_period", "site_id:s period:i corr:d n:i",
       "SELECT site_id, year(day) AS period, corr(conc_0_5, conc_10) AS corr, count(*) AS n FROM daily GROUP BY ALL")
def _(v):
    return correlation_by_period(v.daily, "conc_0_5", "conc_10", F.year("day"))


_TREND = """tr0 AS (SELECT site_id, cell, "delta_T" - lag("delta_T", 8) OVER w AS "trend_dT",
    CASE WHEN p > 8 THEN regr_slope("delta_T", p) OVER (PARTITION BY site_id ORDER BY cell ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) END AS "slope_dT", thermo_grad - lag(thermo_grad, 8) OVER w AS d_thermo_grad,
    lead(conc_0_5, 8) OVER w - conc_0_5 AS ahead
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY cell) AS DOUBLE) AS p FROM fast_wide) WINDOW w AS (PARTITION BY site_id ORDER BY cell)),
pairs AS (SELECT site_id, cell, 'trend_dT' AS feature, round("trend_dT", 9) + 0.0 AS x, round(ahead, 9) + 0.0 AS y FROM tr0
  UNION ALL SELECT site_id, cell, 'slope_dT', round("slope_dT", 9) + 0.0, round(ahead, 9) + 0.0 FROM tr0
  UNION ALL SELECT site_id, cell, 'd_thermo_grad', round(d_thermo_grad, 9) + 0.0, round(ahead, 9) + 0.0 FROM tr0),
ok AS (SELECT * FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL)"""


def _trend(v):
    """Values at nine decimals, so that ranks tie alike whatever the order of sums."""
    rows = difference(trend_features(v.fast_wide, "cell", drop_head=False), ["conc_0_5"], 8, "cell", suffix="_ahead", ahead=True)
    return rows.withColumns({c: F.round(c, 9) for c in ("trend_dT", "slope_dT", "d_thermo_grad", "conc_0_5_ahead")})


@query("feature_correlation", "site_id:s feature:s pearson:d spearman:d n:i",
       """SELECT site_id, feature, corr(x, y) AS pearson, corr(rx, ry) AS spearman, count(*) AS n FROM (
            SELECT *, rank() OVER (PARTITION BY site_id, feature ORDER BY x) + (count(*) OVER (PARTITION BY site_id, feature, x) - 1) / 2.0 AS rx,
              rank() OVER (PARTITION BY site_id, feature ORDER BY y) + (count(*) OVER (PARTITION BY site_id, feature, y) - 1) / 2.0 AS ry FROM ok) GROUP BY ALL""",
       ctes=_TREND)
def _(v):
    return feature_correlation(_trend(v), ["trend_dT", "slope_dT", "d_thermo_grad"], ["conc_0_5_ahead"])


_N_BOOT = 500
_CDF = "[" + ", ".join(repr(x) for x in __import__("limnoscope.operators.lags", fromlist=["x"]).POISSON1_CDF) + "]"


@query("bootstrap_correlation", "site_id:s low:d high:d mean:d n:i",
       f"""SELECT site_id, quantile_cont(r, 0.025) AS low, quantile_cont(r, 0.975) AS high, avg(r) AS mean, max(n) AS n FROM (
             SELECT site_id, b, max(n) AS n, (sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w)) / sqrt((sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w))
               * (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w))) AS r FROM (
               SELECT d.*, b, len(list_filter({_CDF}, lambda c: c <= ('0x' || substr(md5('0|' || b || '|' || d.site_id || '|' || d.day), 1, 8))::BIGINT / 4294967296.0)) AS w
               FROM cen d, range(1, {_N_BOOT + 1}) r(b)) WHERE w > 0 GROUP BY ALL) GROUP BY site_id""",
       ctes="""cen AS (SELECT site_id, day, air_temp - avg(air_temp) OVER s AS x, conc_0_5 - avg(conc_0_5) OVER s AS y, count(*) OVER s AS n FROM daily
         WINDOW s AS (PARTITION BY site_id))""")
def _(v):
    return bootstrap_correlation(v.daily.select("site_id", "day", "air_temp", "conc_0_5"), "air_temp", "conc_0_5",
                                 ["site_id", "day"], n_boot=_N_BOOT)


_LONG = "lng AS (" + " UNION ALL ".join(f"SELECT site_id, day, '{c}' AS variable, {c} AS value FROM daily" for c in WIDE_COLS) + """),
num AS (SELECT *, row_number() OVER (PARTITION BY site_id, variable ORDER BY day) AS p, count(*) OVER (PARTITION BY site_id, variable) AS n,
    value - avg(value) OVER (PARTITION BY site_id, variable) AS x FROM lng),
acf AS (SELECT a.site_id, a.variable, CAST(b.p - a.p AS INTEGER) AS lag, sum(a.x * b.x) / max(v.ss) AS acf, max(a.n) AS n FROM num a
  JOIN num b ON b.site_id = a.site_id AND b.variable = a.variable AND b.p > a.p AND b.p <= a.p + 30
  JOIN (SELECT site_id, variable, sum(x * x) AS ss FROM num GROUP BY ALL) v ON v.site_id = a.site_id AND v.variable = a.variable GROUP BY ALL)"""
_BOUND = _LONG + """, dl AS (SELECT site_id, variable, coalesce(min(lag) FILTER (WHERE abs(acf) < 2.0 / sqrt(n)), 30) AS first_below, max(n) AS n FROM acf GROUP BY ALL)"""


def _long(v):
    return unpivot_columns(v.daily, WIDE_COLS, ["site_id", "day"])


@query("autocorrelation", "site_id:s variable:s lag:i acf:d n:i", "SELECT * FROM acf", ctes=_LONG)
def _(v):
    return autocorrelation(_long(v), "value", "day", 30)


@query("decorrelation_lag", "site_id:s variable:s first_below:i n:i", "SELECT * FROM dl", ctes=_BOUND)
def _(v):
    return decorrelation_lag(autocorrelation(_long(v), "value", "day", 30), 30)


@query("lag_bound", "site_id:s tau_max:i", "SELECT site_id, least(30, 2 * max(first_below)) AS tau_max FROM dl GROUP BY site_id", ctes=_BOUND)
def _(v):
    return lag_bound(decorrelation_lag(autocorrelation(_long(v), "value", "day", 30), 30), 30)


@query("efold_lag", "site_id:s variable:s efold_days:d n:i",
       """SELECT s.site_id, s.variable, CASE WHEN s.n >= 256 THEN CAST(coalesce(l, least(60, floor(s.n / 3.0))) AS DOUBLE) END AS efold_days, s.n
          FROM (SELECT site_id, variable, max(n) AS n FROM num GROUP BY ALL) s LEFT JOIN (
            SELECT site_id, variable, min(lag) FILTER (WHERE r <= exp(-1.0)) AS l FROM (
              SELECT a.site_id, a.variable, b.p - a.p AS lag, corr(a.value, b.value) AS r FROM num a JOIN num b ON b.site_id = a.site_id
                AND b.variable = a.variable AND b.p > a.p AND b.p < a.p + least(60, floor(a.n / 3.0)) GROUP BY ALL) GROUP BY ALL) USING (site_id, variable)""", ctes=_LONG)
def _(v):
    return efold_lag(_long(v), "value", "day", max_days=60, rows_per_day=1)


_SCAN = """dp AS (SELECT site_id, day, conc_5, conc_0_5, row_number() OVER (PARTITION BY site_id ORDER BY day) AS p FROM daily),
scan AS (SELECT a.site_id, b.p - a.p AS shift, corr(a.conc_5, b.conc_0_5) AS corr, count(*) AS n FROM dp a JOIN dp b
  ON b.site_id = a.site_id AND b.p BETWEEN a.p - 14 AND a.p + 14 GROUP BY ALL)"""


@query("lead_scan", "site_id:s shift:i corr:d n:i", "SELECT * FROM scan", ctes=_SCAN)
def _(v):
    return lead_scan(v.daily, "conc_5", "conc_0_5", "day", 14)


@query("strongest_shift", "site_id:s shift:i corr:d",
       "SELECT site_id, shift, corr FROM scan QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY abs(corr) DESC, shift) = 1", ctes=_SCAN)
def _(v):
    return strongest_shift(lead_scan(v.daily, "conc_5", "conc_0_5", "day", 14))


# ----------------------------------------------------------- lag screen and edges
_VARS = ("conc_0_5", "conc_3", "conc_10", "temp_0_5", "temp_10", "delta_T", "thermo_grad", "wind_speed", "pressure", "air_temp", "humidity", "rainfall")
_TAU = 60
# The screen and the edges: as many sources as one plan takes beside the windows that rank them.
_SCREENED, _TARGETS, _SCREEN_TAU = ("conc_0_5", "temp_0_5", "humidity", "air_temp"), ("conc_0_5", "temp_0_5"), 10


def _screen_sql(sources, targets, tau):
    z = ", ".join(f"({c} - avg({c}) OVER s) / (stddev_samp({c}) OVER s + 1e-12) AS {c}" for c in sources)
    parts = []
    for t in targets:
        for s in sources:
            parts.append(f"""SELECT a.site_id, '{t}' AS target, '{s}' AS source, a.p - b.p AS lag, a.{t} AS y, a.{t}_1 AS y1, a.{t}_2 AS y2, a.ss AS s, a.cc AS c,
               b.{s} AS x, a.n FROM zz a JOIN zz b ON b.site_id = a.site_id AND b.p < a.p AND b.p >= a.p - {tau} WHERE a.p > {tau}""")
    names = ["x", "y", "y1", "y2", "s", "c"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    ctes = [f"""zz AS (SELECT *, {", ".join(f"lag({t}, {k}) OVER w AS {t}_{k}" for t in targets for k in (1, 2))} FROM (
        SELECT site_id, day, {z}, (sin(2 * pi() * dayofyear(day) / 365.25)) AS ss, cos(2 * pi() * dayofyear(day) / 365.25) AS cc,
          row_number() OVER (PARTITION BY site_id ORDER BY day) AS p, count(*) OVER s AS n FROM daily WINDOW s AS (PARTITION BY site_id))
        WINDOW w AS (PARTITION BY site_id ORDER BY p))""",
            f"pr AS ({' UNION ALL '.join(parts)})",
            f"r0 AS (SELECT site_id, target, source, lag, max(n) AS n, {', '.join(f'corr({a}, {b}) AS {a}_{b}' for a, b in pairs)} FROM pr GROUP BY site_id, target, source, lag)"]
    level = 0
    for given in ("c", "s", "y2", "y1"):
        names = [v for v in names if v != given]
        cols = []
        for i, a in enumerate(names):
            for b in names[i + 1:]:
                ac, bc = f"{a}_{given}", f"{b}_{given}"
                room = f"((1 - {ac} * {ac}) * (1 - {bc} * {bc}))"
                cols.append(f"CASE WHEN {room} > 1e-12 THEN ({a}_{b} - {ac} * {bc}) / sqrt({room}) END AS {a}_{b}")
        # keep conditions alphabetically oriented: earlier name first
        ctes.append(f"r{level + 1} AS (SELECT site_id, target, source, lag, n, {', '.join(cols)} FROM r{level})")
        level += 1
    ctes.append("pc AS (SELECT site_id, target, source, lag, x_y AS pcorr, n FROM r4)")
    return ", ".join(ctes)


PC_SQL = _screen_sql(_SCREENED, _TARGETS, _SCREEN_TAU)


def _pcorr(v, sources=_SCREENED, targets=_TARGETS, tau=_SCREEN_TAU):
    rows = standard_scores(v.daily.select("site_id", "day", *sources), sources)
    rows = with_season(rows.withColumn("cell", F.col("day").cast("timestamp_ntz")))
    return partial_correlations(rows, list(targets), list(sources), tau, "day")


@query("partial_correlations", "site_id:s target:s source:s lag:i pcorr:d n:i", "SELECT * FROM pc", ctes=_screen_sql(_VARS, _VARS, _TAU))
def _(v):
    return _pcorr(v, _VARS, _VARS, _TAU)


@query("lag_screen", "site_id:s target:s source:s lag:i pcorr:d source_rank:i lag_rank:i",
       """SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY site_id, target ORDER BY best DESC, source) AS source_rank FROM (
            SELECT *, row_number() OVER (PARTITION BY site_id, target, source ORDER BY abs(pcorr) DESC, lag) AS lag_rank,
              max(abs(pcorr)) OVER (PARTITION BY site_id, target, source) AS best FROM pc WHERE abs(pcorr) > 1.0 / sqrt(n)))
          WHERE source_rank <= 5 AND lag_rank <= 3""", ctes=PC_SQL)
def _(v):
    return screen_lags(_pcorr(v), noise=1.0)


@query("forced_candidates", "site_id:s target:s source:s lag:i",
       f"""SELECT site_id, target, source, lag FROM (SELECT DISTINCT site_id FROM daily), (SELECT unnest({list(_VARS)}) AS target),
            (SELECT unnest(['season_sin', 'season_cos']) AS source), range(1, {_TAU + 1}) r(lag)
          UNION ALL SELECT site_id, target, target, lag FROM (SELECT DISTINCT site_id FROM daily), (SELECT unnest({list(_VARS)}) AS target), range(1, 3) r(lag)""")
def _(v):
    targets = v.daily.select("site_id").distinct().select("site_id", F.explode(F.array(*[F.lit(c) for c in _VARS])).alias("target"))
    return forced_candidates(targets, ("season_sin", "season_cos"), _TAU)


_P = f"2.0 * (1.0 - {cdf_sql('(abs(0.5 * ln((1 + pcorr) / (1 - pcorr))) * sqrt(n - 7.0))')})"
_EDGES = PC_SQL + f", ed AS (SELECT *, {_P} AS p FROM pc WHERE pcorr IS NOT NULL)"
_BH = _EDGES + """, bh AS (SELECT *, least(1.0, min(raw) OVER (PARTITION BY site_id ORDER BY p DESC, target DESC, source DESC, lag DESC
     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM (SELECT *, p * count(*) OVER (PARTITION BY site_id) / row_number() OVER
     (PARTITION BY site_id ORDER BY p, target, source, lag) AS raw FROM ed))"""


def _edges(v):
    edges = _pcorr(v).filter(F.col("pcorr").isNotNull())
    return benjamini_hochberg(edges.withColumn("p", fisher_p(F.col("pcorr"), F.col("n"))), tie=("target", "source", "lag"))


@query("adjusted_p_values", "site_id:s target:s source:s lag:i p:d q:d", "SELECT * FROM bh", ctes=_BH)
def _(v):
    return _edges(v)


@query("top_edges", "site_id:s target:s source:s lag:i lag_hours:i pcorr:d p:d rank:i",
       """SELECT *, lag * 24 AS lag_hours FROM (SELECT *, row_number() OVER (PARTITION BY site_id, target ORDER BY abs(pcorr) DESC, source, lag) AS rank
          FROM bh WHERE p < 0.2) WHERE rank <= 12""", ctes=_BH)
def _(v):
    return top_edges(_edges(v), alpha=0.2, step_hours=24)


@query("spectral_bands", "site_id:s depth:d n:i dominant_period:d share_2_7d:d share_7_30d:d share_30_180d:d share_180_730d:d",
       """SELECT site_id, depth, max(n) AS n, n / arg_max(k, pw) AS dominant_period, """ + ", ".join(
           f"coalesce(sum(pw) FILTER (WHERE f >= 1.0::DOUBLE / {b} AND f < 1.0::DOUBLE / {a}), 0) / sum(pw) AS share_{a}_{b}d"
           for a, b in ((2, 7), (7, 30), (30, 180), (180, 730))) + """
          FROM (SELECT site_id, depth, n, k, k * (1.0::DOUBLE / n) AS f, pow(sum(x * cos(2 * pi() * k * p / n)), 2) + pow(sum(x * sin(2 * pi() * k * p / n)), 2) AS pw
            FROM sp, range(1, 1300) r(k) WHERE k * (1.0::DOUBLE / n) > 1.0::DOUBLE / 730 AND k * (1.0::DOUBLE / n) <= 0.5 GROUP BY ALL) GROUP BY site_id, depth, n""",
       ctes="""sp AS (SELECT site_id, depth, total_conc - avg(total_conc) OVER s AS x, row_number() OVER (PARTITION BY site_id, depth ORDER BY day) - 1 AS p,
         count(*) OVER s AS n FROM (SELECT site_id, depth, day, total_conc FROM cells) WINDOW s AS (PARTITION BY site_id, depth) QUALIFY count(*) OVER s >= 512)""")
def _(v):
    return spectral_bands(v.cells.select("site_id", "depth", "day", "total_conc"), "total_conc", "day", rows_per_day=1)
