"""Early-warning evaluation: probabilities per day, hits, lead times, false alarms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from limnoscope.operators.events import event_days, runs
from limnoscope.schema import KEYS

LEAD_DAYS = 30
THRESHOLDS = (0.3, 0.5, 0.6, 0.7, 0.8)


def daily_probability(forecasts: DataFrame, value: str = "p", day: str = "day",
                      keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean over the members of a window, then over the windows that cover the day."""
    per_window = forecasts.groupBy(*keys, "window_id", day).agg(F.avg(value).alias("_p"))
    return per_window.groupBy(*keys, day).agg(F.avg("_p").alias("p"),
                                              F.count(F.lit(1)).alias("n_windows"))


def threshold_rule(band_rows: DataFrame, quantile: float = 0.75, value: str = "band",
                   day: str = "day", keys: Sequence[str] = KEYS) -> DataFrame:
    """Baseline warning: on a test day of any window the band exceeds the window's
    train quantile.  ``band_rows`` are days assigned to windows."""
    ids = [*keys, "window_id"]
    limit = (band_rows.filter("is_train_row").groupBy(*ids)
             .agg(F.percentile(value, F.lit(quantile)).alias("_q")))
    test = band_rows.filter(~F.col("is_train_row")).join(limit, ids, "left")
    over = F.coalesce((F.col(value) > F.col("_q")).cast("int"), F.lit(0))
    return test.groupBy(*keys, day).agg(F.max(over).alias("warn"))


def at_thresholds(series: DataFrame, thresholds: Sequence[float] = THRESHOLDS, value: str = "p",
                  day: str = "day", keys: Sequence[str] = KEYS) -> DataFrame:
    """One copy of the daily series per threshold with ``warn``; a missing
    probability never warns.  Thresholds are a short constant list."""
    theta = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("theta")
    warn = F.coalesce((F.col(value) > F.col("theta")) & ~F.isnan(F.coalesce(F.col(value), F.lit(0.0))),
                      F.lit(False))
    return (series.select(*keys, F.col(day).alias("day"), F.col(value), theta)
            .withColumn("warn", warn))


def episodes(warnings: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs of warning rows per station and threshold, half-open in position."""
    return runs(warnings, "warn", "day", [*keys, "theta"])


def events_in_period(series: DataFrame, events: DataFrame, day: str = "day",
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """Events that start between the first and the last day of the series."""
    period = series.groupBy(*keys).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    return (events.join(period, list(keys))
            .filter(F.col("start").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi"))


def event_hits(warnings: DataFrame, events: DataFrame, thresholds: Sequence[float],
               lead_days: int = LEAD_DAYS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per event and threshold: hit and lead.

    A hit is a warning in the ``lead_days`` rows before the event start; the lead
    counts calendar days from the start of the last episode that touches those
    rows, which may have begun earlier.  Events are sorted into the series, so
    the last warning before each is carried to it by one window.
    """
    ids = [*keys, "theta"]
    order = W.partitionBy(*ids).orderBy("day")
    rows = warnings.withColumns({
        "_pos": F.row_number().over(order) - 1,
        "_first": F.col("warn") & ~F.coalesce(F.lag("warn").over(order), F.lit(False)),
    })
    rows = rows.select(*ids, "day", F.lit(1).alias("_kind"), "_pos",
                       F.when(F.col("warn"), F.col("_pos")).alias("_wpos"),
                       F.when(F.col("_first"), F.col("day")).alias("_wday"))
    theta = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("theta")
    marks = events.select(*keys, F.col("start").alias("day"), F.lit(0).alias("_kind"),
                          F.struct("event_id", "start", "end").alias("_ev"), theta)
    # An event sorts before the row of its own day: only earlier rows count.
    upto = (W.partitionBy(*ids).orderBy("day", "_kind")
            .rowsBetween(W.unboundedPreceding, 0))
    both = rows.unionByName(marks, allowMissingColumns=True).withColumns({
        "_last": F.last("_pos", ignorenulls=True).over(upto),
        "_lw": F.last("_wpos", ignorenulls=True).over(upto),
        "_ls": F.last("_wday", ignorenulls=True).over(upto),
    }).filter(F.col("_ev").isNotNull())
    at = F.coalesce(F.col("_last") + 1, F.lit(0))
    hit = F.coalesce(F.col("_lw") >= F.greatest(F.lit(0), at - F.lit(lead_days)), F.lit(False))
    return both.select(*ids, "_ev.event_id", "_ev.start", "_ev.end", hit.alias("hit"),
                       F.when(hit, F.datediff("day", "_ls")).alias("lead_days"))


def false_alarms(warnings: DataFrame, events: DataFrame, thresholds: Sequence[float],
                 lead_days: int = LEAD_DAYS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every episode with ``false_alarm``.

    An episode is excused if its last day lies inside an event or an event starts
    within the ``lead_days`` days after it.
    """
    ids = [*keys, "theta"]
    eps = episodes(warnings, keys).select(
        *ids, F.col("end").alias("day"), F.lit(1).alias("_kind"),
        F.struct("start", "end", "length").alias("_ep"))
    theta = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("theta")
    marks = events.select(*keys, F.col("start").alias("day"), F.lit(0).alias("_kind"),
                          F.col("end").alias("_until"), F.col("start").alias("_start"), theta)
    part = W.partitionBy(*ids)
    upto = part.orderBy("day", "_kind").rowsBetween(W.unboundedPreceding, 0)
    later = (part.orderBy(F.col("day").desc(), F.col("_kind").desc())
             .rowsBetween(W.unboundedPreceding, 0))
    both = eps.unionByName(marks, allowMissingColumns=True).withColumns({
        "_inside": F.max("_until").over(upto), "_next": F.last("_start", ignorenulls=True).over(later),
    }).filter(F.col("_ep").isNotNull())
    excused = (F.coalesce(F.col("_inside") >= F.col("day"), F.lit(False))
               | F.coalesce(F.datediff("_next", "day") <= lead_days, F.lit(False)))
    return both.select(*ids, "_ep.start", "_ep.end", F.col("_ep.length").alias("days"),
                       (~excused).alias("false_alarm"))


def warning_sweep(series: DataFrame, events: DataFrame, thresholds: Sequence[float] = THRESHOLDS,
                  lead_days: int = LEAD_DAYS, value: str = "p", day: str = "day",
                  keys: Sequence[str] = KEYS) -> DataFrame:
    """Events, episodes and day counts at all thresholds from one pass over days and event starts.

    A day holds its warnings as a bit mask, one bit per threshold, so no row is copied per
    threshold. Days and the starts of the events inside the series' period are merged in
    one order per station; running values carry the last warning, the start of the running
    episode and the reach of the events begun so far, and one look back from the end
    carries the next event. Rows of the result: ``what`` = days (``n_days``), event
    (``event_id``, ``start``, ``end``, ``hit``, ``lead_days``) or episode (``start``,
    ``end``, ``days``, ``false_alarm``), as defined in :func:`event_hits` and
    :func:`false_alarms`.
    """
    keys, taus = list(keys), [float(t) for t in thresholds]
    if len(taus) > 62:
        raise ValueError("at most 62 thresholds fit the mask of a day")
    p = F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")), F.lit(float("-inf")))
    mask = sum((F.when(p > t, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, t in enumerate(taus)), F.lit(0).cast("long"))
    in_order = W.partitionBy(*keys).orderBy("day")
    rows = series.select(*keys, F.col(day).alias("day"), mask.alias("_mask"))
    rows = rows.select(*keys, "day", F.lit(1).alias("_kind"), (F.row_number().over(in_order) - 1).alias("_pos"), "_mask",
                       F.coalesce(F.lag("_mask").over(in_order), F.lit(0)).alias("_before"), F.coalesce(F.lead("_mask").over(in_order), F.lit(0)).alias("_after"))
    marks = events.select(*keys, F.col("start").alias("day"), F.lit(0).alias("_kind"), F.struct("event_id", "start", "end").alias("_ev"))
    whole = W.partitionBy(*keys)
    on_day = F.when(F.col("_kind") == 1, F.col("day"))
    both = rows.unionByName(marks, allowMissingColumns=True).withColumns(
        {"_lo": F.min(on_day).over(whole), "_hi": F.max(on_day).over(whole), "_n": F.count(on_day).over(whole)})
    both = both.filter(F.col("_ev").isNull() | F.col("day").between(F.col("_lo"), F.col("_hi")))
    # An event sorts before the row of its own day: only earlier rows count for it.
    upto = whole.orderBy("day", "_kind").rowsBetween(W.unboundedPreceding, 0)
    later = whole.orderBy(F.col("day").desc(), F.col("_kind").desc()).rowsBetween(W.unboundedPreceding, 0)

    def bit(column, i):
        return F.col(column).bitwiseAND(F.lit(1 << i).cast("long")) != 0

    carried = {"_last": F.last("_pos", ignorenulls=True).over(upto), "_inside": F.max("_ev.end").over(upto),
               "_next": F.last("_ev.start", ignorenulls=True).over(later)}
    for i in range(len(taus)):
        begins = bit("_mask", i) & ~bit("_before", i)
        carried |= {f"_lw{i}": F.last(F.when(bit("_mask", i), F.col("_pos")), ignorenulls=True).over(upto),
                    f"_ls{i}": F.last(F.when(begins, F.struct("day", "_pos")), ignorenulls=True).over(upto)}
    swept = both.withColumns(carried)
    at = F.coalesce(F.col("_last") + 1, F.lit(0))
    excused = (F.coalesce(F.col("_inside") >= F.col("day"), F.lit(False))
               | F.coalesce(F.datediff("_next", "day") <= lead_days, F.lit(False)))
    none = {"n_days": "long", "event_id": dict(events.dtypes)["event_id"], "start": "date", "end": "date", "hit": "boolean", "lead_days": "int",
            "days": "long", "false_alarm": "boolean"}

    def told(what, t, **values):
        return F.struct(F.lit(t).alias("theta"), F.lit(what).alias("what"),
                        *[values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in none.items()])

    out = []
    for i, t in enumerate(taus):
        hit = F.coalesce(F.col(f"_lw{i}") >= F.greatest(F.lit(0), at - F.lit(lead_days)), F.lit(False))
        out += [
            F.when(F.col("_pos") == 0, told("days", t, n_days=F.col("_n"))),
            F.when(F.col("_ev").isNotNull(), told("event", t, event_id=F.col("_ev.event_id"), start=F.col("_ev.start"), end=F.col("_ev.end"), hit=hit,
                                                  lead_days=F.when(hit, F.datediff("day", f"_ls{i}.day")))),
            F.when(F.col("_ev").isNull() & bit("_mask", i) & ~bit("_after", i),
                   told("episode", t, start=F.col(f"_ls{i}.day"), end=F.col("day"), days=F.col("_pos") - F.col(f"_ls{i}._pos") + 1, false_alarm=~excused))]
    return swept.select(*keys, F.inline(F.filter(F.array(*out), lambda r: r.isNotNull())))


def evaluate_warnings(series: DataFrame, events: DataFrame, thresholds: Sequence[float] = THRESHOLDS,
                      lead_days: int = LEAD_DAYS, value: str = "p", day: str = "day",
                      keys: Sequence[str] = KEYS) -> DataFrame:
    """Summary per station and threshold: recall, leads, episodes, false alarms.

    ``recall`` is null for a station without an event in the period.
    """
    swept = warning_sweep(series, events, thresholds, lead_days, value, day, keys)
    event, wrong = F.col("what") == "event", F.coalesce(F.col("false_alarm"), F.lit(False))
    out = swept.groupBy(*keys, "theta").agg(
        F.max("n_days").alias("n_days"), F.count_if(event).alias("n_events"), F.count_if(F.col("hit")).alias("n_hit"),
        F.percentile("lead_days", F.lit(0.5)).alias("lead_median"), F.avg("lead_days").alias("lead_mean"),
        F.min("lead_days").alias("lead_min"), F.max("lead_days").alias("lead_max"),
        F.count_if(F.col("what") == "episode").alias("n_episodes"), F.count_if(wrong).alias("false_episodes"),
        F.coalesce(F.sum(F.when(wrong, F.col("days"))), F.lit(0)).alias("false_days"))
    return (out.withColumn("recall", F.when(F.col("n_events") > 0,
                                            F.col("n_hit") / F.greatest(F.col("n_events"), F.lit(1))))
            .withColumn("false_day_rate", F.col("false_days") / F.col("n_days")))


def align_events(reference: DataFrame, detected: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """For each reference event the detected event with the nearest start (the
    earlier on a tie), the distance in days, and the days both share."""
    keys = list(keys)
    det = F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("event_id").alias("id"))
    left = reference.select(*keys, F.col("start").alias("_at"),
                            F.struct("event_id", "start", "end").alias("_ref"))
    right = detected.select(*keys, F.col("start").alias("_at"), det.alias("_det"))
    both = left.unionByName(right, allowMissingColumns=True)
    part = W.partitionBy(*keys)
    upto = part.orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)
    later = part.orderBy(F.col("_at").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumns({"_p": F.last("_det", ignorenulls=True).over(upto),
                             "_n": F.last("_det", ignorenulls=True).over(later)})
    back, ahead = F.datediff("_at", "_p.s"), F.datediff("_n.s", "_at")
    best = F.when(back.isNotNull() & (ahead.isNull() | (back <= ahead)), F.col("_p")).otherwise(F.col("_n"))
    out = both.filter(F.col("_ref").isNotNull()).withColumn("_b", best)
    shared = F.datediff(F.least("_b.e", "_ref.end"), F.greatest("_b.s", "_ref.start")) + 1
    return out.select(
        *keys, "_ref.event_id", "_ref.start", "_ref.end", F.col("_b.id").alias("nearest_id"),
        F.col("_b.s").alias("nearest_start"), F.col("_b.e").alias("nearest_end"),
        F.abs(F.datediff("_b.s", "_ref.start")).alias("offset_days"),
        F.greatest(F.lit(0), shared).alias("shared_days"))


def lookback_coverage(events: DataFrame, periods: DataFrame, span: DataFrame,
                      lead_days: int = LEAD_DAYS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of the ``lead_days`` days before each event that some test period covers.

    ``periods`` has half-open (train_end, test_end) dates, ``span`` the first and
    last data day (``lo``, ``hi``) of each station; days outside it do not count.
    """
    days = F.explode(F.sequence("train_end", F.date_sub("test_end", 1))).alias("day")
    covered = periods.select(*keys, days).distinct().withColumn("_c", F.lit(1.0))
    back = (event_days(events, keys, before_days=lead_days, inside=False).join(span, list(keys))
            .filter(F.col("day").between(F.col("lo"), F.col("hi"))))
    share = (back.join(covered, [*keys, "day"], "left").groupBy(*keys, "event_id")
             .agg(F.avg(F.coalesce("_c", F.lit(0.0))).alias("covered"), F.count(F.lit(1)).alias("n_days")))
    return events.select(*keys, "event_id", "start", "end").join(share, [*keys, "event_id"], "left")
