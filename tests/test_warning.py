"""Warning evaluation: the published cases and edge rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from limnoscope.operators.events import flag_event_rows
from limnoscope.operators.warning import at_thresholds, episodes, evaluate_warnings
from limnoscope.sources.raw import event_table

D0 = dt.date(2023, 1, 1)


def series(spark, values, site="1"):
    return spark.createDataFrame([(site, D0 + dt.timedelta(i), v) for i, v in enumerate(values)], "site_id string, day date, p double")


def two_peaks():
    return [0.9 if i in (10, 30) else 0.0 for i in range(60)]


EVENT = [("1", "2023-01-15", "2023-01-17")]


@pytest.mark.parametrize("theta,lead,expected", [
    (0.5, 10, (1, 1, 1.0, 4.0, 1, 1)), (0.5, 2, (1, 0, 0.0, None, 2, 2)), (0.95, 10, (1, 0, 0.0, None, 0, 0))])
def test_published_cases(spark, theta, lead, expected):
    r = evaluate_warnings(series(spark, two_peaks()), event_table(spark, EVENT), (theta,), lead).first()
    assert (r.n_events, r.n_hit, r.recall, r.lead_median, r.false_episodes, r.false_days) == expected


def test_no_events(spark):
    r = evaluate_warnings(series(spark, two_peaks()), event_table(spark, EVENT).filter("false"), (0.5,), 10).first()
    assert r.n_events == 0 and r.recall is None and r.n_hit == 0


def test_run_before_event(spark):
    values = [1.0 if 5 <= i < 8 else 0.0 for i in range(20)]
    r = evaluate_warnings(series(spark, values), event_table(spark, [("1", "2023-01-10", "2023-01-11")]), (0.5,), 10).first()
    assert r.n_hit == 1 and r.lead_median == 4.0


def test_episodes(spark):
    mask = [1, 1, 0, 1, 0, 1, 1, 1]
    got = episodes(at_thresholds(series(spark, [float(m) for m in mask]), (0.5,)))
    assert [(r.start_pos, r.end_pos) for r in got.orderBy("start_pos").collect()] == [(0, 2), (3, 4), (5, 8)]


def test_missing_probability_never_warns(spark):
    got = at_thresholds(series(spark, [None, float("nan"), 0.9]), (0.5,)).orderBy("day").collect()
    assert [r.warn for r in got] == [False, False, True]


def test_span_is_inclusive(spark):
    days = series(spark, [0.0] * 5)
    flagged = flag_event_rows(days, event_table(spark, [("1", "2023-01-01", "2023-01-03")])).orderBy("day").collect()
    assert [r.in_event for r in flagged] == [True, True, True, False, False]


def test_matches_plain_python(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    p = rng.random(200).round(3)
    spans = [(20, 23), (60, 61), (90, 99), (150, 155)]
    dates = [D0 + dt.timedelta(int(i)) for i in np.cumsum(rng.integers(1, 3, 200))]
    ev = [(dates[a] + dt.timedelta(0), dates[b]) for a, b in spans]
    theta, L = 0.8, 12
    warn = p > theta
    hits, leads = 0, []
    for s, _ in ev:
        i_s = next(i for i, d in enumerate(dates) if d >= s)
        w = [i for i in range(max(0, i_s - L), i_s) if warn[i]]
        if w:
            a = w[-1]
            while a > 0 and warn[a - 1]:
                a -= 1
            hits += 1
            leads.append((s - dates[a]).days)
    fp = i = 0
    while i < 200:
        if warn[i]:
            j = i
            while j < 200 and warn[j]:
                j += 1
            end = dates[j - 1]
            if not any(s <= end <= e for s, e in ev) and not any(s > end and (s - end).days <= L for s, _ in ev):
                fp += 1
            i = j
        else:
            i += 1
    df = spark.createDataFrame([("1", d, float(v)) for d, v in zip(dates, p)], "site_id string, day date, p double")
    r = evaluate_warnings(df, event_table(spark, [("1", str(s), str(e)) for s, e in ev]), (theta,), L).first()
    assert (r.n_hit, r.false_episodes) == (hits, fp)
    assert r.lead_mean == pytest.approx(sum(leads) / len(leads))
