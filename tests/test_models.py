"""Models of many groups, slices, sweep and spectrum against small direct versions."""

import datetime as dt
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalog.forecasts import members, rises, scored
from catalog.warnings_ import series
from limnoscope.operators import boosting
from limnoscope.operators import isotonic
from limnoscope.operators import lags
from limnoscope.operators import logistic
from limnoscope.operators import slices
from limnoscope.operators.align import complete_axis, fill_forward, interpolate_time
from limnoscope.operators.boosting import boosted_scores
from limnoscope.operators.forecast import after_train, autoregression, change_quantiles, window_quantiles
from limnoscope.operators.isotonic import apply_isotonic, isotonic_curves
from limnoscope.operators.lags import efold_lag, spectral_bands
from limnoscope.operators.logistic import fit_logistic, state_probability
from limnoscope.operators.metrics import interval_counts
from limnoscope.operators.ranks import ranked_values, roc_auc
from limnoscope.operators.warning import at_thresholds, event_hits, false_alarms, warning_sweep
from limnoscope.session import settled

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(1)
    rows = []
    for site, window in (("a", 0), ("a", 1), ("b", 0)):
        x = rng.normal(size=(220, 3))
        y = np.where(x[:, 0] > 0.3, 2.0, -1.0) * (1 + window) + 0.5 * x[:, 1] + rng.normal(size=220) * 0.1
        for i in range(220):
            rows.append((site, window, i, *map(float, x[i]), float(y[i]), int(y[i] > 0), i < 160))
    return pd.DataFrame(rows, columns=["site_id", "window_id", "i", "f0", "f1", "f2", "v", "on", "is_train"])


def test_first_tree_is_the_best_histogram_split(spark, groups):
    got = boosted_scores(spark.createDataFrame(groups), ["f0", "f1", "f2"], F.array("v", F.col("v") * 2), trees=1, depth=1, step=1.0, reg=0.0, bins=8).toPandas()
    for _, g in got.groupby(["site_id", "window_id"]):
        train = g[g.is_train]
        best = None
        for f in ("f0", "f1", "f2"):
            for cut in np.quantile(train[f], np.arange(1, 8) / 8):
                left = train[f] <= cut
                if 5 <= left.sum() <= len(train) - 5:
                    loss = sum(((p.v - p.v.mean()) ** 2).sum() for p in (train[left], train[~left]))
                    if best is None or loss < best[0] - 1e-9:
                        best = (loss, f, cut, train[left].v.mean(), train[~left].v.mean())
        _, f, cut, low, high = best
        scores = np.stack(g.score.to_list())
        assert np.allclose(scores[:, 0], np.where(g[f] <= cut, low, high)) and np.allclose(scores[:, 1], 2 * scores[:, 0])


def test_groups_held_by_a_task_and_groups_shared_by_all_grow_alike(spark, groups, monkeypatch):
    df = spark.createDataFrame(groups).withColumn("heavy", F.when(F.col("on") == 1, 3.0).otherwise(0.5))
    spoiled = df.withColumn("f1", F.when((F.col("site_id") == "b") & (F.col("i") == 3), None).otherwise(F.col("f1")))
    for loss, target, options in (("squared", F.array("v", F.col("v") * 2), {}), ("logistic", F.array("on"), {"weight": F.col("heavy")}),
                                  ("quantile", F.array("v", "v"), {"levels": (0.1, 0.9)})):
        def scores(rows):
            got = boosted_scores(rows, ["f0", "f1", "f2"], target, trees=2, depth=2, loss=loss, **options).toPandas()
            return np.stack(got.sort_values(["site_id", "window_id", "i"]).score.to_list())

        near, mixed = scores(df), scores(spoiled)
        with monkeypatch.context() as m:
            m.setattr(boosting, "MOST_ROWS", 0)
            assert np.allclose(near, scores(df)) and np.allclose(mixed, scores(spoiled))


def test_small_groups_take_no_pass_over_all_rows_a_level(spark, groups, monkeypatch):
    passes = []
    monkeypatch.setattr(boosting, "settled", lambda df: passes.append(1) or settled(df))
    assert boosted_scores(spark.createDataFrame(groups), ["f0"], F.array("v"), trees=4, depth=3).count() == len(groups)
    assert len(passes) == 1


def test_boosting_learns_each_group_apart_and_ignores_test_rows(spark, groups):
    df = spark.createDataFrame(groups)
    got = boosted_scores(df, ["f0", "f1", "f2"], F.array("v"), trees=6, depth=2, step=0.5).toPandas()
    test = got[~got.is_train]
    residual = test.v - np.stack(test.score.to_list())[:, 0]
    assert len(got) == len(groups) and residual.std() < 0.4 * test.v.std()
    spoiled = df.withColumn("v", F.when(F.col("is_train"), F.col("v")).otherwise(F.lit(1e6)))
    again = boosted_scores(spoiled, ["f0", "f1", "f2"], F.array("v"), trees=2, depth=2).toPandas().set_index(["site_id", "window_id", "i"]).score
    plain = boosted_scores(df, ["f0", "f1", "f2"], F.array("v"), trees=2, depth=2).toPandas().set_index(["site_id", "window_id", "i"]).score
    assert np.allclose(np.stack(again.loc[plain.index].to_list()), np.stack(plain.to_list()))
    odds = boosted_scores(df, ["f0", "f1", "f2"], F.array("on"), trees=4, depth=2, loss="logistic").toPandas()
    assert ((np.stack(odds.score.to_list())[:, 0] > 0) == (odds.on == 1)).mean() > 0.9
    q = boosted_scores(df, ["f2"], F.array("v", "v"), trees=2, depth=1, loss="quantile", levels=(0.1, 0.9)).toPandas()
    low, high = np.stack(q.score.to_list()).T
    assert ((q.v >= low) & (q.v <= high)).mean() > 0.6
    assert boosted_scores(df.where("1 = 0"), ["f0"], F.array("v")).count() == 0


def test_logistic_equals_a_fit_by_hand(spark, groups):
    df = spark.createDataFrame(groups)
    got = state_probability(df, ["f0", "f1", "f2"], "on", rounds=10).toPandas()
    coefficients = {(r.site_id, r.window_id): r.beta for r in fit_logistic(df, ["f0", "f1", "f2"], "on", rounds=10).collect()}
    for key, g in got.groupby(["site_id", "window_id"]):
        train = g[g.is_train]
        x = train[["f0", "f1", "f2"]].to_numpy()
        centre, scale = x.mean(0), x.std(0)
        design, y = np.column_stack([np.ones(len(x)), (x - centre) / scale]), train.on.to_numpy(float)
        w = len(y) / (2 * (np.where(y == 1, y.sum(), len(y) - y.sum()) + 1))
        hold = w.sum() * np.array([1e-6, 0.01, 0.01, 0.01])
        b = np.zeros(4)
        for _ in range(10):
            p = 1 / (1 + np.exp(-np.clip(design @ b, -35, 35)))
            h = (design * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + np.diag(hold + 1e-12)
            b = b + np.clip(np.linalg.solve(h, design.T @ (w * (y - p)) - hold * b), -8, 8)
        assert np.allclose(coefficients[key], b, atol=1e-6)
        rows = np.column_stack([np.ones(len(g)), (g[["f0", "f1", "f2"]].to_numpy() - centre) / scale])
        assert np.allclose(g.p, 1 / (1 + np.exp(-np.clip(rows @ b, -35, 35))), atol=1e-6)


def test_small_groups_are_fitted_where_their_rows_are_and_large_ones_alike(spark, groups, monkeypatch):
    extra = groups[(groups.site_id == "b") & (groups.i % 2 == 0)].assign(site_id=None)
    df = spark.createDataFrame(pd.concat([groups[(groups.site_id != "b") | (groups.i < 100)], extra]))

    def fits():
        return {(r.site_id, r.window_id): (r.centre, r.scale, r.beta) for r in fit_logistic(df, ["f0", "f1", "f2"], "on").collect()}

    monkeypatch.setattr(logistic, "MOST_ROWS", 0)
    together = fits()
    monkeypatch.setattr(logistic, "MOST_ROWS", 120)
    mixed = fits()
    monkeypatch.setattr(logistic, "MOST_ROWS", 160)
    monkeypatch.setattr(logistic, "_newton_step", None)  # rounds over all rows are only for large groups
    near = fits()
    assert set(near) == set(mixed) == set(together) == {("a", 0), ("a", 1), ("b", 0)}
    for key, parts in near.items():
        for other in (mixed[key], together[key]):
            assert all(np.allclose(x, y, rtol=1e-8, atol=1e-10) for x, y in zip(parts, other, strict=True))


def test_scored_days_lie_after_the_train_part(spark):
    rows = [(i < 5, DAY + dt.timedelta(days=i), DAY + dt.timedelta(days=8)) for i in range(12)]
    df = spark.createDataFrame(rows, "is_train boolean, origin date, train_end date")
    assert [r.origin.day for r in after_train(df).orderBy("origin").collect()] == [9, 10, 11, 12]


def test_autoregression_solves_the_normal_equations(spark):
    rng = np.random.default_rng(4)
    x = [0.0, 0.0]
    for _ in range(300):
        x.append(1.2 * x[-1] - 0.5 * x[-2] + rng.normal())
    series = spark.createDataFrame([("s", DAY + dt.timedelta(days=i), 5.0 + v) for i, v in enumerate(x)], "site_id string, day date, v double")
    got = autoregression(series, "v", "day", order=6, horizon=3).toPandas()
    v = np.array(x) + 5.0
    n = len(v) - 9
    m = int(n * 0.7) + 8
    c = v[:m] - v[:m].mean()
    r = np.array([np.dot(c[k:], c[:m - k]) for k in range(9)])
    toeplitz = r[np.abs(np.subtract.outer(range(6), range(6)))]
    at = {DAY + dt.timedelta(days=i): i for i in range(len(v))}
    assert len(got) == 3 * (n - int(n * 0.7) - int(n * 0.15))
    for h in (1, 2, 3):
        phi = np.linalg.solve(toeplitz, r[h:h + 6])
        part = got[got.h == h]
        want = [v[:m].mean() + phi @ (v[at[d] - 5:at[d] + 1][::-1] - v[:m].mean()) for d in part.day]
        assert np.allclose(part.pred, want) and np.allclose(part.y_h, [v[at[d] + h] for d in part.day])
    flat = spark.createDataFrame([("s", DAY + dt.timedelta(days=i), 2.0) for i in range(60)], "site_id string, day date, v double")
    assert {round(r.pred, 9) for r in autoregression(flat, "v", "day", order=6, horizon=3).collect()} == {2.0}


def pooled(p, y):
    """Isotonic fit from its definition: the highest, over starts, of the lowest mean over ends."""
    points = sorted(set(p))
    s = [sum(b for a, b in zip(p, y) if a == q) for q in points]
    n = [sum(a == q for a in p) for q in points]
    return points, [max(min(sum(s[a:b + 1]) / sum(n[a:b + 1]) for b in range(i, len(points))) for a in range(i + 1)) for i in range(len(points))]


@pytest.mark.parametrize("by_month", [False, True])
def test_change_quantiles_equal_their_definition_and_order_no_samples(spark, by_month):
    rng = np.random.default_rng(5)
    rows = [(site, 0, DAY + dt.timedelta(days=i), h, float(rng.normal()), None if i % 11 == 3 else float(rng.normal()), i < cut)
            for site, cut in (("a", 70), (None, 70), ("b", 0)) for i in range(100) for h in (1, 2)]
    df = spark.createDataFrame(rows, "site_id string, window_id int, origin date, h int, cur double, delta_h double, is_train boolean")
    got = change_quantiles(df, (0.1, 0.5, 0.9), by_month, min_rows=10)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()  # nor is any sample sorted
    got = {(r.site_id, r.origin, r.h): r for r in got.collect()}
    assert len(got) == len(rows)
    for site, _, day, h, cur, delta, _ in rows:
        same = [r for r in rows if r[0] == site and r[3] == h and r[6] and r[5] is not None]
        month = [r for r in same if r[2].month == day.month]
        values = [r[5] for r in (month if by_month and len(month) >= 10 else same)]
        q = got[site, day, h].q
        assert (q is None) == (not values) and (not values or np.allclose(q, cur + np.quantile(values, [0.1, 0.5, 0.9])))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_window_quantiles_equal_their_definition_and_send_no_windows_to_python(spark):
    rng = np.random.default_rng(15)
    rows = [(site, w, DAY + dt.timedelta(days=3 * i), float(rng.normal()), None if i % 4 == 0 or site == "c" else float(rng.normal()))
            for site, w, n in (("a", 0, 120), ("a", 1, 17), (None, 0, 60), ("c", 2, 40)) for i in range(n)] + [("a", 0, None, 99.0, 99.0)]
    df = spark.createDataFrame(rows, "site_id string, window_id int, day date, u double, v double")
    levels, least = (0.1, 0.5, 0.9), 8
    found = window_quantiles(df, F.array("u", "v"), "day", levels, least)
    assert "Python" not in plan(found)  # a batch of windows grows with the windows of a task
    got = {(r.site_id, r.window_id): r for r in found.collect()}
    assert len(got) == 4
    for (site, w), r in got.items():
        same = [x for x in rows if x[:2] == (site, w) and x[2]]
        for k in (0, 1):
            for m in range(13):
                values = [x[3 + k] for x in same if x[3 + k] is not None and m in (0, x[2].month)]
                q = r.months[m - 1][k] if m else r.whole[k]
                assert (q is None) == (len(values) < (least if m else 1)) and (q is None or np.allclose(q, np.quantile(values, levels)))
    assert got["c", 2].whole[1] is None and got["a", 0].months[0][0] and got["a", 1].months[11][0] is None


def test_forecasts_scores_and_alarms_send_no_windows_to_python(spark):
    rng = np.random.default_rng(16)
    days = [("a", DAY + dt.timedelta(days=i), float(rng.random())) for i in range(780)]
    view = SimpleNamespace(daily=spark.createDataFrame(days, "site_id string, day date, conc_0_5 double"))
    for made in (members(view), scored(view), rises(view), series(view)):
        assert "Python" not in plan(made)
    got = [r for r in members(view).collect() if r.member == "month_change" and r.h == 3]
    v, at = [x[2] for x in days], {x[1]: i for i, x in enumerate(days)}
    assert {r.window_id for r in got} == {0, 1}
    for r in got:
        i, first = at[r.origin], 45 * r.window_id
        train = [j for j in range(first + 29, first + 730 - 7) if days[j][1].month == r.origin.month]
        assert np.isclose(r.q[4], v[i] + np.quantile([v[j + 3] - v[j] for j in train], 0.5), atol=2e-9)


def test_isotonic_curves_are_pooled_a_chunk_at_a_time(spark, monkeypatch):
    rows = [(f"g{i % 30}", (i * 37 % 1000) / 1000, i % 3 % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    plans, keep = [], isotonic.settled
    monkeypatch.setattr(isotonic, "settled", lambda made: plans.append(plan(made)) or keep(made))
    assert isotonic.isotonic_curves(df, "p", "y", ["g"], chunk=7).count() == 30
    assert len(plans) > 2 and all("FlatMapGroupsInArrow" in p and "EvalPython" not in p for p in plans)


def test_isotonic_curves_equal_their_definition(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(p), int(rng.random() < (p if g != "down" else 1 - p))) for g in ("up", "down") for p in np.round(rng.random(150), 3)]
    rows += [("one", 0.4, 1), ("one", 0.4, 0), ("all", 0.1, 1), ("all", 0.2, 1)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    curves = isotonic_curves(df, "p", "y", ["g"], chunk=7)
    got = {(r.g, r.p): r.c for r in apply_isotonic(df, curves, "p", ["g"], name="c").collect()}
    for g in ("up", "down"):
        points, want = pooled([p for k, p, _ in rows if k == g], [y for k, _, y in rows if k == g])
        assert np.allclose([got[g, p] for p in points], want)
    assert got["one", 0.4] == 0.5 and got["all", 0.1] == 1 - 1e-6
    ask = spark.createDataFrame([("all", 9.0), ("none", 0.5), ("up", None)], "g string, p double")
    assert [r.c for r in apply_isotonic(ask, curves, "p", ["g"], name="c").orderBy("g").collect()] == [1 - 1e-6, None, None]


def test_slices_bound_a_hot_group_of_close_values(spark):
    rng = np.random.default_rng(6)
    rows = [("hot", float(v)) for v in 1013.1 + 0.2 * rng.random(3000)] + [(f"g{i % 40}", float(i)) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, v double")
    sizes = slices.sliced(df, "v", ["k"], rows_a_slice=250).groupBy("k", "_slice").count().filter("k = 'hot'").collect()
    assert len(sizes) >= 10 and max(r["count"] for r in sizes) <= 500
    ranked = ranked_values(df, "v", ["k"], rows_a_slice=250).toPandas()
    want = pd.DataFrame(rows, columns=["k", "v"]).groupby("k").v.rank(method="min").sub(1)
    check = pd.DataFrame(rows, columns=["k", "v"]).assign(below=want).drop_duplicates().merge(ranked, on=["k", "v"], suffixes=("_w", ""))
    assert len(check) == len(ranked) and (check.below_w == check.below).all() and set(ranked[ranked.k == "hot"].total) == {3000}
    whole = ranked_values(df, "v", rows_a_slice=500).toPandas().sort_values("v")
    assert (whole.below.to_numpy() == np.concatenate([[0], whole.n.cumsum()[:-1]])).all()
    labelled = df.withColumn("y", (F.col("v") > 1013.2).cast("int"))
    assert {r.auc for r in roc_auc(labelled.filter("k = 'hot'"), "v", "y", ["k"]).collect()} == {1.0}


def test_neighbours_and_gaps_do_not_depend_on_slices(spark):
    rng = np.random.default_rng(8)
    t0 = dt.datetime(2020, 1, 1)
    rows = [("s", t0 + dt.timedelta(hours=3 * i), None if rng.random() < 0.6 else float(rng.normal())) for i in range(200)] + [("e", t0, None)]
    df = spark.createDataFrame(rows, "site_id string, cell timestamp_ntz, v double")
    for run in (lambda n: interpolate_time(df, ["v"], rows_a_slice=n), lambda n: interpolate_time(df, ["v"], limit=2, rows_a_slice=n),
                lambda n: fill_forward(df, ["v"], rows_a_slice=n)):
        one, many = (run(n).toPandas().sort_values(["site_id", "cell"]).reset_index(drop=True) for n in (None, 9))
        pd.testing.assert_frame_equal(one, many)
    series = pd.Series([v for _, _, v in rows[:200]], dtype=float)
    filled = interpolate_time(df, ["v"], rows_a_slice=9).filter("site_id = 's'").toPandas().sort_values("cell").v
    assert np.allclose(filled, series.interpolate(limit_direction="both"))
    instants = spark.createDataFrame([("s", t0 + dt.timedelta(seconds=int(x))) for x in rng.integers(0, 5000, 900)], "site_id string, t timestamp_ntz")
    counts = {r.seconds: r.n for r in interval_counts(instants, "t", rows_a_slice=50).collect()}
    gaps = pd.Series(sorted(r.t for r in instants.collect())).diff().dropna().dt.total_seconds().value_counts().to_dict()
    assert counts == gaps
    far = spark.createDataFrame([("s", t0), ("s", t0 + dt.timedelta(hours=3 * 20000))], "site_id string, cell timestamp_ntz")
    axis = complete_axis(far, "cell", "INTERVAL 3 HOURS")
    assert axis.count() == axis.distinct().count() == 20001


def test_sweep_equals_hits_and_alarms_taken_apart(spark):
    rng = np.random.default_rng(9)
    series = [(s, DAY + dt.timedelta(days=int(d)), None if rng.random() < 0.05 else float(rng.random())) for s in "ab" for d in np.flatnonzero(rng.random(200) < 0.9)]
    ev = [(s, i, DAY + dt.timedelta(days=20 * i + int(rng.integers(0, 9)) - 10), DAY + dt.timedelta(days=20 * i + 4)) for s in "abz" for i in range(12)]
    series = spark.createDataFrame(series, "site_id string, day date, p double")
    events = spark.createDataFrame(ev, 'site_id string, event_id int, start date, `end` date')
    taus = (0.5, 0.9)
    swept = warning_sweep(series, events, taus, 10)
    from limnoscope.operators.warning import events_in_period
    warnings, inside = at_thresholds(series, taus), events_in_period(series, events)
    columns = ["site_id", "theta", "event_id", "start", "end", "hit", "lead_days"]
    assert sorted(map(str, swept.filter("what = 'event'").select(columns).collect())) == sorted(map(str, event_hits(warnings, inside, taus, 10).select(columns).collect()))
    columns = ["site_id", "theta", "start", "end", "days", "false_alarm"]
    alarms = false_alarms(warnings, inside, taus, 10).withColumn("days", F.col("days").cast("long")).select(columns)
    assert sorted(map(str, swept.filter("what = 'episode'").select(columns).collect())) == sorted(map(str, alarms.collect()))


@pytest.mark.parametrize("n", [600, 601, 625])
def test_spectrum_equals_the_fast_transform(spark, n):
    rng = np.random.default_rng(n)
    v = np.sin(np.arange(n) / 3.1) + rng.normal(size=n)
    df = spark.createDataFrame([("s", 0.5, DAY + dt.timedelta(days=i), float(x)) for i, x in enumerate(v)], "site_id string, depth double, day date, v double")
    got = spectral_bands(df, "v", "day", rows_per_day=1, rows_a_slice=100).first()
    power, f = np.abs(np.fft.rfft(v - v.mean()))[1:] ** 2, np.arange(1, n // 2 + 1) / n
    power, f = power[(f > 1 / 730) & (f <= 0.5)], f[(f > 1 / 730) & (f <= 0.5)]
    assert np.isclose(got.dominant_period, 1 / f[power.argmax()])
    assert np.isclose(got.share_2_7d, power[(f >= 1 / 7) & (f < 1 / 2)].sum() / power.sum())


def test_short_series_are_transformed_in_one_row_and_long_ones_alike(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(s, 0.5, DAY + dt.timedelta(days=i), float(x)) for s, n in (("a", 600), ("b", 660), ("c", 512), ("d", 300))
            for i, x in enumerate(np.cos(np.arange(n) / 2.3) + rng.normal(size=n))]
    df = spark.createDataFrame(rows, "site_id string, depth double, day date, v double")
    long = spectral_bands(df, "v", "day", rows_per_day=1, series_rows=0).orderBy("site_id").collect()
    mixed = spectral_bands(df, "v", "day", rows_per_day=1, series_rows=600).orderBy("site_id").collect()
    monkeypatch.setattr(lags, "numbered", None)  # positions and copies of rows are only for long series
    short = spectral_bands(df.orderBy(F.rand(1)), "v", "day", rows_per_day=1).orderBy("site_id").collect()
    assert [r.site_id for r in short] == ["a", "b", "c"]
    for other in (long, mixed):
        assert [r[:3] for r in other] == [r[:3] for r in short]
        assert np.allclose([r[3:] for r in other], [r[3:] for r in short], rtol=1e-9)


def test_efold_lag_of_long_and_constant_series(spark):
    rng = np.random.default_rng(11)
    n = 2300
    walk = np.zeros(n)
    for i in range(1, n):
        walk[i] = 0.9 * walk[i - 1] + rng.normal()
    series = {"slow": walk + 1000.0, "noise": rng.normal(size=n), "constant": np.full(n, 1000.1), "short": walk[:100]}
    pdf = pd.DataFrame([("a", k, i, float(v)) for k, vs in series.items() for i, v in enumerate(vs)], columns=["site_id", "variable", "i", "v"])
    got = efold_lag(spark.createDataFrame(pdf), "v", "i", max_days=60, rows_per_day=1).toPandas().set_index("variable")
    first = next(k for k in range(1, 60) if np.corrcoef(walk[:-k], walk[k:])[0, 1] <= np.exp(-1))
    assert got.efold_days["slow"] == first and got.efold_days["noise"] == 1 and got.efold_days["constant"] == 60
    assert np.isnan(got.efold_days["short"]) and got.n.to_dict() == {k: len(v) for k, v in series.items()}
