"""Scores, ranks and conformal adjustments against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from limnoscope.functions.columns import from_target, normal_cdf, to_target
from limnoscope.functions.scores import crps_energy, crps_pinball, crps_quantiles, pit, with_prob_up
from limnoscope.operators.conformal import calibrate, calibrate_seasonal, finite_sample_index
from limnoscope.operators.forecast import feature_ablation, ridge_forecast
from limnoscope.operators.profile import greedy_depths, greedy_depths_by_site
from limnoscope.operators.ranks import pooled_quantiles, ranked_values, roc_auc, with_average_rank
from limnoscope.operators.lags import spectral_bands
from limnoscope.schema import QUANTILE_LEVELS, depth_column


def quantile_frame(spark, q, y):
    return spark.createDataFrame([(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(q, y))],
                                 "i int, q array<double>, y double")


def crps_by_integration(q, p, y, n=200_001):
    """Twice the quantile loss integrated over the level."""
    q = np.sort(q)
    lo = q[0] - (q[1] - q[0]) / (p[1] - p[0]) * p[0]
    hi = q[-1] + (q[-1] - q[-2]) / (p[-1] - p[-2]) * (1 - p[-1])
    a = (np.arange(n) + 0.5) / n
    qa = np.interp(a, [0, *p, 1], [lo, *q, hi])
    return np.mean(2 * ((y <= qa) - a) * (qa - y))


def test_crps_is_the_integral(spark):
    rng = np.random.default_rng(1)
    q = np.sort(rng.normal(10, 3, (20, 9)), axis=1)
    y = rng.normal(10, 4, 20)
    got = quantile_frame(spark, q, y).select("i", crps_quantiles("q", QUANTILE_LEVELS, "y").alias("c")).orderBy("i").toPandas()["c"]
    want = [crps_by_integration(a, QUANTILE_LEVELS, b) for a, b in zip(q, y)]
    assert np.allclose(got, want, atol=1e-4) and (got >= 0).all()


def test_point_forecast_scores_the_distance(spark):
    df = quantile_frame(spark, np.full((5, 9), 4.0), [1, 3, 4, 5, 9])
    r = df.select(crps_quantiles("q", QUANTILE_LEVELS, "y").alias("a"), crps_pinball("q", QUANTILE_LEVELS, "y").alias("b"), "y").toPandas()
    assert np.allclose(r["a"], (r["y"] - 4).abs()) and np.allclose(r["b"], (r["y"] - 4).abs())


def test_energy_and_pit(spark):
    rng = np.random.default_rng(2)
    q, y = rng.normal(0, 1, (8, 9)), rng.normal(0, 1, 8)
    r = quantile_frame(spark, q, y).select("i", crps_energy("q", "y").alias("e"), pit("q", "y").alias("p")).orderBy("i").toPandas()
    want = np.abs(q - y[:, None]).mean(1) - 0.5 * np.abs(q[:, :, None] - q[:, None, :]).mean((1, 2))
    assert np.allclose(r["e"], want) and np.allclose(r["p"], (q < y[:, None]).mean(1))


def test_normal_cdf(spark):
    from math import erf, sqrt
    z = [-3.0, -0.5, 0.0, 0.7, 2.5]
    got = spark.createDataFrame([(v,) for v in z], "z double").select(normal_cdf("z").alias("c")).toPandas()["c"]
    assert np.allclose(got, [0.5 * (1 + erf(v / sqrt(2))) for v in z], atol=2e-7)


def test_targets_round_trip(spark):
    df = spark.createDataFrame([(0.2, 3.0), (5.0, 1.5), (12.0, 12.0)], "cur double, y double")
    for kind in ("abs_delta", "rel_delta", "log_ratio", "abs_log"):
        out = df.withColumn("t", to_target(kind, "cur", "y")).withColumn("b", from_target(kind, "cur", "t")).toPandas()
        assert np.allclose(out["b"], out["y"])


def test_monotone_probability(spark):
    rng = np.random.default_rng(4)
    q = np.sort(rng.normal(0.3, 1, (50, 3)), axis=1)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(q)], "i int, a double, b double, c double")
    got = with_prob_up(df, "a", "b", "c").orderBy("i").toPandas()
    probs = np.array([0, 0.1, 0.5, 0.9, 1])
    for row, (a, b, c) in zip(got.itertuples(), q):
        x = np.array([a - (b - a) / 4, a, b, c, c + (c - b) / 4])
        lin = 1 - np.interp(0, x, probs)
        assert row.p_linear == pytest.approx(lin, abs=1e-9)
        h, s = np.diff(x), np.diff(probs) / np.diff(x)
        d = np.r_[s[0], [(3 * h[i - 1] + 3 * h[i]) / ((2 * h[i - 1] + h[i]) / s[i - 1] + (h[i - 1] + 2 * h[i]) / s[i]) for i in (1, 2, 3)], s[3]]
        if x[0] >= 0:
            f = 0.0
        elif x[4] <= 0:
            f = 1.0
        else:
            k = int(np.searchsorted(x, 0, side="right") - 1)
            t = -x[k] / h[k]
            f = ((2 * t**3 - 3 * t**2 + 1) * probs[k] + (t**3 - 2 * t**2 + t) * h[k] * d[k]
                 + (3 * t**2 - 2 * t**3) * probs[k + 1] + (t**3 - t**2) * h[k] * d[k + 1])
        assert row.p_monotone == pytest.approx(1 - min(max(f, 0), 1), abs=1e-9)


def test_ranks_with_a_hot_group(spark):
    rng = np.random.default_rng(6)
    hot = np.r_[np.zeros(500), rng.normal(0, 1e3, 300), -rng.random(200), [1e-300, -0.0]]
    pdf = pd.DataFrame({"k": ["hot"] * len(hot) + ["cold"] * 40, "v": np.r_[hot, rng.normal(size=40)]})
    df = spark.createDataFrame(pdf)
    q = pooled_quantiles(df, "v", {"a": 0.05, "b": 0.5, "c": 0.99}, ["k"]).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert np.allclose(q.loc[k, ["a", "b", "c"]].to_numpy(dtype=float), np.quantile(g["v"], [0.05, 0.5, 0.99]))
    ranked = with_average_rank(df, "v", ["k"]).toPandas().sort_values(["k", "v"])
    want = pdf.assign(r=pdf.groupby("k")["v"].rank()).sort_values(["k", "v"])
    assert np.allclose(ranked["rank"], want["r"])
    assert ranked_values(df, "v", ["k"]).filter("k = 'hot' and v = 0").first()["n"] == 501


def test_auc(spark):
    pdf = pd.DataFrame({"p": [0.1, 0.4, 0.35, 0.8, 0.4], "y": [0, 0, 1, 1, 1]})
    r = roc_auc(spark.createDataFrame(pdf), "p", "y").first()
    pairs = [(a > b) + 0.5 * (a == b) for a in pdf.p[pdf.y == 1] for b in pdf.p[pdf.y == 0]]
    assert r.auc == pytest.approx(np.mean(pairs))
    assert roc_auc(spark.createDataFrame(pdf[pdf.y == 1]), "p", "y").first().auc is None


def test_conformal(spark):
    rng = np.random.default_rng(7)
    n = 57
    pdf = pd.DataFrame({"g": 1, "q10": rng.normal(-1, 0.2, n), "q50": 0.0, "q90": rng.normal(1, 0.2, n), "y_h": rng.normal(0, 1.2, n),
                        "month": rng.integers(1, 13, n), "centre_month": 4})
    df = spark.createDataFrame(pdf)
    k = finite_sample_index(n, 0.8)
    r = calibrate(df, 0.2, ["g"]).first()
    assert r.adj_low == pytest.approx(np.sort(np.maximum(pdf.q10 - pdf.y_h, 0))[k - 1])
    assert r.adj_symabs == pytest.approx(np.sort(np.maximum(pdf.q10 - pdf.y_h, pdf.y_h - pdf.q90))[k - 1])
    assert r.adj_abs50 == pytest.approx(np.sort(np.abs(pdf.y_h))[k - 1])
    s = np.maximum(pdf.y_h - pdf.q90, 0)
    m = np.array([s[pdf.month == i].mean() if (pdf.month == i).any() else s.mean() for i in range(1, 13)])
    sm = 0.25 * np.roll(m, 1) + 0.5 * m + 0.25 * np.roll(m, -1)
    want = sm[3] + np.sort(s - sm[pdf.month - 1])[k - 1]
    assert calibrate_seasonal(df, 0.2, ["g"]).first().adj_up == pytest.approx(want)


def test_ridge(spark):
    rng = np.random.default_rng(8)
    X, n = rng.normal(size=(60, 2)), 60
    y = X @ [1.5, -2] + 3 + rng.normal(0, 0.1, n)
    rows = [("1", 0, 1, i < 40, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(X, y))]
    df = spark.createDataFrame(rows, "site_id string, window_id int, h int, is_train boolean, a double, b double, y_h double")
    got = ridge_forecast(df, ["a", "b"]).toPandas()
    Xc, yc = X[:40] - X[:40].mean(0), y[:40] - y[:40].mean()
    coef = np.linalg.solve(Xc.T @ Xc + np.eye(2), Xc.T @ yc)
    want = (X - X[:40].mean(0)) @ coef + y[:40].mean()
    assert np.allclose(np.sort(got["pred"]), np.sort(want))


def test_greedy_depths(spark):
    rng = np.random.default_rng(9)
    depths = (0.5, 1.0, 2.0, 4.0, 8.0)
    t = 20 - np.outer(rng.random(80), np.array(depths)) + rng.normal(0, 0.3, (80, 5))
    pdf = pd.DataFrame(t, columns=[depth_column("temp", d) for d in depths]).assign(site_id="1")
    chosen = []
    for _ in range(3):
        errs = {}
        for d in depths:
            if d not in chosen:
                obs = sorted([*chosen, d])
                hid = [i for i, z in enumerate(depths) if z not in obs]
                fit = np.array([np.interp(depths, obs, row[[depths.index(o) for o in obs]]) for row in t])
                errs[d] = np.sqrt(np.mean((fit[:, hid] - t[:, hid]) ** 2))
        chosen.append(min(errs, key=errs.get))
    wide = spark.createDataFrame(pdf)
    assert [d for d, _ in greedy_depths(wide, depths, 3)] == chosen
    by_site = greedy_depths_by_site(wide, depths, 3).orderBy("step").toPandas()
    assert list(by_site["depth"]) == chosen and by_site["rmse"].iloc[2] == pytest.approx(errs[chosen[2]], rel=1e-6)


def test_spectrum_finds_the_period(spark):
    t = np.arange(1200)
    pdf = pd.DataFrame({"site_id": "1", "depth": 0.5, "day": pd.date_range("2020-01-01", periods=1200).date, "v": np.sin(2 * np.pi * t / 20)})
    r = spectral_bands(spark.createDataFrame(pdf), "v", "day", rows_per_day=1).first()
    assert r.dominant_period == pytest.approx(20) and r.share_7_30d == pytest.approx(1)


def test_histogram_without_keys(spark):
    from limnoscope.operators.metrics import histogram
    v = np.random.default_rng(10).normal(size=400)
    got = histogram(spark.createDataFrame(pd.DataFrame({"v": v})), "v", 12).orderBy("bin").toPandas()
    n, edges = np.histogram(v, 12)
    assert got.set_index("bin")["n"].reindex(range(12), fill_value=0).tolist() == n.tolist()
    assert got["left_edge"].iloc[0] == pytest.approx(edges[0])


def test_ablation_takes_the_sums_once_for_all_arms(spark):
    rng = np.random.default_rng(12)
    n = 60
    pdf = pd.DataFrame({"site_id": "a", "window_id": 0, "h": 1, "a": rng.normal(size=n), "b": rng.normal(size=n), "is_train": np.arange(n) < 40})
    pdf["y_h"] = 2 * pdf.a - pdf.b + rng.normal(size=n) * 0.1
    df = spark.createDataFrame(pdf)
    arms = {"one": ["b"], "both": ["a", "b"]}
    got = feature_ablation(df, arms)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    for row in got.collect():
        alone = ridge_forecast(df, arms[row.arm]).filter("not is_train").toPandas()
        e = alone.y_h - alone.pred
        assert row.rmse == pytest.approx(np.sqrt((e**2).mean())) and row.mae == pytest.approx(e.abs().mean()) and row.n == 20
