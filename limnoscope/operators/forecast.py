"""Baseline forecasts as Spark jobs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from limnoscope.operators.boosting import boosted_scores
from limnoscope.operators.slices import join_keys
from limnoscope.schema import HORIZON, KEYS, QUANTILE_LEVELS

IDS = ("site_id", "window_id")


def persistence(samples_h: DataFrame, n_levels: int = len(QUANTILE_LEVELS)) -> DataFrame:
    """Every quantile is the current value."""
    return samples_h.withColumn("q", F.array_repeat("cur", n_levels))


def known_start(samples: DataFrame, known: int) -> DataFrame:
    """True values for the first ``known`` horizons, then the last of them."""
    held = F.transform("y", lambda v, i: F.when(i < known, v).otherwise(F.get("y", F.lit(known - 1))))
    return samples.withColumn("pred", held)


def month_quantiles(train: DataFrame, value: str, day: str = "day", levels: Sequence[float] = (0.1, 0.5, 0.9),
                    min_rows: int = 5, ids: Sequence[str] = IDS) -> DataFrame:
    """Per month the quantiles and the mean of the train rows when there are at least
    ``min_rows``, and per window the same over all rows (month null) as fallback."""
    p = F.array(*[F.lit(float(v)) for v in levels])
    rows = train.withColumn("month", F.month(day))
    monthly = rows.groupBy(*ids, "month").agg(
        F.percentile(value, p).alias("q"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    overall = rows.groupBy(*ids).agg(
        F.percentile(value, p).alias("q"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    return (monthly.filter(F.col("n") >= min_rows)
            .unionByName(overall.withColumn("month", F.lit(None).cast("int"))))


def climatology(samples_h: DataFrame, month_q: DataFrame, target_day: str = "target_day",
                ids: Sequence[str] = IDS) -> DataFrame:
    """Quantiles of the target's month, or of the whole train part."""
    per_month = month_q.filter(F.col("month").isNotNull()).select(
        *ids, F.col("month").alias("_month"), F.col("q").alias("_qm"), F.col("mean").alias("_mm"))
    overall = month_q.filter(F.col("month").isNull()).select(
        *ids, F.col("q").alias("_qa"), F.col("mean").alias("_ma"))
    return (samples_h.withColumn("_month", F.month(target_day))
            .join(overall, list(ids), "left").join(per_month, [*ids, "_month"], "left")
            .withColumns({"q": F.coalesce("_qm", "_qa"), "mean": F.coalesce("_mm", "_ma")})
            .drop("_month", "_qm", "_qa", "_mm", "_ma"))


def change_quantiles(samples_h: DataFrame, levels: Sequence[float] = QUANTILE_LEVELS,
                     by_month: bool = False, min_rows: int = 5,
                     ids: Sequence[str] = IDS, name: str = "q") -> DataFrame:
    """Quantile forecast: the train part's empirical change over ``h`` rows, added to
    the current value.  With ``by_month`` the change of the origin's month is used
    where the train part has at least ``min_rows`` of it.

    Only the train part's changes are gathered, one row a window and horizon is left of
    them, and that is joined to the samples: no order of all samples is needed.
    """
    groups, train = [*ids, "h"], samples_h.filter("is_train")
    if by_month:
        found = window_quantiles(train, F.array("delta_h"), "origin", levels, min_rows, groups)
        found = found.select(*groups, F.get("whole", F.lit(0)).alias("_qa"), F.transform("months", lambda m: F.get(m, F.lit(0))).alias("_qm"))
        change = F.coalesce(F.get("_qm", F.month("origin") - 1), "_qa")
    else:
        found = train.groupBy(*groups).agg(F.percentile("delta_h", F.array(*[F.lit(float(v)) for v in levels])).alias("_qa"))
        change = F.col("_qa")
    out = join_keys(samples_h, found, groups)
    return out.withColumn(name, F.transform(change, lambda v: v + F.col("cur"))).drop("_qa", "_qm")


def train_changes(samples_h: DataFrame, levels: Sequence[float] = QUANTILE_LEVELS, min_rows: int = 5,
                  ids: Sequence[str] = IDS) -> tuple[DataFrame, DataFrame]:
    """Quantiles of the train part's change: per horizon (``change``), and per horizon and
    month of the origin with at least ``min_rows`` rows (``month_change``).

    Two aggregations to one row per group; only those rows are joined to what is forecast.
    """
    p = F.array(*[F.lit(float(v)) for v in levels])
    train = samples_h.filter("is_train")
    overall = train.groupBy(*ids, "h").agg(F.percentile("delta_h", p).alias("change"))
    monthly = (train.groupBy(*ids, "h", F.month("origin").alias("month"))
               .agg(F.percentile("delta_h", p).alias("month_change"), F.count("delta_h").alias("_n"))
               .filter(F.col("_n") >= min_rows).drop("_n"))
    return overall, monthly


def _sorted_quantiles(v: Column, levels: Sequence[float], least: int) -> Column:
    """Quantiles of an ascending array, as Spark's ``percentile`` interpolates; null for fewer than ``least`` values."""
    def at(p):
        place = p * (F.size(v) - 1)
        low, high = F.floor(place), F.ceil(place)
        below, above = F.get(v, low.cast("int")), F.get(v, high.cast("int"))
        return F.when(below == above, below).otherwise((high - place) * below + (place - low) * above)

    return F.when(F.size(v) >= least, F.transform(F.array(*[F.lit(float(p)) for p in levels]), at))


def window_quantiles(train: DataFrame, values: Column, day: str, levels: Sequence[float] = QUANTILE_LEVELS, min_rows: int = 5,
                     ids: Sequence[str] = IDS) -> DataFrame:
    """One row per window: ``whole``, the quantiles of each entry of the array ``values``, and ``months``, the same for
    January to December, null where the month has fewer than ``min_rows`` values of an entry.

    The rows of a window, one a day, are taken together once, in a list per month. Each list is sorted per entry, and the
    sorted months make the whole. One window is worked on at a time, whatever the number of windows in a task.
    """
    rows = train.select(*ids, F.month(day).alias("_m"), values.alias("_e")).filter(F.col("_m").isNotNull())
    months = F.array(*[F.collect_list(F.when(F.col("_m") == m, F.col("_e"))) for m in range(1, 13)])
    rows = rows.groupBy(*ids).agg(months.alias("_rows"), F.max(F.size("_e")).alias("_k"))
    entries = F.sequence(F.lit(0), F.col("_k") - 1)

    def in_order(days, k):
        return F.sort_array(F.filter(F.transform(days, lambda e: F.get(e, k)), lambda v: v.isNotNull()))

    rows = rows.select(*ids, entries.alias("_entries"), F.transform("_rows", lambda days: F.transform(entries, lambda k: in_order(days, k))).alias("_sorted"))
    whole = F.transform("_entries", lambda k: F.sort_array(F.flatten(F.transform("_sorted", lambda month: F.get(month, k)))))
    return rows.select(*ids, F.transform(whole, lambda v: _sorted_quantiles(v, levels, 1)).alias("whole"),
                       F.transform("_sorted", lambda month: F.transform(month, lambda v: _sorted_quantiles(v, levels, max(1, min_rows)))).alias("months"))


# ------------------------------------------------------------- linear baselines
def ridge_forecast(samples_h: DataFrame, features: Sequence[str], alpha: float = 1.0,
                   ids: Sequence[str] = IDS, name: str = "pred") -> DataFrame:
    """Ridge regression per window and horizon, predictions for all rows.

    Sums of products per (window, horizon) are one aggregation with map-side
    partials; the small system is solved on the one row that is left of each
    group, many groups per Arrow batch.
    """
    return ridge_forecasts(samples_h, {name: features}, alpha, ids)


def ridge_forecasts(samples_h: DataFrame, arms: dict[str, Sequence[str]], alpha: float = 1.0, ids: Sequence[str] = IDS) -> DataFrame:
    """The ridge forecasts of several feature lists, a column each: all from the same sums of products and one join."""
    import numpy as np

    features = list(dict.fromkeys(f for fs in arms.values() for f in fs))
    k = len(features)
    chosen = [[features.index(f) for f in fs] for fs in arms.values()]
    train = samples_h.filter("is_train")
    x = [F.col(c).cast("double") for c in features]
    y = F.col("y_h").cast("double")
    n = F.count(F.lit(1)).cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    moments = train.groupBy(*ids, "h").agg(
        F.array(*[F.avg(c) for c in x]).alias("_mx"), F.avg(y).alias("_my"),
        F.array(*[F.covar_pop(x[i], x[j]) * n for i, j in pairs]).alias("_xx"),
        F.array(*[F.covar_pop(c, y) * n for c in x]).alias("_xy"))

    @F.pandas_udf("array<array<double>>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        def fits(upper, b):
            a = np.zeros((k, k))
            for (i, j), v in zip(pairs, upper):
                a[i, j] = a[j, i] = v
            b = np.asarray(b, dtype=float)
            return [np.linalg.lstsq(a[np.ix_(c, c)] + np.eye(len(c)) * alpha, b[c], rcond=None)[0].tolist() for c in chosen]

        return pd.Series([fits(np.asarray(a, dtype=float), b) for a, b in zip(xx, xy)], dtype=object)

    fitted = moments.withColumn("_b", solve("_xx", "_xy")).select(*ids, "h", "_mx", "_my", "_b")

    def forecast(arm):
        terms = [(x[i] - F.get("_mx", F.lit(i))) * F.get(F.get("_b", F.lit(arm)), F.lit(at)) for at, i in enumerate(chosen[arm])]
        return F.col("_my") + sum(terms, F.lit(0.0))

    out = samples_h.join(fitted, [*ids, "h"])
    return out.withColumns({name: forecast(i) for i, name in enumerate(arms)}).drop("_mx", "_my", "_b")


def _levinson(r: Column, order: int, horizon: int) -> Column:
    """Solutions of ``sum_j r(|i - j|) x(j) = r(h + i)`` for h = 1..horizon, an array of arrays of ``order`` coefficients.

    ``r`` holds the autocovariances 0 .. order + horizon - 1. The recursion adds one
    coefficient a step: the prediction polynomial ``a`` and its error ``e`` grow, and each
    solution is corrected by the reversed polynomial. It stops where the error vanishes,
    which a series has that its past explains fully.
    """
    def dot(x, n):
        """``sum_i x(i) r(n - i)``"""
        return F.aggregate(F.zip_with(x, F.reverse(F.slice(r, 2, n)), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    def lengthen(acc, n):
        k = -dot(acc["a"], n) / acc["e"]
        longer = F.concat(acc["a"], F.array(F.lit(0.0)))
        a = F.zip_with(longer, F.reverse(longer), lambda u, v: u + k * v)
        return F.struct(a.alias("a"), (acc["e"] * (F.lit(1.0) - k * k)).alias("e"), acc["x"].alias("x"))

    def correct(acc, n):
        back = F.reverse(acc["a"])

        def one(x, h):
            miss = (F.get(r, h + 1 + n) - dot(x, n)) / acc["e"]
            return F.zip_with(F.concat(x, F.array(F.lit(0.0))), back, lambda u, v: u + miss * v)

        return F.struct(acc["a"].alias("a"), acc["e"].alias("e"), F.transform(acc["x"], one).alias("x"))

    r0 = F.get(r, F.lit(0))
    first = F.transform(F.slice(r, 2, horizon), lambda v: F.array(v / r0))
    start = F.struct(F.array(F.lit(1.0)).alias("a"), r0.alias("e"), first.alias("x")).cast("struct<a:array<double>,e:double,x:array<array<double>>>")

    def step(acc, n):
        # One at a time: the second half reads what the first has made.
        grown = F.element_at(F.transform(F.array(lengthen(acc, n)), lambda made: F.when(made["e"] > r0 * 1e-12, correct(made, n))), 1)
        padded = F.struct(F.concat(acc["a"], F.array(F.lit(0.0))).alias("a"), acc["e"].alias("e"),
                          F.transform(acc["x"], lambda x: F.concat(x, F.array(F.lit(0.0)))).alias("x"))
        return F.coalesce(grown, padded)

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(order - 1)), start, step, lambda acc: acc["x"]) if order > 1 else first
    none = F.array_repeat(F.array_repeat(F.lit(0.0), order), horizon)
    return F.when(r0 > 1e-12, solved).otherwise(none)


def autoregression(series: DataFrame, value: str, ts: str, order: int = 48, horizon: int = 8,
                   look_back: int | None = None, train_frac: float = 0.7, val_frac: float = 0.15,
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Autoregression of each horizon on the last ``order`` values, from the train part's autocovariances.

    Samples are cut 70/15/15 by position; rows that train samples touch give the mean and
    the autocovariances (one aggregation of each row's products with the rows before it).
    The normal equations of all horizons are solved by recursion on the few numbers left
    per series, and applied to the look-back of the test samples. Returns rows (origin, h,
    cur, y_h, pred). ``order`` is limited to the look-back.
    """
    T, keys = look_back or order, list(keys)
    p = min(order, T)
    n_lags = p + horizon
    at = W.partitionBy(*keys).orderBy(ts)
    rows = (series.filter(F.col(value).isNotNull()).select(*keys, ts, F.col(value).cast("double").alias("_v"))
            .withColumns({"_i": F.row_number().over(at) - 1, "_n": F.count(F.lit(1)).over(W.partitionBy(*keys)) - F.lit(T + horizon)})
            .filter(F.col("_n") >= 3))
    n_train, n_val = F.floor(F.col("_n") * F.lit(train_frac)), F.floor(F.col("_n") * F.lit(val_frac))
    in_train = F.col("_i") < n_train + F.lit(T + horizon - 1)
    rows = rows.withColumn("_mean", F.avg(F.when(in_train, F.col("_v"))).over(W.partitionBy(*keys)))
    rows = rows.withColumn("_x", F.col("_v") - F.col("_mean"))
    # The row itself and those before it, the nearest first.
    past = F.reverse(F.collect_list("_x").over(at.rowsBetween(-(n_lags - 1), 0)))
    rows = rows.withColumns({"_past": past, "_y": F.array(*[F.lead("_v", h).over(at) for h in range(1, horizon + 1)])})
    lagged = [F.sum(F.col("_x") * F.coalesce(F.get("_past", F.lit(k)), F.lit(0.0))) for k in range(n_lags)]
    fitted = (rows.filter(in_train).groupBy(*keys).agg(F.array(*lagged).alias("_r"))
              .select(*keys, _levinson(F.col("_r"), p, horizon).alias("_phi")))
    sample = F.col("_i") - F.lit(T - 1)
    test = rows.filter((sample >= n_train + n_val) & (sample < F.col("_n"))).join(fitted, keys)

    def forecast(phi):
        terms = F.zip_with(phi, F.slice("_past", 1, p), lambda b, x: b * x)
        return F.col("_mean") + F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)

    pairs = F.posexplode(F.arrays_zip(F.col("_y").alias("y"), F.transform("_phi", forecast).alias("p"))).alias("_h", "_p")
    return (test.select(*keys, ts, F.col("_v").alias("cur"), pairs)
            .select(*keys, ts, (F.col("_h") + 1).alias("h"), "cur", F.col("_p.y").alias("y_h"), F.col("_p.p").alias("pred")))


# --------------------------------------------------------------- learned models
def after_train(samples: DataFrame, train_end: str = "train_end") -> DataFrame:
    """Samples to judge a window's model on: all their target days lie after its train part.

    The first samples that are not train samples begin before the cut; their first target
    days are days the model has been fitted on.
    """
    return samples.filter(~F.col("is_train") & (F.col("origin") >= F.col(train_end)))


def boosted_trees(samples: DataFrame, features: Sequence[str], ids: Sequence[str] = IDS, name: str = "pred", **options) -> DataFrame:
    """Gradient-boosted trees, one model per window and horizon; ``name`` holds the horizons' forecasts as an array."""
    return boosted_scores(samples, features, F.col("y"), ids=ids, name=name, **options)


def boosted_quantiles(samples: DataFrame, features: Sequence[str], levels: Sequence[float] = (0.1, 0.5, 0.9), horizon: int = HORIZON,
                      ids: Sequence[str] = IDS, **options) -> DataFrame:
    """Boosted quantile forecasts per window and horizon: ``q``, an array over horizons of arrays over ``levels``, in order.

    All levels of all horizons grow in the same rounds.
    """
    each = [float(p) for _ in range(horizon) for p in levels]
    targets = F.flatten(F.transform(F.slice("y", 1, horizon), lambda v: F.array_repeat(v, len(levels))))
    out = boosted_scores(samples, features, targets, ids=ids, loss="quantile", levels=each, name="_q", **options)
    q = F.array(*[F.array_sort(F.slice("_q", h * len(levels) + 1, len(levels))) for h in range(horizon)])
    return out.withColumn("q", q).drop("_q")


def boosted_peak(samples: DataFrame, features: Sequence[str], ids: Sequence[str] = IDS, name: str = "pred_peak", **options) -> DataFrame:
    """The same for the highest value of the coming rows."""
    out = samples.withColumn("peak", F.array_max("y"))
    return boosted_scores(out, features, F.array("peak"), ids=ids, name="_s", **options).withColumn(name, F.get("_s", F.lit(0))).drop("_s")


def level_classifier(labelled: DataFrame, features: Sequence[str], weights: DataFrame, n_levels: int = 4, ids: Sequence[str] = IDS,
                     **options) -> DataFrame:
    """Warning level of every window by boosted trees on its class-weighted train rows; ``predicted`` on all rows.

    One model per level tells it from the others; the level with the highest odds is predicted, the lower on a tie.
    """
    data = labelled.join(weights.select(*ids, "level", F.col("weight").alias("_weight")), [*ids, "level"], "left")
    targets = F.array(*[(F.col("level") == i).cast("double") for i in range(n_levels)])
    out = boosted_scores(data, features, targets, weight=F.col("_weight"), ids=ids, loss="logistic", name="_odds", **options)
    return out.withColumn("predicted", (F.array_position("_odds", F.array_max("_odds")) - 1).cast("int")).drop("_odds", "_weight")


def feature_ablation(samples_h: DataFrame, arms: dict[str, Sequence[str]], by: Sequence[str] = IDS,
                     alpha: float = 1.0) -> DataFrame:
    """Test error of the ridge forecast for each feature list; one row per arm and group."""
    from limnoscope.operators.metrics import errors

    names = {f"_pred{i}": arm for i, arm in enumerate(arms)}
    test = ridge_forecasts(samples_h, dict(zip(names, arms.values())), alpha).filter(~F.col("is_train"))
    each = F.array(*[F.struct(F.lit(arm).alias("arm"), F.col(c).alias("pred")) for c, arm in names.items()])
    return errors(test.select(*by, "y_h", F.inline(each)), "pred", "y_h", [*by, "arm"])
