"""Weighted logistic regression of many groups at once, by iteratively reweighted least squares.

Groups of at most ``MOST_ROWS`` train rows are spread over the tasks by one shuffle and
each takes all its rounds where its rows are. For larger groups a round is one
aggregation: the weighted sums of products of all features, per group, with partial sums
before the shuffle. What is left is one small system per group, solved many groups per
Arrow batch. Coefficients are a table, joined back to the rows in the next round and
written to the checkpoint folder after each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnoscope.session import settled

IDS = ("site_id", "window_id")
#: Train rows of a group that one task may hold; a larger group is shared by all tasks.
MOST_ROWS = 20_000


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _probability(score: Column) -> Column:
    # Beyond 35 the double nearest to the probability is 0 or 1.
    s = F.greatest(F.lit(-35.0), F.least(F.lit(35.0), score))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-s))


def _newton_step(k: int, reg: float):
    @F.pandas_udf("array<double>")
    def solve(gram: pd.Series, gradient: pd.Series, total: pd.Series, beta: pd.Series) -> pd.Series:
        n = len(gram)
        if not n:
            return pd.Series([], dtype=object)
        upper = np.triu_indices(k)
        h = np.zeros((n, k, k))
        h[:, upper[0], upper[1]] = np.stack(gram.to_list())
        h = h + np.triu(h, 1).transpose(0, 2, 1)
        b = np.stack(beta.to_list())
        # The intercept is all but free; the rest is held by ``reg`` per unit of weight.
        hold = total.to_numpy(float)[:, None] * np.array([1e-6, *[reg] * (k - 1)])
        h[:, range(k), range(k)] += hold + 1e-12
        step = np.linalg.solve(h, (np.stack(gradient.to_list()) - hold * b)[:, :, None])[:, :, 0]
        return pd.Series(list(b + np.clip(step, -8.0, 8.0)))

    return solve


def _group_fit(k: int, reg: float, rounds: int, ids: list[str]) -> Callable[[pa.Table], pa.Table]:
    """All rounds of one group that a task holds: its ids and ``beta``."""
    def fit(table: pa.Table) -> pa.Table:
        x = pc.list_flatten(table["_row"]).to_numpy().reshape(table.num_rows, k)
        y, w = table["_y"].to_numpy(), table["_w"].to_numpy()
        hold, beta = w.sum() * np.array([1e-6, *[reg] * (k - 1)]), np.zeros(k)
        for _ in range(rounds):
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -35.0, 35.0)))
            curve = w * np.maximum(p * (1.0 - p), 1e-9)
            h = (x * curve[:, None]).T @ x + np.diag(hold + 1e-12)
            beta = beta + np.clip(np.linalg.solve(h, x.T @ (w * (y - p)) - hold * beta), -8.0, 8.0)
        return table.slice(0, 1).select(ids).append_column("beta", pa.array([beta], pa.list_(pa.float64())))

    return fit


def fit_logistic(labelled: DataFrame, features: Sequence[str], label: str, train: str = "is_train", ids: Sequence[str] = IDS,
                 reg: float = 0.01, rounds: int = 8) -> DataFrame:
    """One row per group: ``centre`` and ``scale`` of the features and ``beta``, intercept first.

    Only train rows with a label count. They are weighted by ``n / (2 * (class count + 1))``;
    features are centred and scaled by the group's train rows, a missing one is its mean.
    """
    ids, k = list(ids), len(features) + 1
    x = [F.col(f).cast("double") for f in features]
    x = [F.when(~F.isnan(c), c) for c in x]
    rows = labelled.filter(F.col(train) & F.col(label).isNotNull()).select(*ids, *[c.alias(f"_x{i}") for i, c in enumerate(x)], F.col(label).cast("double").alias("_y"))
    names = [f"_x{i}" for i in range(k - 1)]
    stats = rows.groupBy(*ids).agg(
        F.array(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in names]).alias("centre"),
        F.array(*[F.coalesce(F.stddev_pop(c), F.lit(0.0)) for c in names]).alias("_sd"),
        F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_n1"))
    stats = settled(stats.select(*ids, "centre", F.transform("_sd", lambda s: F.when(s > 1e-12, s).otherwise(1.0)).alias("scale"), "_n", "_n1"))
    share = F.col("_n") / (F.lit(2.0) * (F.when(F.col("_y") == 1, F.col("_n1")).otherwise(F.col("_n") - F.col("_n1")) + 1))

    def weighted(some: DataFrame) -> DataFrame:
        return rows.join(some, ids).select(*ids, "_y", share.alias("_w"), standard_row(names).alias("_row"))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.select(*ids).schema.fields)
    near = weighted(stats.filter(F.col("_n") <= MOST_ROWS)).groupBy(*ids).applyInArrow(_group_fit(k, reg, rounds, ids), f"{types}, beta array<double>")
    fitted = stats.join(near, ids).select(*ids, "centre", "scale", "beta")
    far = stats.filter(F.col("_n") > MOST_ROWS)
    if not far.isEmpty():
        fitted = fitted.unionByName(_fit_together(settled(weighted(far)), far, k, ids, reg, rounds))
    return settled(fitted)


def _fit_together(rows: DataFrame, stats: DataFrame, k: int, ids: list[str], reg: float, rounds: int) -> DataFrame:
    """Groups of any size, each round one aggregation for all of them."""
    fitted = stats.select(*ids, "centre", "scale", F.array_repeat(F.lit(0.0), k).alias("beta"))
    at = [F.get("_row", F.lit(i)) for i in range(k)]
    solve = _newton_step(k, reg)
    for _ in range(rounds):
        p = _probability(_dot(F.col("_row"), F.col("beta")))
        scored = rows.join(fitted.select(*ids, "beta"), ids).withColumn("_p", p)
        curve = F.col("_w") * F.greatest(F.col("_p") * (F.lit(1.0) - F.col("_p")), F.lit(1e-9))
        rest = F.col("_w") * (F.col("_y") - F.col("_p"))
        sums = scored.withColumns({"_c": curve, "_r": rest}).groupBy(*ids).agg(
            F.array(*[F.sum(F.col("_c") * at[i] * at[j]) for i in range(k) for j in range(i, k)]).alias("_gram"),
            F.array(*[F.sum(F.col("_r") * c) for c in at]).alias("_gradient"), F.sum("_w").alias("_total"))
        fitted = settled(fitted.join(sums, ids).select(*ids, "centre", "scale", solve("_gram", "_gradient", "_total", "beta").alias("beta")))
    return fitted


def standard_row(names: Sequence[str]) -> Column:
    """1 and the features in units of ``scale`` around ``centre``; a missing one is 0."""
    def unit(i: int, name: str) -> Column:
        z = (F.col(name) - F.get("centre", F.lit(i))) / F.get("scale", F.lit(i))
        return F.coalesce(F.when(~F.isnan(z), z), F.lit(0.0))

    return F.array(F.lit(1.0), *[unit(i, n) for i, n in enumerate(names)])


def state_probability(labelled: DataFrame, features: Sequence[str], label: str = "bloom", train: str = "is_train",
                      ids: Sequence[str] = IDS, reg: float = 0.01, rounds: int = 8, name: str = "p") -> DataFrame:
    """``labelled`` with the probability ``name`` of a two-valued state, learned from each group's own train rows.

    Groups without labelled train rows are left out.
    """
    fitted = fit_logistic(labelled, features, label, train, ids, reg, rounds)
    doubles = {f"_f{i}": F.col(f).cast("double") for i, f in enumerate(features)}
    out = labelled.withColumns(doubles).join(fitted, list(ids))
    return (out.withColumn(name, _probability(_dot(standard_row(list(doubles)), F.col("beta"))))
            .drop("centre", "scale", "beta", *doubles))
