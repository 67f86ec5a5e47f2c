"""Bloom identification and warning evaluation from daily depth cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnoscope.operators.events import events
from limnoscope.operators.forecast import after_train
from limnoscope.operators.labels import band_median, bloom_state
from limnoscope.operators.logistic import state_probability
from limnoscope.operators.warning import daily_probability, evaluate_warnings, threshold_rule
from limnoscope.operators.windows import assign_windows
from limnoscope.session import settled


def bloom_events(cells: DataFrame, quantile: float = 0.9, min_layers: int = 3, gap: int = 1,
                 min_days: int = 2) -> DataFrame:
    """Daily cells (site_id, day, depth, total_conc) to bloom events."""
    state = bloom_state(cells, quantile=quantile, min_layers=min_layers)
    return events(state, F.col("bloom") == 1, gap=gap, min_length=min_days)


def rule_warnings(cells: DataFrame, quantile: float = 0.75, **protocol) -> DataFrame:
    """Daily warnings of the train-quantile rule, merged over the rolling windows."""
    band = band_median(cells)
    return threshold_rule(assign_windows(band, **protocol), quantile)


def learned_probability(samples: DataFrame, state: DataFrame, members: dict[str, Sequence[str]], label: str = "bloom",
                        **options) -> DataFrame:
    """Daily bloom probability learned in every rolling window: mean over members, then over the windows that judge the day.

    ``samples`` carry the features of all ``members`` (a name and its feature list) and
    ``train_end``; ``state`` has the label of each day. A window's members are fitted on its
    train samples only, and only its samples from ``train_end`` on are scored.
    """
    known = state.select("site_id", F.col("day").alias("origin"), label)
    labelled = settled(samples.join(known, ["site_id", "origin"], "left"))
    out = None
    for member, features in members.items():
        scored = after_train(state_probability(labelled, features, label, **options))
        part = scored.select("site_id", "window_id", F.col("origin").alias("day"), F.lit(member).alias("member"), "p")
        out = part if out is None else out.unionByName(part)
    return daily_probability(out)


def warning_report(series: DataFrame, event_rows: DataFrame,
                   thresholds: Sequence[float] = (0.3, 0.5, 0.6, 0.7, 0.8), lead_days: int = 30) -> DataFrame:
    """Warning summary of a daily probability series against a list of events."""
    return evaluate_warnings(series, event_rows, thresholds, lead_days)
