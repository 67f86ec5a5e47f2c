"""Daily protocol on a synthetic reservoir, with a second station and a data gap."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from limnoscope.operators.events import events, runs
from limnoscope.operators.grid import daily_table
from limnoscope.operators.labels import bloom_labels, bloom_state, warning_levels
from limnoscope.operators.windows import assign_windows, supervised_windows
from limnoscope.schema import depth_column

DEPTHS = (0.5, 1.0, 1.5, 2.5, 3.0, 5.0, 10.0)
T0 = pd.Timestamp("2022-01-01")


def standard_frame(site="0902", flat=False, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for step in range(120 * 8):
        t = T0 + pd.Timedelta(hours=3 * step)
        bloom = pd.Timestamp("2022-03-10") <= t < pd.Timestamp("2022-04-01")
        for d in DEPTHS:
            base = 60 if bloom else (5 if d <= 3 else 3)
            temp = 18.0 if flat else 18 - 0.5 * d + rng.normal(0, 0.3)
            conc = 2.0 if flat else max(0.0, base + rng.normal(0, 2))
            rows.append((site, t.to_pydatetime(), d, temp, conc, 2.0, 100.0, 1000.0, 20.0, 60.0, 0.0))
    return rows


SCHEMA = ("site_id string, timestamp timestamp_ntz, depth double, water_temp double, total_conc double, wind_speed double, "
          "wind_dir double, pressure double, air_temp double, humidity double, rainfall double")


@pytest.fixture(scope="module")
def standard(spark):
    return spark.createDataFrame(standard_frame() + standard_frame("0903", seed=1), SCHEMA).cache()


def day_cells(df):
    return df.groupBy("site_id", F.to_date("timestamp").alias("day"), "depth").agg(F.avg("total_conc").alias("total_conc"))


def test_windows(standard):
    daily = daily_table(standard, DEPTHS)
    assert daily.groupBy("site_id").count().collect()[0]["count"] == 120
    s = supervised_windows(daily, "conc_0_5", keys=("site_id",), train_row=None, history=("conc_0_5",))
    pdf = s.filter("site_id = '0902'").toPandas()
    assert len(pdf) == 83 and pdf["n_samples"].eq(83).all()
    assert all(len(h) == 30 for h in pdf["conc_0_5_hist"])
    assert np.allclose(np.stack(pdf["y"]) - pdf["cur"].to_numpy()[:, None], np.stack(pdf["delta"]))


def test_daily_means_of_cell_means(standard):
    got = daily_table(standard, DEPTHS).filter("site_id = '0902'").orderBy("day").toPandas()
    pdf = pd.DataFrame(standard_frame(), columns=[c.split()[0] for c in SCHEMA.split(", ")])
    wide = pdf.pivot_table(index="timestamp", columns="depth", values="total_conc").resample("1D").mean()
    for d in DEPTHS:
        assert np.allclose(got[depth_column("conc", d)], wide[d])
    temp = pdf.pivot_table(index="timestamp", columns="depth", values="water_temp")
    g = np.zeros(len(temp))
    for a, b in zip(DEPTHS, DEPTHS[1:]):
        g = np.maximum(g, (temp[b] - temp[a]).to_numpy() / (b - a))
    assert np.allclose(got["thermo_grad"], pd.Series(g, index=temp.index).resample("1D").mean())


def _n_train(daily):
    rows = assign_windows(daily.select("site_id", "day", "conc_0_5"), "2022-01-01", 60, 20, 30, 1)
    s = supervised_windows(rows, "conc_0_5").select("site_id", "n_train", "n_samples").distinct()
    return {r.site_id: (r.n_train, r.n_samples) for r in s.collect()}


def test_train_count_survives_a_missing_cut_day(standard):
    whole = _n_train(daily_table(standard, DEPTHS))
    assert whole["0902"] == (24, 43)
    cell = F.col("timestamp") != F.lit("2022-03-02 00:00:00").cast("timestamp_ntz")
    assert _n_train(daily_table(standard.filter(cell), DEPTHS))["0902"] == (24, 43)
    day = F.to_date("timestamp") != F.lit("2022-03-02").cast("date")
    assert _n_train(daily_table(standard.filter(day), DEPTHS))["0902"] == (24, 42)


def test_bloom_and_events(standard):
    state = bloom_state(day_cells(standard))
    found = events(state, F.col("bloom") == 1).filter("site_id = '0902'").collect()
    assert state.filter("site_id = '0902' and bloom = 1").count() >= 10
    assert len(found) >= 1 and all(e.n_days >= 2 for e in found)


def test_bloom_negative_control(spark):
    flat = spark.createDataFrame(standard_frame(flat=True), SCHEMA)
    assert bloom_state(day_cells(flat)).filter("bloom = 1").count() == 0


def test_order_partitioning_and_other_stations_do_not_matter(standard):
    cells = day_cells(standard)
    a = bloom_state(cells).filter("site_id = '0902'").orderBy("day").toPandas()
    b = bloom_state(cells.filter("site_id = '0902'").orderBy(F.rand(1)).repartition(7)).orderBy("day").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_runs_add_up(standard):
    state = bloom_state(day_cells(standard), quantile=0.75, min_layers=2)
    r = runs(state, F.col("bloom") == 1)
    assert r.agg(F.sum("length")).first()[0] == state.agg(F.sum("bloom")).first()[0]


def test_merge_rule(spark):
    flags = [1, 1, 0, 1, 0, 0, 1, 0, 0, 1, 1]
    df = spark.createDataFrame([("1", dt.date(2023, 1, 1) + dt.timedelta(i), f) for i, f in enumerate(flags)], "site_id string, day date, f int")
    got = [(e.start_pos, e.end_pos, e.n_days) for e in events(df, F.col("f") == 1).orderBy("event_id").collect()]
    assert got == [(0, 4, 4), (9, 11, 2)]


def test_level_labels(spark):
    rng = np.random.default_rng(0)
    y = np.abs(rng.normal(5, 3, (100, 7)))
    rows = [("1", 0, i, [float(v) for v in y[i]], i < 60) for i in range(100)]
    df = spark.createDataFrame(rows, "site_id string, window_id int, sample int, y array<double>, is_train boolean")
    got = warning_levels(df).orderBy("sample").toPandas()["level"].to_numpy()
    cuts = np.quantile(y[:60].max(axis=1), [0.75, 0.9, 0.97])
    assert (got == np.searchsorted(cuts, y.max(axis=1))).all()
    with pytest.raises(ValueError):
        bloom_labels(df, "bloom")
