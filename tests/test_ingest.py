"""Raw tables, typing, alignment, statistics."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from limnoscope.operators.align import asof_nearest, asof_nearest_grid
from limnoscope.operators.ingest import norm_stats, standard_table
from limnoscope.plans.standard import build_standard
from limnoscope.sources.raw import depth_of, event_table, read_depth_tables, read_weather

T0 = dt.datetime(2022, 1, 1)


@pytest.fixture
def raw(tmp_path):
    root = tmp_path / "readings"
    root.mkdir()
    for i, depth in enumerate((0.5, 1.0)):
        df = pd.DataFrame({"站点编号": "902", "测量时间": [T0 + dt.timedelta(minutes=4 * i, hours=3 * k) for k in range(4)],
                           "水温": 18 - 0.2 * depth, "总浓度": 5 + depth})
        if depth == 1.0:
            df["深度"] = depth
            df["透光率"] = ["1", "2", "bad", "4"]
        df.to_csv(root / f"{depth}m.csv", index=False)
    weather = pd.DataFrame({"站点编号": "902", "测量时间": [T0 + dt.timedelta(minutes=10 * k) for k in range(30)],
                            "风速": 3.0, "风向": 120.0, "压力": 1013.0, "温度": 20.0, "湿度": 55.0, "降雨量": 0.0})
    weather.to_csv(tmp_path / "weather.csv", index=False)
    return str(root), str(tmp_path / "weather.csv")


def test_depth_names():
    assert depth_of("/x/0.5m.csv") == 0.5 and depth_of("a/10m") == 10.0
    with pytest.raises(ValueError):
        depth_of("a/surface.csv")


def test_union_and_types(spark, raw):
    df = read_depth_tables(spark, raw[0])
    assert df.count() == 8
    assert {r.depth for r in df.select("depth").distinct().collect()} == {0.5, 1.0}
    assert "总浓度" not in df.columns and df.columns.count("depth") == 1
    assert {r.site_id for r in df.select("site_id").distinct().collect()} == {"0902"}
    assert df.filter("depth = 1.0 and transmittance is null").count() == 1


def test_standard_table_and_files(spark, raw, tmp_path):
    readings, weather = read_depth_tables(spark, raw[0]), read_weather(spark, raw[1])
    out = standard_table(readings, weather)
    rows = out.select("timestamp", "wind_speed").collect()
    assert len(rows) == 8
    # Weather covers 00:00 and 03:00; 06:00 is within tolerance of the last cell, 09:00 is not.
    assert {r.timestamp.hour: r.wind_speed for r in rows} == {0: 3.0, 3: 3.0, 6: 3.0, 9: None}
    stored, stats = build_standard(spark, readings, weather, str(tmp_path / "out"))
    assert dict(stored.dtypes)["total_conc"] == "float" and dict(stored.dtypes)["site_id"] == "string"
    assert {r.site_id for r in stored.select("site_id").distinct().collect()} == {"0902"}
    assert stats.filter("variable = 'total_conc'").first()["n"] == 5


def test_beyond_tolerance_is_null(spark):
    left = spark.createDataFrame([("1", T0)], "site_id string, timestamp timestamp_ntz")
    right = spark.createDataFrame([("1", T0 + dt.timedelta(hours=12), 3.0)], "site_id string, timestamp timestamp_ntz, w double")
    assert asof_nearest(left, right, ["w"], tolerance_hours=3).first()["w"] is None
    assert asof_nearest(left, right, ["w"], tolerance_hours=12).first()["w"] == 3.0


def test_asof_matches_pandas(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    base = pd.Timestamp(T0)
    left = pd.DataFrame({"site_id": "1", "i": range(300), "timestamp": base + pd.to_timedelta(rng.integers(0, 200_000, 300), unit="s")})
    right = pd.DataFrame({"site_id": "1", "timestamp": base + pd.to_timedelta(np.unique(rng.integers(0, 200_000, 60)), unit="s")})
    right["w"] = np.arange(len(right), dtype=float)
    right.loc[::7, "w"] = np.nan
    want = pd.merge_asof(left.sort_values("timestamp"), right[["timestamp", "w"]], on="timestamp", direction="nearest",
                         tolerance=pd.Timedelta("1h")).set_index("i")["w"].sort_index()
    sl = spark.createDataFrame(left).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    sr = spark.createDataFrame(right).withColumns({"timestamp": F.col("timestamp").cast("timestamp_ntz"), "w": F.nanvl("w", F.lit(None))})
    got = asof_nearest(sl, sr, ["w"], tolerance_hours=1, rows_a_slice=5).toPandas().set_index("i")["w"].sort_index()
    pd.testing.assert_series_equal(got, want, check_names=False)


def test_grid_tie_goes_back(spark):
    t = [T0 + dt.timedelta(hours=3 * k) for k in range(5)]
    left = spark.createDataFrame([("1", t[1])], "site_id string, timestamp timestamp_ntz")
    right = spark.createDataFrame([("1", t[0], 1.0), ("1", t[2], 2.0)], "site_id string, cell timestamp_ntz, w double")
    assert asof_nearest_grid(left, right, ["w"], step_hours=3).first()["w"] == 1.0


def test_stats_use_the_train_part(spark):
    rows = [("1", dt.date(2022, 1, 1 + i), 0.5, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "site_id string, day date, depth double, total_conc double")
    r = norm_stats(df, ["total_conc"], ts="day").first()
    assert r["mean"] == pytest.approx(3.0) and r["n"] == 7 and r["std"] == pytest.approx(2.160246909)


def test_event_table(spark):
    ev = event_table(spark, [("1", "2023-02-01", "2023-02-03"), ("1", "2023-01-15", "2023-01-17")])
    assert [(r.event_id, str(r.start)) for r in ev.orderBy("event_id").collect()] == [(1, "2023-01-15"), (2, "2023-02-01")]


@pytest.mark.parametrize("ids", [("00902", "0902"), ("1e3", "1000"), ("12.0", "0012")])
def test_station_ids_stay_apart(spark, tmp_path, ids):
    from limnoscope.sources.tables import read_standard, write_standard

    rows = spark.createDataFrame([(i, T0, 0.5, float(k)) for k, i in enumerate(ids)], "site_id string, timestamp timestamp_ntz, depth double, total_conc double")
    write_standard(rows, str(tmp_path / "s"))
    back = read_standard(spark, str(tmp_path / "s"))
    assert {(r.site_id, r.total_conc) for r in back.collect()} == {(i, float(k)) for k, i in enumerate(ids)}


def test_depths_are_found_again(spark, tmp_path):
    from limnoscope.operators.grid import profile_table
    from limnoscope.sources.tables import read_standard, write_standard

    rows = spark.createDataFrame([("1", T0, 0.1, 18.0, 3.0)], "site_id string, timestamp timestamp_ntz, depth double, water_temp double, total_conc double")
    write_standard(rows, str(tmp_path / "s"))
    back = read_standard(spark, str(tmp_path / "s"))
    wide = profile_table(back, (0.1,), measures={"conc": "total_conc"}, weather=())
    assert [r.conc_0_1 for r in wide.collect()] == [3.0]


def test_nan_is_skipped_by_means(spark):
    from limnoscope.functions.columns import coerce_double
    from limnoscope.operators.grid import cell_means, day_means

    nan = float("nan")
    rows = spark.createDataFrame([("1", T0, 0.5, nan), ("1", T0, 0.5, 4.0), ("1", T0, 1.0, nan)],
                                 "site_id string, timestamp timestamp_ntz, depth double, total_conc double")
    for means in (cell_means, day_means):
        got = {r.depth: r.total_conc for r in means(rows, ["total_conc"]).collect()}
        assert got == {0.5: 4.0, 1.0: None}
    assert spark.createDataFrame([("NaN",), ("2",)], "x string").select(coerce_double("x").alias("x")).collect() == [(None,), (2.0,)]


def test_forms_of_time(spark):
    from limnoscope.functions.columns import coerce_timestamp
    from limnoscope.operators.ingest import unreadable_times

    rows = spark.createDataFrame([("2022-01-01 00:05:00",), ("2022/1/1 0:05",), ("2022/01/01 00:05:00",), (" 2022-1-1 0:5 ",), ("2022/1/1",),
                                  ("2022-01-01T00:05:00",), ("soon",), (None,)], "timestamp string")
    got = [r.t for r in rows.select(coerce_timestamp("timestamp").alias("t")).collect()]
    five = dt.datetime(2022, 1, 1, 0, 5)
    assert got == [five, five, five, five, T0, five, None, None]
    assert tuple(unreadable_times(rows).first()) == (8, 1)


def test_train_statistics_do_not_depend_on_partitioning(spark):
    rows = [("1", T0 + dt.timedelta(hours=3 * (k // 6)), 0.5, float(k * 7 % 11)) for k in range(20)]
    frame = spark.createDataFrame(rows, "site_id string, timestamp timestamp_ntz, depth double, total_conc double")
    got = [norm_stats(frame.repartition(n, "total_conc"), ["total_conc"]).first() for n in (1, 3, 7)]
    assert len({(round(r["mean"], 9), round(r["std"], 9), r["n"]) for r in got}) == 1


def test_observations_events_and_statistics_files(spark, tmp_path):
    from limnoscope.sources.raw import read_events, read_observations
    from limnoscope.sources.tables import read_stats, write_metrics, write_stats

    (tmp_path / "o.csv").write_text("site_id,datetime,variable,observation\n0902,2022-01-02 00:00:00,temp,4.5\n0902,2022-01-01 00:00:00,temp,\n")
    got = read_observations(spark, str(tmp_path / "o.csv"), sort=True).collect()
    assert [(r.site_id, r.datetime, r.observation) for r in got] == [("0902", T0, None), ("0902", T0 + dt.timedelta(days=1), 4.5)]
    (tmp_path / "e.json").write_text('{"site_id": "1", "start": "2023-02-01", "end": "2023-02-03"}\n{"site_id": "1", "start": "2023-01-01", "end": "2023-01-02"}\n')
    assert [(r.event_id, str(r.start)) for r in read_events(spark, str(tmp_path / "e.json")).collect()] == [(1, "2023-01-01"), (2, "2023-02-01")]
    stats = spark.createDataFrame([("0902", "temp", 1.5, 0.5, 7)], "site_id string, variable string, mean double, std double, n long")
    write_stats(stats, str(tmp_path / "stats"))
    assert read_stats(spark, str(tmp_path / "stats")).collect() == stats.collect()
    write_metrics(stats, str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).count() == 1
