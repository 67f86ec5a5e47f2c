"""Column contracts and the fixed values the operators share."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: raw header -> column name -------------------------------
HEADER_NAMES = {
    "站点编号": "site_id",
    "测量时间": "timestamp",
    "深度": "depth",
    "水温": "water_temp",
    "透光率": "transmittance",
    "绿藻浓度": "green_conc",
    "蓝藻浓度": "cyano_conc",
    "硅藻浓度": "diatom_conc",
    "隐藻浓度": "crypto_conc",
    "总浓度": "total_conc",
    "黄色物质": "cdom",
    "绿藻细胞数": "green_cells",
    "蓝藻细胞数": "cyano_cells",
    "硅藻细胞数": "diatom_cells",
    "隐藻细胞数": "crypto_cells",
    "总细胞数": "total_cells",
    "风速": "wind_speed",
    "风向": "wind_dir",
    "压力": "pressure",
    "温度": "air_temp",
    "湿度": "humidity",
    "降雨量": "rainfall",
}

# --- fixed values: measures, bands, thresholds -----------------------------
WATER_MEASURES = (
    "water_temp", "transmittance", "green_conc", "cyano_conc", "diatom_conc",
    "crypto_conc", "total_conc", "cdom", "green_cells", "cyano_cells",
    "diatom_cells", "crypto_cells", "total_cells",
)
WEATHER_MEASURES = ("wind_speed", "wind_dir", "pressure", "air_temp", "humidity", "rainfall")
NUMERIC_COLUMNS = ("depth", *WATER_MEASURES, *WEATHER_MEASURES)

DEPTHS = tuple(0.5 * i for i in range(1, 21))
TOP_BAND = (0.5, 3.0)
LINK_BAND = (0.5, 5.0)
RECOMMENDED_DEPTHS = (1.5, 5.0, 8.5, 9.5, 10.0)
TARGET_DEPTH = 0.5
BLOOM_MIN_DAYS = 2
BLOOM_GAP_DAYS = 1
QUANTILE_LEVELS = (0.05, 0.10, 0.20, 0.35, 0.50, 0.65, 0.80, 0.90, 0.95)
WARNING_CUTS = (0.75, 0.90, 0.97)

# --- fixed values: rolling-origin protocol ----------------------------------
TRAIN_DAYS, TEST_DAYS, STRIDE_DAYS = 730, 90, 45
# Windows of the published protocol; operators take as many as a station's days hold.
N_WINDOWS = 17
LOOK_BACK, HORIZON = 30, 7

# The small epsilon added to every fitted scale.
EPS = 1e-8

KEYS = ("site_id",)

READINGS = T.StructType(
    [T.StructField("site_id", T.StringType()), T.StructField("timestamp", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in ("depth", *WATER_MEASURES)]
)
WEATHER = T.StructType(
    [T.StructField("site_id", T.StringType()), T.StructField("timestamp", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in WEATHER_MEASURES]
)
OBSERVATIONS = T.StructType([
    T.StructField("site_id", T.StringType()),
    T.StructField("datetime", T.TimestampNTZType()),
    T.StructField("variable", T.StringType()),
    T.StructField("observation", T.DoubleType()),
])
EVENTS = T.StructType([
    T.StructField("site_id", T.StringType()),
    T.StructField("start", T.DateType()),
    T.StructField("end", T.DateType()),
])


def depth_column(prefix: str, depth: float) -> str:
    """Name of a per-depth column of a wide table: ``temp_0_5`` for 0.5 m."""
    return f"{prefix}_{float(depth):g}".replace(".", "_")
