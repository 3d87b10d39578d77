"""Table schemas and the fixed values every module shares."""

from __future__ import annotations

from pyspark.sql import types as T

# Feed, quality, detector and alert constants.
HEIGHT_SENTINEL = 9999.0
DART_INTERVAL_SEC = {1: 900, 2: 60, 3: 15}
COOPS_INTERVAL_SEC = {"one_minute_water_level": 60, "water_level": 360}
TIMING_GAP_FACTOR = 2.0
FLAT_LINE_WINDOW_SEC = 3600
DART_QC = {"spike_m": 0.1, "spike_window_sec": 15, "rate_m_per_sec": 0.001, "flat_m": 0.0001}
COOPS_QC = {"spike_m": 0.3, "spike_window_sec": 60, "rate_m_per_sec": 0.005, "flat_m": 0.001}
COOPS_RANGE_M = 3.0
COOPS_RANGE_SUSPECT_M = 4.5
USABLE_CONFIDENCE = 0.5
T1, T2, T3 = 0.35, 0.60, 0.85
TRIGGER_MAGNITUDE = 6.0
ESCALATION_MAGNITUDE = 7.5
ESCALATION_DEPTH_KM = 100.0
MONITOR_TIMEOUT_HOURS = 12
WINDOW_HOURS = 6
WINDOW_MIN_SAMPLES = 10
FUTURE_TOLERANCE_SEC = 900
QUIET_MAGNITUDE = 6.5
QUIET_LOOKBACK_MIN = 90
QUIET_FACTOR = 1.3
TSUNAMI_SPEED_KM_S = 0.198
RAYLEIGH_SPEED_KM_S = 3.6
RAYLEIGH_MAX_KM = 3000.0
RAYLEIGH_MIN_TRAVEL_SEC = 10.0
RAYLEIGH_TOLERANCE = 0.20
COHERENCE_TOLERANCE = 0.20
COHERENCE_FLOOR_SEC = 5.0
COHERENCE_MIN_STATIONS = 2
EARTH_RADIUS_KM = 6371.0
DETECT_THRESHOLD_M = {"dart": 0.03, "coops": 0.15}
WEIGHT_THRESHOLD, WEIGHT_STATISTICAL, WEIGHT_ML = 0.50, 0.35, 0.15
HAMPEL_HALF = 3
HAMPEL_SIGMAS = 3.0
MAD_SCALE = 1.4826
GAP_FACTOR = 6.0
LEVEL_SAMPLES = 5
CADENCE_IRREGULAR_FACTOR = 3.0
MAX_INPUT_REFS = 1000
CALIBRATION_ADEQUATE_MIN = 4320.0
SOURCE_RADIUS_KM = 500.0
MAX_SOURCES = 15

SECOND_US = 1_000_000
HOUR_US = 3600 * SECOND_US
DAY_US = 24 * HOUR_US

DART = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("station_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("ingest_ts", T.TimestampType()),
        T.StructField("measurement_type", T.IntegerType()),
        T.StructField("height_m", T.DoubleType()),
        T.StructField("event_mode", T.BooleanType()),
        T.StructField("payload_hash", T.StringType()),
    ]
)

COOPS_PAYLOAD = T.StructType(
    [
        T.StructField("error", T.StructType([T.StructField("message", T.StringType())])),
        T.StructField(
            "metadata",
            T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())]),
        ),
        T.StructField(
            "data",
            T.ArrayType(
                T.StructType([T.StructField(n, T.StringType()) for n in ("t", "v", "s", "f", "q")])
            ),
        ),
    ]
)

SEISMIC_PAYLOAD = T.StructType(
    [
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField(
                            "properties",
                            T.StructType(
                                [
                                    T.StructField("mag", T.DoubleType()),
                                    T.StructField("place", T.StringType()),
                                    T.StructField("time", T.LongType()),
                                    T.StructField("updated", T.LongType()),
                                    T.StructField("tsunami", T.IntegerType()),
                                    T.StructField("type", T.StringType()),
                                ]
                            ),
                        ),
                        T.StructField(
                            "geometry",
                            T.StructType([T.StructField("coordinates", T.ArrayType(T.DoubleType()))]),
                        ),
                    ]
                )
            ),
        )
    ]
)

KAFKA = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)
