"""Raw feed readers: buoy text, tide-gauge JSON and CSV, earthquake GeoJSON, stream envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import canonical_json, coops_source_id, dart_source_id, event_version, payload_hash, seismic_source_id
from ..functions.values import is_reading, safe_float
from ..schemas import COOPS_PAYLOAD, HEIGHT_SENTINEL, SEISMIC_PAYLOAD

MISSING_MARK = "MM"
MIN_FIELDS = 8
MIN_STATION_ROWS = 10


def _whole(text: Column) -> Column:
    """An integer written as one, else null."""
    return F.when(text.rlike("^[+-]?[0-9]{1,9}$"), text.try_cast("int"))


def parse_dart_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Typed buoy rows with a `reason` for each line that is not a reading.

    reason is null for a reading, `blank` for blanks and comments, `missing` for
    marked or sentinel values, `skipped` for anything that cannot be read.
    """
    text = F.regexp_replace(F.col(line), r"^\s+|\s+$", "")
    rows = lines.withColumn("_line", text).withColumn("_f", F.split("_line", r"\s+"))
    # The seven whole numbers are read once per line; everything else refers to them.
    rows = rows.withColumn("_n", F.transform(F.slice("_f", 1, 7), _whole)).withColumn("_height", F.try_element_at("_f", F.lit(8)).try_cast("double"))
    number = [F.try_element_at("_n", F.lit(i)) for i in range(1, 8)]
    year = F.when(number[0] < 100, number[0] + 2000).otherwise(number[0])
    parsed = rows.withColumn("_kind", number[6]).withColumn(
        "_ts", F.try_make_timestamp(year, *number[1:5], number[5].cast("decimal(16,6)"))
    )
    marked = F.exists(F.slice("_f", 1, MIN_FIELDS), lambda x: F.upper(x) == MISSING_MARK)
    reason = (
        F.when((F.col("_line") == "") | F.col("_line").startswith("#"), "blank")
        .when(F.size("_f") < MIN_FIELDS, "skipped")
        .when(marked, "missing")
        .when(F.exists("_n", lambda x: x.isNull()) | F.col("_height").isNull(), "skipped")
        .when(~F.col("_kind").isin(1, 2, 3), "skipped")
        .when(F.isnan("_height") | (F.abs("_height") == float("inf")) | (F.col("_height") >= HEIGHT_SENTINEL), "missing")
        .when(F.col("_ts").isNull() | (number[5] > 59), "skipped")
    )
    # One generated struct per line: a later filter on the reason stays above it and
    # does not drag copies of the parsing expressions down to the scan.
    read = reason.isNull()
    found = F.struct(
        reason.alias("reason"),
        F.when(read, F.col("_ts")).alias("ts"),
        F.when(read, F.col("_kind")).alias("measurement_type"),
        F.when(read, F.col("_height")).alias("height_m"),
    )
    return parsed.select(*[c for c in lines.columns if c != line], F.col("_line").alias("raw_line"), F.inline(F.array(found)))


def dart_records(parsed: DataFrame) -> DataFrame:
    """Readings as records with identity, mode and payload hash (`station_id` present)."""
    good = parsed.where(F.col("reason").isNull())
    return good.select(
        dart_source_id(F.col("station_id"), F.col("ts"), F.col("measurement_type")).alias("source_id"),
        "station_id",
        "ts",
        "measurement_type",
        "height_m",
        F.col("measurement_type").isin(2, 3).alias("event_mode"),
        payload_hash(F.col("raw_line")).alias("payload_hash"),
    )


def read_dart_text(spark: SparkSession, path: str) -> DataFrame:
    """Buoy files named <station>....; `seq` follows the order of lines within a file.

    A line's place is the start of its block in the file and its number in the block,
    so it does not depend on how the cluster deals blocks to tasks.
    """
    in_block = Window.partitionBy("_file", "_block")
    lines = spark.read.text(path).select(
        "value",
        F.regexp_extract(F.col("_metadata.file_name"), r"([0-9]{5})", 1).alias("station_id"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    placed = lines.withColumn("seq", F.shiftleft(F.col("_block"), 22) + F.col("_id") - F.min("_id").over(in_block))
    return parse_dart_lines(placed.drop("_file", "_block", "_id"))


def reason_counts(parsed: DataFrame, keys: list[str]) -> DataFrame:
    return parsed.groupBy(*keys).agg(
        F.count_if(F.col("reason").isNull()).alias("n_read"),
        F.count_if(F.col("reason") == "skipped").alias("n_skipped"),
        F.count_if(F.col("reason") == "missing").alias("n_missing"),
    )


def _minute(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm"))


def parse_coops_payloads(payloads: DataFrame, payload: str = "value") -> DataFrame:
    """Gauge rows out of JSON payloads; a payload with an error gives no rows.

    `payloads` also carries `station_id` and `product`.
    """
    body = F.from_json(F.col(payload), COOPS_PAYLOAD)
    rows = payloads.select(*[c for c in payloads.columns if c != payload], body.alias("_p")).where(
        F.col("_p").isNotNull() & F.col("_p.error").isNull()
    )
    each = rows.select("*", F.col("_p.metadata.name").alias("station_name"), F.explode("_p.data").alias("_d")).drop("_p")
    return _gauge_rows(each, [c for c in each.columns if c != "_d"], F.col("_d.t"), F.col("_d.v"), F.col("_d.f"), F.col("_d.q"))


def _gauge_rows(rows: DataFrame, keep: list[str], t: Column, v: Column, f: Column, q: Column) -> DataFrame:
    at = _minute(t)
    out = rows.withColumn("ts", at).where(F.col("ts").isNotNull())
    return out.select(
        *keep,
        coops_source_id(F.col("station_id"), F.col("product"), F.col("ts")).alias("source_id"),
        "ts",
        safe_float(v).alias("water_level_m"),
        F.coalesce(f, F.lit("")).alias("flags"),
        F.coalesce(q, F.lit("")).alias("quality"),
        payload_hash(canonical_json(t=t, v=v, f=f, q=q)).alias("payload_hash"),
    )


def read_coops_json(spark: SparkSession, path: str, product: str) -> DataFrame:
    """One payload per file; the station comes from the file name."""
    files = spark.read.text(path, wholetext=True).select(
        "value", F.regexp_extract(F.col("_metadata.file_name"), r"([0-9]{7})", 1).alias("station_id"), F.lit(product).alias("product")
    )
    return parse_coops_payloads(files)


def read_coops_csv(spark: SparkSession, path: str, product: str) -> DataFrame:
    """Gauge CSV with header t,v,s,f,q."""
    rows = spark.read.csv(path, header=True, schema="t string, v string, s string, f string, q string").select(
        "*", F.regexp_extract(F.col("_metadata.file_name"), r"([0-9]{7})", 1).alias("station_id"), F.lit(product).alias("product")
    )
    return _gauge_rows(rows, ["station_id", "product"], F.col("t"), F.col("v"), F.col("f"), F.col("q"))


def parse_seismic_payloads(payloads: DataFrame, payload: str = "value") -> DataFrame:
    """Earthquake rows out of GeoJSON collections; rows without id or time are dropped."""
    body = F.from_json(F.col(payload), SEISMIC_PAYLOAD)
    each = payloads.select(*[c for c in payloads.columns if c != payload], F.explode(body["features"]).alias("f"))
    p, xyz = F.col("f.properties"), F.col("f.geometry.coordinates")
    place = [F.when(F.size(xyz) >= 3, F.try_element_at(xyz, F.lit(i))) for i in (1, 2, 3)]
    found = each.where(F.col("f.id").isNotNull() & p["time"].isNotNull())
    at, updated = F.timestamp_millis(p["time"]), F.timestamp_millis(p["updated"])
    return found.select(
        *[c for c in each.columns if c != "f"],
        seismic_source_id(F.col("f.id"), F.coalesce(updated, at)).alias("source_id"),
        F.col("f.id").alias("event_id"),
        at.alias("ts"),
        updated.alias("updated_ts"),
        p["mag"].alias("magnitude"),
        F.coalesce(p["place"], F.lit("")).alias("place"),
        F.coalesce(p["type"], F.lit("")).alias("event_type"),
        p["tsunami"].alias("tsunami_flag"),
        place[0].alias("lon"),
        place[1].alias("lat"),
        place[2].alias("depth_km"),
        event_version(p["mag"], p["time"], p["updated"], p["tsunami"], p["place"], p["type"], *place).alias("version"),
    )


def read_seismic_geojson(spark: SparkSession, path: str) -> DataFrame:
    return parse_seismic_payloads(spark.read.text(path, wholetext=True))


def clean_station_rows(rows: DataFrame) -> DataFrame:
    """Event or calibration CSV rows as a series: readable, finite, below the sentinel, ten rows or more.

    `rows` has text columns station_id, timestamp_utc, height_m and file_name;
    times without an offset are UTC.
    """
    named = F.when(F.coalesce(F.col("station_id"), F.lit("")) != "", F.col("station_id")).otherwise(
        F.regexp_extract("file_name", r"dart_([0-9]+)_", 1)
    )
    good = rows.select(
        named.alias("station_id"), F.col("timestamp_utc").try_cast("timestamp").alias("ts"), safe_float(F.col("height_m")).alias("height_m")
    ).where(F.col("ts").isNotNull() & is_reading(F.col("height_m")))
    enough = good.groupBy("station_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MIN_STATION_ROWS)
    return good.join(enough.select("station_id"), "station_id", "left_semi")


def read_station_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = "station_id string, timestamp_utc string, seconds_from_origin string, height_m string"
    rows = spark.read.csv(path, header=True, schema=schema)
    return clean_station_rows(rows.select("*", F.col("_metadata.file_name").alias("file_name")))


def decode_envelopes(messages: DataFrame) -> DataFrame:
    """Kafka-shaped rows with `status` ok or rejected, the source type and the record as JSON.

    Rejected rows keep their coordinates, so offsets stay complete; the record of
    an envelope is unwrapped, a bare object is its own record.
    """
    text = F.col("value").cast("string")
    readable = F.when(F.is_valid_utf8(text), text)
    parsed = F.try_parse_json(readable)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    record = F.coalesce(F.get_json_object(readable, "$.record"), readable)
    return messages.select(
        "topic",
        "partition",
        "offset",
        F.when(is_object, "ok").otherwise("rejected").alias("status"),
        F.when(is_object, F.get_json_object(readable, "$.source_type")).alias("source_type"),
        F.when(is_object, record).alias("record"),
    )
