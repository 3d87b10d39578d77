"""Readers on files, idempotent sinks, and the ingest stream with a redelivered batch."""

import json

from pyspark.sql import functions as F

from tidelattice.functions.hashing import is_sha256
from tidelattice.schemas import KAFKA
from tidelattice.sources import feeds, sinks
from tidelattice.streaming import jobs


def test_dart_text(spark, tmp_path):
    (tmp_path / "21413.dart").write_text(
        "#YY MM DD hh mm ss T HEIGHT\n\n2024 01 02 03 04 05 1 5000.25\n24 01 02 03 04 05 2 5000.5\n2024 01 02 03 04\n"
        "2024 01 02 MM 04 05 1 5000\n2024 02 30 00 00 00 1 5000\n2024 01 02 03 04 05 4 5000\n2024 01 02 03 04 05 1 9999.0\n"
        "2024 01 02 03 04 60 1 5000\n2024 01 02 03 04 05 1 nan\n2024 01 02 03 04 05 1 high\n"
    )
    parsed = feeds.read_dart_text(spark, str(tmp_path))
    counts = feeds.reason_counts(parsed, ["station_id"]).first()
    assert (counts["station_id"], counts["n_read"], counts["n_skipped"], counts["n_missing"]) == ("21413", 2, 5, 3)
    rows = feeds.dart_records(parsed).orderBy("measurement_type").collect()
    assert rows[0]["source_id"] == "dart:21413:20240102030405:1" and not rows[0]["event_mode"]
    assert rows[1]["ts"].year == 2024 and rows[1]["event_mode"] and len(rows[1]["payload_hash"]) == 64


def test_coops(spark, tmp_path):
    good = {"metadata": {"id": "1612340", "name": "Honolulu"}, "data": [
        {"t": "2024-01-01 00:00", "v": "0.5", "s": "0", "f": "0,0,0,0", "q": "p"}, {"t": "2024-01-01 00:06", "v": ""},
        {"t": "2024-01-01 00:12", "v": "nan"}, {"t": "soon", "v": "1"}]}
    (tmp_path / "coops_1612340.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "coops_1611400.json").write_text('{"error": {"message": "No data was found"}}')
    rows = feeds.read_coops_json(spark, str(tmp_path), "water_level").orderBy("ts").collect()
    assert [r["water_level_m"] for r in rows] == [0.5, None, None]
    assert rows[0]["source_id"] == "coops:1612340:water_level:202401010000" and rows[0]["station_name"] == "Honolulu"
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "coops_1612340.csv").write_text('t,v,s,f,q\n2024-01-01 00:00,0.25,0.1,"0,0,0,0",p\n2024-01-01 00:06,,,,\n')
    rows = feeds.read_coops_csv(spark, str(folder), "water_level").orderBy("ts").collect()
    assert [(r["water_level_m"], r["flags"]) for r in rows] == [(0.25, "0,0,0,0"), (None, "")]


def test_seismic(spark, tmp_path):
    feature = {"type": "Feature", "id": "us1", "properties": {"mag": 7.1, "place": "x", "time": 1704067200123, "updated": 1704067260000, "tsunami": 1, "type": "earthquake"},
               "geometry": {"type": "Point", "coordinates": [142.4, 38.3, 29.0]}}
    flat = {**feature, "id": "us2", "geometry": {"coordinates": [1.0, 2.0]}}
    lost = {**feature, "id": None}
    (tmp_path / "q.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, flat, lost]}))
    rows = feeds.read_seismic_geojson(spark, str(tmp_path)).orderBy("event_id").collect()
    assert [r["event_id"] for r in rows] == ["us1", "us2"]
    assert (rows[0]["lon"], rows[0]["lat"], rows[0]["depth_km"]) == (142.4, 38.3, 29.0) and rows[1]["lat"] is None
    assert rows[0]["source_id"] == "seismic:us1:20240101000100000000" and rows[0]["version"] != rows[1]["version"]


def test_station_csv(spark, tmp_path):
    lines = ["station_id,timestamp_utc,seconds_from_origin,height_m"]
    lines += [f",2024-01-01T00:{i:02d}:00+00:00,{i},{5000 + i}" for i in range(12)] + [",2024-01-01 01:00:00,1,9999.0", ",never,1,1"]
    (tmp_path / "dart_21413_event.csv").write_text("\n".join(lines))
    (tmp_path / "dart_21414_event.csv").write_text("\n".join(lines[:6]))
    rows = feeds.read_station_csv(spark, str(tmp_path)).groupBy("station_id").count().collect()
    assert [(r["station_id"], r["count"]) for r in rows] == [("21413", 12)]


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "obs")
    rows = spark.range(100).select(
        F.col("id").alias("seq"), F.lit("21413").alias("station_id"), F.timestamp_seconds(F.col("id") * 5000).alias("ts"), F.sha2(F.col("id").cast("string"), 256).alias("payload_hash")
    )
    twice = rows.unionByName(rows.withColumn("seq", F.col("seq") + 1000))
    assert sinks.append_observations(twice.where("seq % 1000 < 60"), path) == 60
    assert sinks.append_observations(twice, path) == 40
    assert sinks.append_observations(rows, path) == 0
    stored = spark.read.parquet(path)
    assert stored.count() == 100 and stored.agg(F.max("seq")).first()[0] == 99
    archive = str(tmp_path / "archive")
    texts = spark.createDataFrame([("a",), ("b",), ("a",)], "payload string")
    assert sinks.archive_payloads(texts, archive) == 2 and sinks.archive_payloads(texts, archive) == 0
    assert sinks.append_assessments(spark.createDataFrame([(1, 1, 5), (1, 1, 4), (2, 1, 1)], "checkpoint_id int, schema_version int, produced_us int"), str(tmp_path / "a")) == 2


def test_ingest_stream(spark, tmp_path):
    def message(i, text):
        return (None, text, "raw", 0, i)

    good = [json.dumps({"source_type": "dart", "record": {"station_id": "21413", "ts": f"2024-01-01T00:0{i}:00Z", "height_m": 5000.0 + i, "payload_hash": f"{i:064x}"}}).encode() for i in range(5)]
    bad = [b"\xc3\x28", b"[1]", None, json.dumps({"record": {"station_id": "x", "ts": "2024-01-01T00:00:00Z", "height_m": 1.0, "payload_hash": "y"}}).encode()]
    folder = str(tmp_path / "topic")
    first = [message(i, t) for i, t in enumerate(good + bad)]
    spark.createDataFrame(first, KAFKA).coalesce(1).write.mode("append").parquet(folder)
    # The same readings again under new offsets.
    spark.createDataFrame([message(100 + i, t) for i, t in enumerate(good)], KAFKA).coalesce(1).write.mode("append").parquet(folder)
    record = "station_id string, ts timestamp, height_m double, payload_hash string"
    schema = spark.createDataFrame([], record).schema

    def rules():
        return {"station_id format": F.col("station_id").rlike("^[0-9]{5}$"), "payload_hash format": is_sha256(F.col("payload_hash"))}

    source = spark.readStream.schema(KAFKA).option("maxFilesPerTrigger", 1).parquet(folder)
    table, quarantine = str(tmp_path / "table"), str(tmp_path / "quarantine")
    jobs.ingest(source, schema, rules, table, quarantine, str(tmp_path / "ckpt"), seconds=None).awaitTermination()
    assert spark.read.parquet(table).count() == 5
    assert spark.read.parquet(f"{quarantine}/messages").count() == 3
    held = spark.read.parquet(f"{quarantine}/records").collect()
    assert [r["reason_detail"] for r in held] == ["station_id format; payload_hash format"]


def test_line_order_does_not_depend_on_how_blocks_are_dealt(spark, tmp_path):
    lines = [f"2024 01 {1 + i // 1440:02d} {i // 60 % 24:02d} {i % 60:02d} 00 1 {5000 + i % 7}.0" for i in range(4000)]
    (tmp_path / "21413t2024.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    orders = []
    try:
        for size in ("16k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = feeds.read_dart_text(spark, str(tmp_path)).orderBy("seq").select("ts", "height_m").collect()
            assert len(got) == 4000 and [r.ts for r in got] == sorted(r.ts for r in got)
            orders.append(got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert orders[0] == orders[1]
