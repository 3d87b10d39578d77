"""Content hashes and record identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHA256_PATTERN = "^[0-9a-f]{64}$"


def payload_hash(raw: Column) -> Column:
    return F.sha2(raw, 256)


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike(SHA256_PATTERN), F.lit(False))


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys; nulls are written, not dropped."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def dart_source_id(station: Column, ts: Column, kind: Column) -> Column:
    return F.concat_ws(":", F.lit("dart"), station, F.date_format(ts, "yyyyMMddHHmmss"), kind.cast("string"))


def coops_source_id(station: Column, product: Column, ts: Column) -> Column:
    return F.concat_ws(":", F.lit("coops"), station, product, F.date_format(ts, "yyyyMMddHHmm"))


def seismic_source_id(event: Column, ts: Column) -> Column:
    return F.concat_ws(":", F.lit("seismic"), event, F.date_format(ts, "yyyyMMddHHmmssSSSSSS"))


def event_version(magnitude: Column, time: Column, updated: Column, tsunami: Column, place: Column, kind: Column, lon: Column, lat: Column, depth: Column) -> Column:
    """Fingerprint of everything a revision of one earthquake may change."""
    return F.sha2(
        canonical_json(
            magnitude=magnitude, time=time, updated=updated, tsunami=tsunami, place=place, kind=kind, lon=lon, lat=lat, depth=depth
        ),
        256,
    )
