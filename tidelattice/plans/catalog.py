"""All registered queries."""

from __future__ import annotations

from . import Query, context, detect, evaluation, hygiene, ingest, inversion, lineage, quality, streams, text

MODULES = (ingest, quality, hygiene, context, detect, evaluation, lineage, inversion, text, streams)


def all_queries() -> dict[str, Query]:
    return {name: build for m in MODULES for name, build in m.C.queries.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.C.sql.items()}
