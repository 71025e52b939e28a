"""Identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def task_id(kind: Column, path: Column, queued_at: Column) -> Column:
    return F.left(F.sha2(F.concat_ws(":", kind, path, queued_at), 256), F.lit(12))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(source: Column, start: Column, end: Column, digest: Column, model: str) -> Column:
    return F.left(F.sha2(F.concat_ws(":", source, start.cast("string"), end.cast("string"), digest, F.lit(model)), 256), F.lit(16))
