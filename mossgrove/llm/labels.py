"""Labelled rows for the classifiers: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossgrove.llm.common import held_out


def sample(labels: DataFrame, column: str, most: int) -> DataFrame:
    """id and label (0 or 1) of at most ``most`` labelled rows that aren't held out.

    The rows are those least by a hash of the id, so the sample is even and the same on each run. An id that
    is labelled twice has its larger label; rows without an id or a label don't count.
    """
    rows = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col(column).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    rows = rows.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(most)
