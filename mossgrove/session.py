"""Spark sessions as this engine wants them."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parents[1])


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. Partitions are left to Spark unless given."""
    b = SparkSession.builder.appName("mossgrove").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.master(master) if master else b
    b = b.config("spark.sql.shuffle.partitions", str(partitions)) if partitions else b
    return b.config(map=conf).getOrCreate() if conf else b.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH", "")]))
