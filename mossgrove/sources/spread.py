"""Inputs of few splits dealt out over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """The rows of ``scan``, an unchanged read of files, over a partition for each core at least.

    Files of few row groups are read by as few tasks, however many cores there are; then rows are dealt out. A read of as
    many tasks as there are cores, or more, is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
