"""What the operators of this subpackage share: Arrow batches, stored tables, rows that are held out."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mossgrove.sources.scratch import drop, store
from mossgrove.sources.spread import spread

#: ``[^\x20\x09-\x0D]+``: what a word is in every contract of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"
BATCH_BYTES = 16 << 20
_ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package and bounds the bytes of an Arrow batch."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH", "")]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """``make()`` runs once a task and gives a function from a batch's columns to those of ``schema``."""
    prepare(df.sparkSession)
    target = df.sparkSession.createDataFrame([], schema).schema
    arrow = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in target])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            out = work({k: batch.column(i) for i, k in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
    "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()),
    "array<float>": pa.list_(pa.float32()),
}


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def texts_of(column: pa.Array) -> list[str]:
    """A text column's values; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def held_out(doc_id: Column) -> Column:
    """Rows that no model here learns from: crc32 of the id as text, modulo 4, is 2. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Ids up to so many (8 bytes each) are sent to every executor; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def counted(small: DataFrame) -> DataFrame:
    """``small``, written once, and marked for broadcast if its counted rows are few enough."""
    kept = store(small, "ids")
    return F.broadcast(kept) if kept.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else kept


#: Over so many tasks the rows of one key are dealt where a key may hold a large part of all rows.
SALTS = 8


def salted(many: DataFrame, one: DataFrame, key: list[str], by: str) -> DataFrame:
    """The inner join of ``many`` with ``one``, which has a row a key; a key's rows in ``many`` are dealt out by ``by``."""
    left = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*key, "_salt"]).drop("_salt")


def with_text(docs: DataFrame, column: str, change: Callable[[], Callable[[pa.Array], tuple[pa.Array, pa.Array | None]]]) -> DataFrame:
    """``docs`` with all its columns, ``column`` changed and rows filtered by what ``change()`` gives for a batch."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = change()
        for batch in batches:
            k = batch.schema.get_field_index(column)
            values, rows = work(batch.column(k))
            batch = batch.set_column(k, batch.schema.field(k), values)
            yield batch if rows is None else batch.filter(rows)

    return docs.mapInArrow(run, docs.schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
