"""From raw documents to packed sequences: five operators of mossgrove.llm, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mossgrove.llm import mixing, packing, pii, quality, simhash
from mossgrove.llm.common import drop, prepare, read, store


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that boosted trees over their statistics, learned from `labels`, do not reject."""
    return quality.keep(docs, read(prepare(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of SimHash near-duplicates."""
    return simhash.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked, and n_chars to match."""
    out = pii.mask(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: Trees and fingerprints are beyond SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over whole `documents`; each stage's result is written and read again, and dropped once the next is written."""
    docs = read(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        then = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(docs)
        docs = then
    return STAGES[-1][1](spark, docs, sf_dir)
