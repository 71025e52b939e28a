"""The queries that apply this subpackage's operators to whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mossgrove.llm import codes, lexical, linktrust, mixing, neighbours, packing, pii, quality, rules, secrets, simhash, toxicity, warc
from mossgrove.llm.common import prepare, read


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`: fingerprint and component of near-duplicates."""
    return simhash.near_duplicates(read(prepare(spark), sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every 50th row of `embeddings` among all others."""
    return neighbours.nearest(read(prepare(spark), sf_dir, "embeddings"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of `documents`, learned from `labels.quality`."""
    return quality.classify(read(prepare(spark), sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of `documents`, learned from `labels.toxic`."""
    return toxicity.classify(read(prepare(spark), sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, score and verdict of every whole text of `documents`."""
    return rules.judge(read(prepare(spark), sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of `documents`."""
    return secrets.find(read(prepare(spark), sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of `documents`."""
    return pii.find(read(prepare(spark), sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every url of `pages`."""
    return linktrust.judge(read(prepare(spark), sf_dir, "pages"))


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` mixed to the sources' target weights."""
    return mixing.mix(read(prepare(spark), sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`, packed into sequences of at most 1024 tokens."""
    return packing.pack(read(prepare(spark), sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code of 16 bytes for each vector of `embeddings`."""
    return codes.codes(read(prepare(spark), sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all `documents` for each item of `benchmark`."""
    return lexical.search(read(prepare(spark), sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for each of `pages`, written and read back."""
    return warc.round_trip(read(prepare(spark), sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_secret_scans": op6_secret_scans,
    "op7_pii": op7_pii,
    "op8_url_filters": op8_url_filters,
    "op9_mixing_sources": op9_mixing_sources,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_vector_codes": op11_vector_codes,
    "op12_lexical_search": op12_lexical_search,
    "op13_warc": op13_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op8_url_filters": linktrust.ORACLE,
    "op9_mixing_sources": mixing.ORACLE,
    "op11_vector_codes": codes.ORACLE,
    "op12_lexical_search": lexical.ORACLE,
    "op13_warc": warc.ORACLE,
}
