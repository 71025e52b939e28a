"""Encrypted entries: AES-GCM under a key that is never in the data, read only with consent."""

from __future__ import annotations

import secrets
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossgrove.functions.text import scrub


@dataclass(frozen=True)
class Consent:
    """A right to read one vault, good for that vault object only."""

    token: str
    reason: str


class Vault:
    """Writes and reads encrypted rows. The key comes from the caller's secret store."""

    def __init__(self, key: bytes):
        if len(key) not in (16, 24, 32):
            raise ValueError("the key must have 16, 24 or 32 bytes")
        self._key, self._token = key, secrets.token_hex(16)

    def consent(self, reason: str) -> Consent:
        return Consent(self._token, reason)

    def write(self, rows: DataFrame) -> DataFrame:
        """path and ciphertext of rows (entity, day, pos, content): one file each, counted by entity and day."""
        n = F.row_number().over(Window.partitionBy("entity", "day").orderBy("pos"))
        path = F.concat("entity", F.lit("/"), F.date_format("day", "yyyy-MM-dd"), F.lit("-"), F.format_string("%03d", n), F.lit(".md.enc"))
        sealed = F.base64(F.aes_encrypt(F.col("content").cast("binary"), F.lit(self._key), F.lit("GCM")))
        return rows.select(path.alias("path"), "entity", sealed.alias("ciphertext"))

    def read(self, rows: DataFrame, consent: Consent) -> DataFrame:
        """``rows`` with their content; null where the key or the text is wrong. Needs this vault's consent."""
        if not isinstance(consent, Consent) or not secrets.compare_digest(consent.token, self._token):
            raise PermissionError("reading needs a consent issued by this vault")
        opened = F.try_aes_decrypt(F.unbase64("ciphertext"), F.lit(self._key), F.lit("GCM")).cast("string")
        return rows.withColumn("content", opened)


def listing(paths: DataFrame) -> DataFrame:
    """Sorted paths of ciphertext files; nothing is decrypted."""
    return paths.where(F.col("path").endswith(".md.enc")).select("path").orderBy("path")


def failures(read: DataFrame, at: Column, session: str) -> DataFrame:
    """Audit rows for what could not be read: tabs and line ends are blanks, a missing value is a hyphen."""
    field = lambda c: F.coalesce(scrub(c), F.lit("-"))
    return read.where("content IS NULL").select(at.cast("string").alias("timestamp"), F.lit("read").alias("operation"), field(F.col("path")).alias("path"), field(F.col("entity")).alias("entity"), F.lit(session).alias("session_id"), F.lit("decryption failed").alias("error"))
