"""Columns about text: slugs, titles, previews, front matter."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from mossgrove.functions.paths import base_name, forward, stem

TOKEN = r"[\p{L}\p{N}]+"


def _plain(c: str) -> str | None:
    """The letter that a lower-case Latin one with diacritics is without them."""
    d = unicodedata.normalize("NFD", c)
    return d[0] if len(d) > 1 and "LATIN SMALL" in unicodedata.name(c, "") and all(map(unicodedata.combining, d[1:])) else None


_ACCENTED = [c for c in map(chr, range(0xC0, 0x2000)) if _plain(c)]
_MARKS = "".join(map(chr, range(0x300, 0x370)))


def folded(text: Column) -> Column:
    """Lower case, Latin letters without their diacritics, composed or not."""
    low = F.lower(text)
    plain = F.translate(low, "".join(_ACCENTED) + _MARKS, "".join(_plain(c) or "" for c in _ACCENTED))  # marks have no counterpart and go
    return F.when(F.octet_length(low) > F.length(low), plain).otherwise(low)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def search_tokens(text: Column) -> Column:
    """Tokens as keyword search compares them."""
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))


def query_terms(query: str) -> list[str]:
    """A query's words, each to be matched as a phrase of its tokens; quotes are dropped."""
    return query.replace('"', " ").split()


def first_heading(text: Column) -> Column:
    """The first top heading's text, empty if there is none."""
    return F.regexp_extract(text, r"(?m)^#\s+(.+)", 1)


def slug(path: Column, content: Column) -> Column:
    """From the first heading, else the file's stem: word characters and hyphens, lower case, 60 at most."""
    title = F.coalesce(F.nullif(F.trim(first_heading(content)), F.lit("")), stem(path))
    plain = F.lower(F.trim(F.regexp_replace(title, r"(?U)[^\w\s-]", "")))
    return F.coalesce(F.nullif(F.left(F.regexp_replace(plain, r"(?U)[\s_-]+", "-"), F.lit(60)), F.lit("")), F.lit("untitled-concept"))


def title_of(name: Column) -> Column:
    """A stem as a title. Letters after digits or apostrophes stay as they are."""
    return F.initcap(F.translate(name, "-_", "  "))


def preview(text: Column, most: int = 200) -> Column:
    """The first characters on one line, with three dots if there are more."""
    return F.concat(F.regexp_replace(F.left(text, F.lit(most)), "\n", " "), F.when(F.length(text) > most, F.lit("...")).otherwise(F.lit("")))


def cut_at_line(text: Column, most: int) -> Column:
    """The text, or its first characters back to the last line's end, if there is one."""
    short = F.left(text, F.lit(most))
    return F.when(F.length(text) <= most, text).when(short.contains("\n"), F.regexp_extract(short, r"(?s)^(.*\n)", 1)).otherwise(short)


def scrub(text: Column) -> Column:
    return F.translate(text, "\t\n\r", "   ")


def project_hash(folder: Column) -> Column:
    return F.translate(folder, ":\\/", "---")


def entity(folder: Column, ending: str) -> Column:
    """A namespace from a working folder's name; unknown if there is none."""
    name = F.coalesce(F.nullif(base_name(F.regexp_replace(forward(folder), "/+$", "")), F.lit("")), F.lit("unknown"))
    return F.concat(F.lower(F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9._-]", "-"), r"^-+|-+$", "")), F.lit(ending))


def front_matter(**fields: Column | None) -> Column:
    """A fenced block of ``key: value`` lines; a null value leaves its line out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in fields.items() if v is not None]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def fenced_value(text: Column, key: str) -> Column:
    """The value of a ``key:`` line in the first fenced block."""
    return F.regexp_extract(text, rf"(?s)```.*?(?:^|\n)\s*{key}:\s*([^\n`]+)", 1)


def candidate_listing(position: Column, source: Column, distance: Column, content: Column) -> Column:
    return F.concat(F.lit("["), position.cast("string"), F.lit("] "), source, F.lit(" (trunk_distance: "), distance.cast("string"), F.lit(")\n"), F.left(content, F.lit(2000)))
