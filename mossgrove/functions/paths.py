"""Columns about paths in the tree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mossgrove.model import IDENTITY_FILES, LEAF_PREFIXES, PROTECTED_FILES


def forward(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(forward(path), "/"), -1)


def suffix(path: Column) -> Column:
    """The last extension with its dot; a name's leading dot doesn't start one."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"^(.+)\.[^.]+$", "$1")


def parent(path: Column) -> Column:
    """The directory, empty for a file in the root."""
    return F.regexp_replace(F.regexp_replace(forward(path), r"[^/]*$", ""), r"/$", "")


def without_suffix(path: Column) -> Column:
    return F.regexp_replace(forward(path), r"(?<=[^/])\.[^./]+$", "")


def trunk_distance(path: Column) -> Column:
    """Directories between a path and the root; -1 for a path that is null, absolute or leads out of the root."""
    p = forward(path)
    out = p.isNull() | p.startswith("/") | p.rlike(r"^[A-Za-z]:|(^|/)\.\.(/|$)")
    return F.when(out, F.lit(-1)).otherwise(F.size(F.split(p, "/")) - 1)


def trunk_boost(distance: Column) -> Column:
    return F.when(distance < 0, F.lit(0.0)).otherwise(1 / (1 + distance))


def is_leaf(path: Column, prefixes: tuple[str, ...] = LEAF_PREFIXES) -> Column:
    """Whether a path lies under a capture directory; any dots and slashes it starts with are skipped."""
    p = F.regexp_replace(forward(path), r"^[./]+", "")
    out = F.lit(False)
    for x in prefixes:
        out = out | p.startswith(x)
    return out


def is_protected(path: Column, names: tuple[str, ...] = PROTECTED_FILES) -> Column:
    return base_name(path).isin(*names)


def is_identity(path: Column, files: tuple[str, ...] = IDENTITY_FILES) -> Column:
    return forward(path).isin(*files)


def is_hidden(path: Column) -> Column:
    return forward(path).rlike(r"(^|/)\.")


def is_watched(path: Column, system: str) -> Column:
    """Whether a change to a path counts: a markdown file outside the system directory that isn't an index."""
    p = forward(path)
    return p.endswith(".md") & (base_name(path) != "index.md") & ~p.rlike(rf"(^|/){system.replace('.', '[.]')}(/|$)")


def ancestors(path: Column) -> Column:
    """Directories above a path, outermost first, without the root."""
    parts = F.split(forward(path), "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def summary_level(path: Column) -> Column:
    """week, month or year for a summary's path, else null."""
    parts = F.split(forward(path), "/")
    n, at = F.size(parts), lambda i: F.get(parts, F.lit(i))
    return (
        F.when((n == 5) & at(3).startswith("week") & at(4).startswith("week"), F.lit("week"))
        .when((n == 4) & at(3).rlike(r"^\d{2}\.md$"), F.lit("month"))
        .when((n == 3) & at(2).rlike(r"^\d{4}\.md$"), F.lit("year"))
    )
