"""Columns about days and the journal's calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_of_month(day: Column) -> Column:
    return (F.floor((F.dayofmonth(day) - 1) / 7) + 1).cast("int")


def week_dir(branch: Column, day: Column) -> Column:
    return F.concat(branch, F.lit("/"), F.date_format(day, "yyyy/MM"), F.lit("/week"), week_of_month(day).cast("string"))


def journal_path(branch: Column, day: Column) -> Column:
    return F.concat(week_dir(branch, day), F.lit("/"), F.date_format(day, "MM-dd"), F.lit(".md"))


def flat_path(branch: Column, day: Column) -> Column:
    return F.concat(branch, F.lit("/"), F.date_format(day, "yyyy/MM-dd"), F.lit(".md"))


def entry_path(branch: Column, day: Column) -> Column:
    journal = (branch == "journal") | branch.startswith("journal/")
    return F.when(journal, journal_path(branch, day)).otherwise(flat_path(branch, day))


def summaries(path: Column) -> Column:
    """(path, level, priority) of the week, month and year summaries above a daily path, read from its end."""
    parts = F.split(path, "/")
    year = F.array_join(F.slice(parts, 1, F.size(parts) - 3), "/")
    at = lambda k: F.element_at(parts, -k)
    row = lambda p, level, n: F.struct(p.alias("path"), F.lit(level).alias("level"), F.lit(n).alias("priority"))
    return F.array(
        row(F.concat(year, F.lit("/"), at(3), F.lit("/"), at(2), F.lit("/"), at(2), F.lit(".md")), "week", 3),
        row(F.concat(year, F.lit("/"), at(3), F.lit("/"), at(3), F.lit(".md")), "month", 2),
        row(F.concat(year, F.lit("/"), at(4), F.lit(".md")), "year", 1),
    )


def parsed(text: Column) -> Column:
    """An ISO time, with Z or an offset; now if it can't be read."""
    return F.coalesce(F.try_to_timestamp(text), F.current_timestamp())
