"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reformat_date(col: Column, source: str, target: str) -> Column:
    return F.date_format(F.to_date(col, source), target)


def is_older(a: Column, b: Column) -> Column:
    return F.to_date(a) < F.to_date(b)


def days_between(a: Column, b: Column) -> Column:
    """Days from a to b; 0 if either is missing."""
    return F.coalesce(F.datediff(b, a), F.lit(0))


def next_workdays(day: Column, n: int) -> Column:
    """The next n days from Monday to Friday after a day."""
    days = F.sequence(F.date_add(day, 1), F.date_add(day, 2 * n + 3))
    return F.slice(F.filter(days, lambda d: F.weekday(d) < 5), 1, n)


def human_bytes(col: Column) -> Column:
    """Bytes with a binary unit and one decimal, halves to even; null for null."""
    units = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB", "ZiB", "YiB"]
    x = col.cast("double")
    step = F.lit(0)
    for k in range(1, len(units)):
        step = F.when(F.abs(x) >= 1024.0**k, F.lit(k)).otherwise(step)
    return F.concat(F.format_string("%.1f", F.bround(x / F.pow(F.lit(1024.0), step), 1)), F.element_at(F.array(*map(F.lit, units)), step + 1))


def duration_words(ms: Column) -> Column:
    """Milliseconds as days, hours, minutes, seconds and milliseconds; parts of 0 are left out and `and` stands before the last of several. FINISHED where none are left."""
    parts, rest = [], ms.cast("long")
    for name, size in (("days", 86_400_000), ("hours", 3_600_000), ("minutes", 60_000), ("seconds", 1000), ("milliseconds", 1)):
        n = F.floor(rest / size)
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(" " + name))))
        rest = rest % size
    said = F.array_compact(F.array(*parts))
    head, last = F.array_join(F.slice(said, 1, F.size(said) - 1), " "), F.element_at(said, -1)
    return F.when(ms <= 0, F.lit("FINISHED")).when(F.size(said) == 1, said[0]).when(F.size(said) > 1, F.concat(head, F.lit(" and "), last))


def parent_path(path: Column) -> Column:
    """What stands before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def file_extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def is_numeric_text(col: Column) -> Column:
    """Digits with one dot at most."""
    return F.coalesce(col.rlike(r"^[0-9]*\.?[0-9]*$") & col.rlike("[0-9]"), F.lit(False))


def id_year(col: Column) -> Column:
    """Year of a record id `CVE-yyyy-n`, null for other texts."""
    return F.when(col.rlike(r"^CVE-[0-9]{4}-[0-9]*$"), F.regexp_extract(col, r"^CVE-([0-9]{4})", 1).cast("int"))
