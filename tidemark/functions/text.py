"""Names, ids and sort keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded(value: Column) -> Column:
    """A text for comparison without regard to case: ``Straße`` as ``strasse``, the two small sigmas alike."""
    return F.translate(F.lower(F.upper(value)), "ς", "σ")


def natural_key(name: Column) -> Column:
    """A list of texts that sorts names with their numbers by value, however long, the rest without regard to case.

    Texts and numbers take turns, a text first. A number is its length without
    leading zeros, then its digits.
    """
    parts = F.regexp_extract_all(folded(name), F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def part(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+", "")
        return F.when(F.rlike(x, F.lit("^[0-9]")), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(x)

    first = F.when(F.rlike(name, F.lit("^[0-9]")), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(first, F.transform(parts, part))


def clean_field(value: Column, most: int) -> Column:
    """White space collapsed and trimmed; null if control characters or more than ``most`` characters remain."""
    flat = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.when(F.rlike(flat, F.lit(r"[\x00-\x1F\x7F]")) | (F.length(flat) > most), F.lit(None)).otherwise(flat)


def file_stem(title: Column, most_bytes: int = 180) -> Column:
    """A title as a file name: forbidden characters replaced, cut to a number of UTF-8 bytes at a whole character."""
    safe = F.trim(F.regexp_replace(title, r'[\\/:*?"<>|\x00-\x1F]', "_"), F.lit(" ."))
    raw = F.encode(safe, "utf-8")
    head = F.substring(raw, 1, most_bytes)
    # A character cut in two leaves replacement marks at the end.
    cut = F.regexp_replace(F.decode(head, "utf-8"), "�+$", "")
    return F.trim(F.when(F.length(raw) <= most_bytes, safe).otherwise(cut), F.lit(" ."))


def clock(seconds: Column) -> Column:
    """Seconds as ``m:ss``, rounded half up, never below zero."""
    whole = F.greatest(F.lit(0), F.floor(seconds + 0.5)).cast("int")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("int"), whole % 60)


def timeline_percent(time: Column, duration: Column) -> Column:
    share = F.least(F.lit(100.0), F.greatest(F.lit(0.0), time / duration * 100))
    return F.when(time.isNull() | duration.isNull() | (duration <= 0), F.lit(0.0)).otherwise(share)


def rational(rate: Column) -> Column:
    """A rate written as ``n/d`` or a number; 0 where it can't be read."""
    parts = F.split(rate, "/")
    top = F.try_element_at(parts, F.lit(1)).try_cast("double")
    bottom = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("1")).try_cast("double")
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))
