"""Times as text and back.  All times are BIGINT milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(ms: Column) -> tuple[Column, Column, Column, Column]:
    ms = F.greatest(F.coalesce(ms, F.lit(0)), F.lit(0)).cast("long")
    return F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm; null counts as 0."""
    return F.format_string("%02d:%02d:%02d,%03d", *_parts(ms))


def clock(ms: Column) -> Column:
    """HH:MM:SS"""
    return F.format_string("%02d:%02d:%02d", *_parts(ms)[:3])


def clock_ms(ms: Column) -> Column:
    """HH:MM:SS.mmm"""
    return F.format_string("%02d:%02d:%02d.%03d", *_parts(ms))


def dotted(ms: Column) -> Column:
    """HH.MM.SS"""
    return F.format_string("%02d.%02d.%02d", *_parts(ms)[:3])


def minutes(ms: Column) -> Column:
    """MM:SS with minutes beyond 59 counted on."""
    h, m, s, _ = _parts(ms)
    return F.format_string("%02d:%02d", h * 60 + m, s)


def seconds_to_ms(seconds: Column) -> Column:
    return F.floor(seconds * 1000).cast("long")


def ms_to_seconds(ms: Column) -> Column:
    return ms / F.lit(1000.0)


def parse_clock(text: Column) -> Column:
    """SS, MM:SS or HH:MM:SS, with an optional fraction, in milliseconds; null if it is none of these."""
    parts = F.split(F.trim(text), ":")
    numbers = F.transform(parts, lambda x: F.when(F.trim(x).rlike(r"^\d{1,9}(\.\d+)?$"), F.trim(x).cast("decimal(18,3)")))
    total = F.aggregate(numbers, F.lit(0).cast("decimal(28,3)"), lambda a, x: (a * 60 + x).cast("decimal(28,3)"))
    return F.when((F.size(parts) <= 3) & F.forall(numbers, lambda x: x.isNotNull()), (total * 1000).cast("long"))


def parse_range(text: Column) -> Column:
    """"a-b" as struct(start_ms, end_ms); null unless both parse and start < end."""
    sides = F.split(F.trim(text), "-")
    a, b = parse_clock(F.get(sides, F.lit(0))), parse_clock(F.get(sides, F.lit(1)))
    return F.when((F.size(sides) == 2) & (a < b), F.struct(a.alias("start_ms"), b.alias("end_ms")))


def parse_srt_time(text: Column) -> Column:
    """HH:MM:SS,mmm in milliseconds; null if malformed."""
    pattern = r"^\s*(\d+):(\d{2}):(\d{2})[,.](\d{3})\s*$"
    part = lambda k: F.regexp_extract(text, pattern, k).cast("long")
    return F.when(text.rlike(pattern), part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + part(4))
