"""Time columns: float seconds in the tables, whole milliseconds in the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_ms(seconds: Column | str) -> Column:
    """Whole milliseconds of a float-seconds column, rounded half up; NaN and infinities become null."""
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(1e12))
    return F.when(finite, F.round(c * 1000).cast("long"))


def format_timestamp(seconds: Column | str) -> Column:
    """``HH:MM:SS`` of seconds, clamped at zero and truncated; hours may take more than two digits."""
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    s = F.greatest(F.lit(0).cast("long"), F.floor(c).cast("long"))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def parse_timestamp(text: Column | str) -> Column:
    """Seconds of ``H:M:S`` or ``M:S`` text, null where a part is not a number."""
    c = F.col(text) if isinstance(text, str) else text
    parts = F.transform(F.split(c, ":"), lambda p: p.try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)
