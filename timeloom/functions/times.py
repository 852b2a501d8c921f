"""Time stamps and sampling times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_timestamp(c: Column) -> Column:
    """Seconds of `MM:SS.s`; null if it isn't one."""
    parts = F.split(F.trim(c), ":")
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("double"))


def format_timestamp(seconds: Column) -> Column:
    """`MM:SS` of whole seconds; minutes go on beyond 59 and 99."""
    whole = seconds.cast("bigint")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("bigint"), whole % 60)


def sample_times(start: Column, end: Column, step: float = 2.0, most: int = 5) -> Column:
    """Every `step` seconds from the start on, before the end, at most `most`; the start alone if the end isn't later."""
    n = F.least(F.lit(most), F.greatest(F.ceil((end - start) / step), F.lit(1))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + i * step)


def probe_times(start: Column, duration: Column, fractions: tuple[float, ...] = (0.1, 0.4, 0.7)) -> Column:
    return F.array(*[start + duration * f for f in fractions])
