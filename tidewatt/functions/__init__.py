"""Column functions: time buckets, exact arithmetic, identities of values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewatt.schemas import Resolution

_STEP = {"Day": "INTERVAL 1 DAY", "Month": "INTERVAL 1 MONTH", "Year": "INTERVAL 1 YEAR"}


def floor_to(t: Column, micros: int, anchor: int | Column = 0) -> Column:
    """Start of the fixed bucket that holds ``t``, also before the epoch."""
    shifted = t - anchor
    return t - F.pmod(shifted, F.lit(micros))


def _local(t: Column, tz: str) -> Column:
    """Wall-clock time in ``tz``, as a timestamp of the UTC session."""
    return F.from_utc_timestamp(F.timestamp_micros(t), tz)


def _utc(local: Column, tz: str) -> Column:
    return F.unix_micros(F.to_utc_timestamp(local, tz))


def bucket_start(t: Column, resolution: Resolution) -> Column:
    """Start of the bucket that holds ``t``: fixed, or local midnight of the day, month or year."""
    if resolution.micros:
        return floor_to(t, resolution.micros)
    return _utc(F.date_trunc(resolution.unit, _local(t, resolution.tz)), resolution.tz)


def bucket_end(t: Column, resolution: Resolution) -> Column:
    """End of the bucket that holds ``t``; calendar buckets have their real length."""
    if resolution.micros:
        return floor_to(t, resolution.micros) + resolution.micros
    return _utc(F.date_trunc(resolution.unit, _local(t, resolution.tz)) + F.expr(_STEP[resolution.unit]), resolution.tz)


def bucket_starts(first: Column, last: Column, resolution: Resolution) -> Column:
    """Starts of all buckets from the one that holds ``first`` to the one that holds ``last``."""
    if resolution.micros:
        return F.sequence(floor_to(first, resolution.micros), floor_to(last, resolution.micros), F.lit(resolution.micros))
    unit, tz = resolution.unit, resolution.tz
    local = F.sequence(F.date_trunc(unit, _local(first, tz)), F.date_trunc(unit, _local(last, tz)), F.expr(_STEP[unit]))
    return F.transform(local, lambda x: _utc(x, tz))


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def value_bits(x: Column) -> Column:
    """A text that tells 0.0 from -0.0 and any two different doubles apart."""
    return x.cast("string")


def saturating_add(a: Column, b: Column) -> Column:
    """Long sum, held at the ends of the range."""
    return F.coalesce(F.try_add(a, b), F.when(b > 0, F.lit((1 << 63) - 1)).otherwise(F.lit(-(1 << 63))))


def blank(x: Column) -> Column:
    return x.isNull() | (F.trim(x) == "")


def time_weighted_mean(integral: Column, covered: Column) -> Column:
    return F.when(covered > 0, integral / covered)


def sample_mean(total: Column, count: Column) -> Column:
    return F.when(count > 0, total / count)


def value_hours(integral: Column) -> Column:
    """Integral over microseconds in value-hours: W to Wh."""
    return integral / 3.6e9
