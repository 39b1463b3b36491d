"""Scalar column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_SECOND = 1_000_000_000
NS_PER_MINUTE = 60 * NS_PER_SECOND
NS_PER_HOUR = 60 * NS_PER_MINUTE
NS_PER_DAY = 24 * NS_PER_HOUR


def long(value: int) -> Column:
    return F.lit(value).cast("long")


def floor_div(x: Column, n: int) -> Column:
    """Floor division of longs below 2^62 in size, which in ns covers the years 1824 to 2115.

    ``div`` truncates toward zero, so the value is moved into the positive range and back. ``x`` is
    named once: nested divisions would otherwise double the generated code at every level.
    """
    shift = (1 << 62) // n
    return F.call_function("div", x + long(shift * n), long(n)) - long(shift)


def yyyymmdd(days: Column) -> Column:
    """Days since 1970-01-01 as a yyyymmdd long, independent of the session time zone."""
    return F.date_format(F.date_from_unix_date(days.cast("int")), "yyyyMMdd").cast("long")


def days_of(day: Column) -> Column:
    """A yyyymmdd long as days since 1970-01-01."""
    return F.unix_date(F.to_date(day.cast("string"), "yyyyMMdd")).cast("long")


def wall_clock_ns(text: Column) -> Column:
    """First 19 characters of ``yyyy-MM-dd HH:mm:ss...`` as wall-clock ns; any offset is ignored."""
    day = F.unix_date(F.to_date(F.substring(text, 1, 10))).cast("long")
    seconds = (
        F.substring(text, 12, 2).cast("long") * 3600
        + F.substring(text, 15, 2).cast("long") * 60
        + F.substring(text, 18, 2).cast("long")
    )
    return (day * 86400 + seconds) * long(NS_PER_SECOND)


def local_to_utc_ns(local_ns: Column, zone: str) -> Column:
    micros = floor_div(local_ns, 1000)
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(micros), zone)) * long(1000)


def session_date_of(local_ns: Column, roll_hours: int = 6) -> Column:
    return yyyymmdd(floor_div(local_ns + long(roll_hours * NS_PER_HOUR), NS_PER_DAY))


def minute_of_day(local_ns: Column) -> Column:
    return F.pmod(floor_div(local_ns, NS_PER_MINUTE), long(1440))


def minute_text(minute: Column, suffix: str = "+08:00") -> Column:
    """Minutes since the epoch as ``yyyy-MM-dd HH:mm:ss`` wall-clock text plus a zone suffix."""
    day = F.date_format(F.date_from_unix_date(floor_div(minute, 1440).cast("int")), "yyyy-MM-dd")
    hour, of_hour = floor_div(F.pmod(minute, long(1440)), 60), F.pmod(minute, long(60))
    return F.concat(day, F.format_string(" %02d:%02d:00" + suffix, hour, of_hour))


def no_nan(x: Column) -> Column:
    """NaN to null, so that aggregates skip unknown values."""
    return F.when(~F.isnan(x), x)


def strings(values: Iterable[str]) -> Column:
    items = [F.lit(v) for v in values]
    return F.array(*items) if items else F.array().cast("array<string>")


def codes(fixed: Iterable[str], *optional: tuple[Column, str]) -> Column:
    """A code array: the fixed codes, then each optional code whose condition holds."""
    return F.array_compact(
        F.array(*[F.lit(c) for c in fixed], *[F.when(cond, F.lit(c)) for cond, c in optional])
    )


def structure_id(
    kind: Column, start: Column, anchors: Column, rulebook_version: str, structure_version: str, scope: str | None
) -> Column:
    """Stable id over what identifies a structure; state, end and confirmation are left out on purpose."""
    identity = F.to_json(
        F.struct(
            anchors.alias("anchor_bar_ids"), kind.alias("kind"),
            F.lit(rulebook_version).alias("rulebook_version"),
            F.lit(scope).cast("string").alias("scope_ref"), start.alias("start_bar_id"),
            F.lit(structure_version).alias("structure_version"),
        ),
        {"ignoreNullFields": "false"},
    )
    return F.concat_ws("-", kind, start.cast("string"), F.substring(F.sha2(identity, 256), 1, 16))
