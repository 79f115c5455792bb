"""Expressions on single records: corrected counts, clocks, sampling rates, wire integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import U64

WRAP = 1 << 32
#: an uptime up to an hour ahead of the export's own is taken for skew, beyond that for a wrapped counter
SKEW_MS = 3_600_000


def is_aggregated(version: Column, flows_reported: Column) -> Column:
    """Records that sum up several flows: they count for their exporter alone."""
    return (version == "netflow_v8") | F.coalesce(flows_reported, F.lit(False))


def halves(count: Column, rate: Column) -> tuple[Column, Column]:
    """count times the sampling rate (0: unsampled), at most 2**64 - 1, as its upper and lower 32 bits; NULL counts as 0.

    Products that fit 63 bits, which are nearly all, are whole numbers throughout; DECIMAL is for the others alone."""
    fast = F.try_multiply(count.try_cast("long"), F.greatest(rate, F.lit(1)))
    exact = corrected_exact(count, rate)
    upper = F.floor(exact / F.lit(1 << 32).cast("decimal(20,0)")).cast("long")
    lower = (exact - upper.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(20,0)")).cast("long")
    return tuple(F.when(fast.isNotNull(), a).otherwise(F.coalesce(b, F.lit(0).cast("long"))) for a, b in ((F.shiftright(fast, 32), upper), (fast.bitwiseAND(F.lit((1 << 32) - 1)), lower)))


def saturated(upper: Column, lower: Column, kind: str = "decimal(20,0)") -> Column:
    """The number whose halves add up to these, at most 2**64 - 1, or 2**63 - 1 where a table holds it as LONG."""
    whole = upper.cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(11,0)") + lower.cast("decimal(38,0)")
    return F.least(whole, F.lit(str(U64 if kind != "bigint" else (1 << 63) - 1)).cast("decimal(38,0)")).cast(kind)


def total(count: Column, rate: Column, kind: str = "decimal(20,0)") -> Column:
    """Sum of corrected counts that stops at its type's greatest value instead of failing."""
    upper, lower = halves(count, rate)
    return saturated(F.sum(upper), F.sum(lower), kind)


def corrected_exact(count: Column, rate: Column) -> Column:
    stopped = F.least(count.cast("decimal(20,0)") * F.greatest(rate, F.lit(1)).cast("decimal(10,0)"), F.lit(str(U64)).cast("decimal(31,0)")).cast("decimal(20,0)")
    return F.when(count.isNotNull(), stopped)  # least() would take the limit for a missing count


def unsigned(payload: Column, at: Column | int, size: int) -> Column:
    """Big-endian unsigned number of `size` bytes at a 0-based place. Up to 7 bytes give a LONG, 8 a DECIMAL."""
    place = (at + 1) if isinstance(at, Column) else F.lit(at + 1)
    digits = F.conv(F.hex(F.substring(payload, place, F.lit(size))), 16, 10)
    return digits.cast("decimal(20,0)") if size == 8 else digits.cast("long")


def anchored_ms(export_ms: Column, uptime_ms: Column, value_ms: Column) -> Column:
    """Instant of an uptime reading, given the export's instant and uptime (both modulo 2**32 ms)."""
    age = F.pmod(uptime_ms - value_ms, F.lit(WRAP))
    return export_ms - F.when(age > WRAP - SKEW_MS, age - WRAP).otherwise(age)


def ordered(start: Column, end: Column) -> tuple[Column, Column]:
    """Both instants, or neither if the end is before the start."""
    return F.when(end >= start, start), F.when(end >= start, end)


def options_rate(interval: Column, space: Column, population: Column, size: Column, random: Column, plain: Column) -> Column:
    """The rate that an options record declares. Interval and space add up modulo 2**32."""
    return (
        F.when(space.isNotNull() & (interval > 0), F.floor(F.pmod(interval + space, F.lit(WRAP)) / interval))
        .when((size > 0) & (population > 0), F.floor(population / size))
        .when(random > 0, random)
        .otherwise(F.coalesce(plain, F.lit(0)))
        .cast("long")
    )


def clean_name(raw: Column, most: int = 255) -> Column:
    """A device's string without trailing NULs and spaces; NULL if it is empty, too long or not UTF-8."""
    text = F.regexp_replace(raw.cast("string"), "[\\x00 ]+$", "")
    return F.when(F.is_valid_utf8(raw.cast("string")) & (F.octet_length(text).between(1, most)), text)
