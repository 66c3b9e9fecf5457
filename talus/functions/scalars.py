"""Scalar column expressions shared by the operators (all JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published split recipe.
SPLIT_SALT = "mimiciv-3.1-loadimbalance-v1"
SPLIT_BOUNDS = (("train", 0, 70), ("val", 70, 85), ("test", 85, 100))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from ``start`` to ``end`` as a double (microsecond exact)."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def hours_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / F.lit(3600.0)


def days_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / F.lit(86400.0)


def age_at(anchor_age: Column, anchor_year: Column, when: Column) -> Column:
    """Age in the year of ``when`` given an age in an anchor year."""
    return anchor_age + (F.year(when) - anchor_year)


def hash_bucket(key: Column, salt: str = SPLIT_SALT, buckets: int = 100) -> Column:
    """First 64 bits of sha256("salt|key") modulo ``buckets``."""
    digest = F.sha2(F.concat(F.lit(salt + "|"), key.cast("string")), 256)
    high = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(high, F.lit(buckets).cast("decimal(20,0)")).cast("int")


def split_of(bucket: Column) -> Column:
    """Name of the split whose half-open range holds ``bucket``."""
    expr = None
    for name, low, high in SPLIT_BOUNDS:
        cond = (bucket >= low) & (bucket < high)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr


def hash_order(key: Column, seed: int) -> Column:
    """Hex digest that orders rows pseudo-randomly but reproducibly."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256)


def order_bits(x: Column) -> Column:
    """A long that orders as the double does: its exponent and fraction, negated below zero.

    Worked out from exact powers of two. Magnitudes under 2^-1022 count as zero,
    and NaN comes after infinity, as in Spark's own order.
    """
    size = F.abs(x)
    power = lambda e: F.pow(F.lit(2.0), e)
    near = F.floor(F.log2(size))
    e = F.when(power(near) > size, near - 1).when(power(near + 1) <= size, near + 1).otherwise(near)
    fraction = ((size / power(e) - 1) * F.lit(2.0**52)).cast("long")
    plain = (e + 1023) * F.lit(1 << 52) + fraction
    top = F.lit(2047 << 52)
    bits = F.when(F.isnan(x), top + 1).when(size == float("inf"), top).when(size < 2.0**-1022, F.lit(0)).otherwise(plain)
    return F.when(~F.isnan(x) & (x < 0), -bits).otherwise(bits).cast("long")


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def harmonise(value: Column, scale: Column, offset: Column) -> Column:
    return value * scale + offset


def null_if_sentinel(x: Column, sentinel: float = -1) -> Column:
    return F.when(x != F.lit(sentinel), x)


def right_closed_bin(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the interval (edges[i], edges[i+1]] that holds ``x``."""
    expr = None
    for low, high, label in zip(edges[:-1], edges[1:], labels):
        cond = (x > low) & (x <= high)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def note_value(notes: Column, key: str) -> Column:
    """Value of ``key`` in a ``k=v;k=v`` string, NULL when absent."""
    return F.nullif(F.regexp_extract(notes, rf"(?:^|;){key}=([^;]*)", 1), F.lit(""))


def sanitise_note(text: Column) -> Column:
    """Keep a free-text field on one CSV cell: ',' -> ';', line breaks -> ' '."""
    return F.translate(text, ",\n\r", ";  ")


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when the denominator is zero (ANSI safe)."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def relative_pct(num: Column, den: Column) -> Column:
    """Percentage by which ``num`` exceeds ``den``."""
    return F.lit(100.0) * (safe_ratio(num, den) - F.lit(1.0))


def file_digest(content: Column) -> Column:
    return F.sha2(content, 256)
