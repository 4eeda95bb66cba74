"""Small value expressions of the learner model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom import config as C

MICROS_PER_DAY = 86_400_000_000.0


def retention(now: Column, last_practice: Column, stability: Column) -> Column:
    """Share still remembered: halves every ``stability`` days."""
    days = (F.unix_micros(now) - F.unix_micros(last_practice)) / F.lit(MICROS_PER_DAY)
    return F.pow(F.lit(0.5), days / stability)


def csv_to_units(csv: Column) -> Column:
    """A comma-separated list as a set of integers; blanks are ignored."""
    parts = F.filter(F.split(F.coalesce(csv, F.lit("")), ","), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.trim(p).cast("int")))


def units_to_csv(units: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(units), lambda u: u.cast("string")), ",")


def content_key(text: Column, slow: Column) -> Column:
    """Cache key of one spoken text."""
    return F.md5(F.concat(text, F.when(slow, F.lit("_slow")).otherwise("")))


def clamp_unit(unit: Column, floor: int = C.RULES.first_unit) -> Column:
    return F.when(unit < floor, F.lit(floor)).otherwise(unit)


def seeded_order(seed: str, *parts: Column) -> Column:
    """A reproducible stand-in for random order."""
    return F.md5(F.concat_ws(":", F.lit(seed), *parts))


def hash_number(key: Column) -> Column:
    """A number of 32 bits for a string, the same in every engine."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def hash_bucket(key: Column, buckets: Column) -> Column:
    """Spread a string evenly over ``buckets`` values, the same way in every engine."""
    return hash_number(key) % buckets


def round_tenth(x: Column) -> Column:
    """A number not below 0, rounded to one place by its exact binary value, half to even.

    ``7 / 20`` is stored a little below 0.35 and goes to 0.3. With ``f`` the part after the point, the tie above tenth ``n`` is
    ``20 f = 2 n + 1``; ``16 f - (2 n + 1)`` is exact near the tie and is held against ``4 f``.
    """
    f = x - F.floor(x)
    n = F.floor(f * 10)
    side = F.lit(16.0) * f - (2 * n + 1)
    above = (F.lit(4.0) * f > -side) | ((F.lit(4.0) * f == -side) & (n % 2 == 1))
    return (F.floor(x) * 10 + n + above.cast("int")) / F.lit(10.0)
