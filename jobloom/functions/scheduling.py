"""Retry delays as column expressions. All arithmetic saturates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX = 2**63 - 1


def sat_add(a: Column, b: Column) -> Column:
    """a + b, held within the range of a long."""
    a, b = a.cast("long"), b.cast("long")
    return F.coalesce(F.try_add(a, b), F.when(a > 0, F.lit(LONG_MAX)).when(a < 0, F.lit(-LONG_MAX - 1)))


def backoff_ms(base: Column, cap: Column, attempt: Column) -> Column:
    """min(base * 2^(attempt - 1), cap); 0 for a base of 0.

    The power is taken in doubles up to 2^62, where it is exact, so shifts can't wrap.
    """
    power = F.pow(F.lit(2.0), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(62)))
    grown = F.coalesce(F.try_multiply(base.cast("long"), power.cast("long")), F.lit(LONG_MAX))
    return F.when(base <= 0, F.lit(0).cast("long")).otherwise(F.least(grown, cap.cast("long")))


def jittered_ms(delay: Column, jitter: Column, draw: Column) -> Column:
    """round((1 - j) * d + j * draw * d), within [0, d]; d itself without jitter or delay."""
    moved = F.round((1 - jitter) * delay + jitter * draw * delay).cast("long")
    return F.when((jitter <= 0) | (delay <= 0), delay.cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), F.least(moved, delay.cast("long"))))


def client_backoff_ms(base: Column, cap: Column, n: Column, draw: Column) -> Column:
    """floor(min(cap, base * 2^n) * (0.5 + draw / 2)), the wait of a polling client."""
    return F.floor(F.least(cap.cast("double"), base * F.pow(F.lit(2.0), n)) * (0.5 + draw / 2))
