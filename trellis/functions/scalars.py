"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xlogx(x: Column) -> Column:
    """x ln x with 0 at 0."""
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone, so retries and re-plans repeat it."""
    h = F.xxhash64(F.lit(seed), *keys)
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)
