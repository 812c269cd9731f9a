"""Small statistics as column formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.96


def wilson_lower_bound(correct: Column, sampled: Column, z: float = Z_95) -> Column:
    """Lower end of the Wilson score interval; 0 without a sample."""
    n = sampled.cast("double")
    p = correct / n
    centre = p + z * z / (2 * n)
    spread = F.lit(z) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(sampled >= 1, F.greatest(F.lit(0.0), (centre - spread) / (1 + z * z / n))).otherwise(F.lit(0.0))
