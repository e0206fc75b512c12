"""Ratios, limits and number formats used in reasons and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(x: Column, n: Column) -> Column:
    """x / max(n, 1)."""
    return x.cast("double") / F.greatest(n, F.lit(1))


def improvement(candidate: Column, champion: Column) -> Column:
    return candidate - champion


def relative_improvement(candidate: Column, champion: Column, floor: float = 0.001) -> Column:
    """Improvement over the champion in percent; the champion's value is floored."""
    return (candidate - champion) / F.greatest(champion, F.lit(floor)) * 100


def clip(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def pct(c: Column, digits: int = 0) -> Column:
    """Percent text. Ties go to the even digit, so 0.925 is 92%."""
    return F.format_string(f"%.{digits}f%%", F.bround(c.cast("double") * 100, digits))


def fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(c.cast("double"), digits))


def signed(c: Column, digits: int) -> Column:
    return F.format_string(f"%+.{digits}f", F.bround(c.cast("double"), digits))
