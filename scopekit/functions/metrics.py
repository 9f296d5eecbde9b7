"""Per-row correctness of a predicted value against a true value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scopekit import fixed_values as FV


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _close(p: Column, t: Column, atol: float, rtol: float) -> Column:
    # |p - t| <= atol + rtol * |t|: the true value is the base (asymmetric).
    return F.abs(p - t) <= F.lit(atol) + F.lit(rtol) * F.abs(t)


def strict_correct(pred, truth) -> Column:
    """Both null, or values rounded half-to-even are close with tight default tolerances."""
    p, t = _col(pred).cast("double"), _col(truth).cast("double")
    close = _close(F.bround(p, 0), F.bround(t, 0), FV.STRICT_ATOL, FV.STRICT_RTOL)
    return (p.isNull() & t.isNull()) | F.coalesce(close, F.lit(False))


def tolerant_correct(pred, truth) -> Column:
    """Both null, or within 1 + 10 % of the true value (unrounded)."""
    p, t = _col(pred).cast("double"), _col(truth).cast("double")
    close = _close(p, t, FV.TOLERANT_ATOL, FV.TOLERANT_RTOL)
    return (p.isNull() & t.isNull()) | F.coalesce(close, F.lit(False))


def unit_free_digits(value) -> Column:
    """Rounded (half to even) integer text without trailing zeros."""
    rounded = F.bround(_col(value).cast("double"), 0)
    return F.rtrim(rounded.try_cast("decimal(38,0)").cast("string"), F.lit("0"))


def graceful_correct(pred, truth) -> Column:
    """Equal digits after dropping trailing zeros (unit-free); both null counts as equal."""
    return unit_free_digits(pred).eqNullSafe(unit_free_digits(truth))


def pages_overlap(pred_pages, true_pages) -> Column:
    """A shared page between the cited and the true page sets; empty or null never overlaps."""
    return F.coalesce(F.arrays_overlap(_col(pred_pages).cast("array<bigint>"),
                                       _col(true_pages).cast("array<bigint>")), F.lit(False))
