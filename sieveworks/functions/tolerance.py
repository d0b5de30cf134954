"""Duration and similarity thresholds, strict or inclusive as the rules have them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LISTEN_MS = 30_000
SAME_AUDIO, OTHER_AUDIO, GOOD_PREVIEW, BAD_PREVIEW = 0.9, 0.75, 0.85, 0.8
PROMOTE_DAYS, PROMOTE_LISTENS, WARN_DAYS, DELETE_DAYS, NOTICE_DAYS, ADOPT_DAYS = 28, 3, 35, 42, 7, 14
DUPLICATE_SPREAD = 3.0


def far_from(value: Column, reference: Column, least: float, share: float) -> Column:
    """``abs(value - reference) > max(least, share * reference)``."""
    return F.abs(value - reference) > F.greatest(F.lit(float(least)), share * reference)


def other_version(value: Column, reference: Column) -> Column:
    """More than 3 s, or 1 % of the reference, apart."""
    return far_from(value, reference, 3, 0.01)


def cut_short(decoded: Column, declared: Column) -> Column:
    """Whether audio ends more than 2 s, or 3 % of its declared length, early."""
    return decoded < declared - F.greatest(F.lit(2.0), 0.03 * declared)


def band(value: Column) -> Column:
    """A number for which values that aren't :func:`other_version` differ by at most 1: 6 s wide under 300, 2 % wide above."""
    size = F.when(value < 300, value / 3).otherwise(100 + F.log(F.greatest(value, F.lit(300.0)) / 300) / math.log(1.01))
    return F.floor(size / 2)


def same_recording_length(file: Column, other: Column) -> Column:
    """At most 4 s, or 3 % of the file's length, apart."""
    return F.abs(file - other) <= F.greatest(F.lit(4.0), 0.03 * file)


def same_audit_length(a: Column, b: Column) -> Column:
    """At most 3 s, or 2 % of the longer, apart."""
    return F.abs(a - b) <= F.greatest(F.lit(3.0), 0.02 * F.greatest(a, b))
