"""Scores of paths and facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def npmi(path: Column, both: Column, predicate: Column, domain: Column, range_: Column) -> Column:
    """Normalised pointwise mutual information of a path and a predicate over domain x range pairs.

    0 where a count or the logarithm's base case vanishes, never negative, not limited above:
    walks may outnumber pairs.
    """
    pairs = domain.cast("double") * range_
    joint = both / pairs
    value = F.ln(joint / ((path / pairs) * (predicate / pairs))) / -F.ln(joint)
    fine = (pairs > 0) & (path > 0) & (both > 0) & (predicate > 0) & (joint != 1)
    return F.when(fine, F.greatest(value, F.lit(0.0))).otherwise(F.lit(0.0))


def veracity(scores: Column, clamp: bool = False) -> Column:
    """1 - product(1 - score) over a group's rows; 0 without any."""
    value = F.coalesce(F.lit(1.0) - F.product(F.lit(1.0) - scores), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) if clamp else value
