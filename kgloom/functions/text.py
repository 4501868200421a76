"""Text normalisation, tokens and similarities."""

from __future__ import annotations

import string
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

# workers get these functions themselves and need not find this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ENDS = r"(?U)^\s+|\s+$"


def normalized(text: Column) -> Column:
    """Lower case without ASCII punctuation and outer white space; null is empty."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), string.punctuation, ""), _ENDS, "")


def tokens(text: Column) -> Column:
    """Words between white space, repeats kept; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def token_set(text: Column) -> Column:
    """The distinct words of the normalised text, for blocking."""
    return F.array_distinct(tokens(normalized(text)))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence: one bit per place of a, a row of the table per character of b."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    row = full = (1 << len(a)) - 1
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """2 * LCS / (len a + len b), the similarity that counts insertions and deletions only; two empty texts are equal."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    return 2.0 * _common(a, b) / total


@pandas_udf(DoubleType())
def _ratios(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def indel_ratio(a: Column, b: Column) -> Column:
    """ratio() of two text columns.  Score distinct pairs: it runs in Python over Arrow batches."""
    return _ratios(a, b)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of the smaller over sum of the larger token counts of two token arrays; 0 if either is empty."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    low = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(count(a, t), count(b, t)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(low / (F.size(a) + F.size(b) - low))


def composite(a: Column, b: Column, alpha: float = 0.5) -> Column:
    """alpha * weighted Jaccard + (1 - alpha) * ratio of the normalised texts."""
    x, y = normalized(a), normalized(b)
    return F.lit(alpha) * weighted_jaccard(tokens(x), tokens(y)) + F.lit(1 - alpha) * indel_ratio(x, y)


@pandas_udf(StringType())
def two_digits(x: pd.Series) -> pd.Series:
    """A number with two decimals, halves rounded as binary floats are; for sinks only."""
    return x.map(lambda v: f"{v:.2f}", na_action="ignore")


@pandas_udf(StringType())
def three_digits(x: pd.Series) -> pd.Series:
    return x.map(lambda v: f"{v:.3f}", na_action="ignore")
