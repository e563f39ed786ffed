"""Closed-form measures over counts, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once.

    A lambda evaluates the expressions of its enclosing scope again for each element; a bound
    variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def binary_entropy(p) -> Column:
    p = col(p)
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))


def scaled_entropy(p, n) -> Column:
    """Entropy that shrinks with the number of votes."""
    return binary_entropy(p) / F.sqrt(col(n))


def majority(share, missing: int = -5) -> Column:
    """A tie counts as 1; an item without votes gets ``missing``."""
    share = col(share)
    return F.when(share.isNull(), F.lit(missing)).when(share >= 0.5, F.lit(1)).otherwise(F.lit(0))


def _need(yes: int, n: int, threshold: float, max_votes: int, min_votes: int) -> int:
    def entropy(p: float) -> float:
        return 0.0 if p <= 0 or p >= 1 else -p * math.log2(p) - (1 - p) * math.log2(1 - p)

    if n == 0:
        return min_votes
    if entropy(yes / n) < threshold:
        return max(0, min_votes - n)
    lead = max(yes, n - yes)
    more = next((k for k in range(1, max_votes - n + 1) if entropy((lead + k) / (n + k)) < threshold), max_votes - n)
    return max(more, min_votes - n)


def votes_needed(yes, n, threshold: float = 0.8, max_votes: int = 15, min_votes: int = 3) -> Column:
    """Votes still wanted for an item with ``yes`` of ``n`` positive votes.

    The winning side is assumed to receive every further vote until entropy drops below the
    threshold.  Below ``max_votes`` votes there are few cases (n, yes), held in one constant array;
    from there on an open item has used up its votes.
    """
    yes, n = F.round(col(yes)).cast("int"), col(n).cast("int")
    cases = F.lit([_need(y, m, threshold, max_votes, min_votes) for m in range(max_votes) for y in range(m + 1)])
    settled = binary_entropy(yes / n) < threshold
    return F.when(n < max_votes, F.get(cases, (n * (n + 1) / 2).cast("int") + yes)) \
        .when(settled, F.lit(0)).otherwise(F.lit(max_votes) - n).cast("int")


def kappa(n11, n10, n01, n00) -> Column:
    """Cohen's kappa of a 2x2 table; two equal label lists give 1 even when constant."""
    n11, n10, n01, n00 = (col(c).cast("double") for c in (n11, n10, n01, n00))
    n = n11 + n10 + n01 + n00
    po = (n11 + n00) / n
    pe = ((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00)) / (n * n)
    return F.when(n == 0, F.lit(None).cast("double")).when(n10 + n01 == 0, F.lit(1.0)) \
        .otherwise((po - pe) / (1 - pe))


def ratio(num, den) -> Column:
    """Division that yields 0 for an empty denominator."""
    return F.when(col(den) > 0, col(num) / col(den)).otherwise(F.lit(0.0))


def jaccard(a, b) -> Column:
    """Overlap of two index sets; NULL when either is empty."""
    a, b = F.array_distinct(col(a)), F.array_distinct(col(b))
    inter = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), inter / (F.size(a) + F.size(b) - inter))
