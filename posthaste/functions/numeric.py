"""Numeric expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The price of a billion input tokens, in dollars.
DOLLARS_PER_BILLION_TOKENS = 42


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def engagement(likes: Column, replies: Column, reposts: Column) -> Column:
    """Sum of the three counters, each 0 when missing."""
    return or_zero(likes) + or_zero(replies) + or_zero(reposts)


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """part / whole, or ``empty`` where the whole is not positive."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def token_cost(tokens: Column, price: float = DOLLARS_PER_BILLION_TOKENS) -> Column:
    return tokens / F.lit(1e9) * F.lit(price)


def nan_to_zero(value: Column) -> Column:
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def linear_head(vector: Column, weights: Sequence[float], bias: float) -> Column:
    """w·x + b over an array column."""
    w = F.lit([float(v) for v in weights])
    products = F.zip_with(vector, w, lambda x, y: x.cast("double") * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x) + F.lit(float(bias))


def masked_mean(vector: Column, mask: Column, dim: int) -> Column:
    """Aggregate: mean of the vectors whose mask is set, element by element.

    One sum per element keeps the rows whole instead of exploding each of them
    ``dim`` times; partial sums run before the shuffle, so a long document is
    no hot group.
    """
    weight = mask.cast("double")
    count = F.greatest(F.sum(weight), F.lit(1e-9))
    return F.array(*[F.sum(F.get(vector, F.lit(i)).cast("double") * weight) / count
                     for i in range(dim)])
