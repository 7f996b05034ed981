"""Join conditions on the six-part claim key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame


def null_safe(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """NULL equals NULL; Spark still plans this as an equi join."""
    return reduce(
        lambda a, b: a & b, [left[name].eqNullSafe(right[name]) for name in names]
    )
