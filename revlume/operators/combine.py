"""Unions of countries and platforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(*parts: DataFrame) -> DataFrame:
    """Union by name; columns a part lacks become null. No rows are dropped."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
