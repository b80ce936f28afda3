"""Joins that hold up when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: Column, how: str = "left", salts: int = SALTS, hint: str | None = None) -> DataFrame:
    """Join ``rows`` to ``lookup`` (one row per key), spreading each key over ``salts`` tasks.

    ``spread`` is an expression over ``rows`` that differs within a hot key.
    Each lookup row is repeated ``salts`` times, so it should be narrow;
    ``hint`` names a join strategy where the lookup's stored size misleads.
    """
    salt = "__salt"
    left = rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = lookup.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if hint is not None:
        right = right.hint(hint)
    return left.join(right, [*keys, salt], how).drop(salt)
