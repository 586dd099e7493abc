"""Joins of a star schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flagged(df: DataFrame, keys: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """df with whether its key is among keys; false where it isn't or is null."""
    known = keys.select(*on).distinct().withColumn(flag, F.lit(True))
    return df.join(known, list(on), "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def dimension_key(facts: DataFrame, fact_column: str, dimension: DataFrame, natural: str, key: str, unknown: Column) -> DataFrame:
    """facts with the dimension's key, the Unknown member's where the natural key is missing or not found."""
    lookup = dimension.select(F.col(natural).alias("_natural"), F.col(key).alias(key))
    return facts.join(lookup, F.col(fact_column) == F.col("_natural"), "left").withColumn(key, F.coalesce(F.col(key), unknown)).drop("_natural")


def orphans(children: DataFrame, parents: DataFrame, child: str, parent: str) -> DataFrame:
    """Rows of children with a key that no parent has."""
    return children.where(F.col(child).isNotNull()).join(parents.select(F.col(parent).alias("_parent")), F.col(child) == F.col("_parent"), "left_anti")


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """df with the columns of a one-row frame (an aggregate without groups)."""
    return df.crossJoin(F.broadcast(one_row))
