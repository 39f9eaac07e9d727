"""Checks that return the rows which break a rule, and one that makes them an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A table breaks a rule it has to keep."""


def assert_empty(violations: DataFrame, message: str, shown: int = 5) -> None:
    """Raises if there are violations; only a few of them reach the driver."""
    rows = violations.limit(shown).collect()
    if rows:
        raise CheckFailed(f"{message}: {', '.join(map(str, rows))}")


def assert_some(df: DataFrame, message: str) -> DataFrame:
    """The table itself, if it has a row."""
    if df.isEmpty():
        raise CheckFailed(message)
    return df


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once or are null, with their number."""
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return grouped.where((F.col("n") > 1) | missing)


def dependency_conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with several values where there may be one only."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values"), F.count(F.lit(1)).alias("n_rows")).where("n_values > 1")


def out_of_range(df: DataFrame, columns: tuple[str, ...], low: float = 0.0, high: float = 1 + 1e-9) -> DataFrame:
    """Rows with a value that is not finite or lies outside the bounds; null is not judged."""
    bad: Column = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(F.isnan(c) | ~F.col(c).between(low, high), F.lit(False))
    return df.where(bad)


def missing_and_unexpected(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one table only."""
    e, a = expected.select(key).distinct().withColumn("e", F.lit(True)), actual.select(key).distinct().withColumn("a", F.lit(True))
    both = e.join(a, key, "full_outer").where(F.col("e").isNull() | F.col("a").isNull())
    return both.select(key, F.when(F.col("a").isNull(), "missing").otherwise("unexpected").alias("side"))
