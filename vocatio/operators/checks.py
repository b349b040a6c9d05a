"""Data-quality checks in place of a database's constraints: each gives the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with ``n``."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def nulls(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, n: how many nulls each column has, where any."""
    counts = rows.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(c, F.lit(0)).alias("n")) for c in columns]))
    return counts.select(pairs.alias("p")).select("p.*").where("n > 0")


def orphans(child: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of the child that the parent lacks; nulls reference nothing."""
    there = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))
    return child.where(there).select(*key).distinct().join(parent.select(*key).distinct(), key, "left_anti")


def not_accepted(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """value, n: values outside the list; null is accepted."""
    return rows.where(~F.col(column).isin(*values)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
