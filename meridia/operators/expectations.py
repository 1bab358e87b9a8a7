"""Data quality: each expectation is a DataFrame of violations, empty where it holds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """Values that more than one row has; rows with a null in them don't count."""
    present = df
    for c in columns:
        present = present.filter(F.col(c).isNotNull())
    return present.groupBy(*columns).count().filter("count > 1")


def accepted(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(list(values)))


def relationship(df: DataFrame, column: str, parent: DataFrame, parent_column: str, where: Column | None = None) -> DataFrame:
    """Rows whose value no parent has; nulls are not held against it."""
    child = df.filter(F.col(column).isNotNull())
    if where is not None:
        child = child.filter(where)
    return child.join(parent.select(F.col(parent_column).alias(column)).distinct(), column, "left_anti")


def holds(df: DataFrame, rule: Column) -> DataFrame:
    """Rows for which a rule is false or can't be told."""
    return df.filter(~F.coalesce(rule, F.lit(False)))


def between(df: DataFrame, column: str, low: float, high: float, nulls: bool = False) -> DataFrame:
    inside = F.col(column).between(low, high)
    return holds(df, inside | F.col(column).isNull() if nulls else inside)


def rows_per_key(df: DataFrame, keys: Iterable[str], n: int, parent: DataFrame | None = None) -> DataFrame:
    """Keys that have not exactly n rows; with a parent, keys without rows count too."""
    keys = list(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if parent is not None:
        counts = parent.select(*keys).distinct().join(counts, keys, "left")
    return counts.filter(F.coalesce("n", F.lit(0)) != n)


def row_count(df: DataFrame, n: int, *distinct: str) -> DataFrame:
    """One row if the count of rows, or of distinct values of columns, is not n."""
    what = F.count_distinct(F.struct(*distinct)) if distinct else F.count(F.lit(1))
    return df.agg(what.alias("n")).filter(F.col("n") != n)


def share_at_most(df: DataFrame, hit: Column, most: float) -> DataFrame:
    """One row if the share of rows that hit is over the limit; no rows, no violation."""
    return df.agg((F.count_if(hit) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("share")).filter(F.col("share") > most)


def same(a: DataFrame, b: DataFrame, keys: Iterable[str], column: str, tolerance: float = 0.0) -> DataFrame:
    """Keys for which two ways of computing a column disagree; a missing key or null on one side does."""
    keys = list(keys)
    both = a.select(*keys, F.col(column).alias("x"), F.lit(True).alias("in_a")).join(b.select(*keys, F.col(column).alias("y"), F.lit(True).alias("in_b")), keys, "full")
    missing = F.col("in_a").isNull() | F.col("in_b").isNull()
    differs = ~F.col("x").eqNullSafe(F.col("y")) if not tolerance else (F.col("x").isNull() != F.col("y").isNull()) | (F.abs(F.col("x") - F.col("y")) > tolerance)
    return both.filter(missing | F.coalesce(differs, F.lit(False)))


def distinct_from(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose two columns differ, a null being equal to a null and to nothing else."""
    return df.filter(~F.col(a).eqNullSafe(F.col(b)))


def row_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule: its name and how many rows break it, in one pass over the rows.

    A rule is a condition that holds; where it can't be told it is broken.
    """
    counts = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"r{i}") for i, rule in enumerate(rules.values())])
    pairs = F.array(*[F.struct(F.lit(name).alias("expectation"), F.col(f"r{i}").alias("violations")) for i, name in enumerate(rules)])
    return counts.select(F.inline(pairs))


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """A row for each expectation: its name and how many violations there are."""
    rows = [v.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("expectation"), "violations") for name, v in checks.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
