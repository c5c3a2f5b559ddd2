"""Structural checks of record tables: one row per violation, as filters and joins.

Issues: check, key, column, value. A check on an empty table finds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _issues(rows: DataFrame, check: str, key: str, column: str, value: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.col(key).cast("string").alias("key"), F.lit(column).alias("column"), value.cast("string").alias("value"))


def blank(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Null or blank values of required ``columns``."""
    empty = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    return reduce(DataFrame.unionByName, (_issues(df.where(empty(c)), "blank", key, c, F.col(c)) for c in columns))


def absent(df: DataFrame, key: str, record: str, required: Sequence[str]) -> DataFrame:
    """Required names that a map column ``record`` does not have; a null map has none."""
    names = F.coalesce(F.map_keys(record), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*map(F.lit, required)), names)
    rows = df.select(F.col(key), F.explode(missing).alias("name"))
    return rows.select(F.lit("absent").alias("check"), F.col(key).cast("string").alias("key"), F.lit(record).alias("column"), F.col("name").alias("value"))


def duplicated(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    rows = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return _issues(rows, "duplicated", key, key, F.col("n"))


def outside(df: DataFrame, key: str, column: str, allowed: Sequence[str]) -> DataFrame:
    """Non-null values that are none of ``allowed``."""
    return _issues(df.where(~F.col(column).isin(*allowed)), "outside", key, column, F.col(column))


def unknown(df: DataFrame, key: str, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """Non-null values of ``column`` that ``known`` does not have."""
    have = known.select(F.col(known_column).alias("known_value")).where("known_value is not null").distinct()
    rows = df.where(F.col(column).isNotNull()).join(have, F.col(column) == F.col("known_value"), "left_anti")
    return _issues(rows, "unknown", key, column, F.col(column))


def unequal(df: DataFrame, key: str, column: str, other: DataFrame, other_key: str, other_column: str) -> DataFrame:
    """Values that differ from those stored under the same key in ``other``, such as pinned hashes."""
    stored = other.select(F.col(other_key).alias("other_key"), F.col(other_column).alias("stored_value")).distinct()
    rows = df.join(stored, F.col(key) == F.col("other_key")).where(F.col(column) != F.col("stored_value"))
    return _issues(rows, "unequal", key, column, F.concat_ws(" ", F.col(column).cast("string"), F.col("stored_value").cast("string")))


def all_issues(*issues: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


def strict(issues: DataFrame, shown: int = 20) -> None:
    """Raises with the first ``shown`` issues if there are any."""
    rows = issues.orderBy("check", "column", "key").limit(shown).collect()
    if rows:
        raise ValueError("; ".join(f"{r['check']} {r['column']} of {r['key']}: {r['value']}" for r in rows))


def pages(spec: Column, total: Column) -> Column:
    """The pages of a specification such as ``1,3-5``: sorted, once each, none beyond ``total``."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    first = lambda p: F.regexp_extract(p, r"^(\d+)", 1).cast("int")
    last = lambda p: F.regexp_extract(p, r"(\d+)$", 1).cast("int")
    ranges = F.filter(parts, lambda p: p.rlike(r"^\d+(\s*-\s*\d+)?$") & (first(p) <= last(p)))
    every = F.flatten(F.transform(ranges, lambda p: F.sequence(F.greatest(first(p), F.lit(1)), F.greatest(F.least(last(p), total), first(p), F.lit(1)))))
    return F.array_sort(F.array_distinct(F.filter(every, lambda n: (n >= 1) & (n <= total))))
