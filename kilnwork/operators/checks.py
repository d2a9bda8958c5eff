"""Constraint checks: each gives the violations as rows, or the reasons as a column."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def citation_reasons(cites: DataFrame, cite: str, files: DataFrame) -> DataFrame:
    """Adds reason: why a citation ``file:line`` holds nothing, empty if it does. ``files``: file,
    n (its lines)."""
    pattern = r"^([^:]+):(\d+)$"
    split = cites.withColumn("_file", F.when(F.col(cite).rlike(pattern), F.regexp_extract(cite, pattern, 1))).withColumn("_line", F.regexp_extract(cite, pattern, 2).try_cast("long"))
    joined = split.join(files.select(F.col("file").alias("_file"), F.col("n").alias("_n"), F.lit(True).alias("_there")), "_file", "left")
    reason = F.when(F.col("_file").isNull(), "format").when(F.col("_there").isNull(), "no file").when(~F.col("_line").between(1, F.col("_n")), "no line").otherwise("")
    return joined.withColumn("reason", reason).drop("_file", "_line", "_n", "_there")


def is_missing(value: Column) -> Column:
    """Null or an empty text."""
    return value.isNull() | (value.cast("string") == "")


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, missing: one row per column, from one pass."""
    counts = df.agg(*(F.count_if(is_missing(F.col(c))).alias(c) for c in columns))
    return counts.unpivot([], columns, "field", "missing")


def row_errors(rules: Mapping[str, Column]) -> Column:
    """The messages of all rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(bad, F.lit(message)) for message, bad in rules.items())))


def unknown_keys(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key), key, "left_anti")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def gate(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One row: each check over all rows, and whether all passed. An empty table passes."""
    each = df.agg(*(F.coalesce(F.bool_and(c), F.lit(True)).alias(n) for n, c in checks.items()))
    return each.withColumn("passed", reduce(lambda a, b: a & b, (F.col(n) for n in checks)))


def not_shrunk(before: DataFrame, now: DataFrame, key: str, count: str) -> DataFrame:
    """Keys whose count is smaller now than in the snapshot."""
    both = before.select(key, F.col(count).alias("before")).join(now.select(key, F.col(count).alias("now")), key, "left")
    return both.filter(F.col("before") > F.coalesce("now", F.lit(0)))


def presence_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, present: rows that have a value in each column, from one pass."""
    counts = df.agg(*(F.count_if(~is_missing(F.col(c))).alias(c) for c in columns))
    return counts.unpivot([], columns, "field", "present")


def resolve_summary(results: DataFrame, resolved: Column, failed: Column) -> DataFrame:
    """One row: total, resolved, unresolved, error_count and the share resolved (0 without rows)."""
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    n = results.agg(F.count("*").alias("total"), yes(resolved).alias("resolved"), yes(failed).alias("error_count"))
    rate = F.bround(F.col("resolved") / F.greatest(F.col("total"), F.lit(1)), 4)
    return n.select("total", "resolved", (F.col("total") - F.col("resolved")).alias("unresolved"), "error_count", rate.alias("resolve_rate"))


def check_report(checks: Mapping[str, DataFrame]) -> DataFrame:
    """name, passed of each check (a table of one column passed and one row), and ``overall``."""
    each = reduce(DataFrame.union, (df.select(F.lit(name).alias("name"), "passed") for name, df in checks.items()))
    return each.union(each.agg(F.bool_and("passed").alias("passed")).select(F.lit("overall"), "passed"))
