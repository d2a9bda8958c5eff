"""Rates, means, histograms and group reports over flags and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .sequence import ranked


def or_unknown(key: Column) -> Column:
    return F.coalesce(F.nullif(key.cast("string"), F.lit("")), F.lit("unknown"))


def rate(flag: Column, digits: int = 4) -> Column:
    """Share of rows with the flag, half-even; a missing flag counts as false, no rows as 0."""
    return F.bround(F.coalesce(F.avg(F.coalesce(flag, F.lit(False)).cast("int")), F.lit(0.0)), digits)


def mean(value: Column, digits: int = 4) -> Column:
    return F.bround(F.coalesce(F.avg(F.coalesce(value.cast("double"), F.lit(0.0))), F.lit(0.0)), digits)


def counts_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(or_unknown(F.col(key)).alias(key)).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, and its values with counts as ``value=n`` in order of the values. ``value`` is a class
    of few values (a kind of failure, a reason), as a key's counts become one text."""
    counted = df.groupBy(key, value).agg(F.count("*").alias("n"))
    told = F.concat_ws("=", value, F.col("n").cast("string"))
    return counted.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(told)), ",").alias("histogram"))


def duplicate_groups(df: DataFrame, key: Column, row_id: str, least: int = 2) -> DataFrame:
    """key, n, first_id, last_id of each group of different ids; members stay in their rows."""
    return df.groupBy(key.alias("key")).agg(F.count_distinct(row_id).alias("n"), F.min(row_id).alias("first_id"), F.max(row_id).alias("last_id")).filter(F.col("n") >= least)


def first_non_empty(df: DataFrame, key: str, order: list, columns: list[str]) -> DataFrame:
    """Per key, each column's first value in ``order`` that is not null or empty."""
    picks = [F.min(F.when(F.length(F.col(c).cast("string")) > 0, F.struct(*order, F.col(c).alias("_v")))).getField("_v").alias(c) for c in columns]
    return df.groupBy(key).agg(*picks)


def deltas(before: DataFrame, after: DataFrame, key: str, count: str) -> DataFrame:
    both = before.select(key, F.col(count).alias("_b")).join(after.select(key, F.col(count).alias("_a")), key, "full")
    return both.select(key, (F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))).alias("delta"))


def group_advantage(df: DataFrame, key: str, reward: str, eps: float = 1e-6) -> DataFrame:
    """Reward against its group: (r - mean) / (sd + eps); groups of one value are left out. The
    groups' sums are aggregated first and joined, so that no group is held in one task."""
    stats = df.groupBy(key).agg(F.avg(reward).alias("_m"), F.stddev_pop(reward).alias("_s"), F.min(reward).alias("_lo"), F.max(reward).alias("_hi")).filter("_lo < _hi")
    return df.join(stats, key).withColumn("advantage", (F.col(reward) - F.col("_m")) / (F.col("_s") + eps)).drop("_m", "_s", "_lo", "_hi")


def every_nth_split(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """Adds split: every n-th distinct key in order is eval, and all its rows with it; with more
    than one key but none to eval, the last one is. Only distinct keys are ranked, by ranges."""
    keys = ranked(df.select(key).distinct(), [F.col(key)], "_place")
    count = keys.agg(F.count("*").alias("_n"))
    split = F.when(F.col("_place") % n == n - 1, "eval").when((F.col("_n") < n) & (F.col("_n") > 1) & (F.col("_place") == F.col("_n") - 1), "eval").otherwise("train")
    return df.join(keys.join(F.broadcast(count)).select(key, split.alias("split")), key)  # one row
