"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of one key that one task may meet, and the most hot keys that a broadcast may hold.
KEY_ROWS, HOT_KEYS = 256, 65_536


def salted_lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, spread: str | list[str], how: str = "inner", total: int | None = None) -> DataFrame:
    """Join ``rows`` with ``table`` (one row per key, ``weight`` = how many rows have that key).

    A key with more rows than ``cap`` is dealt over several salts by the columns ``spread``, which
    should differ from row to row (a row number, not an id that rows may repeat), and its table row
    is repeated once per salt. As the weights sum to the rows, at most rows / cap keys are hot;
    ``cap`` grows with the rows so that the broadcast list of hot keys never exceeds HOT_KEYS.
    """
    if total is None:  # at least the sum of the weights
        total = table.agg(F.sum(weight)).first()[0] or 0
    cap = max(KEY_ROWS, -(-total // HOT_KEYS))
    splits = F.ceil(F.col(weight) / F.lit(cap)).cast("int")
    hot = table.filter(F.col(weight) > cap).select(*keys, splits.alias("_splits"))
    spread = [spread] if isinstance(spread, str) else spread
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_splits").cast("long")), F.lit(0)).cast("int")
    )
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(splits, F.lit(1)) - 1)))
    return dealt.drop("_splits").join(repeated, [*keys, "_salt"], how).drop("_salt")
