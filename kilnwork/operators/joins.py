"""Joins that plain equi-joins do not cover: as-of, ranges, overlaps of intervals, stars of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

def group_stars(df: DataFrame, key: list[str], row_id: str) -> DataFrame:
    """first, row_id: each row of a group of two or more linked to the group's smallest id."""
    firsts = df.groupBy(*key).agg(F.min(row_id).alias("first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return df.join(firsts, key).filter(F.col(row_id) > F.col("first")).select("first", row_id)


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, bucket: Column) -> DataFrame:
    """Each left row with the last right ``value`` of its key at or before its time: no row pairs.

    Rows of a key are dealt over ``bucket``, a number that grows with the time, and each bucket is
    ordered by itself; what was last before it is carried over from the buckets before, so a key
    with many rows is no single task.
    """
    names = left.columns
    both = left.withColumn("_side", F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType)).unionByName(
        right.select(key, time, value).withColumn("_side", F.lit(0)), allowMissingColumns=True
    ).withColumn("_b", bucket)
    tails = both.groupBy(key, "_b").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(time))).alias("_tail"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(key, "_b", F.last("_tail", ignorenulls=True).over(before).alias("_carried"))
    w = Window.partitionBy(key, "_b").orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_key", F.col(key)).join(carried.withColumnRenamed(key, "_k"), F.col("_key").eqNullSafe(F.col("_k")) & (both["_b"] == carried["_b"])).drop(carried["_b"])
    last = F.coalesce(F.last(value, ignorenulls=True).over(w), F.col("_carried"))
    return found.withColumn(value, last).filter("_side = 1").select(*names, value)


def range_join(points: DataFrame, point: Column, ranges: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Points within [low, high): ranges are dealt over buckets of ``width`` that they touch, so
    that it is an equi-join on buckets."""
    touched = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    dealt = ranges.withColumn("_bucket", F.explode(touched))
    placed = points.withColumn("_point", point).withColumn("_bucket", F.floor(F.col("_point") / width))
    return placed.join(dealt, "_bucket").filter((F.col("_point") >= F.col(low)) & (F.col("_point") < F.col(high))).drop("_bucket", "_point")


def overlap_join(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], width: float) -> DataFrame:
    """Pairs of one ``key`` whose closed intervals overlap, each once; columns other than the key
    must differ. Intervals of a null end, or that end before they begin, overlap nothing.

    Time is cut into slots of ``width``. Two intervals overlap exactly if one begins within the
    other, so a pair belongs to the slot where the later one begins, and only the earlier one must
    be known there. Of that, an interval is listed in a slot as itself where it begins; a longer one
    is covered by blocks of slots whose lengths are powers of two, few of them whatever its length
    (a segment tree), and the later one looks up the blocks above its own slot. So long intervals
    are not copied to every slot they span, and a key with many rows is spread over its slots.
    """
    (l0, l1), (r0, r1) = left_span, right_span
    slot = lambda c: F.floor(F.col(c) / width).cast("long")
    left, right = left.filter(F.col(l0) <= F.col(l1)), right.filter(F.col(r0) <= F.col(r1))
    spans = left.agg(F.max(slot(l1) - slot(l0)).alias("m")).union(right.agg(F.max(slot(r1) - slot(r0))))
    levels = max(1, (spans.agg(F.max("m")).first()[0] or 0).bit_length() + 1)  # of blocks, two numbers reach the driver

    def covered(df: DataFrame, low: str, high: str) -> DataFrame:
        """A row for each block (level, number) of the cover of the slots low..high: at each level
        an odd first one and an even last one are blocks of their own, the rest goes a level up."""
        cover = F.expr(f"""aggregate(sequence(0, {levels}), named_struct('a', _a, 'b', _b, 'out', cast(array() as array<struct<l:int,x:bigint>>)),
            (s, l) -> IF(s.a > s.b, s, named_struct('a', shiftright(s.a + 1, 1), 'b', shiftright(s.b - 1, 1), 'out', concat(s.out, array_compact(array(
                IF(pmod(s.a, 2) = 1, named_struct('l', l, 'x', s.a), NULL), IF(pmod(s.b, 2) = 0, named_struct('l', l, 'x', s.b), NULL)))))), s -> s.out)""")
        return df.withColumns({"_a": slot(low), "_b": slot(high)}).withColumn("_c", F.explode(cover)).withColumns({"_l": F.col("_c.l"), "_x": F.col("_c.x")}).drop("_a", "_b", "_c")

    def above(df: DataFrame, low: str) -> DataFrame:
        """A row for each block above the slot where the interval begins."""
        return df.withColumn("_a", slot(low)).withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("_x", F.expr("shiftright(_a, _l)")).drop("_a")

    on = [key, "_l", "_x"]
    first = covered(left, l0, l1).join(above(right, r0), on).filter((F.col(r0) >= F.col(l0)) & (F.col(r0) <= F.col(l1)))
    second = covered(right, r0, r1).join(above(left, l0), on).filter((F.col(l0) > F.col(r0)) & (F.col(l0) <= F.col(r1)))
    return first.unionByName(second).drop("_l", "_x")
