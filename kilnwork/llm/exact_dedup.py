"""Op 4: exact dedup over an extendible-hash index on shared files. DataFrame functions only.

One pass over the texts writes the index's entries (id, 64-bit key, digest, normalised text) to the
shared folder. A directory over the top bits of the key doubles until no bucket holds more entries
than its capacity, so a bucket is a range of keys. A bucket that no bit can split, as one key has
most of its entries, gets overflow pages. Each page is dealt to one owner task, which chains the
entries of a key and compares their texts byte by byte; pages of one bucket are merged after that.
Only texts whose key occurs again are brought to the owners.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .skew import salted_lookup
from ..sources.store import saved

#: Bits of the key that the directory may use, and a bucket's capacity in entries at least.
DIRECTORY_BITS, BUCKET_ROWS = 16, 256
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text):
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def split_directory(histogram: dict[int, int], capacity: int, bits: int = DIRECTORY_BITS) -> list[tuple[int, int, int]]:
    """(prefix, local depth, entries) of each bucket. Starting from one bucket, an overfull one
    splits on its next bit; where its depth equals the directory's, the directory doubles first. At
    ``bits`` a bucket stays overfull. ``histogram``: entries by the top ``bits`` of their keys."""
    sums = [dict(histogram)]  # sums[d]: entries by their top bits - d
    for _ in range(bits):
        half: dict[int, int] = {}
        for k, n in sums[-1].items():
            half[k >> 1] = half.get(k >> 1, 0) + n
        sums.append(half)
    buckets, todo = [], [(0, 0)]
    while todo:
        prefix, depth = todo.pop()
        n = sums[bits - depth].get(prefix, 0)
        if depth < bits and n > capacity:
            todo += [(prefix * 2 + 1, depth + 1), (prefix * 2, depth + 1)]
        else:
            buckets.append((prefix, depth, n))
    return buckets


def _placed(entries: DataFrame, key_bits: int, bucket_rows: int) -> DataFrame:
    """``entries`` with the bucket that the directory gives their key, and a page of it."""
    top = F.pmod(F.shiftright("_key", max(0, key_bits - DIRECTORY_BITS)), F.lit(1 << DIRECTORY_BITS)).cast("int")
    # at most 2 ** DIRECTORY_BITS counts reach the driver, and as many directory entries are broadcast
    histogram = {r[0]: r[1] for r in entries.groupBy(top.alias("top")).count().collect()}
    capacity = max(bucket_rows, -(-sum(histogram.values()) // (1 << DIRECTORY_BITS - 2)))
    owners = [
        (prefix << DIRECTORY_BITS - depth, (prefix + 1 << DIRECTORY_BITS - depth) - 1, b, max(1, -(-n // capacity)))
        for b, (prefix, depth, n) in enumerate(split_directory(histogram, capacity))
    ]
    directory = entries.sparkSession.createDataFrame(owners, "low int, high int, bucket int, _pages int")
    directory = directory.select(F.explode(F.sequence("low", "high")).alias("_top"), "bucket", "_pages")
    return entries.withColumn("_top", top).join(F.broadcast(directory), "_top").withColumn("_page", F.pmod(F.xxhash64("_at"), F.col("_pages").cast("long"))).drop("_top")


def exact_dedup(docs: DataFrame, key_bits: int = 64, bucket_rows: int = BUCKET_ROWS, digest: Callable[[Column], Column] = lambda t: F.sha2(t, 256)) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, bucket.

    Texts equal after white space is normalised form a group; the smallest doc_id of a group stays.
    Rows that repeat a doc_id and its text share that verdict and all count in group_size. A null
    doc_id never stays if its group has another one. Null and empty texts are equal; texts of any
    length are read whole. An empty table gives an empty result; extra columns are left out.
    ``key_bits`` shortens the key and ``digest`` replaces SHA-256, for tests of colliding chains:
    texts are equal by their bytes, whatever key and digest say.
    """
    entries = docs.select("doc_id", normalised(F.col("text")).alias("_norm"))
    entries = entries.select("doc_id", "_norm", F.shiftright(F.xxhash64("_norm"), 64 - key_bits).alias("_key"), digest(F.col("_norm")).alias("text_sha256"), F.monotonically_increasing_id().alias("_at"))
    entries = _placed(saved(entries, "entries"), key_bits, bucket_rows)

    # owners count their keys; the pages of a bucket are added up
    met = entries.select("bucket", "_page", "_key").repartition("bucket", "_page").groupBy("bucket", "_page", "_key").agg(F.count("*").alias("n"))
    again = saved(met.groupBy("bucket", "_key").agg(F.sum("n").alias("n")).filter("n > 1"), "again")

    # chains of the keys that occur again, told apart by their bytes
    members = salted_lookup(entries, again, ["bucket", "_key"], "n", "_at").select("bucket", "_page", "_pages", "_key", "text_sha256", "_norm", "doc_id").repartition("bucket", "_page")
    links = ["bucket", "_key", "text_sha256", "_norm"]
    owned = members.groupBy(*links, "_page", "_pages").agg(F.count("*").alias("n"), F.min("doc_id").alias("keep_id"))
    owned = saved(owned, "owned")
    merged = owned.filter("_pages > 1").groupBy(*links).agg(F.sum("n").alias("n"), F.min("keep_id").alias("keep_id"))
    chains = saved(owned.filter("_pages = 1").select(*links, "n", "keep_id").union(merged), "chains")

    # rows find their link of the chain by the digest, or by the text where two links share one
    by_digest = chains.groupBy("bucket", "_key", "text_sha256").agg(F.sum("n").alias("n"), F.min("keep_id").alias("keep_id"), F.count("*").alias("_links"))
    by_digest = saved(by_digest, "links")
    row = ["doc_id", "bucket", "_key", "text_sha256", "_at"]
    found = salted_lookup(entries.select(*row), by_digest, ["bucket", "_key", "text_sha256"], "n", "_at", "left")
    out = found.filter("_links is null or _links = 1")
    twins = by_digest.filter("_links > 1").select("bucket", "_key", "text_sha256")
    if not twins.isEmpty():
        mixed = entries.select(*row, "_norm").join(twins, ["bucket", "_key", "text_sha256"], "left_semi")
        told = salted_lookup(mixed, chains.join(twins, ["bucket", "_key", "text_sha256"], "left_semi"), links, "n", "_at")
        out = out.drop("_links").unionByName(told.drop("_norm"))
    single = F.col("n").isNull()
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (single | F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())).alias("kept"),
        "text_sha256",
        "bucket",
    )
