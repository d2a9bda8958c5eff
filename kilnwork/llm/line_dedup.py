"""Op 5: drop lines that many documents share, but for one document that keeps each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .skew import salted_lookup
from ..sources.store import saved

#: Stripped at both ends of a line.
BLANK = " \t\n\x0b\x0c\r"


def with_key(rows: DataFrame, min_chars: int) -> DataFrame:
    """Rows with a column key: their ``line`` without blanks at its ends and with A-Z in lower case;
    lines whose key has fewer than ``min_chars`` code points go. Most lines are ASCII without blanks
    at their ends, which needs no search for single characters."""
    ends = reduce(Column.__or__, (F.col("line").startswith(x) | F.col("line").endswith(x) for x in BLANK))
    bare = rows.filter(F.length("line") >= min_chars).withColumn("line", F.when(ends, F.btrim("line", F.lit(BLANK))).otherwise(F.col("line")))
    ascii_only = F.octet_length("line") == F.length("line")
    low = F.when(ascii_only, F.lower("line")).otherwise(F.translate("line", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return bare.filter(F.length("line") >= min_chars).withColumn("key", low)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _reassembled(text: Column, gone: Column) -> Column:
    """The lines of ``text`` whose positions are not in ``gone``, joined in order. The outer
    transform binds the lines once."""
    def join(lines):
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(left, lambda at: F.get(lines, at)), "\n")

    return F.transform(F.array(lines_of(text)), join)[0]


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text`` replaced by its kept lines, and n_lines, n_dropped.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents loses all its
    lines but those of the largest doc_id that holds it. A null text is one empty line and becomes
    an empty text. Rows that repeat a doc_id count as one document, and each loses its own lines. A
    row without doc_id counts for no key and keeps all its lines. Texts of any length are read
    whole. Columns n_lines and n_dropped of ``docs`` are replaced; others pass unchanged. An empty
    table stays empty.

    Lines are exploded with their positions and a 128-bit hash of their key; documents are counted
    per hash, and only positions of dropped lines go back to their text.
    """
    text = F.col("text").cast("string")
    exploded = docs.filter("doc_id is not null").select("doc_id", F.xxhash64(text).alias("_h"), F.posexplode(lines_of(text)).alias("pos", "line"))
    held = saved(with_key(exploded, min_chars).select("doc_id", "_h", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"), F.monotonically_increasing_id().alias("at")), "lines")
    shared = held.groupBy("k1", "k2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"), F.count("*").alias("held")).filter(F.col("n") >= min_docs)
    shared = saved(shared, "shared")
    drops = salted_lookup(held, shared, ["k1", "k2"], "held", "at").filter("doc_id != keeper")
    drops = drops.groupBy("doc_id", "_h").agg(F.collect_set("pos").alias("_gone"))  # at most the lines of a document

    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select("doc_id", F.xxhash64(text).alias("_h"), text.alias("text"), F.struct(*(c for c in columns if c != "text"), F.lit(None).alias("_kilnwork")).alias("_row"))
    joined = rows.join(drops, ["doc_id", "_h"], "left")
    kept = F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(_reassembled(F.col("text"), F.col("_gone")))
    return joined.select(
        *(kept.alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in columns),
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
