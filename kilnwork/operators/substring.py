"""Texts that contain needles, as a join on the rarest gram of each needle.

A gram is a run of bytes of a text's UTF-8 (in which a needle's bytes stand exactly where the needle
stands). Each needle of eight bytes or more is met through one of its eight-byte grams, a shorter one
through grams of four, two or one. Texts are read once to count the grams of all needles, and once
for the one that each needle chose because fewest texts hold it; what they share is verified by the
whole needle. Needles are a table of any size: they are never collected, and a gram that many texts
hold is dealt over salts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.store import release, saved
from .skew import salted_lookup

#: Lengths of grams in bytes, the longest first.
SIZES = (8, 4, 2, 1)
#: Bits of the filter that grams of texts pass before they are counted or moved, at most (2 MB).
FILTER_BITS = 1 << 24
#: Bytes of a text that are worked on at a time.
BLOCK = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _place(grams: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Where a gram's bit is in a filter of ``bits`` (a power of two)."""
    h = (grams + np.uint64(size)) * _MIX
    return ((h ^ (h >> np.uint64(32))) * _MIX) >> np.uint64(65 - bits.bit_length())


def windows(data: bytes, size: int) -> np.ndarray:
    """Every run of ``size`` bytes as a number."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < size:
        return np.zeros(0, np.uint64)
    n = len(b) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out << np.uint64(8)) | b[i : i + n]
    return out


def grams_of(data: bytes, size: int, held: np.ndarray | None = None) -> np.ndarray:
    """Distinct grams of ``data``; with a filter (a bit for each place) only those that pass it."""
    parts = []
    for at in range(0, max(1, len(data)), BLOCK):
        w = windows(data[at : at + BLOCK + size - 1], size)
        if held is not None and len(w):
            p = _place(w, size, 8 * len(held))
            w = w[(held[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        parts.append(np.unique(w))
    return np.unique(np.concatenate(parts))


def _needle_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """at, size, gram and the gram's place of all grams of a needle, of the longest size that fits."""
    for batch in batches:
        for at, needle in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = needle.encode()
            size = next(s for s in SIZES if s <= len(data))
            grams = grams_of(data, size)
            places = _place(grams, size, FILTER_BITS).astype(np.int64)
            columns = [np.full(len(grams), at), np.full(len(grams), size, np.int32), grams.view("<i8"), places]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["at", "size", "gram", "place"])


def _filter(grams: DataFrame) -> bytes:
    """A bit for the place of every gram; other grams may share it."""
    place = F.col("place") + 1
    parts = grams.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()  # 4 KB each
    out = bytearray(FILTER_BITS // 8)
    for r in parts:
        out[(r.part - 1) * 4096 : r.part * 4096] = r.bits
    return bytes(out)


def _blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Places and bytes of neighbouring texts of about BLOCK bytes together; a longer one is alone."""
    places, held, size = [], [], 0
    for i, text in enumerate(texts):
        if not text.is_valid:
            continue
        data = text.as_py().encode()
        if held and size + len(data) > BLOCK:
            yield np.array(places), held
            places, held, size = [], [], 0
        places.append(i)
        held.append(data)
        size += len(data)
    if held:
        yield np.array(places), held


def _grams_of_all(texts: list[bytes], size: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``grams_of`` each of the texts that pass the filter: which text, and the gram."""
    if len(texts) == 1:
        grams = grams_of(texts[0], size, held)
        return np.zeros(len(grams), np.int64), grams
    w = windows(b"".join(texts), size)
    ends = np.cumsum([len(t) for t in texts])
    p = _place(w, size, 8 * len(held))
    at = np.flatnonzero((held[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1)
    of = np.searchsorted(ends, at, "right")
    inside = at + size <= ends[of]  # a run over two texts is in neither
    of, w = of[inside], w[at[inside]]
    order = np.lexsort((w, of))
    of, w = of[order], w[order]
    first = np.ones(len(w), bool)
    first[1:] = (of[1:] != of[:-1]) | (w[1:] != w[:-1])
    return of[first], w[first]


def _text_grams(shared, sizes: list[int]):
    """at (the text's row number), size, gram of what a text shares with the filter. Short texts are
    worked on together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for places, texts in _blocks(batch.column(1)):
                for size in sizes:
                    of, grams = _grams_of_all(texts, size, held)
                    if len(grams):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places[of])), pa.array(np.full(len(grams), size, np.int32)), pa.array(grams.view("<i8"))], ["at", "size", "gram"])

    return run


def contains_pairs(texts: DataFrame, text_id: str, text: str, needles: DataFrame, needle_id: str, needle: str) -> DataFrame:
    """text_id, needle_id of every text that contains a needle, once for each row of either side.

    An empty needle is in every text, a null one in none; null texts contain nothing. Only texts that
    hold a chosen gram are moved, once. Empty tables give no rows.
    """
    spark = texts.sparkSession
    texts = saved(texts.select(F.col(text_id).alias("id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("at")).filter("text is not null"), "texts")
    spelled = needles.select(F.col(needle_id).alias("needle_id"), F.col(needle).cast("string").alias("needle"), F.monotonically_increasing_id().alias("n_at")).filter("needle is not null")
    spelled = saved(spelled, "needles")
    grams = saved(spelled.filter("needle != ''").select("n_at", "needle").mapInArrow(_needle_grams, "at long, size int, gram long, place long"), "grams")
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # of SIZES
    out = spark.createDataFrame([], f"{text_id} {texts.schema['id'].dataType.simpleString()}, {needle_id} {spelled.schema['needle_id'].dataType.simpleString()}")
    if sizes:
        found = _text_grams(spark.sparkContext.broadcast(_filter(grams)), sizes)
        counted = texts.select("at", "text").mapInArrow(found, "at long, size int, gram long").groupBy("size", "gram").agg(F.count("*").alias("n"))
        # a needle with a gram that no text holds is in none
        held = grams.join(counted, ["size", "gram"], "left").groupBy("at").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "size", "gram", "place")).alias("x"))
        chosen = saved(held.filter("x.n > 0").select(F.col("at").alias("n_at"), "x.*"), "chosen")
        found = _text_grams(spark.sparkContext.broadcast(_filter(chosen)), sizes)
        hits = saved(texts.select("at", "text").mapInArrow(found, "at long, size int, gram long"), "hits")
        keys = chosen.groupBy("size", "gram").agg(F.max("n").alias("n"))  # n: texts with the gram
        met = salted_lookup(hits, keys, ["size", "gram"], "n", "at").select("size", "gram", "at")
        pairs = met.join(chosen.select("size", "gram", "n_at"), ["size", "gram"]).join(spelled, "n_at").select("at", "needle_id", "needle")
        inside = texts.select("at", "id", "text").join(pairs, "at").filter(F.contains("text", "needle"))
        out = out.union(inside.select("id", "needle_id"))
        release(grams)
    empty = spelled.filter("needle = ''").select("needle_id")
    if not empty.isEmpty():  # the result itself holds every text for each of these
        salts = 64
        dealt = empty.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = out.union(texts.select("id", F.pmod(F.xxhash64("at"), F.lit(salts)).cast("int").alias("salt")).join(dealt, "salt").select("id", "needle_id"))
    return out
