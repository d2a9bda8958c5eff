"""Op 12: spelling variants over a forward and a reversed sorted dictionary.

One inserted, deleted or replaced code point leaves a half of a word intact: of two near words, the
shorter of m code points, the common prefix or the common suffix has at least floor(m / 2). So each
word stands in a forward dictionary by its leading half and in a reversed one by its trailing half,
and near words are in one block (a range) of one of them. A block with many words is subdivided by
the same argument on what is still open between its prefix and its suffix, until it is small or one
code point is open. A block of a single open code point is bounded by the alphabet. Ranges are then
scanned, and pairs verified by their common prefix and suffix.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .skew import salted_lookup
from ..sources.store import release, saved

#: Words of a block that is scanned as it is; larger ones are subdivided.
BLOCK_WORDS = 256
#: Distinct words that a task counts before it hands them on, and code points compared at a time.
HELD_WORDS, CELLS = 200_000, 1 << 22
_RUN = re.compile(rb"[A-Za-z\xC0-\xFF]+")


def _altered(word: bytes, crc: int, every: int) -> bytes:
    """``word`` (Latin-1), or without one code point where ``every`` divides the checksum that goes
    on from ``crc`` over its UTF-8."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), crc)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _counter(least: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], ["word", "n"])

        held: Counter[bytes] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):  # one text at a time outside of Arrow
                crc = zlib.crc32(f"{doc_id.as_py() or ''}:".encode())
                # a code point outside of Latin-1 is in no run, and becomes a question mark
                runs = Counter(_RUN.findall((text.as_py() or "").encode("latin-1", "replace").lower()))
                for word, n in runs.items():
                    if len(word) >= least and len(own := _altered(word, crc, every)) >= least:
                        held[own] += n
                if len(held) > HELD_WORDS:
                    yield made()
                    held.clear()
        if held:
            yield made()

    return run


def word_counts(docs: DataFrame, least: int = 5, every: int = 97) -> DataFrame:
    """word, n: runs of Latin letters of at least ``least`` code points, A-Z lower-cased, over whole
    texts. A run loses a code point where ``every`` divides the CRC-32 of ``<doc_id>:<run>`` (a null
    id: empty). Counted in each task before they are shuffled."""
    held = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(_counter(least, every), "word string, n long")
    return held.groupBy("word").agg(F.sum("n").alias("n"))


def _children(entries: DataFrame) -> DataFrame:
    """Each entry in two sub-blocks: with a longer prefix, and with a longer suffix. ``below`` keeps
    a pair out of the second one if it is in the first (its common prefix reaches that far)."""
    step = F.floor((F.col("m") - F.col("lo") - F.col("hi")) / 2).cast("int")
    lead = F.struct(F.concat("path", F.lit("p")).alias("path"), (F.col("lo") + step).alias("lo"), F.col("hi").alias("hi"), F.col("below").alias("below"))
    tail = F.struct(F.concat("path", F.lit("s")).alias("path"), F.col("lo").alias("lo"), (F.col("hi") + step).alias("hi"), F.least("below", F.col("lo") + step).alias("below"))
    out = entries.select("word", "n", "m", F.explode(F.array(lead, tail)).alias("x")).select("word", "n", "m", "x.*")
    return out.withColumn("head", F.expr("substring(word, 1, lo)")).withColumn("tail", F.expr("substring(reverse(word), 1, hi)"))


def dictionary_blocks(words: DataFrame, least: int, block_words: int) -> list[DataFrame]:
    """Saved tables of entries (word, n, m, path, lo, hi, below, head, tail) whose blocks (path, m,
    head, tail) have two words or more, and at most ``block_words`` unless one code point is open."""
    size = F.length("word")
    entries = words.select("word", "n", F.explode(F.array_distinct(F.array(size, F.greatest(size - 1, F.lit(least))))).alias("m"))
    entries = entries.select("word", "n", "m", F.lit("").alias("path"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), (F.col("m") + 1).alias("below"))
    block, ready = ["path", "m", "head", "tail"], []
    while True:
        entries = saved(_children(entries), "entries")
        counts = entries.groupBy(*block).agg(F.count("*").alias("size"), F.max("lo").alias("_lo"), F.max("hi").alias("_hi")).filter("size > 1")
        counts = counts.select(*block, "size", ((F.col("size") > block_words) & (F.col("m") - F.col("_lo") - F.col("_hi") > 1)).alias("large"))
        placed = saved(salted_lookup(entries, saved(counts, "blocks"), block, "size", "word"), "placed")
        release(entries)
        ready.append(placed)
        entries = placed.filter("large").select("word", "n", "m", "path", "lo", "hi", "below")
        if entries.isEmpty():
            return ready


def _matrix(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def near_pairs(words: list[bytes], m: int, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j of the near words (Latin-1) whose shorter one has ``m`` code points and whose
    common prefix is shorter than ``below``."""
    short = np.array([i for i, w in enumerate(words) if len(w) == m], dtype=np.int64)
    long = np.array([i for i, w in enumerate(words) if len(w) == m + 1], dtype=np.int64)
    if not len(short):
        return short, short
    a = _matrix([words[i] for i in short])
    found = []
    for other, b in ((short, a), (long, _matrix([words[i] for i in long]) if len(long) else None)):
        if b is None:
            continue
        rows = max(1, CELLS // (m * len(b)))
        for at in range(0, len(a), rows):
            lead = a[at : at + rows, None, :] == b[None, :, :m]
            common = np.logical_and.accumulate(lead, axis=2).sum(axis=2)
            if other is short:
                near = (m - lead.sum(axis=2) == 1) & (np.arange(at, at + len(lead))[:, None] < np.arange(len(b))[None, :])
            else:
                trail = a[at : at + rows, None, ::-1] == b[None, :, :0:-1]
                near = common + np.logical_and.accumulate(trail, axis=2).sum(axis=2) >= m
            i, j = np.nonzero(near & (common < below))
            found.append((short[i + at], other[j]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come as ranges of sorted entries; one that spans batches is carried on."""

    def made(block: list[tuple]) -> pa.RecordBatch:
        words, n = [x[2].encode("latin-1") for x in block], np.array([x[3] for x in block], dtype=np.int64)
        i, j = near_pairs(words, block[0][1][1], block[0][4])
        one, two = np.concatenate([i, j]), np.concatenate([j, i])
        own = pa.array([x[2] for x in block], pa.string())
        return pa.RecordBatch.from_arrays([own.take(pa.array(one)), own.take(pa.array(two)), pa.array(n[two])], ["word", "near", "near_n"])

    block: list[tuple] = []
    for batch in batches:
        path, m, head, tail, word, n, below = (batch.column(c).to_pylist() for c in ("path", "m", "head", "tail", "word", "n", "below"))
        for row in zip(path, zip(path, m, head, tail), word, n, below):
            if block and row[1] != block[0][1]:
                if len(block) > 1:
                    yield made(block)
                block = []
            block.append(row)
    if len(block) > 1:
        yield made(block)


def near_words(words: DataFrame, least: int = 5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, near, near_n: every pair of near words, once in each direction. ``words``: word, n."""
    key, out = ["path", "m", "head", "tail"], None
    for table in dictionary_blocks(words, least, block_words):
        entries = table.filter("not large").select(*key, "word", "n", "below")
        pairs = entries.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_scan, "word string, near string, near_n long")
        out = pairs if out is None else out.union(pairs)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that forms lead to. Each turn halves the way, as a form has at
    least twice its word's n."""
    ways = saved(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        more = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        out = saved(ways.join(more, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "ways")
        release(ways)
        if out.filter("moved").isEmpty():
            return out.drop("moved")
        ways = out.drop("moved")


def spelling_groups(docs: DataFrame, least: int = 5, occurrences: int = 3, ratio: int = 2, every: int = 97, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per word with at least ``least`` code points and ``occurrences`` in all texts: word,
    n, n_near, form, form_n, root.

    A word's form is its near word (one inserted, deleted or replaced code point) of largest n, of
    ties the first in code-point order, if that n is at least ``ratio`` times its own; else null.
    root follows forms to the last. Null and empty texts have no words; a null doc_id counts as
    empty in the checksum; repeated rows count again; extra columns are left out; an empty table
    gives no rows. Words of any length are compared whole.
    """
    words = saved(word_counts(docs, least, every).filter(F.col("n") >= occurrences), "words")
    first = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    best = near_words(words, least, block_words).groupBy("word").agg(F.count("*").alias("n_near"), first.alias("best"))
    lead = -F.col("best.less") >= ratio * F.col("n")
    out = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(lead, F.col("best.form")).alias("form"), F.when(lead, -F.col("best.less")).alias("form_n")
    )
    out = saved(out, "forms")
    roots = _roots(out.filter("form is not null"))
    return out.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
