"""Op 1: best-fit packing after Martello-Toth dominance reduction.

Packing depends on the pieces' lengths only, and there are at most ``capacity`` lengths. So the
driver solves the problem on the histogram of lengths (never more than ``capacity`` numbers, at
any size of the corpus) and gets *layouts*: what a bin holds, and how many bins are alike.
Workers then look up each piece's place by its rank among the pieces of the same length.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.store import saved

#: Salts over which pieces of one length are ranked.
RANK_SALTS = 1024
#: Words kept in a worker's cache of token ids, and the longest of them in characters.
CACHE_WORDS, CACHED_CHARS = 250_000, 64

#: Characters of a text that are worked on at a time.
BLOCK_CHARS = 2_000_000
#: Code points for which lower case and normal form need the tokenizer's own steps.
HIGH = re.compile("[\u0130\u0300-\U0010ffff]")
#: A full stop or comma before white space that may belong to a longer run of marks.
AFTER_MARK = re.compile(r"[.,](?<=[\W_].)\s")
LETTERS_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")

Histogram = dict[int, int]
Layout = tuple[int, dict[int, int]]  # bins alike, {length: pieces in each}


def _partner(sizes: list[int], count: Histogram, own: int, room: int) -> int:
    """The largest length that fits ``room`` beside a piece of ``own``, or 0."""
    i = bisect.bisect_right(sizes, room) - 1
    while i >= 0 and count[sizes[i]] - (sizes[i] == own) < 1:
        i -= 1
    return sizes[i] if i >= 0 else 0


def _best_pair(sizes: list[int], count: Histogram, own: int, room: int) -> tuple[int, int, int]:
    """The pair (r >= s) of largest sum beside ``own`` within ``room``, and the largest second
    member that any feasible pair has; zeros if no pair fits."""
    left = lambda x: count[x] - (x == own)
    best, second, hi = (0, 0), 0, bisect.bisect_right(sizes, room) - 1
    lo = 0
    while lo <= hi:
        a, b = sizes[lo], sizes[hi]
        if a + b > room or left(b) < 1:
            hi -= 1
        elif left(a) < 1 or lo == hi and left(a) < 2:
            lo += 1
        else:
            if (a + b, b) > (sum(best), best[0]):
                best = (b, a)
            second = max(second, a)
            lo += 1
    return (*best, second)


def reduce_by_dominance(histogram: Histogram, capacity: int) -> tuple[list[Layout], Histogram]:
    """Fix bins that provably belong to some optimal packing; return them and what is left.

    For the largest open length ``w``, a set of at most three pieces with ``w`` is fixed if it
    dominates every other feasible set with ``w``, that is if the pieces of any other set can be
    grouped so that each group is no longer than a distinct piece of the fixed one. Taking copies
    of equal length together never changes the argument, so a set is fixed for as many bins as
    its lengths allow. The first length for which no set dominates passes to the caller's
    heuristic, and the scan goes on with the next shorter one.
    """
    count = defaultdict(int, {k: v for k, v in histogram.items() if v > 0})
    sizes = sorted(count)
    fixed: list[Layout] = []

    def fix(*members: int) -> None:
        need = {x: members.count(x) for x in members}
        bins = min(count[x] // n for x, n in need.items())
        fixed.append((bins, need))
        for x, n in need.items():
            count[x] -= bins * n
            if not count[x]:
                del count[x]
                sizes.pop(bisect.bisect_left(sizes, x))

    at = len(sizes) - 1
    while sizes and at >= 0:
        at = min(at, len(sizes) - 1)
        own = sizes[at]
        room = capacity - own
        mate = _partner(sizes, count, own, room)
        if not mate:
            fix(own)
        elif mate == room:
            fix(own, mate)
        else:
            r, s, second = _best_pair(sizes, count, own, room)
            if not r:
                fix(own, mate)  # one more piece at most, and the largest one dominates
            elif _fits_three(sizes, count, own, room):
                at -= 1
            elif mate >= r + s:
                fix(own, mate)
            elif r == mate and second <= s:
                fix(own, r, s)
            else:
                at -= 1
    return fixed, dict(count)


def _fits_three(sizes: list[int], count: Histogram, own: int, room: int) -> bool:
    """Whether the three smallest pieces fit beside ``own``."""
    need, total = 3, 0
    for x in sizes:
        if x * need + total <= room or x + total <= room:
            take = min(need, count[x] - (x == own))
            total += take * x
            need -= take
            if total > room:
                return False
            if not need:
                return True
        else:
            return False
    return False


def best_fit(histogram: Histogram, capacity: int) -> list[Layout]:
    """Best-fit decreasing over lengths with counts; bins filled alike stay one layout."""
    open_bins: dict[int, list[list]] = defaultdict(list)  # room left -> [[bins alike, contents]]
    rooms: list[int] = []
    done: list[Layout] = []

    def put(bins: int, contents: dict[int, int], room: int) -> None:
        if not bins:
            return
        if not room:
            done.append((bins, contents))
            return
        if not open_bins[room]:
            bisect.insort(rooms, room)
        open_bins[room].append([bins, contents])

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            i = bisect.bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                bins, contents = open_bins[room].pop()
                if not open_bins[room]:
                    rooms.pop(i)
            else:
                room, bins, contents = capacity, -(-left // (capacity // size)), {}
            each = room // size
            full = min(bins, left // each)
            rest = min(left - full * each, each) if full < bins else 0
            put(full, contents | {size: each}, room - each * size)
            put(1 if rest else 0, contents | {size: rest}, room - rest * size)
            put(bins - full - (1 if rest else 0), contents, room) if contents else None
            left -= full * each + rest
    return done + [(b, c) for groups in open_bins.values() for b, c in groups]


def plan_bins(histogram: Histogram, capacity: int) -> list[Layout]:
    """Dominance reduction, then best fit of the remainder."""
    fixed, rest = reduce_by_dominance(histogram, capacity)
    return fixed + best_fit(rest, capacity)


def lookup_arrays(layouts: list[Layout], span: int) -> dict[str, np.ndarray]:
    """For every run of equal pieces: where its ranks begin, its first bin, pieces per bin and
    offset. ``key`` = length * span + first rank is ascending."""
    given: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int]] = []
    first = 0
    for bins, contents in layouts:
        offset = 0
        for size in sorted(contents, reverse=True):
            each = contents[size]
            out.append((size * span + given[size], first, each, offset))
            given[size] += bins * each
            offset += each * size
        first += bins
    out.sort()
    return {k: np.array([x[i] for x in out], dtype=np.int64) for i, k in enumerate(("key", "bin", "each", "offset"))}


class _Words(dict):
    """Token ids of words, as bytes of little-endian unsigned 32-bit numbers; filled when asked."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # The vocabulary spells a byte as one character; that spelling comes from the library.
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {c: "".join(x for x, _ in spell.pre_tokenize_str(chr(c))) for c in range(0x300)}
        self.markers = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self[""] = b""

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and word.islower():  # one unit before the merges
            found = [t.id for t in self.model.tokenize(word)]
        elif word.isalpha() and word.islower() and not HIGH.search(word):
            found = [t.id for t in self.model.tokenize(word.translate(self.spelled))]
        elif not HIGH.search(word) and (parts := LETTERS_MARKS.fullmatch(word)):  # no unit has letters and marks, but for 's and the like
            return self._kept(word, self[parts[1]] + self[parts[2]])
        else:
            found = self.tokenizer.encode(word, add_special_tokens=False).ids
        return self._kept(word, struct.pack(f"<{len(found)}I", *found))

    def _kept(self, word: str, ids: bytes) -> bytes:
        if len(word) <= CACHED_CHARS:
            self[word] = ids
        return ids


_words = functools.cache(_Words)


def _blocks(texts: list[str | None], markers: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about BLOCK_CHARS, each made fit for a split at white space: lower-cased
    where that equals the tokenizer's own step, and with marks that are tokens of their own set
    apart. A letter that the tokenizer's steps spell with a combining mark draws a mark behind it
    to that one, so such texts stay as they are; so do those with a string of a special token, which
    the tokenizer finds before it lower-cases."""
    block, size = [], 0
    for text in texts:
        text = text or ""
        if text.isascii() or not HIGH.search(text):
            low = text.lower()
            if "<" not in low or not any(m in low for m in markers):
                text = low
                if not AFTER_MARK.search(text):
                    for mark in (". ", ", ", ".\n", ",\n"):
                        text = text.replace(mark, f" {mark}")
        block.append(text)
        size += len(text)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def word_ids(path: str, texts: list[str | None]) -> Iterator[bytes]:
    """Token ids of each text as little-endian unsigned 32-bit numbers, as the library's encode gives
    them with add_special_tokens=False (the string of a special token in a text is that token).

    No token crosses white space, so a text's ids are its words' ids in order; each distinct word
    goes through the tokenizers library once per worker, and numpy puts the ids together.
    """
    known = _words(path)
    for block in _blocks(texts, known.markers):
        split = pc.ascii_split_whitespace(pa.array(block, pa.large_string()))
        ends = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        if len(known) > CACHE_WORDS:
            known.clear()
            known[""] = b""
        own = [known[w] for w in coded.dictionary.to_pylist()]
        flat = np.frombuffer(b"".join(own), dtype="<u4")
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4
        starts = np.concatenate([[0], np.cumsum(sizes)])
        code = coded.indices.to_numpy()
        each = sizes[code]
        stops = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(starts[code] - stops[:-1], each) + np.arange(stops[-1])].tobytes()
        at = 4 * stops[ends - ends[0]]
        for i in range(len(block)):
            yield ids[at[i] : at[i + 1]]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Each document's ids and the end id, cut after every ``capacity``: doc_id, piece, start,
    length, ids_crc32, and with ``with_ids`` the ids themselves. A null text is an empty one: one
    piece that is the end id. Texts of any length are read whole; repeated rows and those without
    doc_id give their pieces; extra columns are left out."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), word_ids(vocabulary, batch.column(1).to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(names)])
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def pack(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """Place pieces (length in 1..capacity) into as few bins as best fit finds; adds sequence_id
    and offset. ``parts`` is written to the shared folder once, so that ranks can't change.

    Ranks within a length: a rank within (length, salt) plus the pieces of that length in earlier
    salts, so that a length with most of the rows is ranked by many tasks. An empty table gives an
    empty result; repeated rows are packed like any others.
    """
    columns = parts.columns
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(RANK_SALTS)).cast("int")  # by row: ids may repeat
    parts = saved(parts.withColumn("_salt", salt), "pieces")
    counts = saved(parts.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "lengths")  # at most capacity * RANK_SALTS rows
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # at most capacity rows
    if bad := [x for x in histogram if not 0 < x <= capacity]:
        raise ValueError(f"lengths outside 1..{capacity}: {bad[:5]}")
    span = max([1, *histogram.values()]) + 1
    table = lookup_arrays(plan_bins(histogram, capacity), span)
    before = counts.withColumn(
        "_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")
    ).drop("_n")
    ranked = parts.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", F.xxhash64(*columns))) - 1
    )
    ranked = ranked.join(before, ["length", "_salt"]).select(*columns, (F.col("_rank") + F.col("_before")).alias("_rank"))
    shared = parts.sparkSession.sparkContext.broadcast(table)  # a few entries per length

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        t = shared.value
        i = np.searchsorted(t["key"], length.to_numpy() * span + rank.to_numpy(), side="right") - 1
        n = length.to_numpy() * span + rank.to_numpy() - t["key"][i]
        return pd.DataFrame({"sequence_id": t["bin"][i] + n // t["each"][i], "offset": t["offset"][i] + n % t["each"][i] * length.to_numpy()})

    return ranked.withColumn("_place", place("length", "_rank")).select(*columns, "_place.sequence_id", "_place.offset")
