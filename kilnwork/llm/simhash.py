"""Op 8: SimHash near-duplicates over an inverted index of positional bytes.

A fingerprint is 8 bytes; at most 4 differing bits leave at least 4 bytes equal at their positions
(the guaranteed minimum of matches). A posting of one positional byte would hold 1/256 of all rows,
and tallying all its pairs grows with the square of the input. So a posting's key is three bytes
with their positions, in 20 choices of positions such that any four positions hold one of them: two
fingerprints that share four positional bytes or more meet in a posting. Pairs that meet are
tallied by their shared positional bytes; those that reach the minimum are verified by their
differing bits. Postings are counted before their members are brought together: singles go no
further, a posting of two is its pair, and a posting of more gives a spanning forest of its links,
never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from .graph import components
from .skew import salted_lookup
from ..sources.store import saved

#: Bytes of a fingerprint.
BYTES = 8
#: Distinct fingerprints of one posting that a task compares; larger ones are linked by midpoints.
POSTING_ROWS = 65_536


def covering_triples(classes=((0, 1, 2), (3, 4, 5), (6, 7))) -> list[tuple[int, int, int]]:
    """Triples of byte positions such that any four positions hold one: those inside a class, and
    two of a class with one of the next, as four positions leave no class of three free of both."""
    out = []
    for own, following in zip(classes, classes[1:] + classes[:1]):
        out += combinations(own, 3)
        out += [(*two, x) for two in combinations(own, 2) for x in following]
    return out


POSITIONS = covering_triples()


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash: each bit is set if over half of the shingles' XXH64 have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(x + 1 for x in ends)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :])], dtype="<u8")
    ones = sum(np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(h), 4096))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    @F.arrow_udf(LongType())
    def run(text: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x, shingle) for x in text.to_pylist()], dtype="<u8").view("<i8"))

    return run


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _postings(nodes: DataFrame) -> DataFrame:
    """p (which triple), key (the fingerprint's bytes there), fp: 20 rows a fingerprint."""
    masks = F.array(*(F.lit(_signed(sum(0xFF << 8 * i for i in at))).cast("long") for at in POSITIONS))
    return nodes.select(F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("p", "key"), "fp")


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many positional bytes two fingerprints share, from their differing bits."""
    for shift in (4, 2, 1):
        x = x | x >> np.uint64(shift)
    return BYTES - np.bitwise_count(x & np.uint64(0x0101010101010101))


def linked(x: np.ndarray, bits: int) -> np.ndarray:
    """Whether pairs with the differing bits ``x`` pass the tally and the verification."""
    return (shared_bytes(x) >= BYTES - bits) & (np.bitwise_count(x) <= bits)


def _linked_column(a, b, bits: int):
    """``linked`` as a Spark expression."""
    x = a.bitwiseXOR(b)
    tally = sum((x.bitwiseAND(F.lit(_signed(0xFF << 8 * i)).cast("long")) == 0).cast("int") for i in range(BYTES))
    return (tally >= BYTES - bits) & (F.bit_count(x) <= bits)


def forest(f: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Spanning links of the ascending distinct unsigned fingerprints that differ in few bits."""
    links, left = [], f
    while len(left):
        root, left, queue = left[0], left[1:], [left[0]]
        while queue and len(left):
            near = linked(left ^ queue.pop(), bits)
            if near.any():
                found = left[near]
                links += [(root, x) for x in found]
                queue += list(found)
                left = left[~near]
    return links


def _linker(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings come sorted by key; one that spans batches is carried on."""

        def made(links):
            a, b = np.array(links, dtype="<u8").reshape(-1, 2).view("<i8").T
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], ["a", "b"])

        last, held = 0, np.zeros(0, "<u8")
        for batch in batches:
            key = np.concatenate([np.full(len(held), last), batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([held, np.ascontiguousarray(batch.column(1).to_numpy(zero_copy_only=False), dtype="<i8").view("<u8")])
            if not len(f):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            links = []
            for i, j in zip(cuts[:-2], cuts[1:-1]):  # the last posting may go on
                links += forest(np.unique(f[i:j]), bits)
            last, held = key[-1], f[cuts[-2] :]
            if links:
                yield made(links)
        if links := forest(np.unique(held), bits):
            yield made(links)

    return run


def _midpoints(bits: int):
    """Two fingerprints differ in at most ``bits`` exactly if some value is within half of it of
    both (rounded up and down); in one posting all differences are outside the key's bytes."""
    near, far = bits // 2, -(-bits // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, key, fp in zip(*(batch.column(c).to_pylist() for c in ("p", "key", "fp"))):
                free = [8 * b + i for b in range(BYTES) if b not in POSITIONS[p] for i in range(8)]
                masks = np.array([sum(1 << i for i in c) for n in range(far + 1) for c in combinations(free, n)], dtype="<u8")
                mids = (masks ^ np.uint64(fp % 2**64)).view("<i8")
                rows = len(mids)
                close = np.bitwise_count(masks) <= near
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, p), pa.int32()), pa.array(np.full(rows, key)), pa.array(mids), pa.array(np.full(rows, fp)), pa.array(close)], ["p", "key", "mid", "fp", "close"])

    return run


def near_links(nodes: DataFrame, bits: int = 4, posting_rows: int = POSTING_ROWS) -> DataFrame:
    """Links a, b that join the same fingerprints as all pairs within ``bits`` do. ``nodes``: fp,
    distinct longs."""
    if not 0 <= bits <= 4:
        raise ValueError("4 of 8 bytes are equal only for at most 4 differing bits")
    postings = _postings(nodes)
    shared = postings.groupBy("p", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    shared = saved(shared, "postings")
    pairs = shared.filter("n = 2").filter(_linked_column(F.col("a"), F.col("b"), bits)).select("a", "b")
    crowded = shared.filter((F.col("n") > 2) & (F.col("n") <= posting_rows)).select("p", "key")
    met = postings.join(crowded, ["p", "key"]).select(F.xxhash64("p", "key").alias("key"), "fp")
    spans = met.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(bits), "a long, b long")
    links = pairs.union(spans).distinct()
    hot = shared.filter(F.col("n") > posting_rows).select("p", "key", "n")
    if hot.isEmpty():
        return saved(links, "near")
    members = salted_lookup(postings, hot, ["p", "key"], "n", "fp").select("p", "key", "fp")
    mids = saved(members.mapInArrow(_midpoints(bits), "p int, key long, mid long, fp long, close boolean"), "midpoints")
    stars = mids.filter("close").groupBy("p", "key", "mid").agg(F.min("fp").alias("a"))
    # of an odd distance, one end is a bit nearer; each far end is linked with every near end
    far = mids.join(stars, ["p", "key", "mid"]).filter("a != fp").select("a", F.col("fp").alias("b"))
    return saved(links.union(far).distinct(), "near")


def _rooted(nodes: DataFrame, bits: int, posting_rows: int) -> DataFrame:
    """``nodes`` (fp, ...) with root, the smallest fingerprint that links reach."""
    found = components(near_links(nodes, bits, posting_rows)).withColumnRenamed("node", "fp")
    return saved(nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")


def simhash_groups(docs: DataFrame, bits: int = 4, posting_rows: int = POSTING_ROWS, shingle: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and are linked like any other; texts of any length
    are read whole. Copies share one fingerprint and are one node, so equal texts are never paired.
    component_id is the smallest doc_id reachable over links; rows with a null doc_id take part but
    never give the id. Repeated rows keep their rows; extra columns are left out. An empty table
    gives an empty result.
    """
    prints = docs.select("doc_id", _fingerprints(shingle)(F.col("text").cast("string")).alias("fp"), F.monotonically_increasing_id().alias("at"))
    prints = saved(prints, "prints")
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    nodes = _rooted(nodes, bits, posting_rows)
    roots = nodes.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("size"))
    nodes = salted_lookup(nodes, roots, ["root"], "size", "fp").select("fp", "n", "component_id")
    out = salted_lookup(prints, nodes, ["fp"], "n", "at")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
