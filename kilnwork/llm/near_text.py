"""Near-duplicate texts: SimHash fingerprints and MinHash bands give candidates, exact Jaccard of word
shingles decides.

Fingerprints are met by their positional bytes as in ``simhash`` (at most 4 of 64 bits apart). Few
pairs of a similarity of 0.8 are that close, so bands give the rest. Two texts of similarity s share one of the 32 bands of 5 MinHash rows with probability
1 - (1 - s^5)^32: 0.999997 at 0.8, and more above. Equal texts are one node. Each node is tried
against the lead that shares most of its bands, then against the leads of all its bands. Nodes of a
band that are then still in several components are joined by their rarest shingles (prefix
filtering, which loses no pair), so that neither a group that its leads join nor texts that share a
common passage only are squared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from . import simhash
from .graph import components
from .skew import salted_lookup
from ..sources.store import release, saved

BANDS, ROWS = 32, 5
#: Words of 64 bits of a set's bitmap (a power of two).
BITMAP = 8
_ODD = np.random.default_rng(8).integers(0, 2**63, BANDS * ROWS, dtype="<u8") * np.uint64(2) + np.uint64(1)


def _joined(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split())


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Ascending distinct XXH64 of the runs of ``shingle`` words; a shorter text is one run."""
    joined = _joined(text)
    if not joined:
        return np.zeros(0, "<u8")
    cuts = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts, ends = [0, *(x + 1 for x in cuts)], [*cuts, len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 7) for a, b in zip(starts, ends[min(shingle, len(ends)) - 1 :])], dtype="<u8"))


def band_hashes(h: np.ndarray) -> np.ndarray:
    """One hash for each band; its number is part of it."""
    if not len(h):
        return np.zeros(0, "<i8")
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype="<u8")
    for i in range(0, len(h), 512):
        least = np.minimum(least, (h[i : i + 512, None] * _ODD).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[n].tobytes(), n) for n in range(BANDS)], dtype="<u8").view("<i8")


def _prints(shingle: int):
    """Key of the words (equal for equal words), band hashes and SimHash fingerprint of a text."""
    @F.arrow_udf(StructType([StructField("key", BinaryType()), StructField("bands", ArrayType(LongType())), StructField("fp", LongType())]))
    def run(text: pa.Array) -> pa.Array:
        keys, bands, prints = [], [], []
        for x in text:  # one text at a time outside of Arrow
            own = x.as_py()
            keys.append(xxhash.xxh128_digest(_joined(own)))
            bands.append(band_hashes(shingle_set(own, shingle)))
            prints.append(simhash.fingerprint(own, shingle))
        return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(np.array(prints, dtype="<u8").view("<i8"))], ["key", "bands", "fp"])

    return run


def _sets(shingle: int):
    @F.arrow_udf(ArrayType(LongType()))
    def run(text: pa.Array) -> pa.Array:
        return pa.array([shingle_set(x.as_py(), shingle).view("<i8") for x in text], pa.list_(pa.int64()))

    return run


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sets have a Jaccard similarity of at least ``similarity``."""
    out, total = pairs, pairs.count()
    for side, other in (("a", "b"), ("b", "a")):
        n = pairs.groupBy(side).agg(F.count("*").alias("n"))
        table = sets.select(F.col("key").alias(side), F.col("hashes").alias(f"in_{side}")).join(n, side)
        out = salted_lookup(out, table, [side], "n", other, total=total).drop("n")
    both = F.size(F.array_intersect("in_a", "in_b"))
    return out.filter(both >= similarity * (F.size("in_a") + F.size("in_b") - both)).select("a", "b")


def rare_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b of different roots among which are all of Jaccard ``similarity`` s or more. ``sets``:
    key, hashes, root.

    Shingles are ordered by how many sets hold them, the rarest first. Two sets x and y whose first
    common shingle stands at places i and j (from 0) share at most min(|x| - i, |y| - j) shingles,
    and need s / (1 + s) * (|x| + |y|). So only shingles among the first (1 - s) |x| are met, and
    those that a single set holds meet nothing but count for the place. Each set also has a bitmap
    in which every shingle flips one bit: at least as many shingles differ as bits do, so a pair
    with over (1 - s) / (1 + s) * (|x| + |y|) different bits is none.
    """
    flips = f"transform(sequence(0, {BITMAP - 1}), k -> aggregate(filter(hashes, x -> (shiftrightunsigned(x, 6) & {BITMAP - 1}) = k), 0L, (b, x) -> b ^ shiftleft(1L, cast(x & 63 as int))))"
    sets = saved(sets.filter(F.size("hashes") > 0).select("key", "root", "hashes", F.size("hashes").alias("size"), F.expr(flips).alias("bits")), "rare-sets")
    each = sets.select("key", F.explode("hashes").alias("w"))
    held = saved(each.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1"), "held")
    common = salted_lookup(each, held, ["w"], "n", "key").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("common"))
    ranked = sets.drop("hashes").join(common, "key").withColumn("single", F.col("size") - F.size("common"))
    first = F.greatest(F.lit(0), F.floor(F.col("size") * (1 - similarity) + 1e-9).cast("int") + 1 - F.col("single"))
    posts = ranked.select("key", "root", "size", "bits", "single", F.posexplode(F.slice("common", 1, first)).alias("at", "c"))
    posts = saved(posts.select("key", "root", "size", (F.col("at") + F.col("single")).alias("at"), "c.w", *(F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(BITMAP))), "rare")
    # of each pair of different roots one at least is not of the shingle's most frequent root
    by_root = posts.groupBy("w", "root").agg(F.count("*").alias("n")).groupBy("w").agg(F.max_by("root", "n").alias("most"), F.sum("n").alias("n"), F.count("*").alias("roots"))
    mixed = saved(by_root.filter("roots > 1").select("w", "most", "n"), "mixed")
    names = posts.columns
    posts = salted_lookup(posts, mixed, ["w"], "n", "key").select(*names, "most")
    one, two = (df.select(*(F.col(c).alias(f"{c}_{side}") for c in names)) for df, side in ((posts.filter("root != most"), "a"), (posts, "b")))
    both = F.col("size_a") + F.col("size_b")
    enough = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) >= F.lit(similarity / (1 + similarity)) * both - 1e-6
    flipped = sum((F.bit_count(F.col(f"b{i}_a").bitwiseXOR(F.col(f"b{i}_b"))) for i in range(BITMAP)), F.lit(0))
    met = one.join(two, (F.col("w_a") == F.col("w_b")) & (F.col("root_a") != F.col("root_b")) & enough & (flipped <= F.lit((1 - similarity) / (1 + similarity)) * both + 1e-6))
    return met.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct()


def fingerprint_pairs(nodes: DataFrame, bits: int = 4) -> DataFrame:
    """Pairs a, b of nodes (key, fp) that join the nodes whose fingerprints are within ``bits``: each
    node of a fingerprint with the first one, and first ones along the links of ``simhash``."""
    firsts = saved(nodes.groupBy("fp").agg(F.min("key").alias("a"), F.count("*").alias("n")), "prints")
    own = salted_lookup(nodes, firsts.filter("n > 1"), ["fp"], "n", "key").filter("a != key").select("a", F.col("key").alias("b"))
    links = simhash.near_links(firsts.select("fp"), bits)
    ends = [firsts.select(F.col("fp").alias(side), F.col("a").alias(f"key_{side}")) for side in "ab"]
    met = links.join(ends[0], "a").join(ends[1], "b").select("key_a", "key_b")
    return saved(own.union(met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "print-pairs")


def near_components(posts: DataFrame, sets: DataFrame, similarity: float, more: DataFrame | None = None) -> DataFrame:
    """node, root of every node that has a link. ``posts``: h, key of the bands that several nodes
    share; ``more``: further candidates a, b; ``sets``: key, hashes of the nodes of both. Joins what
    all candidate pairs of the bands would join, and what ``more`` does."""
    leads = posts.groupBy("h").agg(F.min("key").alias("a"), F.count("*").alias("n"))
    stars = salted_lookup(posts, leads, ["h"], "n", "key").filter("a != key").groupBy("a", F.col("key").alias("b")).agg(F.count("*").alias("n"))
    pairs = stars.groupBy("b").agg(F.max(F.struct("n", "a")).alias("x")).select("x.a", "b")
    pairs = saved(pairs if more is None else pairs.union(more.select("a", "b")).distinct(), "pairs")
    tried, links, turns = pairs, saved(_similar(pairs, sets, similarity), "similar"), ["leads", "pairs"]
    found = saved(components(links), "roots")
    while turns:
        rooted = posts.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        rooted = saved(rooted, "rooted")
        bands = rooted.groupBy("h").agg(F.min(F.struct("key", "root")).alias("lead"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
        bands = saved(bands.filter("low != high").select("h", "lead", "n"), "open")
        if bands.isEmpty():
            return found
        rest = salted_lookup(rooted, bands, ["h"], "n", "key")
        if turns.pop(0) == "leads":
            pairs = rest.filter("root != lead.root").select("lead.key", F.col("key").alias("b")).toDF("a", "b")
        else:
            pairs = rare_pairs(sets.join(rest.select("key", "root").distinct(), "key"), similarity)
        pairs = saved(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        tried, links = tried.union(pairs), links.union(saved(_similar(pairs, sets, similarity), "similar"))
        found = saved(components(links), "roots")
    return found


def drop_near_texts(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """One row of each group of near-duplicates of ``docs``, with all its columns.

    A group is joined by links between texts whose sets of ``shingle``-word runs (words in lower
    case) have a Jaccard similarity of ``similarity`` or more; null and empty texts and those
    without words are equal. The row of the smallest doc_id stays; one without doc_id only where
    no row of the group has one. Of rows that repeat a doc_id each is judged by its own text, and
    of repeated rows one stays. Texts of any length are read whole. An empty table stays empty.

    Text is moved once, when rows meet the list of first rows of their text; after that only rows
    that share a band, or nearly a fingerprint, with another text are moved.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(row.alias("row"), F.monotonically_increasing_id().alias("at"), _prints(shingle)(F.col("text").cast("string")).alias("print"))
    rows = saved(rows, "rows")
    order = F.struct(F.col("row.doc_id").isNull().alias("unnamed"), F.col("row.doc_id").alias("doc_id"), "at")
    nodes = rows.groupBy("print.key").agg(F.min(order).alias("first"), F.first("print.bands").alias("bands"), F.first("print.fp").alias("fp"))
    nodes = saved(nodes.select(F.col("first.at").alias("at"), "first", "bands", "fp"), "nodes")  # a node is named by its first row
    posts = nodes.select(F.explode("bands").alias("h"), F.col("at").alias("key"))
    shared = saved(posts.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    posts = saved(salted_lookup(posts, shared, ["h"], "n", "key").select("h", "key"), "posts")
    alike = fingerprint_pairs(nodes.select(F.col("at").alias("key"), "fp"))
    met = posts.select("key").union(alike.select("a")).union(alike.select("b")).toDF("at").distinct().withColumn("met", F.lit(True))
    firsts = rows.select("row", "at").join(nodes.select("at").join(met, "at", "left"), "at")
    firsts = saved(firsts.select("at", F.coalesce("met", F.lit(False)).alias("met"), "row"), "firsts")
    release(rows)
    near = firsts.filter("met")
    sets = saved(near.select(F.col("at").alias("key"), _sets(shingle)(F.col("row.text").cast("string")).alias("hashes")), "sets")
    found = near_components(posts, sets, similarity, alike)
    members = found.join(nodes.select(F.col("at").alias("node"), "first"), "node")
    roots = members.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("size"))
    lost = salted_lookup(members, roots, ["root"], "size", "node").filter("node != best.at").select(F.col("node").alias("at"))
    kept = near.join(lost, "at", "left_anti").select("row")
    return firsts.filter("not met").select("row").union(kept).select("row.*")
