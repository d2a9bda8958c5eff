"""Op 11: documents joined by the Jaccard similarity of their shingle sets, over count-vector R-trees.

The tokens (distinct five-word shingles) of a set are hashed into groups, and the counts of its
groups are a point: two sets share at most the sum of the smaller counts of each group. Points are
kept in R-trees: an inner node holds the largest count of each group and the range of set sizes
below it, so the same sum bounds what any two points of two nodes share, and pairs of nodes that
fall short are not entered. Pairs of points that survive are verified by their exact sets.

The trees are a forest that Spark deals over tasks: one for each cell of points that share a token
among their first ones in an order of all tokens. Two sets of similarity s share a token among the
first (1 - s) |x| + 1 of each, so every link is within a tree. The order begins with tokens of
groups that hold few tokens over all documents: a token that many documents share comes late.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .graph import components
from .skew import salted_lookup
from ..sources.store import release, saved

#: Groups whose tokens are counted over all documents, for the order (a power of two).
ORDER_GROUPS = 1 << 16
#: Least groups of a point (a power of two); larger sets have more, so that a group holds 4 at most.
POINT_GROUPS = 64
#: Points of a leaf and of a cell that one task joins; children of an inner node; counts compared at a time.
LEAF, FANOUT, CELLS = 256, 16, 1 << 21
#: Nodes of a cell that needs no tree; members of a larger one's largest component that its other nodes are tried against first.
FEW, MEMBERS = 8, 16
#: Bytes of neighbouring texts whose words are hashed together.
PIECE = 1 << 21
#: Bits of the filter that wanted texts pass before they are moved, at most (2 MB).
FILTER_BITS = 1 << 24
#: Bytes of the longest word whose hash is made together with those of others (a multiple of 8).
LONG_WORD = 64


def _mixed(h: np.ndarray) -> np.ndarray:
    """SplitMix64's last step."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words: the length and then each eight bytes are mixed in; long words go one
    by one through XXH64."""
    words = words.cast(pa.binary())
    ends = np.frombuffer(words.buffers()[1], "<i4")[words.offset : words.offset + len(words) + 1].astype(np.int64)
    at, size = ends[:-1], np.diff(ends)
    data = words.buffers()[2].to_pybytes() if words.buffers()[2] else b""
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))  # the eight bytes from each place on
    h = _mixed(size.astype("<u8") + np.uint64(0x9E3779B97F4A7C15))
    some = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    for i in range(0, LONG_WORD, 8):
        some = some[size[some] > i]
        if not len(some):
            break
        spare = np.uint64(8) * np.maximum(8 - (size[some] - i), 0).astype("<u8")
        h[some] = _mixed(h[some] ^ (eight[at[some] + i] << spare)) + np.uint64(0x9E3779B97F4A7C15)
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(data[at[i] : at[i] + size[i]], 7)
    return h


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def runs(words: list[bytes], shingle: int) -> np.ndarray:
    """A hash of each run of ``shingle`` words (of all words of a shorter text), as often as it is
    there: the words' 64-bit hashes times unrelated odd numbers of their places, so that two
    different runs are equal once in 2^64."""
    return _runs(word_hashes(pa.array(words, pa.binary())), shingle)


def _runs(h: np.ndarray, shingle: int) -> np.ndarray:
    """``runs`` of words by their hashes."""
    if not len(h):
        return h
    size = min(shingle, len(h))
    out = np.full(len(h) - size + 1, size, dtype="<u8")
    for i in range(size):
        out += h[i : i + len(out)] * np.uint64(xxhash.xxh64_intdigest(b"place %d" % i) | 1)
    return out


def hashed_texts(text: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Neighbouring texts of about PIECE bytes at a time: the hashes of their words, where each
    text's words end, and the same for its runs."""
    text = pc.fill_null(text, "")
    upto = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PIECE, "right")))
        words = pc.ascii_split_whitespace(pc.ascii_lower(text.slice(at, end - at)))
        held, words = pc.list_value_length(words).to_numpy(zero_copy_only=False), words.flatten()
        some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty word
        ends = np.concatenate([[0], np.cumsum(some)])[np.cumsum(held)]
        h = word_hashes(words.filter(pa.array(some)))
        starts = np.concatenate([[0], ends[:-1]])
        n = ends - starts
        made = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
        run_ends = np.cumsum(made)
        found = np.zeros(run_ends[-1], dtype="<u8")
        if len(h) >= shingle:
            first = np.arange(len(found)) + np.repeat(starts - (run_ends - made), made)
            every = _runs(h, shingle)
            found = every[np.minimum(first, len(every) - 1)]
        for i in np.flatnonzero((n > 0) & (n < shingle)):  # a text of one run
            found[run_ends[i] - 1] = _runs(h[starts[i] : ends[i]], shingle)[0]
        yield h, ends, found, run_ends
        at = end


def token_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Ascending distinct hashes of the runs of ``shingle`` words."""
    return np.unique(runs(words_of(text), shingle))


def _counter(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER_GROUPS, dtype=np.int64)
        for batch in batches:
            for _, _, found, _ in hashed_texts(batch.column(0), shingle):
                total += np.bincount((found & np.uint64(ORDER_GROUPS - 1)).view("<i8"), minlength=ORDER_GROUPS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["g", "n"])

    return run


def group_ranks(docs: DataFrame, shingle: int) -> np.ndarray:
    """The place of each of ORDER_GROUPS groups of tokens by the tokens of all documents in it."""
    sums = docs.select(F.col("text").cast("string")).mapInArrow(_counter(shingle), "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(ORDER_GROUPS, dtype=np.int64)
    total[sums.column("g").to_numpy()] = sums.column("n").to_numpy()
    out = np.empty(ORDER_GROUPS, dtype=np.uint64)
    out[np.argsort(total, kind="stable")] = np.arange(ORDER_GROUPS, dtype=np.uint64)
    return out


def first_tokens(tokens: np.ndarray, ranks: np.ndarray, similarity: int) -> np.ndarray:
    """The tokens (ascending) of which a set of ``similarity`` % or more must share one."""
    n = len(tokens)
    if not n:
        return tokens
    place = (ranks[(tokens & np.uint64(ORDER_GROUPS - 1)).view("<i8")] << np.uint64(48)) | (tokens >> np.uint64(16))  # no two alike
    some = min(n, n + 1 + -similarity * n // 100)
    return tokens[np.argpartition(place, some - 1)[:some]] if some < n else tokens


def point(tokens: np.ndarray) -> np.ndarray:
    """How many tokens each group has."""
    groups = POINT_GROUPS
    while 4 * groups < len(tokens):
        groups *= 2
    return np.bincount(((tokens >> np.uint64(16)) & np.uint64(groups - 1)).view("<i8"), minlength=groups)


def packed(counts: np.ndarray) -> bytes:
    kind = "<u1" if counts.max() < 256 else "<u4"
    return kind[1:].encode() + counts.astype(kind).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<" + data[:2].decode(), offset=2).astype("<i4")


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """Points (rows) over fewer groups: a coarser group holds those that agree in their last bits."""
    return counts.reshape(len(counts), -1, groups).sum(axis=1)


def _prints(ranks, shingle: int, similarity: int):
    kind = StructType([StructField("key", BinaryType()), StructField("size", IntegerType()), StructField("first", ArrayType(LongType())), StructField("counts", BinaryType())])

    @F.arrow_udf(kind)
    def run(text: pa.Array) -> pa.Array:
        """A text that stands in the batch already gets its key and size only."""
        keys, sizes, first, counts, known, order = [], [], [], [], {}, ranks.value
        for h, ends, found, run_ends in hashed_texts(text, shingle):
            at = start = 0
            for end, upto in zip(ends.tolist(), run_ends.tolist()):
                own, mine, at, start = h[at:end], found[start:upto], end, upto
                keys.append(key := _key(own))
                if not len(own) or key in known:
                    sizes.append(known.get(key, 0))
                    first.append(None)
                    counts.append(None)
                    continue
                tokens = np.unique(mine)
                known[key] = len(tokens)
                sizes.append(len(tokens))
                first.append(first_tokens(tokens, order, similarity).view("<i8"))
                counts.append(packed(point(tokens)))
        columns = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array(counts, pa.binary())]
        return pa.StructArray.from_arrays(columns, ["key", "size", "first", "counts"])

    return run


def _key(hashes: np.ndarray) -> bytes:
    """Of a text by its words' hashes: equal words are equal keys, whatever white space is between."""
    return xxhash.xxh128_digest(hashes.tobytes())


def _wanted_keys(bits, shingle: int):
    """The key of a text, or null where the filter has no bit for it."""
    @F.arrow_udf(BinaryType())
    def run(text: pa.Array) -> pa.Array:
        held, last, out = bits.value, 8 * len(bits.value) - 1, []
        for h, ends, _, _ in hashed_texts(text, shingle):
            for key in (_key(x) for x in np.split(h, ends[:-1])):
                at = xxhash.xxh64_intdigest(key, 42) & last
                out.append(key if held[at >> 3] >> (at & 7) & 1 else None)
        return pa.array(out, pa.binary())

    return run


def key_filter(keys: DataFrame, n: int) -> bytes:
    """A bit for each of the ``n`` keys, over at most FILTER_BITS bits; other keys may share one."""
    size = 1 << min(FILTER_BITS.bit_length() - 1, max(15, (16 * n).bit_length()))
    at = keys.select((F.pmod(F.xxhash64("key"), F.lit(size)) + 1).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()  # 4 KB each
    out = bytearray(size // 8)
    for r in parts:
        out[(r.part - 1) * 4096 : r.part * 4096] = r.bits
    return bytes(out)


def _sets(shingle: int):
    @F.arrow_udf(ArrayType(LongType()))
    def run(text: pa.Array) -> pa.Array:
        sets = []
        for _, _, found, ends in hashed_texts(text, shingle):
            sets += [np.unique(x).view("<i8") for x in np.split(found, ends[:-1])]
        return pa.array(sets, pa.list_(pa.int64()))

    return run


def fits(bound, size_a, size_b, similarity: int):
    """Whether an overlap of at most ``bound`` allows the similarity: I / (|a| + |b| - I) >= s."""
    return (100 + similarity) * bound >= similarity * (size_a + size_b)


class Tree:
    """A packed R-tree over points with the same groups: rows sorted by size and then, within runs
    of FANOUT leaves, by the group that varies most; a node is a run of FANOUT rows, held as the
    largest counts and the range of sizes below it."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        if len(order) > FANOUT:
            by = counts[:, counts.var(axis=0).argmax()]
            order = np.concatenate([run[np.argsort(by[run], kind="stable")] for run in np.split(order, range(FANOUT**2, len(order), FANOUT**2))])
        self.order, self.counts, self.sizes = order, counts[order], sizes[order]
        at = np.arange(0, len(order), FANOUT)
        self.starts, self.ends = at, np.minimum(at + FANOUT, len(order))
        self.most = np.maximum.reduceat(self.counts, at, axis=0)
        self.least_size, self.most_size = np.minimum.reduceat(self.sizes, at), np.maximum.reduceat(self.sizes, at)


def _minima(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed minima of each row of ``a`` and each row of ``b``."""
    rows = max(1, CELLS // max(1, b.size))
    return np.concatenate([np.minimum(a[i : i + rows, None, :], b[None, :, :]).sum(axis=2) for i in range(0, len(a), rows)])


def joined(one: Tree, two: Tree, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of ``one`` and j of ``two`` whose sizes and summed minima allow the similarity."""
    near = fits(_minima(one.most, two.most), one.least_size[:, None], two.least_size[None, :], similarity)
    near &= (100 * one.most_size[:, None] >= similarity * two.least_size[None, :]) & (100 * two.most_size[None, :] >= similarity * one.least_size[:, None])
    i, j = [], []
    for x, y in zip(*np.nonzero(near)):
        a, b = slice(one.starts[x], one.ends[x]), slice(two.starts[y], two.ends[y])
        m, n = one.sizes[a, None], two.sizes[None, b]
        p, q = np.nonzero(fits(_minima(one.counts[a], two.counts[b]), m, n, similarity) & (100 * m >= similarity * n) & (100 * n >= similarity * m))
        i.append(one.order[p + a.start])
        j.append(two.order[q + b.start])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *i]), np.concatenate([none, *j])


def cell_pairs(nodes: np.ndarray, roots: np.ndarray, sizes: np.ndarray, counts: list[bytes], guests: np.ndarray, hosts: np.ndarray, similarity: int) -> set[tuple[int, int]]:
    """Pairs (a < b) of different roots, a guest and a host, that the trees of a cell can't tell
    apart. Points of other numbers of groups have trees of their own and meet over the fewer."""
    points = [unpacked(c) for c in counts]
    groups = np.array([len(p) for p in points])
    found: set[tuple[int, int]] = set()
    if len(nodes) <= FEW:
        for i in guests.tolist():
            for j in hosts.tolist():
                m, n, least = sizes[i], sizes[j], min(groups[i], groups[j])
                if roots[i] == roots[j] or 100 * m < similarity * n or 100 * n < similarity * m or nodes[i] > nodes[j] and len(guests) == len(hosts) == len(nodes):
                    continue
                bound = np.minimum(*(points[x] if groups[x] == least else folded(points[x][None], least)[0] for x in (i, j))).sum()
                if fits(bound, m, n, similarity):
                    found.add((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
        return found
    for g in np.unique(groups[guests]):
        for h in np.unique(groups[hosts]):
            if 200 * min(g, h) < similarity * max(g, h):
                continue  # g groups have at most 4g tokens, and over 2g but for the least g: sizes too different
            least, own, other = min(g, h), guests[groups[guests] == g], hosts[groups[hosts] == h]
            trees = [Tree(folded(np.stack([points[i] for i in side]), least), sizes[side]) for side in (own, other)]
            i, j = joined(*trees, similarity)
            a, b = own[i], other[j]
            apart = roots[a] != roots[b]
            low, high = np.minimum(nodes[a], nodes[b])[apart], np.maximum(nodes[a], nodes[b])[apart]
            found.update(zip(low.tolist(), high.tolist()))
    return found


def _forest(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells come sorted by cell, leaf and part; role: 0 host, 1 guest, 2 both."""
        names = ("cell", "leaf", "part", "role", "node", "root", "size", "counts")
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in names)))
        for _, cell in groupby(rows, key=lambda r: r[:3]):
            role, nodes, roots, sizes, counts = list(zip(*cell))[3:]
            role = np.array(role)
            guests, hosts = np.flatnonzero(role > 0), np.flatnonzero(role != 1)
            if len(guests) and len(hosts):
                found = cell_pairs(np.array(nodes), np.array(roots), np.array(sizes), counts, guests, hosts, similarity)
                if found:
                    a, b = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _bounds():
    @F.arrow_udf(IntegerType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        """Summed minima of two points."""
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            x, y = unpacked(x)[None], unpacked(y)[None]
            least = min(x.shape[1], y.shape[1])
            out.append(int(np.minimum(folded(x, least), folded(y, least)).sum()))
        return pa.array(out, pa.int32())

    return run


def _beside(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with ``columns`` of both ends as ``<column>_a``, ``<column>_b``."""
    out, total = pairs, pairs.count()
    for side, other in (("a", "b"), ("b", "a")):
        n = pairs.groupBy(F.col(side).alias("node")).agg(F.count("*").alias("n"))
        own = table.join(n, "node").select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns), "n")
        out = salted_lookup(out, own, [side], "n", other, total=total).drop("n")
    return out


def _favourites(met: DataFrame) -> DataFrame:
    """Of all a, b the a that shares most cells with each b, so a pair for each b at most."""
    counted = met.groupBy("a", "b").agg(F.count("*").alias("n"))
    return counted.groupBy("b").agg(F.max(F.struct("n", "a")).alias("x")).select("x.a", "b")


class _Join:
    """The turns of a join: candidates, their exact verification, and the components so far."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, posts: DataFrame, similarity: int, shingle: int):
        self.docs, self.nodes, self.posts, self.similarity, self.shingle = docs, nodes, posts, similarity, shingle
        self.tried = self.links = self.found = None

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """The pairs that sizes and points allow."""
        s = self.similarity
        both = _beside(pairs, self.nodes, ["size", "counts"])
        both = both.filter((100 * F.col("size_a") >= s * F.col("size_b")) & (100 * F.col("size_b") >= s * F.col("size_a")))
        return both.filter(fits(_bounds()("counts_a", "counts_b"), F.col("size_a"), F.col("size_b"), s)).select("a", "b")

    def verify(self, pairs: DataFrame) -> None:
        """Exact sets of the pairs not tried before, from the texts of their nodes; then components. A
        bit filter of bounded size keeps most other texts from being moved to the join."""
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = saved(pairs, "pairs")
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        if pairs.isEmpty():
            return
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = saved(self.nodes.select("node", "key").join(wanted, "node"), "wanted")
        bits = self.docs.sparkSession.sparkContext.broadcast(key_filter(wanted, wanted.count()))
        text = F.col("text").cast("string")
        texts = self.docs.select(_wanted_keys(bits, self.shingle)(text).alias("key"), text.alias("text")).filter("key is not null").join(wanted, "key")
        sets = texts.groupBy("node").agg(F.first("text").alias("text")).select("node", _sets(self.shingle)("text").alias("hashes"))
        sets = saved(sets, "sets")
        both = F.size(F.array_intersect("hashes_a", "hashes_b"))
        close = 100 * both >= self.similarity * (F.size("hashes_a") + F.size("hashes_b") - both)
        links = saved(_beside(pairs, sets, ["hashes"]).filter(close).select("a", "b"), "similar")
        release(sets, wanted)
        self.links = links if self.links is None else self.links.union(links)
        self.found = saved(components(self.links), "roots")

    def open_cells(self) -> DataFrame | None:
        """w, node, root, lead, most, n, others of the cells whose nodes are in several components;
        most: the component of most nodes; lead: its first node; others: nodes outside of it."""
        rooted = self.posts.select("w", "node")
        if self.found is None:
            rooted = rooted.withColumn("root", F.col("node"))
        else:
            rooted = rooted.join(self.found, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rooted = saved(rooted, "rooted")
        by_root = rooted.groupBy("w", "root").agg(F.count("*").alias("n"), F.min("node").alias("lead"))
        most = F.max(F.struct("n", "root", "lead")).alias("x")
        cells = by_root.groupBy("w").agg(most, F.sum("n").alias("n"), F.count("*").alias("roots")).filter("roots > 1")
        cells = saved(cells.select("w", F.col("x.root").alias("most"), F.col("x.lead").alias("lead"), "n", (F.col("n") - F.col("x.n")).alias("others")), "open")
        return None if cells.isEmpty() else salted_lookup(rooted, cells, ["w"], "n", "node")

    def members(self, cells: DataFrame) -> DataFrame:
        """Of each cell of more than FEW nodes, the nodes outside its largest component with MEMBERS of
        the nodes inside of it. They go by a hash of the node, so that like cells give like pairs.
        Nodes of a large group of near copies link with many of it, and hardly all with its lead."""
        large = cells.filter(F.col("n") > FEW)
        own = large.filter("root = most").groupBy("w").agg(F.first("others").alias("others"), F.array_distinct(F.array(*(F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(MEMBERS)))).alias("own"))
        met = salted_lookup(large.filter("root != most").select("w", "node"), own, ["w"], "others", "node").select("own", "node").distinct()
        met = met.select("node", F.explode("own").alias("own"))
        return met.select(F.least("own", "node").alias("a"), F.greatest("own", "node").alias("b")).distinct()

    def trees(self, cells: DataFrame) -> DataFrame:
        """Pairs that the R-trees of the open cells can't tell apart. A cell that fits into a leaf is
        one tree, and equal cells are joined once; of a larger one, leaves of all its nodes meet
        parts of the nodes outside its largest component, one of which is in each pair."""
        cells = saved(cells, "cells")
        small = cells.filter(F.col("n") <= LEAF).groupBy("w").agg(F.sort_array(F.collect_list("node")).alias("nodes")).select("nodes").distinct()
        small = saved(small.select(F.monotonically_increasing_id().alias("cell"), "nodes"), "small")
        small = small.select("cell", F.lit(0).alias("leaf"), F.lit(0).alias("part"), F.lit(2).alias("role"), F.explode("nodes").alias("node"))
        deal = lambda n: F.pmod(F.xxhash64("node"), F.ceil(F.col(n) / LEAF)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / LEAF).cast("int") - 1))
        large = cells.filter(F.col("n") > LEAF)
        hosts = large.select((F.col("w")).alias("cell"), deal("n").alias("leaf"), every("others").alias("part"), F.lit(0).alias("role"), "node")
        guests = large.filter("root != most").select(F.col("w").alias("cell"), every("n").alias("leaf"), deal("others").alias("part"), F.lit(1).alias("role"), "node")
        entries = small.union(hosts).union(guests)
        points = self.nodes.select("node", "size", "counts")
        if self.found is not None:
            points = points.join(self.found, "node", "left")
        points = points.select("node", "size", "counts", (F.coalesce("root", "node") if self.found is not None else F.col("node")).alias("root"))
        key = ["cell", "leaf", "part"]
        dealt = entries.join(points, "node").repartition(*key).sortWithinPartitions(*key)
        return dealt.mapInArrow(_forest(self.similarity), "a long, b long").distinct()


def ngram_components(docs: DataFrame, similarity: int = 80, shingle: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles (size of its set), component_id.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct runs of
    ``shingle`` words, or the whole of a shorter text. Two rows link when 100 * intersection >=
    ``similarity`` * union, exactly (tokens are 64-bit hashes). component_id is the smallest doc_id
    that links reach; rows with a null doc_id take part but never give the id. Null and empty texts
    and those without words have an empty set, link with nothing and keep their own doc_id. Equal
    texts are one node, so copies are never paired; repeated rows keep their rows; extra columns
    are left out. Texts of any length are read whole. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    ranks = docs.sparkSession.sparkContext.broadcast(group_ranks(docs, shingle))
    text = F.col("text").cast("string")
    prints = docs.select("doc_id", F.monotonically_increasing_id().alias("at"), _prints(ranks, shingle, similarity)(text).alias("x"))
    prints = saved(prints.select("doc_id", "at", "x.*"), "prints")
    ids = prints.select("doc_id", "at", "key", "size")
    keys = saved(ids.filter("size > 0").groupBy("key").agg(F.min("at").alias("node"), F.min("doc_id").alias("rep"), F.count("*").alias("n")), "keys")
    # only the first row of a text in a batch has tokens; of these one of each text is its node
    held = prints.filter("counts is not null")
    again = saved(held.select("key", "at").join(keys.select("key", "node"), "key").filter("at != node").select("at"), "again")
    held = held.join(again, "at", "left_anti").withColumnRenamed("at", "node")
    nodes = saved(held.select("node", "key", "size", "counts"), "nodes")
    posts = held.select("node", F.explode("first").alias("w"))
    shared = saved(posts.groupBy("w").agg(F.count("*").alias("n"), F.min("node").alias("lead")).filter("n > 1"), "shared")
    posts = saved(salted_lookup(posts, shared, ["w"], "n", "node").select("w", "node", "lead"), "posts")
    join = _Join(docs, nodes, posts, similarity, shingle)
    join.verify(join.bounded(saved(_favourites(posts.filter("lead != node").select(F.col("lead").alias("a"), F.col("node").alias("b"))), "leads")))
    cells = join.open_cells()
    if cells is not None:
        apart = cells.filter("root != most").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b"))
        join.verify(join.bounded(saved(_favourites(apart).union(join.members(cells)).distinct(), "leads")))
        cells = join.open_cells()
    if cells is not None:
        join.verify(join.trees(cells))
    if join.found is None:
        named = keys.select("key", "n", F.col("rep").alias("component_id"))
    else:
        rooted = saved(keys.join(join.found, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        roots = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("size"))
        named = salted_lookup(rooted, roots, ["root"], "size", "node").select("key", "n", "component_id")
    known = salted_lookup(ids.filter("size > 0"), named, ["key"], "n", "at").select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id")
    return known.union(ids.filter("size = 0").select("doc_id", F.lit(0).cast("long"), F.col("doc_id")))
