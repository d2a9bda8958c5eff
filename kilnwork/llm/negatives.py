"""Op 13: hard negatives by integer inner products, found over an orthogonal PCA rotation.

The rotation turns the axes towards the directions of most energy and leaves inner products as they
are. A pair's product over the leading components, plus or minus the product of the norms of what
is left (and a slack for rounding), bounds its score: candidates whose bound falls short of what an
anchor can use are discarded after a few components, and the products of the original integers
decide on the rest.

Anchors and rows are packed into bounded blocks and chunks, and every chunk meets every block once;
no task sees more than one of each at a time, and it hands on at most a few rows for each anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .skew import salted_lookup
from ..sources.store import saved

#: Anchors of a block, rows of a chunk, and shares of the components after which candidates go.
BLOCK_ROWS, CHUNK_ROWS, STEPS = 512, 2048, (0.125, 0.25, 0.5)
#: The longest vector of integers: the product of two of them fits a long.
MOST_NORM = 2.0**31
_CHUNK = "chunk long, width int, ids array<long>, labels array<int>, ats array<long>, ints binary, turned binary"


def integer_vectors(embeddings: DataFrame, scale: int) -> DataFrame:
    """at (a row number), vec_id, label, q: floor(scale * x) of each component. Rows with a null
    label, a null vector or a null or non-finite component are left out, and vectors of a norm over
    MOST_NORM, whose scores no long could hold."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    whole = embeddings.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    rows = whole.select(F.monotonically_increasing_id().alias("at"), F.col("vec_id").cast("long"), F.col("label").cast("int"), q.alias("q"))
    norm = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.filter(norm <= MOST_NORM**2)


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """Lists of longs as a matrix; shorter ones are filled up by zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _moments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _padded(batch.column(0), width).astype(float)
            total += x.T @ x
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    return run


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Orthogonal columns by falling energy of all vectors. The driver gets one sum for each pair of
    components, width * (width + 1) / 2 in all."""
    sums = vectors.select("q").mapInArrow(_moments(width), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    moment = np.zeros((width, width))
    i, j, v = (sums.column(c).to_numpy() for c in ("i", "j", "v"))
    moment[i, j] = moment[j, i] = v
    return np.ascontiguousarray(np.linalg.eigh(moment)[1][:, ::-1])


def _packer(turn, width: int):
    """Chunks of rows: ids, labels, row numbers, the integers, and the rotated components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                own = batch.slice(at, CHUNK_ROWS)
                ats, ids, labels, q = (own.column(c) for c in ("at", "vec_id", "label", "q"))
                x = _padded(q, width)
                lists = [pa.array([c.to_pylist()], pa.list_(k)) for c, k in ((ids, pa.int64()), (labels, pa.int32()), (ats, pa.int64()))]
                binaries = [pa.array([v.tobytes()], pa.binary()) for v in (x, x @ turn.value)]
                yield pa.RecordBatch.from_arrays([pa.array([ats[0].as_py()]), pa.array([width], pa.int32()), *lists, *binaries], ["chunk", "width", "ids", "labels", "ats", "ints", "turned"])

    return run


class _Bounds:
    """Bounds of the scores of a chunk's rows and an anchor, made narrower step by step."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray):
        self.rows, self.anchors, self.width = rows, anchors, rows.shape[1]
        self.slack = 64 * self.width * np.finfo(float).eps
        self.cuts = sorted({max(1, int(s * self.width)) for s in STEPS} - {self.width})
        energy = [np.cumsum(x[:, ::-1] ** 2, axis=1)[:, ::-1] for x in (rows, anchors)]
        self.norms = [np.sqrt(e[:, 0]) if self.width else np.zeros(len(e)) for e in energy]
        self.left = [[np.sqrt(e[:, k]) for e in energy] for k in self.cuts]
        # partial products over the first components of all pairs at once, the rest only for survivors
        self.first = rows[:, : self.cuts[0]] @ anchors[:, : self.cuts[0]].T if self.cuts else None

    def survivors(self, j: int, among: np.ndarray, floor: Callable[[np.ndarray, np.ndarray], float], ceiling: float) -> np.ndarray:
        """Of the rows ``among``, those whose bounds reach what ``floor`` makes of all lower and
        upper bounds, and do not begin above ``ceiling``."""
        if not self.cuts:
            return among
        part = self.first[among, j]
        for n, k in enumerate(self.cuts):
            if n:
                part = part + self.rows[among, self.cuts[n - 1] : k] @ self.anchors[j, self.cuts[n - 1] : k]
            off = self.left[n][0][among] * self.left[n][1][j] + self.slack * self.norms[0][among] * self.norms[1][j]
            stay = (part + off >= floor(part - off, part + off)) & (part - off <= ceiling)
            among, part = among[stay], part[stay]
        return among


def _matrix(data: bytes, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, width)


def _numbers(values: list) -> np.ndarray:
    """Ids as longs for the order of ties; a null one comes last."""
    return np.array([2**63 - 1 if x is None else x for x in values], dtype=np.int64)


def _highest(bounds: np.ndarray, n: int) -> float:
    return np.partition(bounds, -n)[-n] if len(bounds) >= n else -np.inf


def _positives(x: dict, bounds: _Bounds, rows: np.ndarray, anchors: np.ndarray, n: int):
    """anchor's place, row's place and score of the n best rows of an anchor's own label."""
    labels, ats, order = np.array(x["labels"]), np.array(x["ats"]), _numbers(x["ids"])
    for j, (at, label) in enumerate(zip(x["a_ats"], x["a_labels"])):
        among = np.flatnonzero((labels == label) & (ats != at))
        among = bounds.survivors(j, among, lambda low, high: _highest(low, n), np.inf)
        score = rows[among] @ anchors[j]
        for i in np.lexsort((ats[among], order[among], -score))[:n]:
            yield j, at, None, among[i], score[i]


def _negatives(x: dict, bounds: _Bounds, rows: np.ndarray, anchors: np.ndarray, n: int, share: int):
    """For each positive of an anchor the n best rows of other labels within share % of its score
    and all of it."""
    labels, ats, order = np.array(x["labels"]), np.array(x["ats"]), _numbers(x["ids"])
    for j, (at, label, positives) in enumerate(zip(x["a_ats"], x["a_labels"], x["a_positives"])):
        among = None
        for p in positives or ():
            best, least = p["score"], -(-share * p["score"] // 100)
            if best < least:
                continue
            if among is None:
                among = np.flatnonzero(labels != label)
            floor = lambda low, high: max(least, _highest(low[(low >= least) & (high <= best)], n))
            own = bounds.survivors(j, among, floor, best)
            score = rows[own] @ anchors[j]
            own, score = own[fits := (score >= least) & (score <= best)], score[fits]
            for i in np.lexsort((ats[own], order[own], -score))[:n]:
                yield j, at, p["at"], own[i], score[i]


def _scorer(find: Callable, *parameters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = batch.slice(k, 1).to_pylist()[0]
                rows, turned = _matrix(x["ints"], "<i8", x["width"]), _matrix(x["turned"], "<f8", x["width"])
                anchors, a_turned = _matrix(x["a_ints"], "<i8", x["width"]), _matrix(x["a_turned"], "<f8", x["width"])
                found = list(find(x, _Bounds(turned, a_turned), rows, anchors, *parameters))
                columns = ([f[1] for f in found], [x["a_ids"][f[0]] for f in found], [f[2] for f in found], [x["ids"][f[3]] for f in found], [x["ats"][f[3]] for f in found], [int(f[4]) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_at", "anchor_id", "positive_at", "vec_id", "at", "score"])

    return run


_FOUND = "anchor_at long, anchor_id long, positive_at long, vec_id long, at long, score long"


def _ranked(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n best of each key: higher scores first, then smaller ids. Spark cuts to n in each task
    before it shuffles."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "at")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def _met(chunks: DataFrame, blocks: DataFrame, anchors: int, n_chunks: int) -> DataFrame:
    """Every chunk with every block of anchors; a block's row is repeated over salts of chunks."""
    each = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(anchors - 1))))
    return salted_lookup(each, blocks.withColumn("n", F.lit(n_chunks)), ["block"], "n", "chunk", total=anchors * n_chunks)


def hard_negatives(
    embeddings: DataFrame, anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5, share: int = 80, scale: int = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row for
    which ``anchor`` (of vec_id) holds and each of its ``positives`` best other rows of the same
    label, the ``negatives`` best rows of other labels whose score is at least ``share`` % of the
    positive's and at most the positive's.

    ``embeddings``: vec_id, embedding, label; ``label`` may replace the label. Scores are inner
    products of floor(scale * x) as whole numbers; higher come first, ties by smaller vec_id (null
    last), then by row. Rows with a null label or vector or a null or non-finite component take no
    part, nor do vectors of an integer norm over 2^31. Shorter vectors are filled up by zeros.
    Repeated ids are rows of their own; a row without vec_id is no anchor. Extra columns are left
    out; an empty table, or one without anchors, gives no rows.
    """
    spark = embeddings.sparkSession
    given = embeddings.select("vec_id", "embedding", F.col("label") if label is None else F.when(F.col("label").isNotNull(), label).alias("label"))
    vectors = saved(integer_vectors(given, scale), "vectors")
    is_anchor = F.coalesce(anchor, F.lit(False))
    facts = vectors.agg(F.max(F.size("q")).alias("width"), F.count_if(is_anchor).alias("anchors")).first()
    width, blocks = max(1, facts.width or 0), -(-facts.anchors // BLOCK_ROWS)
    if not blocks:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    turn = spark.sparkContext.broadcast(rotation(vectors, width))
    packer = _packer(turn, width)
    chunks = saved(vectors.mapInArrow(packer, _CHUNK), "chunks")
    n_chunks = chunks.count()
    dealt = saved(vectors.filter(is_anchor).withColumn("block", F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int")), "anchors")

    def blocked(rows: DataFrame) -> DataFrame:
        """One row a block; a block holds about BLOCK_ROWS anchors, whatever their labels."""
        lists = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "label", "q", "positives"))).alias("x"))
        return lists.mapInArrow(_block_packer(turn, width), "block int, a_ats array<long>, a_ids array<long>, a_labels array<int>, a_positives array<array<struct<at:long,score:long>>>, a_ints binary, a_turned binary")

    bare = dealt.withColumn("positives", F.lit(None).cast("array<struct<at:long,score:long>>"))
    first = _met(chunks, blocked(bare), blocks, n_chunks).mapInArrow(_scorer(_positives, positives), _FOUND)
    best = saved(_ranked(first, ["anchor_at"], positives).select("anchor_at", "vec_id", "at", "score"), "positives")
    held = best.groupBy(F.col("anchor_at").alias("at")).agg(F.collect_list(F.struct("at", "score")).alias("positives"))
    second = _met(chunks, blocked(dealt.join(held, "at")), blocks, n_chunks).mapInArrow(_scorer(_negatives, negatives, share), _FOUND)
    second = _ranked(second, ["anchor_at", "positive_at"], negatives)
    named = best.select("anchor_at", F.col("at").alias("positive_at"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return second.join(named, ["anchor_at", "positive_at"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _block_packer(turn, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, x = batch.column(0)[k].as_py(), batch.column(1)[k].values
                q = _padded(x.field("q"), width)
                at, ids, labels = (pa.array([x.field(c).to_pylist()], pa.list_(kind)) for c, kind in (("at", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int32())))
                positives = pa.array([x.field("positives").to_pylist()], pa.list_(pa.list_(pa.struct([("at", pa.int64()), ("score", pa.int64())]))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), at, ids, labels, positives, pa.array([q.tobytes()], pa.binary()), pa.array([(q @ turn.value).tobytes()], pa.binary())],
                    ["block", "a_ats", "a_ids", "a_labels", "a_positives", "a_ints", "a_turned"],
                )

    return run
