"""Lexical retrieval: term statistics, multi-field scores with exclusions, hits. Search by an inverted
index is in ``index``."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import query_terms

# Weights of the scores.
FIELD_WEIGHTS = {"issue_summary": 0.40, "failure_signal": 0.25, "patch_summary": 0.20, "changed_files": 0.10, "strategy": 0.05}
HYBRID_WEIGHTS = {"lexical": 0.50, "structural": 0.15, "path": 0.15, "imports": 0.10, "tests": 0.10}
K1 = 1.2
#: Queries that are scored together, and records at a time.
QUERY_BLOCK, RECORD_BLOCK = 256, 1000
#: Rows that a task gives at a time, about.
OUT_ROWS = 20_000
_IDENTIFIER = re.compile("[a-zA-Z_][a-zA-Z0-9_]*")


def _tokens(low: str) -> list[str]:
    """``identifier_tokens`` of a text in lower case."""
    out = []
    for t in _IDENTIFIER.findall(low):
        if "_" in t and len(t) > 3:
            out += [p for p in t.split("_") if len(p) >= 2]
        if len(t) >= 2:
            out.append(t)
    return out


def _term_rows(doc_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(0).type
            ids, found, tf, peak = [], [], [], []

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(found, pa.string()), pa.array(tf, pa.float64()), pa.array(peak, pa.int64())], [doc_id, "term", "tf", "most"])

            for key, low in zip(*batch.columns, strict=True):  # one text at a time outside of Arrow
                counts = Counter(_tokens(low.as_py() or ""))
                most = max(counts.values(), default=1)
                ids += [key.as_py()] * len(counts)
                found += counts
                tf += [n / most for n in counts.values()]
                peak += [most] * len(counts)
                if len(ids) >= OUT_ROWS:
                    yield made()
                    ids, found, tf, peak = [], [], [], []
            yield made()

    return run


def term_frequencies(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, term, tf (a term's count over the count of the document's most frequent term) and
    most (that count). A document is counted as a whole where it is, so nothing is shuffled."""

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, F.lower(text)).mapInArrow(_term_rows(doc_id), f"{doc_id} {kind}, term string, tf double, most long")


def inverse_frequencies(tf: DataFrame, n_docs: DataFrame) -> DataFrame:
    """term, df, idf = ln((N + 1) / (df + 1)) + 1. ``n_docs``: one row with n."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(n_docs).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # one row


def centrality(links: DataFrame, file: str, other: str, enough: int) -> DataFrame:
    """file, share: its distinct links over ``enough``, at most 1."""
    counted = links.groupBy(file).agg(F.count_distinct(other).alias("_n"))
    return counted.select(file, F.least(F.lit(1.0), F.col("_n") / float(enough)).alias("share"))


def top_k(scored: DataFrame, query_id: str, score: str, doc_id: str, k: int) -> DataFrame:
    """Per query the k best by score, then id; adds rank."""
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc(score), doc_id))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


class _QueryBlock:
    """Queries as a matrix: which distinct words each has, and how often."""

    def __init__(self, rows: list, kind: pa.DataType):
        rows = sorted(rows, key=lambda r: r.query_id)
        self.ids = pa.array([r.query_id for r in rows], kind)
        self.words = {w: i for i, w in enumerate(sorted({w for r in rows for w in r["_terms"] or ()}))}
        self.times = np.zeros((len(self.words), len(rows)))
        for q, r in enumerate(rows):
            for w in r["_terms"] or ():
                self.times[self.words[w], q] += 1
        self.n = np.maximum(1, self.times.sum(axis=0))
        self.values = {c: [r[c] for r in rows] for c in rows[0].asDict() if c.startswith("_x_")}

    def matcher(self):
        """A function low text -> share of each query's words that it holds anywhere: one pass over
        the text for all words."""
        import ahocorasick

        tree = ahocorasick.Automaton()
        for w, i in self.words.items():
            tree.add_word(w, i)
        tree.make_automaton()
        short: dict[str, np.ndarray] = {}

        def share(low: str | None) -> np.ndarray:
            if low in short:
                return short[low]
            found = sorted({i for _, i in tree.iter(low)}) if low and self.words else []
            out = self.times[found].sum(axis=0) / self.n
            if low is not None and len(low) < 100 and len(short) < 10_000:
                short[low] = out
            return out

        return share


def _query_blocks(queries: DataFrame) -> Iterator[_QueryBlock]:
    """The stated queries (query_id, _terms, _x_*) in blocks that fit a task."""
    blocks = -(-queries.count() // QUERY_BLOCK)
    for b in range(blocks):
        if rows := queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect():  # about QUERY_BLOCK queries
            yield _QueryBlock(rows, to_arrow_type(queries.schema["query_id"].dataType))


def _best(scores: np.ndarray, ids: list, k: int) -> tuple[np.ndarray, list]:
    """The k best by score, then id, and those so close behind that rounding may tie them; of one
    score no more than k."""
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))
    least = scores[order[min(k, len(order)) - 1]] - 2e-6
    out, same, last = [], 0, None
    for i in order:
        if scores[i] < least:
            break
        same = same + 1 if scores[i] == last else 1
        last = scores[i]
        if same <= k:
            out.append(i)
    return scores[out], [ids[i] for i in out]


def _top_records(block: _QueryBlock, record_id: str, fields: list[str], modes: dict[str, Sequence[str]], k: int):
    exclude = sorted({c for m in modes.values() for c in m})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, kind = block.matcher(), None
        codes = {c: {v: i for i, v in enumerate(dict.fromkeys(block.values[f"_x_{c}"]))} for c in exclude}
        own = {c: np.array([codes[c][v] for v in block.values[f"_x_{c}"]]) for c in exclude}
        best = {mode: [(np.zeros(0), []) for _ in block.ids] for mode in modes}
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, RECORD_BLOCK):
                part = batch.slice(at, RECORD_BLOCK)
                rows = {n: c for n, c in zip(part.schema.names, part.columns)}
                ids = rows[record_id].to_pylist()
                every = np.zeros((len(ids), len(block.ids)))
                for name in fields:
                    for i, x in enumerate(rows[f"_f_{name}"]):  # one text at a time outside of Arrow
                        every[i] += FIELD_WEIGHTS[name] * share(x.as_py())
                same = {c: np.array([codes[c].get(v, -1) for v in rows[c].to_pylist()])[:, None] == own[c] for c in exclude}
                for mode, without in modes.items():
                    scores = every.copy() if without else every
                    for c in without:
                        scores[same[c]] = -1.0
                    least = np.array([kept[k - 1] - 2e-6 if len(kept) >= k else 0.0 for kept, _ in best[mode]])
                    for q in np.flatnonzero((scores >= least).any(axis=0)):
                        kept, names = best[mode][q]
                        new = np.flatnonzero(scores[:, q] >= least[q])
                        best[mode][q] = _best(np.concatenate([kept, scores[new, q]]), names + [ids[i] for i in new], k)
        for mode in modes:
            for q, (kept, names) in enumerate(best[mode]):
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array([mode] * len(names)), pa.array([block.ids[q].as_py()] * len(names), block.ids.type), pa.array(names, kind), pa.array(kept)], ["mode", "query_id", record_id, "score"])

    return run


def retrieve_modes(queries: DataFrame, query_id: str, text: str, records: DataFrame, record_id: str, fields: dict[str, Column], k: int, modes: dict[str, Sequence[str]]) -> DataFrame:
    """mode, query_id, record, score, rank: ``retrieve`` for several lists of columns to exclude by,
    named, over one pass of the records."""
    exclude = sorted({c for m in modes.values() for c in m})
    asked = queries.select(F.col(query_id).alias("query_id"), query_terms(F.col(text)).alias("_terms"), *(F.col(c).alias(f"_x_{c}") for c in exclude))
    low = records.select(record_id, *exclude, *(F.lower(c).alias(f"_f_{n}") for n, c in fields.items()))
    kinds = f"mode string, query_id {queries.schema[query_id].dataType.simpleString()}, {record_id} {records.schema[record_id].dataType.simpleString()}, score double"
    found = [low.mapInArrow(_top_records(block, record_id, list(fields), modes, k), kinds) for block in _query_blocks(asked)]
    every = reduce(DataFrame.union, found, records.sparkSession.createDataFrame([], kinds)).withColumn("score", F.bround("score", 6))
    rank = F.row_number().over(Window.partitionBy("mode", "query_id").orderBy(F.desc("score"), record_id))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k)


def retrieve(queries: DataFrame, query_id: str, text: str, records: DataFrame, record_id: str, fields: dict[str, Column], k: int = 5, exclude: Sequence[str] = ()) -> DataFrame:
    """Per query the k best records by weighted term overlap, then id.

    A query's words count where they stand anywhere in a field, so every record is scored for every
    query of a stated, small set: by one pass over its text for the words of a block of queries,
    and a matrix. A task keeps the best of its records for each query, so only these are shuffled
    and no pairs are made. ``exclude``: columns that queries and records share; a record equal to
    the query in any of them is left out.
    """
    return retrieve_modes(queries, query_id, text, records, record_id, fields, k, {"": tuple(exclude)}).drop("mode")


def best_overlap(queries: DataFrame, query_id: str, text: str, records: DataFrame, record_id: str, record_text: str) -> DataFrame:
    """record_id, query_id, overlap: for each record the query of which it holds the largest share of
    words, of all of a stated set in blocks; ties go to the smallest query_id. ``record_id`` is
    unique; without queries there are no rows."""
    asked = queries.select(F.col(query_id).alias("query_id"), query_terms(F.col(text)).alias("_terms"))
    kinds = f"{record_id} {records.schema[record_id].dataType.simpleString()}, {query_id} {queries.schema[query_id].dataType.simpleString()}, overlap double"

    def scored(block: _QueryBlock):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            share = block.matcher()
            for batch in batches:
                shares = np.array([share(x) for x in batch.column(1).to_pylist()]).reshape(batch.num_rows, -1)
                first = shares.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), block.ids.take(pa.array(first)), pa.array(shares[np.arange(len(first)), first])], [record_id, query_id, "overlap"])

        return records.select(record_id, F.lower(record_text)).mapInArrow(run, kinds)

    found = [scored(b) for b in _query_blocks(asked)]
    if len(found) == 1:
        return found[0]
    every = reduce(DataFrame.union, found, records.sparkSession.createDataFrame([], kinds))
    best = every.groupBy(record_id).agg(F.min(F.struct((-F.col("overlap")).alias("o"), F.col(query_id))).alias("b"))
    return best.select(record_id, f"b.{query_id}", (-F.col("b.o")).alias("overlap"))


def hit_rates(ranked: DataFrame, queries: DataFrame, query_id: str, match: Column, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """One row: share of all queries with a match within the first k, returned a query, and share
    with nothing returned."""
    hits = ranked.groupBy(query_id).agg(F.count("*").alias("_n"), *(F.max((match & (F.col("rank") <= k)).cast("int")).alias(f"_h{k}") for k in ks))
    all_of = queries.select(query_id).join(hits, query_id, "left")
    share = lambda c: F.bround(F.coalesce(F.avg(F.coalesce(c, F.lit(0))), F.lit(0.0)), 4)
    return all_of.agg(*(share(F.col(f"_h{k}")).alias(f"hit_at_{k}") for k in ks), share(F.col("_n")).alias("mean_returned"), share(F.col("_n").isNull().cast("int")).alias("empty_share"))


def localization(ranked: DataFrame, gold: DataFrame, query_id: str, chunk: str, file: Column, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """One row: n queries with a gold chunk (query_id, chunk in ``gold``), and the shares of them
    with one of its files and one of its chunks among the first k of ``ranked`` (query_id, chunk,
    rank). ``file``: of a chunk. Without gold the shares are 0."""
    own = ranked.withColumn("_file", file)
    symbols = own.join(gold.select(query_id, chunk).distinct(), [query_id, chunk]).select(query_id, F.col("rank").alias("_s"), F.lit(None).cast("int").alias("_f"))
    files = own.join(gold.select(query_id, file.alias("_file")).distinct(), [query_id, "_file"]).select(query_id, F.lit(None).cast("int"), F.col("rank"))
    first = symbols.union(files).groupBy(query_id).agg(F.min("_s").alias("_s"), F.min("_f").alias("_f"))
    every = gold.select(query_id).distinct().join(first, query_id, "left")
    share = lambda c, k: F.bround(F.coalesce(F.avg((F.coalesce(c, F.lit(2**31 - 1)) <= k).cast("int")), F.lit(0.0)), 4)
    return every.agg(F.count("*").alias("n"), *(share(F.col(c), k).alias(f"{name}_hit_at_{k}") for name, c in (("file", "_f"), ("symbol", "_s")) for k in ks))


def remaining(queries: DataFrame, query_id: str, records: DataFrame, record_id: str, groups: tuple[str, str], keys: Sequence[str]) -> DataFrame:
    """query_id, n: records left when those equal to the query in any of the two ``groups`` or of
    the ``keys`` are left out. By inclusion and exclusion over counts of the groups, less the
    records that only a key leaves out: equi-joins throughout."""
    a, b = groups
    own = queries.select(query_id, *groups, *keys)
    both = records.groupBy(a, b).agg(F.count("*").alias("_ab"))
    counted = own.join(both.groupBy(a).agg(F.sum("_ab").alias("_a")), a, "left").join(both.groupBy(b).agg(F.sum("_ab").alias("_b")), b, "left").join(both, [a, b], "left")
    counted = counted.join(F.broadcast(records.agg(F.count("*").alias("_all"))))  # one row
    n = F.col("_all") - sum(F.coalesce(c, F.lit(0)) for c in ("_a", "_b")) + F.coalesce("_ab", F.lit(0))
    rows = records.select(record_id, F.col(a).alias("_ra"), F.col(b).alias("_rb"), *keys)
    by_key = [own.select(query_id, a, b, k).join(rows.select(record_id, "_ra", "_rb", k), k).filter((F.col(a) != F.col("_ra")) & (F.col(b) != F.col("_rb"))).select(query_id, record_id) for k in keys]
    off = reduce(DataFrame.union, by_key).distinct().groupBy(query_id).agg(F.count("*").alias("_off"))
    return counted.join(off, query_id, "left").select(query_id, (n - F.coalesce("_off", F.lit(0))).alias("n"))


def seeded_sample(df: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """The n rows whose hashed id comes first: the same rows for a seed at any partitioning."""
    return df.withColumn("_h", F.xxhash64(row_id, F.lit(seed))).orderBy("_h", row_id).limit(n).drop("_h")
