"""Op 7: language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Hash bins, and lengths of n-grams in code points.
BINS, LENGTHS = 1 << 16, (1, 2, 3)
#: Languages whose log-probabilities (4 bytes a bin) are broadcast and multiplied together; more are
#: scored in as many blocks, over the same bins.
BLOCK_LANGUAGES = 100
#: Code points that are worked on at a time, and distinct bins of texts that are scored together.
BLOCK, BATCH_BINS = 1 << 20, 1 << 18
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each code point: its lower case, or 32 (a space) if it is no letter."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            table[c] = ord(low[0])
    return table


_table: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """Lower-case code points with non-letters as single spaces, and a space at both ends."""
    if not _table:
        _table.append(_letters())
    c = _table[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    c = np.concatenate([[32], c, [32]]).astype(np.uint32)
    return c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]


def grams(text: str | None, bins: int = BINS) -> Iterator[np.ndarray]:
    """Bins of all n-grams of the whole text, in blocks; a gram of spaces only isn't counted."""
    codes = _codes(text or "")
    longest = max(LENGTHS)
    for at in range(0, len(codes), BLOCK):
        block = codes[at : at + BLOCK + longest - 1].astype(np.uint64)
        n_first = min(BLOCK, len(codes) - at)
        for n in LENGTHS:
            m = min(n_first, len(block) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, n, dtype=np.uint64)
            for i in range(n):
                h = (h ^ block[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            if n == 1:
                h = h[block[:m] != 32]
            yield (h & np.uint64(bins - 1)).astype(np.int64)


def bag(text: str | None, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct bins of a whole text and how often each occurs: a sparse row."""
    counts = np.zeros(bins, dtype=np.int64)
    for g in grams(text, bins):
        counts += np.bincount(g, minlength=bins)
    used = np.flatnonzero(counts)
    return used, counts[used]


def train(labelled: DataFrame, bins: int = BINS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (bins x languages, float32).

    ``labelled``: text, lang; rows without either are left out. Every row counts: each task sums
    the counts of its rows, and only the sums reach the driver, ``bins`` numbers a language at most.
    A language's own column does not depend on what other languages there are. An empty table gives
    no language.
    """
    labelled = labelled.filter("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                own = sums.setdefault(lang, np.zeros(bins, dtype=np.int64))
                for g in grams(text, bins):
                    if len(g) < 4096:
                        np.add.at(own, g, 1)
                    else:
                        own += np.bincount(g, minlength=bins)
        for lang, own in sums.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used), pa.array(own[used])], ["lang", "bin", "n"])

    rows = labelled.mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((bins, len(langs)))
    at = {x: i for i, x in enumerate(langs)}
    counts[rows.column("bin").to_numpy(), [at[x] for x in rows.column("lang").to_pylist()]] = rows.column("n").to_numpy()
    counts += 0.5
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def log_likelihoods(rows: list[tuple[np.ndarray, np.ndarray]], table: np.ndarray) -> np.ndarray:
    """Sparse rows times the matrix: for each text and language, the summed log-probabilities."""
    out = np.zeros((len(rows), table.shape[1]))
    full = [i for i, (used, _) in enumerate(rows) if len(used)]
    if full:
        bins, counts = (np.concatenate([rows[i][k] for i in full]) for k in (0, 1))
        starts = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in full])[:-1]])
        out[full] = np.add.reduceat(table[bins] * counts[:, None].astype(np.float64), starts, axis=0)
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", margin_grams: float = 200.0) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1), from the whole text only.

    ``und`` with score 0 for a null text, a text without a letter, or an untrained model. The
    score is the posterior of the best language; as neighbouring n-grams overlap, the evidence of
    a longer text counts as that of ``margin_grams`` grams. Ties go to the first language by name.
    Texts are scored in batches of sparse rows; one of any length is one row. Columns lang_pred and
    score of ``docs`` are replaced, others pass; repeated rows and those without doc_id stay.
    """
    langs, logs = model

    def guess(first: int):
        """For the languages from ``first`` on: the best one, its summed log-probabilities, and the
        sum of all by it."""
        shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs[:, first : first + BLOCK_LANGUAGES]))  # 26 MB at most

        @F.arrow_udf("struct<lang string, top double, mass double>")
        def run(texts: pa.Array) -> pa.Array:
            table, found, tops, masses = shared.value, [], [], []
            rows: list[tuple[np.ndarray, np.ndarray]] = []

            def score_rows() -> None:
                for total, (_, counts) in zip(log_likelihoods(rows, table), rows):
                    if not len(counts):
                        found.append(None)
                        tops.append(None)
                        masses.append(None)
                        continue
                    total *= min(1.0, margin_grams / counts.sum())
                    best = int(np.argmax(total))
                    found.append(langs[first + best])
                    tops.append(float(total[best]))
                    masses.append(float(np.exp(total - total[best]).sum()))
                rows.clear()

            held = 0
            for x in texts:
                text = x.as_py()
                scored = langs and text and any(map(str.isalpha, text))
                rows.append(bag(text, len(table)) if scored else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                held += len(rows[-1][0])
                if held >= BATCH_BINS:
                    score_rows()
                    held = 0
            score_rows()
            return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(tops, pa.float64()), pa.array(masses, pa.float64())], ["lang", "top", "mass"])

        return run

    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    guesses = [guess(i)(F.col(text_col).cast("string")) for i in range(0, max(1, len(langs)), BLOCK_LANGUAGES)]
    out = docs.select(*(F.col(f"`{c}`") for c in rest), F.array(*guesses).alias("_kilnwork_guess"))
    top = F.array_max(F.col("_kilnwork_guess.top"))  # of equal ones the first block's, as languages are in order
    best = F.filter("_kilnwork_guess", lambda x: x["top"] == top)[0]["lang"]
    mass = F.aggregate("_kilnwork_guess", F.lit(0.0), lambda s, x: s + x["mass"] * F.exp(x["top"] - top))
    return out.select(*(F.col(f"`{c}`") for c in rest), F.coalesce(F.when(top.isNotNull(), best), F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(1 / mass, F.lit(0.0)).alias("score"))


def held_out(doc_id):
    """Whether a document is held out: CRC-32 of its id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
