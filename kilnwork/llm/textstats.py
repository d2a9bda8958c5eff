"""Counts of a whole text that the quality operators work on: one short row per document."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?:;\"'()[]{}=+/\\~^_@-"
_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, WINDOW, dtype=np.int64).astype(np.uint64) | np.uint64(1)

#: In the order of ``counts``.
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_letters", "n_digits", "n_marks", "n_stops", "n_short_lines", "longest_word")


def repeated(words: list[bytes]) -> int:
    """Words that lie in windows of five words found twice or more, the first one included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    sums = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        sums += h[i : i + n] * _MULTIPLIERS[i]
    ordered = np.sort(sums)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0  # equal windows have equal sums
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    times = Counter(windows)
    again = np.fromiter((times[w] > 1 for w in windows), dtype=bool, count=n)
    covered = np.zeros(len(words), dtype=bool)
    for i in range(WINDOW):
        covered[i : i + n] |= again
    return int(covered.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The numbers named in COLUMNS; a null text has none of anything, and one line."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = text.split("\n")
    held = [x for x in lines if x.strip(" \t\x0b\x0c\r")]
    by = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    spaces = int(by[9:14].sum() + by[32])
    upper = int(by[65:91].sum()) if text.isascii() else sum(map(str.isupper, text))
    letters = int(by[65:91].sum() + by[97:123].sum() + by[0xC0:].sum())
    return (
        len(words),
        len(text) - spaces,
        int(by[list(SYMBOLS)].sum()),
        len(held) - len(set(held)),
        repeated(words),
        len(held),
        len(set(words)),
        upper,
        letters,
        int(by[48:58].sum()),
        int(by[list(MARKS)].sum()),
        int(by[46]),
        sum(len(x) < 30 for x in held),
        max(map(len, words), default=0),
    )


def text_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the counts of its column text, which is read whole at any
    length; a null text counts as empty."""

    @F.arrow_udf("struct<" + ", ".join(f"{c} long" for c in COLUMNS) + ">")
    def stats(texts: pa.Array) -> pa.Array:
        rows = np.array([counts(x) for x in texts.to_pylist()], dtype=np.int64).reshape(-1, len(COLUMNS))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)) for x in rows.T], list(COLUMNS))

    return docs.select(*keep, stats(F.col("text").cast("string")).alias("_s")).select(*keep, *(f"_s.{c}" for c in COLUMNS))


def _over(a: str, b: str):
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: Shares and means that rules and classifiers use, as Spark expressions over the counts.
FEATURES = {
    "symbol_share": lambda: _over("n_symbols", "word_chars"),
    "upper_share": lambda: _over("n_upper", "n_letters"),
    "mark_share": lambda: _over("n_marks", "word_chars"),
    "digit_share": lambda: _over("n_digits", "word_chars"),
    "letter_share": lambda: _over("n_letters", "word_chars"),
    "word_length": lambda: _over("word_chars", "n_words"),
    "distinct_share": lambda: _over("n_distinct_words", "n_words"),
    "repeat_share": lambda: _over("n_repeat_words", "n_words"),
    "dup_line_share": lambda: _over("n_dup_lines", "n_lines"),
    "short_line_share": lambda: _over("n_short_lines", "n_lines"),
    "stop_rate": lambda: _over("n_stops", "n_words"),
    "words": lambda: F.col("n_words").cast("double"),
    "longest": lambda: F.col("longest_word").cast("double"),
}


def with_features(stats: DataFrame) -> DataFrame:
    return stats.select("*", *(make().alias(name) for name, make in FEATURES.items()))


def labelled_sample(stats: DataFrame, labels: DataFrame, max_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, 0/1 quality and ids of ``max_rows`` labelled texts at most: the first ones by a hash
    of their doc_id and text (``_text``, a hash), whatever rows and partitions they come in. A text
    that one doc_id repeats counts once; labels of one doc_id are averaged before, and half or more
    is good, so no label is met twice. Rows without doc_id or quality are left out. A filter on the
    hash lets a tenth and a hundred more than the bound pass, and the bound reaches the driver."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg((F.col("quality") > 0).cast("double")) >= 0.5).cast("int").alias("quality"))
    texts = stats.filter("doc_id is not null").groupBy("doc_id", "_text").agg(*(F.first(c).alias(c) for c in COLUMNS))
    joined = texts.join(known, "doc_id").withColumn("_h", F.pmod(F.xxhash64("doc_id", "_text"), F.lit(1 << 30)))
    share = min(1.0, (1.1 * max_rows + 100) / max(1, joined.count()))
    first = with_features(joined.filter(F.col("_h") <= int(share * (1 << 30)))).orderBy("_h", "doc_id", "_text").limit(max_rows)
    rows = first.select(*FEATURES, "quality", "doc_id").toPandas()
    return rows[list(FEATURES)].to_numpy(dtype=float), rows["quality"].to_numpy(dtype=int), rows["doc_id"].to_numpy()
