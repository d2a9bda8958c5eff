"""Op 3: byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Texts are encoded in stretches of about so many characters.
STRETCH = 100_000
#: Rows whose ids are held at a time, and in one batch that goes back.
ROWS = 500
#: A letter before one space: no match of the pattern spans these two, and what follows the
#: space never depends on what is before it.
SAFE = re.compile(r"(?<=[^\W\d_])(?= )")
#: Runs of white space (as the pattern's \\s has it) that the regular expression would have to
#: back up over one by one.
SPACES = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_SPACE = re.compile(SPACES + "{2000,}")


@functools.cache
def encoding(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(ranks, pat_str=pattern, mergeable_ranks=table, special_tokens={})


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """Cut ``text`` at safe boundaries only, each stretch at least ``size`` long but the last."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def token_ids(enc, text: str, size: int = STRETCH, long_space: re.Pattern = LONG_SPACE) -> np.ndarray:
    """Ids of a whole text. A long run of white space is one match of the pattern up to its last
    character, or with it at the end of the text: it is encoded as such, without the search."""
    ids = []
    for part in stretches(text, size):
        start = 0
        for run in long_space.finditer(part):
            stop = run.end() - (run.end() < len(part))  # only the text's end ends a stretch in white space
            ids.append(enc.encode_to_numpy(part[start : run.start()], disallowed_special=()))
            ids.append(np.array(enc._encode_single_piece(part[run.start() : stop]), dtype=np.uint32))
            start = stop
        ids.append(enc.encode_to_numpy(part[start:], disallowed_special=()))
    return np.concatenate(ids)


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of each text; null counts as empty, and an empty text has no
    ids. Special tokens are ordinary text. A text of any length is encoded whole. Extra columns are
    left out; repeated rows and those without doc_id stay; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                doc, text = batch.slice(at, ROWS).columns
                ids = [token_ids(enc, x.as_py() or "") for x in text]
                stops = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays([doc, pa.ListArray.from_arrays(stops, flat)], ["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Adds decoded (binary): the raw bytes of the ids, whether they are valid UTF-8 or not; null ids
    give no bytes."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                texts = [enc.decode_bytes(ids.values.to_pylist() if ids.is_valid else []) for ids in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{kinds}, decoded binary")
