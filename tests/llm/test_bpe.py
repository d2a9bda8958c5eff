import hashlib
import random
import re

import pytest
import public_tokenizers

from kilnwork.llm.bpe import SAFE, SPACES, decode, encode, encoding, stretches, token_ids

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

ODD = [
    "", None, "a", "it's  two   spaces \n\n and\ttabs ", "<|endoftext|> 12345 ünïcode 日本語 🙂 é",
    "word " * 60_000, "x" * 5_000, " \n" * 2_000, "l'été des mots' s 'll " * 8_000,
]


def test_stretches_join_to_the_same_ids():
    enc = encoding(RANKS, PATTERN)
    for text in ODD:
        text = text or ""
        for size in (3, 50, 1000):
            if len(text) < 200_000 and len(text) / size < 5000:
                parts = list(stretches(text, size))
                assert "".join(parts) == text
                assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    assert SAFE.search("a b").start() == 1


def test_long_runs_of_white_space():
    enc, rng = encoding(RANKS, PATTERN), random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "é", "1", "!", "'s", " ", "  ", "\n", "\t\r", "\xa0", "\u3000", "\x1c", "   \n "]) for _ in range(rng.randint(0, 40)))
        assert token_ids(enc, text, 5, re.compile(SPACES + "{2,}")).tolist() == enc.encode_ordinary(text), repr(text)
    for text in (" " * 300_000 + "x", "a" + "\n" * 300_000):
        assert enc.decode_bytes(token_ids(enc, text).tolist()).decode() == text


def test_round_trip_with_nulls_repeats_and_extra_columns(spark):
    rows = [(i, t, "x", [1]) for i, t in enumerate(ODD)] + [(1, None, None, None), (None, "same", "y", [2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>")
    enc = encoding(RANKS, PATTERN)
    got = decode(encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert len(got) == len(rows)
    want = sorted((d is None, d or 0, hashlib.sha256((t or "").encode()).hexdigest(), str(enc.encode_ordinary(t or ""))) for d, t, *_ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, hashlib.sha256(r.decoded).hexdigest(), str(r.ids)) for r in got) == want
    assert decode(encode(docs.limit(0), RANKS, PATTERN), RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("ids", [[255], [0, 1, 2]])
def test_raw_bytes_of_any_ids(spark, ids):
    df = spark.createDataFrame([(1, ids)], "doc_id long, ids array<int>")
    assert bytes(decode(df, RANKS, PATTERN).first().decoded) == encoding(RANKS, PATTERN).decode_bytes(ids)
