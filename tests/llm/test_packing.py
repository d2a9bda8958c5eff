import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kilnwork.llm.packing import best_fit, pack, pieces, plan_bins, reduce_by_dominance, word_ids

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

ODD = [
    "", None, "it's O'Neil's. I'LL, don't... x.́ Àb İstanbul ΑΣ. <|endoftext|> 12.5,3 a,b. é. É, \x1c\x1d x", "日本語。テスト, ok.",
    "EN,!! THEDHESH!! auf&&& der### x²,y _a., b_. c", "A. B, C.\nD,\n", "word " * 3000, "\t\n \x0b", "naïve Œuvre ŒUVRE ß ẞ",
]


def brute_ids(text):
    t = Tokenizer.from_file(VOCABULARY)
    return t.encode(text or "", add_special_tokens=False).ids


def test_word_ids_are_the_tokenizers():
    for text, got in zip(ODD, word_ids(VOCABULARY, ODD), strict=True):
        assert np.frombuffer(got, dtype="<u4").tolist() == brute_ids(text)


def test_word_ids_of_random_strings():
    rng = random.Random(11)
    units = ["İ", "i̇", "क़", "é", "É", "ß", "Σ", "a", "Bc", "word", "it's", ".", ",", "!", ")", "'", "'s", "_", " ", "  ", "\n", "\x1c", "\u0307", "\u0301", "中", "9", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "＃", "½", "²"]
    texts = ["".join(rng.choice(units) for _ in range(rng.randint(1, 14))) for _ in range(5000)]
    library = Tokenizer.from_file(VOCABULARY)
    for text, got in zip(texts, word_ids(VOCABULARY, texts), strict=True):
        assert np.frombuffer(got, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_rows_without_an_id_are_dealt_over_salts(spark, monkeypatch):
    from kilnwork.llm import packing

    seen, keep = [], packing.saved
    monkeypatch.setattr(packing, "saved", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    rows = spark.range(4000).selectExpr("cast(null as long) as doc_id", "0 as piece", "0L as start", "10L as length", "1L as ids_crc32")
    out = pack(rows, 2048)
    assert out.select("sequence_id", "offset").distinct().count() == 4000
    assert seen[0].select("_salt").distinct().count() > 500


def fewest_bins(items, capacity):
    """Exact by trying to place each item, largest first, in every bin it fits."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= items[i]:
                rest = list(rooms)
                rest[rest.index(room)] = room - items[i]
                place(i + 1, rest)
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


def spread(histogram):
    return [k for k, n in histogram.items() for _ in range(n)]


def test_reduction_keeps_the_optimum():
    rng = random.Random(3)
    fixed_any = 0
    for _ in range(250):
        capacity = rng.randint(4, 20)
        histogram = {rng.randint(1, capacity): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        if sum(histogram.values()) > 9:
            continue
        fixed, rest = reduce_by_dominance(histogram, capacity)
        bins = sum(n for n, _ in fixed)
        fixed_any += bins
        assert bins + fewest_bins(spread(rest), capacity) == fewest_bins(spread(histogram), capacity)
    assert fixed_any > 100


def test_bins_hold_everything_once():
    rng = random.Random(4)
    for _ in range(300):
        capacity = rng.randint(1, 60)
        histogram = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(0, 12))}
        for layouts in (plan_bins(histogram, capacity), best_fit(histogram, capacity)):
            held = {}
            for bins, contents in layouts:
                assert bins > 0 and sum(k * n for k, n in contents.items()) <= capacity
                for k, n in contents.items():
                    held[k] = held.get(k, 0) + bins * n
            assert held == histogram


def check_packed(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_pieces_and_places(spark):
    texts = [*ODD, *["same words again here"] * 40, "long " * 5000]
    rows = [(i, t, "x", 7, 7) for i, t in enumerate(texts)] + [(0, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, length int, offset int").repartition(3)
    got = pack(pieces(docs, VOCABULARY, 2048, 0), 2048).collect()
    assert check_packed(got, 2048) == -(-sum(r.length for r in got) // 2048)
    want = []
    for doc, text, *_ in rows:
        ids = np.array([*brute_ids(text), 0], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            want.append((doc, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)


def test_empty_table_and_bad_lengths(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pack(pieces(none, VOCABULARY)).count() == 0
    bad = spark.createDataFrame([(1, 0, 9)], "doc_id long, piece int, length long")
    with pytest.raises(ValueError):
        pack(bad, 8)
