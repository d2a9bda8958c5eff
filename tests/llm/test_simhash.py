import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from kilnwork.llm.graph import components
from kilnwork.llm.simhash import POSITIONS, fingerprint, forest, linked, near_links, shared_bytes, simhash_groups


def brute_components(values, linked):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def brute_fingerprint(text):
    words = [w for w in text.encode().lower().split() if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_fingerprint_of_short_long_and_odd_texts():
    for text in ("", "  \t\n", "one", "One two three", "a b c d", "a b c d e a b c d e", "É x\x1cy A" * 3000):
        assert fingerprint(text) == brute_fingerprint(text)
    assert fingerprint(None) == 0


@pytest.mark.parametrize("posting_rows", [65_536, 3])
def test_links_join_what_all_pairs_join(spark, posting_rows):
    rng = random.Random(posting_rows)
    values = {rng.getrandbits(64) - 2**63 for _ in range(60)}
    for v in list(values):
        for _ in range(rng.randint(0, 4)):
            for i in rng.sample(range(64), rng.randint(1, 6)):
                v ^= 1 << i
            v = (v + 2**63) % 2**64 - 2**63
            values.add(v)
    nodes = spark.createDataFrame([(v,) for v in values], "fp long").repartition(3)
    links = near_links(nodes, 4, posting_rows)
    pairs = {(r.a, r.b) for r in links.collect()}
    got = {r.node: r.root for r in components(links).collect()}
    near = lambda a, b: (a ^ b).bit_count() <= 4 if (a < 0) == (b < 0) else ((a % 2**64) ^ (b % 2**64)).bit_count() <= 4
    want = brute_components(values, near)
    assert {v: got.get(v, v) for v in values} == want
    assert len(pairs) < len(values) ** 2 / 4


def test_four_shared_bytes_hold_a_triple():
    assert len(POSITIONS) == len(set(POSITIONS)) == 20
    assert all(any(set(t) <= set(four) for t in POSITIONS) for four in combinations(range(8), 4))


def test_tally_of_shared_bytes():
    rng = random.Random(5)
    x = np.array([rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) for _ in range(500)] + [0, 2**64 - 1, 1 << 63, 0x8000000100000000], dtype="<u8")
    tally = [sum(int(v) >> 8 * i & 0xFF == 0 for i in range(8)) for v in x]
    assert shared_bytes(x).tolist() == tally
    assert linked(x, 4).tolist() == [int(v).bit_count() <= 4 for v in x]


def test_forest_spans_a_chain():
    f = np.sort(np.array([0, 0b1111, 0b11111111, 0xFF << 50], dtype="<u8"))
    assert len(forest(f, 4)) == 2


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 700)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 700)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_of_copies_nulls_and_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base, "x"), (3, base + " more", "x"), (9, base, None), (1, None, "x"), (2, "", "x"), (7, "other words here", None), (7, "other words here", None), (None, "lone", "z")]
    docs = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], "doc_id long, text string, lang string, fp int, n int, key int")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash_groups(docs).collect())
    assert got == [(0, 0), (1, 1), (2, 1), (3, 3), (5, 3), (7, 7), (7, 7), (9, 3)]
    assert simhash_groups(docs.limit(0)).count() == 0
