import random

import pytest

import corpus_pipeline
from kilnwork.llm import near_text
from kilnwork.llm.near_text import drop_near_texts, rare_pairs

from .test_simhash import brute_components, brute_fingerprint


def brute_shingles(text, n=5):
    words = [w for w in (text or "").encode().lower().split() if w]
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def near(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_links_all_pairs_of_similarity_from_0_8(spark, seed):
    rng = random.Random(seed)
    texts = ["", " \n", "one", "ONE", "one two three four", "one two three", None]
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 500]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(1, 5)):
            base = edited(base, rng, max(1, round(len(base) * rng.choice([0.004, 0.01, 0.016, 0.02, 0.03]))))
            texts.append(" ".join(base))
    texts += texts[10:20]
    rng.shuffle(texts)
    rows = [(n, x, "en", "s", 0) for n, x in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, texts[0], "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    sets = [brute_shingles(x) for x in texts]
    want = brute_components(range(len(texts)), lambda a, b: near(sets[a], sets[b]))  # the row without doc_id repeats a text
    prints = [brute_fingerprint(x or "") for x in texts]
    bits = brute_components(range(len(texts)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert want != bits
    got = dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs.repartition(3), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for d, root in want.items() if d == root)
    assert got.columns == docs.columns


def test_rows_not_ids_are_judged(spark):
    long = " ".join(map(str, range(50)))
    other = "another text of its own here"
    rows = [(1, long, 1), (2, long + " x", 2), (2, other, 3), (3, other, 4), (3, long, 5), (3, long, 5), (None, "only without an id, and twice", 6), (None, "only without an id, and twice", 6), (None, long, 7), (4, None, 8), (5, "", 9), (6, " ".join(f"w{n}" for n in range(100_000)), 10)]
    docs = spark.createDataFrame([(d, t, n, "x", "y", "z") for d, t, n in rows], "doc_id long, text string, n int, at string, row string, key string")
    for parts in (1, 5):
        got = drop_near_texts(docs.repartition(parts))
        assert got.columns == docs.columns
        assert sorted(r.n for r in got.collect()) == [1, 3, 6, 8, 10]
    assert drop_near_texts(docs.limit(0)).count() == 0


def test_rare_pairs_lose_none_and_square_no_common_passage(spark):
    rng = random.Random(6)
    passage = [rng.getrandbits(60) for _ in range(60)]
    sets = [passage + [rng.getrandbits(60) for _ in range(rng.randint(20, 40))] for _ in range(120)]  # share a passage only
    for base in (sets[3], sets[50], [rng.getrandbits(60) for _ in range(9)]):
        for n in range(25):
            own = [x for x in base if rng.random() > 0.002 * n * 2] + [rng.getrandbits(60) for _ in range(n // 3)]
            sets.append(own)
    sets = [sorted(set(x)) for x in sets] + [[], [1]]
    rows = [(n, x, n % 7) for n, x in enumerate(sets)]
    got = {(r.a, r.b) for r in rare_pairs(spark.createDataFrame(rows, "key long, hashes array<long>, root int"), 0.8).collect()}
    want = set()
    for a, x, root in rows:
        for b, y, other in rows[a + 1 :]:
            both = len(set(x) & set(y))
            if root != other and x and y and both >= 0.8 * (len(x) + len(y) - both):
                want.add((a, b))
    assert len(want) > 300 and want <= got
    assert len({(a, b) for a, b in got if a < 120 and b < 120}) < 20


def test_fingerprints_give_the_candidates_of_all_pairs_within_four_bits(spark):
    rng = random.Random(9)
    prints = [rng.getrandbits(63) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 6))) for p in prints for _ in range(3)]
    nodes = list(enumerate(prints))
    got = near_text.fingerprint_pairs(spark.createDataFrame(nodes, "key long, fp long").repartition(3)).collect()

    def joined(pairs):
        root = {k: k for k, _ in nodes}
        for _ in nodes:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    want = [(a, b) for a, x in nodes for b, y in nodes if a < b and (x ^ y).bit_count() <= 4]
    assert joined([(r.a, r.b) for r in got]) == joined(want) and len(got) < len(nodes)


def test_a_link_that_no_band_gives_counts(spark):
    text = " ".join(f"w{i}" for i in range(40))
    sets = spark.createDataFrame([(i, near_text.shingle_set(t).view("<i8").tolist()) for i, t in enumerate((text, text + " x", "other words that are not alike at all"))], "key long, hashes array<long>")
    none = spark.createDataFrame([], "h long, key long")
    more = spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    assert {(r.node, r.root) for r in near_text.near_components(none, sets, 0.8, more).collect()} == {(0, 0), (1, 0)}
    assert near_text.near_components(none, sets, 0.8).count() == 0
