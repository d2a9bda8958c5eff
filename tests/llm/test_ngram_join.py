import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from kilnwork.llm import ngram_join
from kilnwork.llm.ngram_join import Tree, first_tokens, fits, folded, joined, ngram_components, packed, point, runs, token_set, unpacked, words_of

from .test_simhash import brute_components


def brute_set(text, shingle=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1)))


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    near = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and bool(sets[b])
    root = brute_components(range(len(rows)), near)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root[i]] = min(doc_id, least.get(root[i], doc_id))
    return sorted(((d, len(sets[i]), least.get(root[i]) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed):
    """Copies, edits around the least similarity, chains of edits, passages that many share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    rows, texts = [], []
    for i in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 6, 20, 60, 200]))]
        texts.append(base)
        for _ in range(rng.randint(0, 6)):
            base = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(base)
        texts.append([*passage, *(rng.choice(words) for _ in range(rng.randint(0, 60)))])
        texts.append([*passage, *(rng.choice(words) for _ in range(3))])
    for i, t in enumerate(texts):
        rows.append((rng.randrange(10**6) if i % 9 else None, rng.choice([" ", "\n", " \t"]).join(t)))
    rows += [rows[0], rows[5], (rows[6][0], "other text"), (11, None), (12, ""), (13, " \n"), (14, "A b"), (15, "a  B"), (16, "x x x x x x x"), (17, "x x x x x"), (None, None)]
    return rows


@pytest.mark.parametrize("leaf", [256, 4])
def test_components_equal_brute_force(spark, leaf, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    for seed in (1,) if leaf > 4 else (2,):
        rows = corpus(seed)
        df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, node int, key string, root int").repartition(3)
        assert sorted((tuple(r) for r in ngram_components(df).collect()), key=repr) == brute(rows)


def test_trees_keep_every_pair_that_links():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = np.unique(rng.integers(0, 2**63, rng.integers(1, 700), dtype="<u8"))
        sets.append(base)
        for _ in range(3):
            keep = rng.random(len(base)) > rng.uniform(0, 0.2)
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**63, rng.integers(0, len(base) // 8 + 1), dtype="<u8")])))
    sets = [s for s in sets if len(s)]
    sizes, points = np.array([len(s) for s in sets]), [unpacked(packed(point(s))) for s in sets]
    tree = Tree(np.concatenate([folded(p[None], 64) for p in points]), sizes)
    found = set(zip(*map(np.ndarray.tolist, joined(tree, tree, 80))))
    shared = [[len(np.intersect1d(a, b, assume_unique=True)) for b in sets] for a in sets]
    links = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if fits(shared[i][j], sizes[i], sizes[j], 80)}
    assert links <= found and len(links) > len(sets) and len(found) < len(sets) ** 2 / 4
    ranks = rng.permutation(ngram_join.ORDER_GROUPS).astype(np.uint64)
    first = [set(first_tokens(s, ranks, 80).tolist()) for s in sets]
    assert all(first[i] & first[j] for i, j in links)


def test_tokens_are_equal_where_runs_of_words_are():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "C", "c", "é", "aa"]) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    name = {}
    for t in texts:
        words = words_of(t)
        for i, h in enumerate(runs(words, 5).tolist()):
            assert name.setdefault(h, tuple(words[i : i + 5])) == tuple(words[i : i + 5])
    assert len(set(name.values())) == len(name)


def test_filter_holds_every_key(spark):
    keys = [bytes([i % 256, i // 256]) * 8 for i in range(3000)]
    bits = ngram_join.key_filter(spark.createDataFrame([(k,) for k in keys], "key binary"), len(keys))
    held = lambda k: bits[(at := xxhash.xxh64_intdigest(k, 42) & (8 * len(bits) - 1)) >> 3] >> (at & 7) & 1
    assert all(held(k) for k in keys) and sum(held(bytes([i % 256, i // 256]) * 7) for i in range(3000)) < 300


def test_large_counts_and_long_texts(spark):
    assert unpacked(packed(np.array([3, 70_000]))).tolist() == [3, 70_000]
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, long), (2, long.replace("v7 ", "x ")), (3, "short one"), (4, long[: len(long) // 2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_components(df).collect()) == brute(rows)
    assert len(point(token_set(long))) > 64


def test_empty_table(spark):
    assert ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_group_of_near_copies_is_not_squared(spark, monkeypatch):
    """Pairs of a group link by chance and not all with its lead; what the trees give stays linear."""
    rng, made, trees = random.Random(7), [], ngram_join._Join.trees
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(w if rng.random() > 0.012 else f"x{rng.random()}" for w in base)) for i in range(160)]

    def counted(self, cells):
        made.append(pairs := ngram_join.saved(trees(self, cells), "counted"))
        return pairs

    monkeypatch.setattr(ngram_join._Join, "trees", counted)
    assert sorted((tuple(r) for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr) == brute(rows)
    assert sum(p.count() for p in made) <= 8 * len(rows)


def test_words_of_a_batch_are_hashed_as_one_by_one(monkeypatch):
    rng = random.Random(2)
    texts = [None, "", " ", "a", *("".join(rng.choice(["a", "B", " ", "\n\t", "\x1c\x85", "é", "x" * 70, "word", "\x0b\r"]) for _ in range(rng.randint(0, 40))) for _ in range(300)), ""]
    for piece in (40, 1 << 21):
        monkeypatch.setattr(ngram_join, "PIECE", piece)
        found = []
        for _, _, each, ends in ngram_join.hashed_texts(pa.array(["cut", *texts]).slice(1), 5):
            found += np.split(each, ends[:-1])
        assert len(found) == len(texts)
        assert all(x.tolist() == runs(words_of(t), 5).tolist() for x, t in zip(found, texts))
