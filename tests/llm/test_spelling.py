import random
import re
import zlib
from collections import Counter

import pytest

from kilnwork.llm.spelling import near_pairs, near_words, spelling_groups


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    others = {w: [x for x in n if near(w, x)] for w in n}
    forms = {}
    for w, xs in others.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, n[w], len(others[w]), forms[w], n.get(forms[w]), root))
    return sorted(out)


def got(df, **options):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling_groups(df, **options).collect())


@pytest.mark.parametrize("block_words", [256, 3])
def test_groups_equal_brute_force(spark, block_words):
    rng = random.Random(1)
    stems = ["".join(rng.choice("abcéÿ") for _ in range(rng.randint(5, 9))) for _ in range(30)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "Überall", "ÜBERALL", "x÷y×zab"]
    rows = []
    for i in range(150):
        words = []
        for _ in range(60):
            w = rng.choice(stems[: rng.randint(1, len(stems))])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcé") + w[at:], w[:at] + rng.choice("abcé") + w[at + 1 :]])
            words.append(w)
        rows.append((i if i % 10 else None, rng.choice([" ", ", ", "_", "1", "中"]).join(words)))
    rows.append((778, "kettle " * 40 + "kettla " * 16 + "kettlab " * 6 + "kittlab " * 3))
    rows += [(7, None), (8, ""), (9, "a" * 30_000 + " " + "a" * 30_000 + " " + "a" * 29_999 + "b"), (10, ("b" + "a" * 29_999 + " ") * 3), (11, ("a" * 30_000 + " ") * 9)] * 2
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string").repartition(5)
    want = brute(rows)
    assert sum(w[3] is not None for w in want) > 20 and any(w[5] not in (w[0], w[3]) for w in want)
    assert got(df, block_words=block_words) == want


def test_every_pair_once_and_blocks_of_one_open_letter(spark):
    words = sorted({f"{a}{b}{c}xy{d}" for a in "abcdef" for b in "abc" for c in "abcd" for d in ("", "z", "zz")})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    for block_words in (2, 20, 1000):
        found = [(r.word, r.near) for r in near_words(df, block_words=block_words).collect()]
        assert len(found) == len(set(found))
        assert set(found) == {(a, b) for a in words for b in words if near(a, b)}


def test_pairs_are_left_to_the_forward_block():
    words = [b"abcde", b"abcdx", b"xbcde", b"abcdef"]
    pairs = lambda below: {tuple(sorted((int(a), int(b)))) for a, b in zip(*near_pairs(words, 5, below))}
    assert pairs(6) == {(0, 1), (0, 2), (0, 3)}
    assert pairs(2) == {(0, 2)}


def test_no_words(spark):
    assert spelling_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert got(spark.createDataFrame([(1, None), (2, ""), (3, "ab cd")], "doc_id long, text string")) == []
