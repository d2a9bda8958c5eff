import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from kilnwork.llm import exact_dedup as exact_dedup_module
from kilnwork.llm.exact_dedup import _placed, exact_dedup, split_directory
from kilnwork.llm.line_dedup import line_dedup
from kilnwork.sources.store import saved


def test_directory_doubles_until_buckets_fit():
    rng = random.Random(1)
    histogram = defaultdict(int)
    for _ in range(5000):
        histogram[rng.choice((rng.getrandbits(16), rng.getrandbits(9)))] += 1
    buckets = split_directory(histogram, 100)
    seen = set()
    for prefix, depth, n in buckets:
        own = range(prefix << 16 - depth, (prefix + 1) << 16 - depth)
        assert not seen & set(own)
        seen |= set(own)
        assert n == sum(histogram.get(k, 0) for k in own)
        assert depth == 16 or n <= 100
    assert len(seen) == 1 << 16
    assert split_directory({}, 10) == [(0, 0, 0)]


def brute_exact(rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for doc, text in rows:
        groups[norm(text)].append(doc)
    return sorted((d, min(groups[norm(t)]), len(groups[norm(t)]), d == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in rows)


def test_exact_groups_also_with_colliding_keys(spark):
    rng = random.Random(2)
    texts = ["", None, "a b", "a \t\n b", "a\x1cb", " a b", "é x", "y" * 200_000, "y" * 199_999 + "z"] + [f"t{i}" for i in range(60)]
    rows = list(enumerate(texts)) + [(100 + i, rng.choice(texts[:20])) for i in range(600)] + [(700 + i, "hot text") for i in range(700)]
    docs = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "doc_id long, text string, bucket string, _key int, group_size int").repartition(4)
    want = brute_exact(rows)
    for bits, rows_of_bucket in ((64, 4), (64, 1024), (3, 4)):
        got = exact_dedup(docs, key_bits=bits, bucket_rows=rows_of_bucket)
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == want
    # key and digest collide: texts are still told apart, by their bytes
    got = exact_dedup(docs, key_bits=2, bucket_rows=8, digest=lambda t: F.lit("same"))
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == [x[:4] for x in want]
    assert exact_dedup(docs.limit(0)).count() == 0


def test_layout_follows_the_directory(spark, monkeypatch):
    rows = [(i, f"text {i % 700}") for i in range(1000)] + [(2000 + i, "hot") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    split = {r.doc_id: r.bucket for r in exact_dedup(docs, bucket_rows=64).collect()}
    assert len(set(split.values())) > 10 and split[1] == split[701] and len({split[2000 + i] for i in range(500)}) == 1
    pages = [r["count"] for r in _placed(saved(docs.select("doc_id", F.xxhash64("text").alias("_key"), F.monotonically_increasing_id().alias("_at")), "t"), 64, 64).groupBy("bucket", "_page").count().collect()]
    assert max(pages) < 130 and sum(pages) == 1500  # the hot key's bucket is dealt over pages
    monkeypatch.setattr(exact_dedup_module, "split_directory", lambda histogram, capacity, bits=16: [(0, 0, sum(histogram.values()))])
    one = exact_dedup(docs, bucket_rows=64)
    assert {r.bucket for r in one.collect()} == {0}


def test_exact_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup(docs).collect())
    assert got == [(False, 3, 3, True), (False, 3, 3, True), (True, 0, 1, True), (True, 3, 3, False)]


def brute_lines(rows):
    blank = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(blank).translate(lower)
    holders = defaultdict(set)
    for doc, text in rows:
        for x in (text or "").split("\n"):
            if doc is not None and len(key(x)) >= 20:
                holders[key(x)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(holders[key(x)]) < 3 or doc == max(holders[key(x)])]
        out.append((doc is None, doc or 0, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines(spark):
    rng = random.Random(3)
    shared = ["This line is shared by many", "  THIS line is shared by many\t", "Ä line with an umlaut here", "ä line with an umlaut here", "short", "exactly twenty chars", ""]
    rows = [(i, "\n".join(rng.choice([*shared, f"own line number {i} {j} ......"]) for j in range(rng.randint(0, 8)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (None, shared[0]), (7, shared[0]), (7, shared[0]), (7, shared[1] + "\nown line of another row of 7")]
    rows += [(600, "\n".join(f"line {i} of a very long document" for i in range(30_000))), (601, shared[0] + "\r")]
    docs = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], "doc_id long, text string, n_lines int, key string, _drops string").repartition(3)
    got = line_dedup(docs)
    assert got.columns == ["doc_id", "text", "key", "_drops", "n_lines", "n_dropped"]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute_lines(rows)
    assert line_dedup(docs.limit(0)).count() == 0
