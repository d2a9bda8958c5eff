import math
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from kilnwork.llm import langid, quality
from kilnwork.sources import store

from .test_dedup import brute_lines
from .test_langid_urls_licenses import brute_bin, brute_grams
from .test_near_text import brute_shingles, near
from .test_packing import brute_ids, check_packed
from .test_simhash import brute_components

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    first = given.filter("length(text) > 400").orderBy("doc_id").first()
    odd = [
        (9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, "12 34 !!", "en", "src1", 8), (9004, "x " * 30_000, None, None, None), (9004, "x " * 30_000, None, None, None),
        (None, first.text, "en", first.source, 1), (None, first.text + " more", "en", first.source, 1), (first.doc_id, first.text, "en", first.source, 1),
        (first.doc_id, first.text[::-1], "en", first.source, 1), (None, "A lone text of some words without a number to its name, which is written in plain English.", "en", first.source, 1),
    ]
    docs = given.union(spark.createDataFrame(odd, given.schema)).withColumn("row", F.lit("r")).withColumn("score", F.lit("s")).withColumn("at", F.monotonically_increasing_id())
    docs = store.saved(docs.withColumn("lang_pred", F.lit(None).cast("string")), "given")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "quality", "lines", "near duplicates", "packing"]
    rows_of = lambda df: sorted(df.collect(), key=lambda r: r.at)

    after = store.saved(stages["language"](spark, docs, SF), "a")
    assert after.columns == docs.columns
    languages = brute_languages([(r.doc_id, r.text, r.lang) for r in rows_of(docs)])
    want = [r for r, (lang, score) in zip(rows_of(docs), languages) if lang and score >= 0.5]
    assert rows_of(after) == want
    assert not {9001, 9002, 9003} & {r.doc_id for r in want}

    before, after = after, store.saved(stages["quality"](spark, after, SF), "b")
    # scores are held against their definition in test_quality; here each row by its own score
    scored = quality.quality_scores(before.withColumnRenamed("doc_id", "id").withColumnRenamed("at", "doc_id"), by_row(spark, before)).collect()
    assert after.columns == docs.columns
    kept = {r.doc_id for r in scored if r.kept}
    agree = [r.at for r in rows_of(after)]
    assert len(set(agree) ^ kept) <= 0.02 * len(scored)  # folds differ, as they go by id
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.at for r in before.join(labels.filter("quality = 1"), "doc_id").collect()}
    assert len(good & set(agree)) >= 0.97 * len(good)
    assert any(r.doc_id is None for r in rows_of(after))

    before, after = after, store.saved(stages["lines"](spark, after, SF), "c")
    assert after.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text, r.n_chars) for r in after.collect())
    assert got == sorted((none, d, text, len(text)) for none, d, _, _, text in brute_lines([(r.doc_id, r.text) for r in before.collect()]))

    before, after = after, store.saved(stages["near duplicates"](spark, after, SF), "d")
    assert after.columns == docs.columns
    rows = sorted(before.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.at))
    sets = [brute_shingles(r.text) for r in rows]
    roots = brute_components(range(len(rows)), lambda a, b: near(sets[a], sets[b]))
    want = sorted((r.doc_id is None, r.doc_id or 0, r.text) for n, r in enumerate(rows) if roots[n] == n)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in after.collect()) == want

    out = stages["packing"](spark, after, SF).collect()
    check_packed(out, 2048)
    want = []
    for r in after.collect():
        ids = np.array([*brute_ids(r.text), 0], dtype="<u4")
        want += [(r.doc_id is None, r.doc_id or 0, k, zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.ids_crc32) for r in out) == sorted(want)


def by_row(spark, docs):
    """The labels of SF by row number."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return docs.join(labels, "doc_id").select(F.col("at").alias("doc_id"), "quality", "toxic")


def brute_languages(rows):
    """(language or None, score) of each row by naive Bayes from its definition."""
    counts = {}
    for doc, text, lang in rows:
        if lang is not None and text is not None and (doc is None or zlib.crc32(str(doc).encode()) % 4 != 2):
            own = counts.setdefault(lang, Counter())
            for g, n in brute_grams(text).items():
                own[brute_bin(g, langid.BINS)] += n
    sums = {x: sum(c.values()) + 0.5 * langid.BINS for x, c in counts.items()}
    out = []
    for _, text, _ in rows:
        if not text or not any(map(str.isalpha, text)):
            out.append((None, 0.0))
            continue
        own = brute_grams(text)
        scale = min(1, 200 / sum(own.values()))
        total = {x: scale * sum(n * math.log((counts[x][brute_bin(g, langid.BINS)] + 0.5) / sums[x]) for g, n in own.items()) for x in counts}
        best = max(sorted(counts), key=lambda x: total[x])
        out.append((best, 1 / sum(math.exp(total[x] - total[best]) for x in counts)))
    return out


def test_scratch_tables_go_with_their_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    left = [p for p in store._made if "kilnwork-packing-" in p or "kilnwork-language-" in p]
    assert left == [out._kilnwork_path]


def test_empty_documents_pass_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = store.saved(stage(spark, docs, SF), "empty")
    assert docs.count() == 0


def test_runs_and_queries_beside_each_other_keep_their_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    stages = dict(corpus_pipeline.STAGES)

    def two_stages(_):
        after = store.saved(stages["language"](spark, docs, SF), "one")
        other = store.saved(spark.range(10), "other")  # a query between stages
        with ThreadPoolExecutor(1) as pool:  # and one in a thread while a stage runs
            beside = pool.submit(lambda: store.saved(spark.range(20), "beside"))
            lines = stages["lines"](spark, after, SF)
        after = store.saved(lines, "two")
        store.saved(stages["packing"](spark, after, SF), "three")
        return other.count(), beside.result().count(), after.count()

    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(two_stages, range(2)))
    assert found[0] == found[1] and found[0][:2] == (10, 20) and found[0][2] > 100
