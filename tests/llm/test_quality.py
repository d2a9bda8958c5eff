import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnwork.llm import quality
from kilnwork.llm.quality import fit_classifier, keep_good, quality_scores
from kilnwork.llm.rules import covers, learn, quality_rules, verdict
from kilnwork.llm.textstats import COLUMNS, FEATURES, counts, labelled_sample, repeated, text_stats

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta", "lambda", "zeta"]
WORDS_TEXT = " ".join(f"{w}{n}" for n in range(10, 16) for w in WORDS)


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_counts_of_odd_texts():
    rng = random.Random(1)
    texts = ["", None, " \n\t", "a\x1cb é x # | <", "x\ny\nx\n\n\n x", "a b c d e " * 3, "a a a a a a", "a b c d e f a b c d e"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += ["\n".join(rng.choice(["# a", "b", " ", "b "]) for _ in range(12)) for _ in range(20)]
    for text in texts:
        assert counts(text)[:5] == brute_counts(text), text
    assert repeated([b"a"] * 4) == 0


def fixture(spark, n=900):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(rng.randint(30, 80))]
        docs.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), f"s{i % 5 if i % 2 else 0}", "en"))
        if i % 2 or i % 8 == 0:
            labels.append((i, 0 if bad else 1, 0))
    labels += [(None, 1, 0), (3, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_reject_what_labels_reject(spark):
    docs, labels = fixture(spark)
    extra = spark.createDataFrame([(2000, None, None, None), (2001, "", None, None), (2002, "a b c d e f g h i j " * 3, None, None), (2001, "", None, None), (2003, "ALPHA77!! " * 200_000, None, None), (None, WORDS_TEXT, None, None)], docs.schema)
    out, rules = quality_rules(docs.union(extra).withColumn("kept", F.lit(1)).withColumn("n_words", F.lit(1)), labels)
    got = {r.doc_id: r for r in out.collect()}
    assert rules and out.count() == 906
    assert got[2003].base_failed and got[2003].n_words == 200_000 and got[None].kept
    assert all(got[i].kept == (i % 4 != 0) for i in range(900))
    assert got[2000].base_failed and got[2001].base_failed and got[2002].base_failed and not got[2002].kept
    assert quality_rules(docs.limit(0), labels)[0].count() == 0
    none, empty = quality_rules(docs, labels.limit(0))
    assert empty == [] and none.filter("not kept").count() == 0


def test_verdict_is_the_first_rule_that_holds(spark):
    rng = np.random.default_rng(3)
    x = rng.random((400, len(FEATURES)))
    good = ((x[:, 0] <= 0.7) & ~((x[:, 1] > 0.6) & (x[:, 2] <= 0.4))).astype(int)
    rules = learn(x, good)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in FEATURES))
    got = [r.v for r in frame.select(verdict(rules).alias("v")).collect()]
    want = [next((n for n, rule in enumerate(rules, 1) if covers(rule, row[None])[0]), 0) for row in x]
    assert got == want
    assert np.mean((np.array(got) == 0) == (good == 1)) > 0.9
    assert learn(np.zeros((0, len(FEATURES))), np.zeros(0)) == []


def test_scores_separate_and_shrink(spark):
    docs, labels = fixture(spark)
    extra = spark.createDataFrame([(3000, None, "new", None), (3001, "", None, "fr"), (3002, "ALPHA77!! " * 200_000, "s0", "en"), (None, WORDS_TEXT, "s0", "en"), (None, WORDS_TEXT.upper().replace(" ", "!! "), "s0", "en"), (1, WORDS_TEXT.upper().replace(" ", "!! "), "s0", "en")], docs.schema)
    all_docs = docs.union(extra).withColumn("evidence", F.lit("x")).withColumn("n", F.lit(1)).withColumn("_row", F.lit(2)).repartition(3)
    scored = quality_scores(all_docs, labels).collect()
    rows = {r.doc_id: r for r in scored if r.doc_id != 1}
    assert len(scored) == 906
    assert np.mean([rows[i].kept == (i % 4 != 0) for i in range(900) if i != 1]) > 0.99
    share = np.mean([r.host_posterior for r in rows.values()])
    assert abs(rows[3000].host_posterior - share) < 0.15  # a site of one document stays near the prior
    assert all(0 <= r.score <= 1 for r in scored) and not rows[3002].kept
    kept = keep_good(all_docs, labels)
    assert kept.columns == all_docs.columns
    # each row by its own verdict: of null ids, and of one id on two texts, one row stays
    found = Counter((r.doc_id, r.text) for r in kept.collect())
    assert sum(found.values()) == sum(r.kept for r in scored)
    assert [t == WORDS_TEXT for d, t in found if d is None] == [True]
    assert [d for d, t in found if d == 1] == [1]
    assert quality_scores(docs.limit(0), labels).count() == 0 and keep_good(docs.limit(0), labels).count() == 0
    assert quality_scores(docs, labels.limit(0)).filter("kept").count() == 900


def test_sections_that_cannot_be_broadcast_give_the_same(spark, monkeypatch):
    docs, labels = fixture(spark, 200)
    both = []
    for most in (quality.BROADCAST_SECTIONS, 0):
        monkeypatch.setattr(quality, "BROADCAST_SECTIONS", most)
        both.append(sorted((r.doc_id, round(r.score, 9)) for r in quality_scores(docs, labels).collect()))
    assert both[0] == both[1]


def brute_strength(groups):
    """Groups (rate, tried, expected): the prior's strength by moments."""
    spread = sum(t * (r - e) ** 2 for r, t, e in groups)
    most = sum(t * e * (1 - e) for _, t, e in groups)
    between = max(0.0, spread - sum(e * (1 - e) for _, _, e in groups)) / most
    return float(np.clip(1 / between - 1 if between > 0 else quality.MOST_STRENGTH, quality.LEAST_STRENGTH, quality.MOST_STRENGTH))


def test_scores_against_brute_force(spark):
    """The classifier's optimum, tallies, shrinkage and score, from their definitions."""
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(260):
        bad = rng.random() < (0.7 if i % 3 == 0 else 0.2)
        words = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(rng.randint(20, 60))]
        docs.append((i, " ".join(w.upper() if bad and rng.random() < 0.5 else w for w in words), f"s{i % 7}", f"p{rng.randint(0, 2)}"))
        if rng.random() < 0.5:
            labels.append((i, int(not bad), 0))
    docs.append((None, "alpha beta", "s1", None))
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in quality_scores(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    known = dict((d, q) for d, q, _ in labels)

    names = {n: i for i, n in enumerate(COLUMNS)}
    over = lambda c, a, b: c[names[a]] / max(c[names[b]], 1)
    def features(text):
        c = counts(text)
        pairs = [("n_symbols", "word_chars"), ("n_upper", "n_letters"), ("n_marks", "word_chars"), ("n_digits", "word_chars"), ("n_letters", "word_chars"), ("word_chars", "n_words"),
                 ("n_distinct_words", "n_words"), ("n_repeat_words", "n_words"), ("n_dup_lines", "n_lines"), ("n_short_lines", "n_lines"), ("n_stops", "n_words")]
        return [over(c, a, b) for a, b in pairs] + [float(c[names["n_words"]]), float(c[names["longest_word"]])]

    x = np.array([features(t) for _, t, _, _ in docs])
    folds = np.array([r.f for r in spark.createDataFrame([(n, d[0]) for n, d in enumerate(docs)], "n int, doc_id long").select("n", F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS)).alias("f")).orderBy("n").collect()])
    labelled = np.array([d[0] in known for d in docs])
    truth = np.array([known.get(d[0], -1) for d in docs])
    evidence, tallies = np.zeros((quality.FOLDS, len(docs))), []
    for fold in range(quality.FOLDS):
        train = labelled & (folds != fold)
        y = truth[train]
        mean, scale = x[train].mean(axis=0), x[train].std(axis=0)
        scale[scale < 1e-9] = 1
        z = np.clip((x - mean) / scale, -6, 6)
        z = np.hstack([z, z * z])
        w = quality.fit_classifier(x[train], y)[2]
        p = 1 / (1 + np.exp(-(z[train] @ w[:-1] + w[-1])))
        assert np.abs(z[train].T @ (p - y) + w[:-1]).max() < 1e-3 and abs((p - y).sum()) < 1e-3  # ridge 1: no slope is left
        prior = np.log(y.mean() / (1 - y.mean()))
        evidence[fold] = np.clip(z @ w[:-1] + w[-1] - prior, -30, 30)
        soft = 1 / (1 + np.exp(-(evidence[fold] + prior)))
        others = np.flatnonzero(folds != fold)
        tallies.append([(docs[n][2], docs[n][3] or "", 1.0 if labelled[n] else quality.SOFT_WEIGHT, float(truth[n]) if labelled[n] else soft[n]) for n in others])

    def sums(rows):
        rows = list(rows)
        return sum(t[2] for t in rows), sum(t[2] * t[3] for t in rows)

    for fold, tally in enumerate(tallies):
        n, g = sums(tally)
        share = min(max(g / n, 1e-4), 1 - 1e-4)
        hosts = {h: sums(t for t in tally if t[0] == h) for h in {d[2] for d in docs}}
        k_host = brute_strength([(g / n, n, share) for n, g in hosts.values() if n])
        of_host = {h: (g + k_host * share) / (n + k_host) for h, (n, g) in hosts.items()}
        sections = {s: sums(t for t in tally if t[:2] == s) for s in {(d[2], d[3] or "") for d in docs}}
        k_path = brute_strength([(g / n, n, of_host[h]) for (h, _), (n, g) in sections.items() if n])
        for n in np.flatnonzero(folds == fold):
            doc, _, h, path = docs[n]
            tried, good = sections[h, path or ""]
            of_path = (good + k_path * of_host[h]) / (tried + k_path)
            score = 1 / (1 + math.exp(-(evidence[fold][n] + math.log(of_path / (1 - of_path)))))
            r = got[doc]
            assert (r.evidence, r.host_posterior, r.path_posterior, r.score) == pytest.approx((evidence[fold][n], of_host[h], of_path, score), rel=1e-6, abs=1e-9)
            assert r.kept == (score >= 0.5)


def test_a_label_leaves_its_own_documents_score_and_layout_changes_nothing(spark):
    docs, labels = fixture(spark, 600)
    run = lambda d, y: {r.doc_id: (round(r.evidence, 9), round(r.score, 9), r.kept) for r in quality_scores(d, y, max_rows=100).collect()}
    base = run(docs.repartition(2), labels)
    assert base == run(docs.repartition(7, "text"), labels.repartition(5))
    flipped = labels.withColumn("quality", F.when(F.col("doc_id").isin(7, 9, 11), 1 - F.col("quality")).otherwise(F.col("quality")))
    changed = run(docs, labels.withColumn("quality", F.when(F.col("doc_id") == 9, 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert changed[9] == base[9] and changed != base
    assert run(docs, flipped)[9] != base[9]  # others' labels do feed it
    verdicts = [{r.doc_id: (r.rule, r.kept) for r in quality_rules(docs.repartition(n), labels, max_rows=100)[0].collect()} for n in (2, 7)]
    assert verdicts[0] == verdicts[1]


def test_a_hot_id_stays_within_the_bound(spark):
    rows = [(i % 10, f"alpha {i} beta") for i in range(1500)] + [(None, "gamma")] * 50
    stats = lambda rows: text_stats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("_text", F.xxhash64("text")), ["doc_id", "_text"])
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(None, 1), (3, None)], "doc_id long, quality int")
    for most in (100, 5000):
        x, y, ids = labelled_sample(stats(rows), labels, most)
        assert x.shape == (min(most, 1500), len(FEATURES)) and len(y) == len(ids) == len(x)
        assert (y == ids % 2).all()
    # one text that an id repeats, with as many labels of it, counts once
    many = spark.createDataFrame([(1, int(k % 3 > 0)) for k in range(3000)] + [(2, 0)] * 3000, "doc_id long, quality int")
    x, y, ids = labelled_sample(stats([(1, "same text")] * 3000 + [(2, f"other {n % 3}") for n in range(30)]), many, 60)
    assert sorted(zip(ids.tolist(), y.tolist())) == [(1, 1), (2, 0), (2, 0), (2, 0)]


def test_classifier_without_two_kinds_says_nothing():
    k = len(FEATURES)
    for y in (np.zeros(0), np.ones(5)):
        mean, scale, w, prior = fit_classifier(np.ones((len(y), k)), y)
        assert not w.any() and prior == 0
