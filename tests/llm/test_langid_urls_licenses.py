import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnwork.llm import langid
from kilnwork.llm.licenses import TEMPLATES, license_scan
from kilnwork.llm.urlfilter import MarkovModel, ORDER, RULES, calibrate, fit, least_error, ratio, sample, url_filter

EN, DE, FR = "the and thing of with that here".split(), "der und dass über schön nicht".split(), "le été où ça être avec".split()


def test_languages_on_held_out_rows(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(4, 40))), lang) for i in range(300) for words, lang in [((EN, "en"), (DE, "de"), (FR, "fr"))[i % 3]]]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 !? \n", "de"), (903, "the thing", None), (904, "der und " * 400_000, None), (None, "avec été", None), (5, "the", "en"), (5, "the", "en")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, lang_pred string, score int")
    docs = docs.withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(docs.filter("not held_out"))
    assert model[0] == ["de", "en", "fr"]
    got = langid.predict(docs, model)
    found = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows) and got.columns == ["doc_id", "text", "lang", "held_out", "lang_pred", "score"]
    held = [r for r in found.values() if r.held_out and (r.doc_id or 999) < 300]
    assert len(held) > 40 and np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert {found[i].lang_pred for i in (900, 901, 902)} == {"und"} and found[900].score == 0
    assert found[903].lang_pred == "en" and found[904].lang_pred == "de" and found[None].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in found.values())
    assert langid.predict(docs.limit(0), model).count() == 0
    assert langid.predict(docs, langid.train(docs.limit(0))).filter("lang_pred != 'und'").count() == 0


def brute_grams(text):
    codes = " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " "
    codes = re.sub(" +", " ", codes)
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            if codes[i : i + n] != " ":
                out[codes[i : i + n]] += 1
    return out


def brute_bin(gram, bins):
    h = len(gram)
    for c in gram:
        h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
        h ^= h >> 29
    return h % bins


def test_naive_bayes_against_brute_force(spark, monkeypatch):
    rng, bins = random.Random(4), 64
    monkeypatch.setattr(langid, "BLOCK_LANGUAGES", 2)  # two blocks
    monkeypatch.setattr(langid, "BATCH_BINS", 100)
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))), lang) for _ in range(60) for words, lang in ((EN, "en"), (DE, "de"), (FR, "fr"))]
    langs, table = langid.train(spark.createDataFrame(rows, "text string, lang string").repartition(4), bins)
    assert langs == ["de", "en", "fr"] and table.shape == (bins, 3)
    counts = {lang: [0.5] * bins for lang in langs}
    for text, lang in rows:
        for g, n in brute_grams(text).items():
            counts[lang][brute_bin(g, bins)] += n
    logs = {lang: [math.log(x / sum(c)) for x in c] for lang, c in counts.items()}
    assert np.allclose(table, np.array([logs[x] for x in langs]).T, atol=1e-5)
    texts = [t for t, _ in rows] + ["Ça!  DER und the 12 thing", "x", "ab c"]
    got = langid.predict(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), (langs, table)).collect()
    for r in got:
        own = brute_grams(r.text)
        total = {x: sum(n * logs[x][brute_bin(g, bins)] for g, n in own.items()) * min(1, 200 / sum(own.values())) for x in langs}
        best = max(langs, key=lambda x: total[x])
        assert r.lang_pred == best
        assert r.score == pytest.approx(1 / sum(math.exp(total[x] - total[best]) for x in langs), rel=1e-3)


def test_a_language_is_the_same_beside_200_others(spark, monkeypatch):
    own = spark.createDataFrame([(t, x) for words, x in ((EN, "en"), (DE, "zde")) for t in words], "text string, lang string")
    others = spark.createDataFrame([(chr(0x4E00 + i) * 5, f"l{i:03}") for i in range(200)], "text string, lang string")
    few, many = langid.train(own), langid.train(own.union(others))
    assert few[1].shape == (langid.BINS, 2) and many[1].shape == (langid.BINS, 202)
    assert (few[1][:, 0] == many[1][:, 0]).all() and (few[1][:, 1] == many[1][:, -1]).all()
    docs = own.union(others).union(spark.createDataFrame([("", None), (None, None)], own.schema))
    monkeypatch.setattr(langid, "BATCH_BINS", 50)
    got = {m: sorted((r.text or "", r.lang_pred, round(r.score, 9)) for r in langid.predict(docs, many).collect()) for m in (monkeypatch.setattr(langid, "BLOCK_LANGUAGES", n) or n for n in (100, 1000))}
    assert got[100] == got[1000]
    assert langid.predict(docs, many).filter("lang_pred = lang").count() > 190


def test_grams_of_a_long_text_are_those_of_its_parts(monkeypatch):
    text = "Ab c, d" * 50
    whole = np.concatenate(list(langid.grams(text)))
    monkeypatch.setattr(langid, "BLOCK", 16)
    assert sorted(whole) == sorted(np.concatenate(list(langid.grams(text))))


def brute_rule(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    best = None
    for verdict, rule in RULES:
        site, _, start = rule.partition("/")
        if (host == site or host.endswith("." + site)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_urls(spark):
    rng = random.Random(2)
    urls = [None, "", "no scheme", "://", "http://COM/x", "http://a.example.com", "http://www.EXAMPLE.com/en/a?b#c", "ftp://xexample.com/en/", "http://x.net/es", "http://x.net/es/1://y", "http://é.net/fr/?", "http://a.org/?q://z", "http://com?x/", "http://a.com/\npath"]
    urls += [f"http://{rng.choice(['a', 'b', 'www.example'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr', 'xx'])}/{rng.randint(0, 99)}" for _ in range(400)]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)] + [(3, None, None, None)], "page_id long, url string, host string, verdict int")
    rows = url_filter(pages).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        host, path, best = brute_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1]), r.url
        assert r.verdict in ("allow", "block") and (best is None or r.verdict == best[0])
    open_fr = [r.verdict for r in rows if r.rule is None and r.url and re.search(r"\.net/xx|\.org/(es|fr)", r.url)]
    assert open_fr.count("block") > len(open_fr) / 2
    assert url_filter(pages.limit(0)).count() == 0
    assert url_filter(pages.filter("url is null")).filter("verdict = 'allow'").count() == 2


def brute_probability(urls, times, context, char):
    """Witten-Bell from the definition: orders 0 to 4 over bytes, mixed from a uniform one up."""
    p = 1 / 256
    for k in range(ORDER + 1):
        own = context[len(context) - k :]
        follow = {}
        for u, n in zip(urls, times):
            b = b"\x02" * ORDER + u.encode() + b"\x03"
            for i in range(ORDER, len(b)):
                if b[i - k : i] == own:
                    follow[b[i]] = follow.get(b[i], 0) + n
        if follow:
            p = (follow.get(char, 0) + len(follow) * p) / (sum(follow.values()) + len(follow))
    return p


def brute_log_likelihood(urls, times, url):
    b = b"\x02" * ORDER + url.encode() + b"\x03"
    return sum(math.log(brute_probability(urls, times, b[i - ORDER : i], b[i])) for i in range(ORDER, len(b)))


def test_markov_model_against_its_definition():
    urls, times = ["abc", "abd", "xyz", "ab/é"], [1, 5, 2, 1]
    model = MarkovModel.train(urls, times)
    for url in ("abc", "", "qqq", "xyd", "ab/é", "abcabc" * 20):
        got, size = model.log_likelihood([url])
        assert size[0] == len(url.encode()) + 1
        assert got[0] == pytest.approx(brute_log_likelihood(urls, times, url))
    assert sum(brute_probability(urls, times, b"\x02\x02ab", c) for c in range(256)) == pytest.approx(1)
    assert MarkovModel.train(["a", "a", "b"]).log_likelihood(["a"])[0] == MarkovModel.train(["a", "b"], [2, 1]).log_likelihood(["a"])[0]


def test_calibration():
    assert calibrate(np.array([1.0, 2.0]), np.array([-1.0, 0.0])) == pytest.approx(0.5)
    assert calibrate(np.array([]), np.array([1.0])) == -np.inf
    a, r = np.array([0.1, 0.5, 0.9]), np.array([0.0, 0.3, 0.6])
    plain = calibrate(np.repeat(a, [5, 1, 1]), np.repeat(r, [1, 1, 9]))
    assert calibrate(a, r, [5, 1, 1], [1, 1, 9]) == pytest.approx(plain)
    model = MarkovModel.train(["a"])
    assert len(ratio((model, model), [])) == 0


def test_url_verdicts_against_brute_force(spark):
    rng = random.Random(7)
    urls = [f"http://{rng.choice(['a', 'b'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr'])}/{rng.randint(0, 9)}" for _ in range(90)]
    got = url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)).collect()
    judged = {"allow": Counter(), "block": Counter()}
    for u in urls:
        if best := brute_rule(u)[2]:
            judged[best[0]][u] += 1
    chosen = {k: [(r.url, r.n) for r in spark.createDataFrame([(u, n, k) for u, n in judged[k].items()], "url string, n long, k string").orderBy(F.pmod(F.xxhash64("url"), F.lit(1 << 30)), "url").collect()] for k in judged}
    kinds = {k: [x for i, x in enumerate(v) if i % 5] for k, v in chosen.items()}
    llr = lambda u: (brute_log_likelihood(*zip(*kinds["allow"]), u) - brute_log_likelihood(*zip(*kinds["block"]), u)) / (len(u) + 1)
    cut = calibrate(*(np.array([llr(u) for u, _ in chosen[k][::5]]) for k in ("allow", "block")), *([n for _, n in chosen[k][::5]] for k in ("allow", "block")))
    for r in got:
        best = brute_rule(r.url)[2]
        assert r.llr == pytest.approx(llr(r.url))
        assert r.verdict == (best[0] if best else "allow" if llr(r.url) >= cut else "block")


def test_a_hot_url_stays_within_the_bound(spark):
    rows = [("http://hot.net/fr/", "block")] * 3000 + [(f"http://{i}.net/fr/", "block") for i in range(300)] + [("http://" + "x" * 50_000 + ".com/", "allow"), (None, "allow")]
    got = sample(spark.createDataFrame(rows, "url string, verdict string"), 50)
    assert len(got["block"]) == 50 and len(got["allow"]) == 1
    assert dict(sample(spark.createDataFrame(rows, "url string, verdict string"), 400)["block"])["http://hot.net/fr/"] == 3000


def test_every_judged_url_counts(spark):
    """More distinct urls of a kind than a sample of 20,000 would take."""
    rows = spark.range(30_000).selectExpr("concat('http://a.com/', id) AS url", "'allow' AS verdict").union(spark.createDataFrame([("http://b.net/fr/", "block")] * 7, "url string, verdict string"))
    (allowed, blocked), _ = fit(rows)
    urls = [r.url for r in rows.filter("verdict = 'allow'").withColumn("h", F.xxhash64("url")).orderBy(F.pmod("h", F.lit(1 << 30)), "h", "url").collect()]
    assert allowed.counts[0].sum() == sum(len(u) + 1 for i, u in enumerate(urls) if i % 5)
    assert blocked.counts[0].sum() == 0


def test_least_error_is_that_of_calibrate(spark):
    rng = random.Random(3)
    for n, step in ((300, 40), (300, 3), (40, 1), (2, 1)):
        rows = [(k, rng.randint(1, 5), rng.randint(-step, step) / 8 + (k == "allow") * rng.randint(0, 1)) for k in ("allow", "block") for _ in range(n)]
        values = [[r for r in rows if r[0] == k] for k in ("allow", "block")]
        want = calibrate(*(np.array([x for _, _, x in v]) for v in values), *([m for _, m, _ in v] for v in values))
        assert least_error(spark.createDataFrame(rows, "verdict string, n long, llr double").repartition(3)) == want
    assert least_error(spark.createDataFrame(rows[:2], "verdict string, n long, llr double")) == -np.inf
    assert least_error(spark.createDataFrame([("block", 1, 2.0), ("allow", 1, 1.0)], "verdict string, n long, llr double")) == calibrate(np.array([1.0]), np.array([2.0]))


def brute_licenses(text, templates, least, slack=0):
    """Templates of which a stretch of their own length, and ``slack`` strides more, holds the least share."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    own, found = words(text), set()
    for name, body in templates.items():
        w = words(body)
        k = min(5, len(w))
        sh = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        length = len(w) + slack * max(1, len(w) // 8)
        for s in range(max(1, len(own) - len(w) + 1)):
            part = own[s : s + length]
            if len({tuple(part[i : i + k]) for i in range(len(part) - k + 1)} & sh) >= least * len(sh):
                found.add(name)
                break
    return found


# no two of these share many words
APART = {k: TEMPLATES[k] for k in ("Apache-2.0-header", "CC-BY-NC-4.0", "GPL-3.0-header", "GPL-3.0", "MIT", "MIT-permission", "MPL-2.0", "Unlicense", "zlib", "All-rights-reserved", "BSL-1.0")}


def test_licenses_found_are_those_of_brute_force(spark):
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choice("aa bb cc license rights under version software".split()) for _ in range(n))
    rows = [(0, None), (1, ""), (2, "licensed"), (3, "All rights reserved."), (4, "ALL\nRIGHTS, RESERVED")]
    for i, (name, body) in enumerate(APART.items()):
        w = body.split()
        cut = rng.randrange(len(w))
        rows += [(10 + i, f"{filler(40)} {body} {filler(30)}"), (30 + i, body.upper()), (50 + i, filler(5) + " ".join(w[:cut] + ["zz"] + w[cut + 1 :])), (70 + i, " ".join(w[len(w) // 2 :]))]
        for k in range(12):  # around the least share, at any offset
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 20))):
                at = rng.randrange(len(v))
                v[at : at + rng.randint(0, 1)] = ["zz"]
            rows.append((1000 + 20 * i + k, f"{filler(rng.randint(0, 25))} {' '.join(v)} {filler(rng.randint(0, 9))}"))
    rows += [(95, filler(30_000) + " " + TEMPLATES["MIT"]), (96, filler(2000)), (3, "All rights reserved."), (None, TEMPLATES["CC-BY-NC-4.0"])]
    docs = spark.createDataFrame([(*r, "x", [1]) for r in rows], "doc_id long, text string, license string, h5 array<int>").repartition(3)
    out = license_scan(docs, APART).collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, set()).add(r.license)
        assert 0.8 <= r.containment <= 1
    least = most = 0
    for doc, text in rows:
        if doc in (95, 96):
            continue
        want = brute_licenses(text, APART, 0.8)
        assert want <= got.get(doc, set()), (doc, text)  # what bands retrieve is all there is
        assert got.get(doc, set()) <= brute_licenses(text, APART, 0.8, 2), (doc, text)
        least, most = least + len(want), most + len(got.get(doc, set()))
    assert 100 < least <= most <= 1.1 * least
    assert len(out) == len({(r.doc_id, r.license) for r in out})
    assert got[95] == {"MIT"} and 96 not in got and 0 not in got
    assert license_scan(docs.limit(0), APART).count() == 0 and license_scan(docs, {}).count() == 0


def test_rows_of_one_id_are_judged_by_themselves(spark):
    cut = TEMPLATES["MIT-warranty"].split()
    texts = [TEMPLATES["BSD-disclaimer"], " ".join(cut[:1] + cut[3:]), "no license here", TEMPLATES["MIT-warranty"]]

    def own(ids):
        docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        return {(r.doc_id, r.license): (round(r.containment, 9), r.first_word) for r in license_scan(docs).collect()}

    apart = own([1, 2, 3, 4])
    best = {}
    for (_, name), (share, at) in apart.items():
        best[name] = max(best.get(name, (0, 0)), (share, -at))
    want = {name: (share, -at) for name, (share, at) in best.items()}
    assert {"BSD-disclaimer", "MIT-warranty"} <= set(want) and (1, "BSD-disclaimer") in apart and (2, "MIT-warranty") in apart
    assert own([7, 7, 7, 7]) == {(7, name): v for name, v in want.items()} and own([None] * 4) == {(None, name): v for name, v in want.items()}


def test_each_license_is_told_from_its_kin(spark):
    names = sorted(TEMPLATES)
    docs = spark.createDataFrame([(i, f"some words before {TEMPLATES[n]} and some after it") for i, n in enumerate(names)], "doc_id long, text string")
    got = {}
    for r in license_scan(docs).collect():
        if r.containment == 1:
            got.setdefault(r.doc_id, set()).add(r.license)
    assert all(n in got[i] for i, n in enumerate(names))
    assert got[names.index("GPL-3.0-header")] == {"GPL-3.0-header"} and got[names.index("CC-BY-4.0")] == {"CC-BY-4.0"}
