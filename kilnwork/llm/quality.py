"""Op 2: quality by hierarchical empirical Bayes over a document classifier, hosts and paths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .skew import salted_lookup
from ..sources.store import saved
from .textstats import FEATURES, labelled_sample, text_stats, with_features

#: Labelled rows that the document classifier is fitted on at most.
TRAIN_ROWS = 20_000
#: What an unlabelled document counts in its site's tally, against 1 for a labelled one.
SOFT_WEIGHT = 0.05
#: The prior strength (in documents) stays in these bounds.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1e5
#: A document is judged by the classifier, tallies and strengths of all folds but its own (by its
#: doc_id), so its label never feeds its score.
FOLDS = 4
#: Sections, and bytes of their names, that may be broadcast; more are joined over salts.
BROADCAST_SECTIONS, BROADCAST_BYTES = 100_000, 8_000_000


def fit_classifier(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Ridge logistic regression by Newton's method on standardised features and their squares.

    Returns (mean, scale, weights with the intercept last, log-odds of the training share). With
    no rows, or one kind only, the evidence is zero everywhere.
    """
    k = len(FEATURES)
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(k), np.ones(k), np.zeros(2 * k + 1), 0.0
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = _expand((x - mean) / scale)
    share = y.mean()
    w = np.zeros(z.shape[1])
    w[-1] = np.log(share / (1 - share))
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty + 1e-6)
        step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w, float(np.log(share / (1 - share)))


def _expand(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.hstack([z, z * z, np.ones((len(z), 1))])


def evidence_column(model) -> "F.Column":
    """Log likelihood ratio of good against bad by the classifier, as a Spark expression."""
    mean, scale, w, prior = model
    k = len(FEATURES)
    total = F.lit(float(w[-1] - prior))
    for i, name in enumerate(FEATURES):
        z = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (F.col(name) - float(mean[i])) / float(scale[i])))
        total = total + z * float(w[i]) + z * z * float(w[k + i])
    return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))


def _logit(p):
    return F.log(p / (1 - p))


def prior_strengths(groups: DataFrame, rates: list, tried: list, expected: list) -> list[float]:
    """For each fold the strength of a beta prior by moments: what the groups' rates vary beyond
    chance. ``groups``: one row per group with its mean rate of so many tried documents; expected:
    the mean it is shrunk to. Only three sums a fold reach the driver."""
    sums = []
    for i, (r, n, e) in enumerate(zip(rates, tried, expected)):
        any_of = n > 0
        sums += [F.sum(F.when(any_of, v)).alias(f"{name}{i}") for name, v in (("spread", n * (r - e) ** 2), ("chance", e * (1 - e)), ("most", n * e * (1 - e)))]
    found = groups.agg(*sums).first()
    out = []
    for i in range(len(rates)):
        spread, chance, most = (found[f"{x}{i}"] or 0.0 for x in ("spread", "chance", "most"))
        between = max(0.0, spread - chance) / most if most > 0 else 0.0  # = variance of true rates / (e (1 - e))
        out.append(float(np.clip(1 / between - 1 if between > 0 else MOST_STRENGTH, LEAST_STRENGTH, MOST_STRENGTH)))
    return out


def _posteriors(rows: DataFrame) -> DataFrame:
    """One row per section (_host, _path) with n, and host_posterior and path_posterior: arrays by
    fold, each from the documents of all other folds. ``rows``: _host, _path, _fold, _w, and _y: an
    array with what the document counts as for each fold."""
    folds = range(FOLDS)
    without = lambda i, v: F.sum(F.when(F.col("_fold") != i, v).otherwise(0.0))
    sections = rows.groupBy("_host", "_path").agg(
        *(without(i, F.col("_w")).alias(f"tried{i}") for i in folds), *(without(i, F.col("_w") * F.get("_y", F.lit(i))).alias(f"good{i}") for i in folds), F.count("*").alias("n")
    )
    sections = saved(sections, "sections")
    hosts = sections.groupBy("_host").agg(*(F.sum(f"{c}{i}").alias(f"h_{c}{i}") for c in ("tried", "good") for i in folds), F.count("*").alias("h_sections"))
    hosts = saved(hosts, "hosts")
    all_of = hosts.agg(*(F.sum(f"h_{c}{i}").alias(f"{c}{i}") for c in ("tried", "good") for i in folds)).first()
    shares = [min(max(all_of[f"good{i}"] / all_of[f"tried{i}"], 1e-4), 1 - 1e-4) if all_of[f"tried{i}"] else 0.5 for i in folds]

    def columns(name):
        return [F.col(f"{name}{i}") for i in folds]

    def rates(good, tried):
        return [F.when(t > 0, g / t).otherwise(0.0) for g, t in zip(columns(good), columns(tried))]

    k = prior_strengths(hosts, rates("h_good", "h_tried"), columns("h_tried"), [F.lit(x) for x in shares])
    by_fold = [(g + k[i] * shares[i]) / (t + k[i]) for i, (g, t) in enumerate(zip(columns("h_good"), columns("h_tried")))]
    hosts = hosts.select("_host", "h_sections", F.array(*by_fold).alias("host_posterior"))
    sections = saved(salted_lookup(sections, hosts, ["_host"], "h_sections", "_path"), "by-host")
    of_host = [F.get("host_posterior", F.lit(i)) for i in folds]
    k = prior_strengths(sections, rates("good", "tried"), columns("tried"), of_host)
    by_fold = [(g + k[i] * of_host[i]) / (t + k[i]) for i, (g, t) in enumerate(zip(columns("good"), columns("tried")))]
    return saved(sections.select("_host", "_path", "n", "host_posterior", F.array(*by_fold).alias("path_posterior")), "posteriors")


def _scored(docs: DataFrame, carried: dict, labels: DataFrame, host: str, path: str, max_rows: int, threshold: float) -> DataFrame:
    """The columns ``carried`` of each row, its evidence, posteriors, score and verdict."""
    site = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((host, "_host"), (path, "_path"))]
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    named = docs.select(*(c.alias(n) for n, c in carried.items()), *site, fold.alias("_fold"), F.monotonically_increasing_id().alias("_at"), F.xxhash64("text").alias("_text"), "text")
    stats = saved(text_stats(named, [c for c in named.columns if c != "text"]), "stats")
    x, y, ids = labelled_sample(stats, labels, max_rows)
    spark = docs.sparkSession
    own = spark.createDataFrame([(i, d) for i, d in enumerate(ids.tolist())], f"i int, doc_id {docs.schema['doc_id'].dataType.simpleString()}").select("i", fold.alias("_fold")).toPandas()
    of_sample = own.sort_values("i")["_fold"].to_numpy()
    models = [fit_classifier(x[of_sample != i], y[of_sample != i]) for i in range(FOLDS)]
    evidences = [evidence_column(m) for m in models]
    evidence = F.get(F.array(*evidences), F.col("_fold"))
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.avg((F.col("quality") > 0).cast("double")).alias("_label"))
    soft = F.array(*(1 / (1 + F.exp(-(e + m[3]))) for e, m in zip(evidences, models)))
    rows = with_features(stats).select("doc_id", "_host", "_path", "_fold", soft.alias("_p"))
    # rows without an id have no label and are kept out of the join, where they would be one key
    rows = rows.filter("doc_id is not null").join(known, "doc_id", "left").unionByName(rows.filter("doc_id is null").withColumn("_label", F.lit(None).cast("double")))
    rows = rows.withColumn("_w", F.when(F.col("_label").isNull(), SOFT_WEIGHT).otherwise(1.0)).withColumn("_y", F.transform("_p", lambda p: F.coalesce("_label", p)))
    sections = _posteriors(rows)
    rows = with_features(stats).select(*carried, "_host", "_path", "_fold", "_at", evidence.alias("evidence"))
    size = sections.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_host") + F.octet_length("_path")), F.lit(0)).alias("bytes")).first()
    if size.n <= BROADCAST_SECTIONS and size.bytes <= BROADCAST_BYTES:
        out = rows.join(F.broadcast(sections.drop("n")), ["_host", "_path"])
    else:
        out = salted_lookup(rows, sections, ["_host", "_path"], "n", "_at")
    out = out.select(*carried, "evidence", *(F.get(c, F.col("_fold")).alias(c) for c in ("host_posterior", "path_posterior")))
    section = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_posterior")))
    score = 1 / (1 + F.exp(-(F.col("evidence") + _logit(section))))
    return out.withColumn("score", score).withColumn("kept", F.col("score") >= threshold - 1e-9)


def quality_scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", max_rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, evidence, host_posterior, path_posterior, score, kept.

    Every document counts in the tally of its site section (``host``, ``path``): with its label if
    it has one, else with the classifier's probability at SOFT_WEIGHT. Hosts are shrunk toward the
    global share and sections toward their host, each by a strength estimated from how much such
    groups vary. A document's evidence and posteriors come from a classifier, tallies and strengths
    without the documents of its own fold (by a hash of doc_id), its own label among them. score = logistic(evidence + log-odds of the section); kept: score of at least
    ``threshold``. Null host or path is a site of its own; a null text has the features of an
    empty one, and texts of any length are read whole; labels of one doc_id that differ are
    averaged. A row without doc_id has no label and is judged like any other. Empty labels give
    evidence 0 and score 0.5, and keep everything. Repeated rows stay, each with its own text's
    verdict; extra columns are left out. An empty table gives an empty result.
    """
    return _scored(docs, {"doc_id": F.col("doc_id")}, labels, host, path, max_rows, threshold)


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", max_rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that quality_scores keeps, with all their columns: every row by its own
    verdict, whether its doc_id is null, repeated or neither. Rows are filtered where they are."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return _scored(docs, {"doc_id": F.col("doc_id"), "_row": row}, labels, host, path, max_rows, threshold).filter("kept").select("_row.*")
