"""Op 10: URL filter by rules, and by the ratio of two character language models elsewhere."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.sequence import ranked
from ..operators.sketches import exact_quantiles
from ..sources.store import saved

#: Bins of a hashed context, and the longest context in characters.
BINS, ORDER = 1 << 17, 4
#: URLs, and characters, that are worked on at a time (a longer URL is taken by itself).
SLICE_URLS, SLICE_CHARS = 4000, 1 << 18
#: Of so many distinct URLs of a kind, in order of a hash, one calibrates and the others train.
HELD_OUT = 5

#: (verdict, rule) of the filter list; a rule is host/path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def with_host_path(pages: DataFrame) -> DataFrame:
    """Adds host (A-Z in lower case) and path of column url; both are empty for null or a url
    without ``://``."""
    rest = F.coalesce(F.expr("CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END"), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("host", lower).withColumn("path", path)


def rule_column(rules=RULES) -> Column:
    """The longest rule that fits host and path, or null: ordered conditions, longest first."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        site, _, rest = rule.partition("/")
        fits = ((F.col("host") == site) | F.col("host").endswith("." + site)) & F.col("path").startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _windows(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, contexts hashed by order 0..ORDER, characters per url), each url with a start
    and an end mark."""
    coded = [np.frombuffer(("\x02" * ORDER + u + "\x03").encode("utf-8", "surrogatepass"), dtype=np.uint8) for u in urls]
    sizes = np.array([len(c) - ORDER for c in coded], dtype=np.int64)
    flat = np.concatenate(coded).astype(np.uint64) if coded else np.zeros(0, np.uint64)
    real = np.concatenate([np.arange(len(c)) >= ORDER for c in coded]) if coded else np.zeros(0, bool)
    at = np.flatnonzero(real)
    contexts = np.zeros((ORDER + 1, len(at)), dtype=np.int64)
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(1, ORDER + 1):
        h = (h ^ flat[at - k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        contexts[k] = (h & np.uint64(BINS - 1)).astype(np.int64)
    return flat[at].astype(np.int64), contexts, sizes


def _pair_counts(urls: list[str], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (order, context and next character as one number) and how often each occurs."""
    chars, contexts, sizes = _windows(urls)
    keys = ((np.arange(ORDER + 1)[:, None] * BINS + contexts) * 256 + chars).ravel()
    p, own = np.unique(keys, return_inverse=True)
    return p, np.bincount(own, weights=np.tile(np.repeat(times, sizes), ORDER + 1), minlength=len(p))


def _slices(urls: list[str]) -> Iterator[slice]:
    """Neighbours that are worked on together."""
    at = chars = 0
    for i, u in enumerate(urls):
        if i > at and (i - at >= SLICE_URLS or chars + len(u) > SLICE_CHARS):
            yield slice(at, i)
            at, chars = i, 0
        chars += len(u)
    if urls:
        yield slice(at, len(urls))


@dataclass
class MarkovModel:
    """Counts of (context, next character) by order. The probability of a character mixes all
    orders: the more different characters followed a context, the more weight passes to the
    shorter one (Witten-Bell), down to a uniform one over bytes."""

    pairs: list[np.ndarray]  # sorted context * 256 + character
    counts: list[np.ndarray]
    seen: np.ndarray  # order x bins: how often a context occurred
    kinds: np.ndarray  # order x bins: how many characters followed it

    @classmethod
    def train(cls, urls: list[str], times: list[int] | None = None) -> MarkovModel:
        """``times``: how often each url occurs, once if not given."""
        return cls.of(*_pair_counts(urls, np.ones(len(urls)) if times is None else np.array(times, dtype=float)))

    @classmethod
    def of(cls, keys: np.ndarray, n: np.ndarray) -> MarkovModel:
        """From distinct keys (as ``_pair_counts`` gives them) and how often each occurs."""
        at = np.argsort(keys)
        keys, n = keys[at], n[at].astype(float)
        cuts = np.searchsorted(keys, np.arange(ORDER + 2) * BINS * 256)
        pairs, counts = [], []
        seen, kinds = np.zeros((ORDER + 1, BINS)), np.zeros((ORDER + 1, BINS))
        for k in range(ORDER + 1):
            p, c = keys[cuts[k] : cuts[k + 1]] - k * BINS * 256, n[cuts[k] : cuts[k + 1]]
            pairs.append(p)
            counts.append(c)
            seen[k] = np.bincount(p // 256, weights=c, minlength=BINS)
            kinds[k] = np.bincount(p // 256, minlength=BINS)
        return cls(pairs, counts, seen, kinds)

    def log_likelihood(self, urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each url, and the characters it was summed over."""
        chars, contexts, sizes = _windows(urls)
        p = np.full(len(chars), 1 / 256)
        for k in range(ORDER + 1):
            key = contexts[k] * 256 + chars
            if not len(self.pairs[k]):
                continue
            at = np.minimum(np.searchsorted(self.pairs[k], key), len(self.pairs[k]) - 1)
            c = np.where(self.pairs[k][at] == key, self.counts[k][at], 0)
            n, t = self.seen[k][contexts[k]], self.kinds[k][contexts[k]]
            p = np.where(n > 0, (c + t * p) / np.maximum(n + t, 1), p)
        stops = np.concatenate([[0], np.cumsum(np.log(p))])
        ends = np.cumsum(sizes)
        return stops[ends] - stops[ends - sizes], sizes


def ratio(models: tuple[MarkovModel, MarkovModel], urls: list[str]) -> np.ndarray:
    """Log-likelihood under the accepted minus the rejected model, a character."""
    if not urls:
        return np.zeros(0)
    (a, n), (r, _) = models[0].log_likelihood(urls), models[1].log_likelihood(urls)
    return (a - r) / n


def calibrate(accepted: np.ndarray, rejected: np.ndarray, n_accepted: np.ndarray | None = None, n_rejected: np.ndarray | None = None) -> float:
    """The threshold with the least mean of both error rates; the middle of the best gap. ``n_*``:
    how often each value occurs."""
    if not len(accepted) or not len(rejected):
        return -np.inf

    def below(values, times, cuts):
        order = np.argsort(values, kind="stable")
        sums = np.concatenate([[0.0], np.cumsum((np.ones(len(values)) if times is None else np.asarray(times, dtype=float))[order])])
        return sums[np.searchsorted(values[order], cuts)] / sums[-1]

    cuts = np.unique(np.concatenate([accepted, rejected]))
    cuts = np.concatenate([cuts[:1] - 1e-6, (cuts[1:] + cuts[:-1]) / 2, cuts[-1:] + 1e-6])
    best = below(accepted, n_accepted, cuts) + 1 - below(rejected, n_rejected, cuts)
    ties = np.flatnonzero(best <= best.min() + 1e-12)
    return float(cuts[ties[len(ties) // 2]])


def sample(judged: DataFrame, max_urls: int) -> dict[str, list[tuple[str, int]]]:
    """Distinct urls with their numbers of rows, of either verdict the first ``max_urls`` by a hash:
    copies are counted before anything is chosen, and no more than that reaches the driver. To look
    at what the rules judge; nothing is trained or calibrated on it."""
    counted = _counted(judged)
    sizes = {r.verdict: r["count"] for r in counted.groupBy("verdict").count().collect()}
    out = {}
    for kind in ("allow", "block"):
        share = min(1.0, (1.1 * max_urls + 100) / sizes.get(kind, 1))  # a few more than the bound pass this filter
        some = counted.filter((F.col("verdict") == kind) & (F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30))))
        first = some.orderBy(F.pmod("h", F.lit(1 << 30)), "h", "url").limit(max_urls)
        out[kind] = [(r.url, r.n) for r in first.select("url", "n").collect()]
    return out


def _counted(judged: DataFrame) -> DataFrame:
    """Distinct urls of either verdict with their numbers of rows and a hash."""
    counted = judged.filter("url is not null and verdict is not null").groupBy("verdict", "url").agg(F.count("*").alias("n"))
    return saved(counted.withColumn("h", F.xxhash64("url")), "urls")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """verdict, key, n of rows of verdict, url, n."""
    for batch in batches:
        verdicts, urls, times = (np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist(), batch.column(2).to_numpy())
        for kind in np.unique(verdicts):
            at = np.flatnonzero(verdicts == kind)
            own = [urls[i] for i in at]
            for s in _slices(own):
                keys, n = _pair_counts(own[s], times[at[s]].astype(float))
                yield pa.RecordBatch.from_arrays([pa.array([str(kind)] * len(keys)), pa.array(keys), pa.array(n.astype(np.int64))], ["verdict", "key", "n"])


def _scorer(shared):
    @F.arrow_udf("double")
    def score(urls: pa.Array) -> pa.Array:
        texts = [u or "" for u in urls.to_pylist()]
        return pa.array(np.concatenate([ratio(shared.value, texts[s]) for s in _slices(texts)] or [np.zeros(0)]), pa.float64())

    return score


def least_error(ratios: DataFrame) -> float:
    """``calibrate`` of a table of any size: verdict, n, llr. Error rates are running sums over the
    distinct values within range partitions, shifted by those before; a few sums a partition reach
    the driver."""
    spark = ratios.sparkSession
    of = lambda kind: F.sum(F.when(F.col("verdict") == kind, F.col("n")).otherwise(0))
    values = ratios.groupBy("llr").agg(of("allow").alias("a"), of("block").alias("b")).orderBy("llr")
    values = saved(values.select("*", F.spark_partition_id().alias("part")), "ratios")
    before, a, b = [], 0, 0
    for r in values.groupBy("part").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).orderBy("part").collect():
        before.append((r.part, a, b))
        a, b = a + r.a, b + r.b
    if not a or not b:
        return -np.inf
    upto = Window.partitionBy("part").orderBy("llr").rowsBetween(Window.unboundedPreceding, 0)
    share = lambda c, n: (F.col(f"{c}_before") + F.sum(c).over(upto)).cast("double") / float(n)
    shifted = values.join(F.broadcast(spark.createDataFrame(before, "part int, a_before long, b_before long")), "part")
    # what a cut just above each value costs, and one below all of them
    costs = shifted.select("llr", (share("a", a) + 1 - share("b", b)).alias("cost")).union(spark.createDataFrame([(float("-inf"), 1.0)], "llr double, cost double"))
    costs = saved(costs, "costs")
    ties = costs.filter(F.col("cost") <= costs.agg(F.min("cost")).first()[0] + 1e-12)
    n = ties.count()
    low = exact_quantiles(ties, "llr", [(n // 2 + 1) / n]).first().value  # the middle one
    real = F.col("llr") > float("-inf")
    ends = costs.agg(F.min(F.when(real, F.col("llr"))).alias("least"), F.max("llr").alias("most"), F.min(F.when(F.col("llr") > low, F.col("llr"))).alias("next")).first()
    if low == float("-inf"):
        return ends.least - 1e-6
    return ends.most + 1e-6 if ends.next is None else (low + ends.next) / 2


def fit(judged: DataFrame) -> tuple[tuple[MarkovModel, MarkovModel], float]:
    """Models of allowed and blocked urls and the threshold. ``judged``: url, verdict. Every row
    counts: of either kind, a fifth of the distinct urls calibrates and the others train, each
    weighted by its rows. What reaches the driver are sums of (context, character) pairs, at most
    256 for each of the bins of an order, however many urls there are."""
    spark = judged.sparkSession
    counted = _counted(judged)
    sizes = {r.verdict: r["count"] for r in counted.groupBy("verdict").count().collect()}
    placed = ranked(counted, [F.col("verdict"), F.pmod("h", F.lit(1 << 30)), F.col("h"), F.col("url")], "place")
    own = F.col("place") - F.when(F.col("verdict") == "block", F.lit(sizes.get("allow", 0))).otherwise(0)
    placed = placed.select("verdict", "url", "n", (own % HELD_OUT == 0).alias("held"))
    sums = placed.filter("not held").select("verdict", "url", "n").mapInArrow(_count, "verdict string, key long, n long").groupBy("verdict", "key").agg(F.sum("n").alias("n")).toArrow()
    kinds = np.array(sums.column("verdict").to_pylist(), dtype=object)
    keys, n = sums.column("key").to_numpy(), sums.column("n").to_numpy()
    models = tuple(MarkovModel.of(keys[kinds == k], n[kinds == k]) for k in ("allow", "block"))
    held = placed.filter("held").select("verdict", "n", _scorer(spark.sparkContext.broadcast(models))("url").alias("llr"))
    return models, least_error(held)


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, llr and verdict.

    verdict is that of the longest rule that fits. Elsewhere a url is allowed if llr, its
    log-likelihood ratio a character, is at least the threshold; the models are trained on all
    urls that rules decide, and the threshold is that of all that were held out of them. A null url is scored as an empty one, and one of any length is read
    whole. Without urls of both kinds everything that no rule decides is allowed. Columns of
    ``pages`` with these names are replaced; repeated rows stay; an empty table gives an empty
    result.
    """
    named = with_host_path(pages.drop("host", "path", "rule", "llr", "verdict").withColumn("url", F.col("url").cast("string"))).withColumn("rule", rule_column(rules))
    by_rule = F.lit(None).cast("string")
    for verdict, rule in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    models, threshold = fit(named.select("url", by_rule.alias("verdict")))
    shared = pages.sparkSession.sparkContext.broadcast(models)  # bounded by the bins
    out = named.withColumn("llr", _scorer(shared)("url"))
    return out.withColumn("verdict", F.coalesce(by_rule, F.when(F.col("llr") >= threshold, "allow").otherwise("block")))
