"""Op 6: quality rules as a decision list learned from labelled statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..sources.store import saved
from .textstats import FEATURES, labelled_sample, text_stats, with_features

#: Labelled rows that rules are learned from at most.
TRAIN_ROWS = 20_000


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(FEATURES).index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self):
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, cuts: dict[str, np.ndarray], longest: int) -> Rule:
    """Add the condition of the highest information gain until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < longest:
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        if not p or not n:
            break
        base, best, choice = np.log2(p / (p + n)), 1e-9, None
        for i, name in enumerate(FEATURES):
            v = x[inside, i]
            for above in (True, False):
                hit = v[:, None] > cuts[name] if above else v[:, None] <= cuts[name]
                hp, hn = hit[bad[inside]].sum(axis=0), hit[~bad[inside]].sum(axis=0)
                gain = hp * (np.log2(np.maximum(hp, 1e-9) / np.maximum(hp + hn, 1)) - base)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, choice = gain[k], Condition(name, above, float(cuts[name][k]))
        if choice is None:
            break
        rule.append(choice)
        inside &= choice.holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drop conditions from the end while that does not lower (p - n) / (p + n) on unseen rows."""
    def worth(r: Rule) -> float:
        hit = covers(r, x)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    scores = [worth(rule[:k]) for k in range(1, len(rule) + 1)]
    return rule[: 1 + int(np.argmax(scores))] if scores else ()


def learn(x: np.ndarray, good: np.ndarray, precision: float = 0.95, longest: int = 4, max_rules: int = 12, seed: int = 5) -> list[Rule]:
    """Sequential covering: rules for rows that are not good, most reliable ways first found.

    Two thirds of the open rows grow a rule, one third prunes it; a rule stays if at least
    ``precision`` of the rows it covers there are bad. Covered rows leave, and the next rule is
    learned from what is open. Without rows of both kinds there are no rules.
    """
    rng = np.random.default_rng(seed)
    bad = good == 0
    cuts = {name: np.unique(np.quantile(x[:, i], np.linspace(0, 1, 65)[1:-1])) if len(x) else np.zeros(1) for i, name in enumerate(FEATURES)}
    for i, name in enumerate(FEATURES):  # finer where bad rows are
        if bad.any():
            cuts[name] = np.unique(np.concatenate([cuts[name], np.quantile(x[bad, i], np.linspace(0, 1, 65)[1:-1])]))
    rules: list[Rule] = []
    open_rows = np.ones(len(x), dtype=bool)
    while len(rules) < max_rules and (open_rows & bad).sum() >= 6 and (open_rows & ~bad).any():
        grown = open_rows & (rng.random(len(x)) < 2 / 3)
        unseen = open_rows & ~grown
        rule = _prune(_grow(x[grown], bad[grown], cuts, longest), x[unseen], bad[unseen])
        hit = covers(rule, x) & unseen
        if not rule or not hit.any() or (hit & bad).sum() < precision * hit.sum():
            break
        rules.append(rule)
        open_rows &= ~covers(rule, x)
    return rules


def verdict(rules: list[Rule]):
    """The list as one ordered Spark condition: the number of the first rule that holds, from 1;
    0 if none does."""
    out = None
    for n, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, n) if out is None else out.when(test, n)
    return F.lit(0) if out is None else out.otherwise(0)


def quality_rules(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> tuple[DataFrame, list[Rule]]:
    """One row per row of ``docs`` (doc_id, the counts, base_failed, rule, kept), and the rules.

    base_failed: under 10 words, or over 20 % of the words in repeated windows. kept: the base
    passed and no learned rule holds. A null text has no words and fails; texts of any length are
    read whole. A row without doc_id has no label and is judged like any other. Empty labels learn
    no rule; an empty table gives an empty result; repeated rows stay, each judged by its own text;
    extra columns are left out.
    """
    stats = saved(text_stats(docs.select("doc_id", "text", F.xxhash64("text").alias("_text")), ["doc_id", "_text"]), "stats")
    x, good, _ = labelled_sample(stats, labels, max_rows)
    rules = learn(x, good)
    out = with_features(stats).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    out = out.withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    return out.drop("_text", *FEATURES), rules
