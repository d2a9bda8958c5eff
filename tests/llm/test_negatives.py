import random

import numpy as np
from pyspark.sql import functions as F

from kilnwork.llm.negatives import _Bounds, hard_negatives
from kilnwork.llm.queries import queries


def brute(rows, every=100):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v]))
    out, last = [], lambda i: 2**63 if i is None else i
    for n, (i, label, q) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, r)), last(j), m) for m, (j, _, r) in enumerate(kept) if m != n)
        positives = [s for s in scored if kept[s[2]][1] == label][:5]
        for p in positives:
            fit = [s for s in scored if kept[s[2]][1] != label and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:5]
            out += [(i, kept[p[2]][0], k, kept[s[2]][0], -p[0], -s[0]) for k, s in enumerate(fit, 1)]
    return sorted(out, key=repr)


def got(spark, rows, extra=False):
    data = [(*r, 1, 2) for r in rows] if extra else rows
    kind = "vec_id long, embedding array<float>, label int" + (", at int, score int" if extra else "")
    df = spark.createDataFrame(data, kind).repartition(3)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted((tuple(r) for r in hard_negatives(df, F.col("vec_id") % 100 == 0, moved).collect()), key=repr)


def test_negatives_of_random_vectors_equal_brute_force(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 0.3) for _ in range(12)] for _ in range(5)]
    rows = []
    for i in range(700):
        c = rng.choice(centres)
        rows.append((i, [float(np.float32(x + rng.gauss(0, 0.1))) for x in c], rng.choice([0, 1, 2, 9])))
    want = brute(rows)
    assert len(want) > 50 and got(spark, rows) == want


def test_odd_rows_take_no_part_ties_go_by_id_and_repeats_count(spark):
    v = [0.5, 0.25, -0.125]
    rows = [(100, v, 1), (3, v, 1), (2, v, 1), (5, v, 2), (4, v, 2), (6, v, None), (8, None, 2), (9, [0.5, None, 0.1], 2), (10, [float("nan"), 0.0, 0.0], 2), (11, [float("inf"), 0.0, 0.0], 2)]
    rows += [(None, v, 2), (None, v, 1), (12, [0.5, 0.25], 2), (13, v, 2), (15, v, 2), (0, [0.0, 0.0, 0.0], 1), (200, [-0.5, 0.0, 0.0], 3), (201, [0.5, 0.0, 0.0], 3)]
    assert got(spark, rows, extra=True) == brute(rows)
    rows += [(4, v, 2), (100, v, 1)]
    found = got(spark, rows)
    assert sum(r[0] == 100 and r[1] == 100 for r in found) == 2 * 5  # each of the two anchors is a positive of the other
    assert [r[3] for r in found if r[:2] == (100, 2)][:2] == [4, 4]


def test_empty_tables_and_tables_without_anchors(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, [0.5], 1), (2, [0.5], 2)]) == []
    assert got(spark, [(100, [0.5], 1)]) == []
    assert got(spark, [(100, [], 1), (1, [], 1), (2, [], 2)]) == [(100, 1, 1, 2, 0, 0)]


def test_bounds_keep_what_reaches_the_floor():
    rng = np.random.default_rng(0)
    x = rng.integers(-300, 300, (500, 40)) * np.geomspace(1, 0.01, 40)
    rows, anchors = x, x[:3]
    bounds, score = _Bounds(rows, anchors), rows @ anchors.T
    for j in range(3):
        floor = np.sort(score[:, j])[-10]
        left = bounds.survivors(j, np.arange(500), lambda low, high: floor, np.inf)
        assert set(np.flatnonzero(score[:, j] >= floor)) <= set(left) and len(left) < 250


def test_query_carries_integer_columns(spark):
    out = queries()["op13_hard_negatives"](spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
