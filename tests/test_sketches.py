import math
import random

import pytest
from pyspark.sql import functions as F

from kilnwork.functions import tables
from kilnwork.operators import sketches as K


@pytest.mark.parametrize("last_rows", [20_000, 3])
def test_exact_quantiles_are_the_ranked_values(spark, monkeypatch, last_rows):
    monkeypatch.setattr(K, "LAST_ROWS", last_rows)
    monkeypatch.setattr(K, "BUCKETS", 16)
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 1), 0.5, 1e300, -1e300, rng.paretovariate(0.3)]) for _ in range(400)]
    shares = [0.0, 0.003, 0.25, 0.5, 0.77, 0.999, 1.0]
    for extra in ([], [math.inf] * 9 + [-math.inf] * 5, [math.nan] * 50):
        rows = values + extra
        got = K.exact_quantiles(spark.createDataFrame([(v,) for v in rows + [None] * 7], "v double").repartition(3), "v", shares).collect()
        ordered = sorted((v for v in rows if v == v)) + [v for v in rows if v != v]
        want = [ordered[max(1, math.ceil(round(q * len(rows), 9))) - 1] for q in shares]
        assert [repr(r.value) for r in got] == [repr(w) for w in want]
    whole = K.exact_quantiles(spark.createDataFrame([(i % 7,) for i in range(100)], "v int"), "v", [0.5]).first()
    assert whole.value == 3 and isinstance(whole.value, int)
    assert K.exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]).first().value is None


def test_states_merge_within_their_error(spark):
    rows = spark.range(60_000).select(F.pmod("id", F.lit(3)).alias("k"), F.pmod("id", F.lit(11)).alias("part"), F.pmod(F.col("id") * 7919, F.lit(20_000)).alias("v"))
    states = K.distinct_states(rows, ["k", "part"], F.col("v"))
    for r in K.merged(states, ["k"]).select("k", K.distinct_count(F.col("state")).alias("n")).collect():
        exact = rows.filter(F.col("k") == r.k).select("v").distinct().count()
        assert abs(r.n - exact) <= 3 / 64 * exact
    a, b = (K.merged(K.distinct_states(rows.filter(c), ["k"], F.col("v")), []).withColumnRenamed("state", n) for c, n in (("v < 12000", "a"), ("v >= 8000", "b")))
    both = a.join(b).select(*(K.distinct_count(f("a", "b")).alias(n) for f, n in ((F.theta_union, "u"), (F.theta_intersection, "i"), (F.theta_difference, "d")))).first()
    assert abs(both.u - 20_000) <= 1000 and abs(both.i - 4000) <= 1000 and abs(both.d - 8000) <= 1000
    median = K.merged_quantiles(K.quantile_states(rows, ["k"], F.col("v")), []).select(F.kll_sketch_get_quantile_double("state", F.lit(0.5)).alias("m")).first().m
    assert abs(median - 10_000) <= 200


def test_source_parts_from_sql(spark):
    tables.register(spark)
    files = spark.createDataFrame([(1, "import os\nfrom a.b import c\n\ndef f(x):\n    return x\n\nclass K:\n    def m(self):\n        pass\n"), (2, "def ("), (3, None), (4, "x = 1")], "id int, code string")
    files.createOrReplaceTempView("files_for_source_parts")
    ask = lambda what: sorted(map(tuple, spark.sql(f"SELECT f.id, p.* FROM files_for_source_parts f, LATERAL source_parts(f.code, '{what}') p").collect()))
    assert ask("imports") == [(1, "a.b", "a/b.py"), (1, "os", "os.py")]
    assert ask("symbols") == [(1, "K", "class"), (1, "f", "function"), (1, "m", "function"), (2, "", "syntax_error")]
    assert [r[:3] for r in ask("chunks")][:3] == [(1, "class", "K"), (1, "file_level", ""), (1, "function", "f")]
    with pytest.raises(Exception, match="second argument"):
        ask("other")


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(K, "TASK_ROWS", 100)
    df = spark.range(0, 5000, 1, 1).selectExpr("id", "id % 3 AS k", "nullif(id % 7, 0) AS x")
    sizes = [r["count"] for r in K.dealt(df).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 5000 and max(sizes) < 200
    assert K.dealt(df.limit(0)).count() == 0
