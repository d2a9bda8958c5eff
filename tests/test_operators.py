import math
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row, functions as F

from kilnwork.operators import index as N, joins as J, retrieval as T, sequence as S, substring, validate as G
from kilnwork.sources import files, store
from kilnwork.streaming import stateful, streams


def test_contained_needles(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK", 64)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("ab é") for _ in range(rng.randint(1, 12)))
    texts = [(i, "".join(word() for _ in range(rng.randint(0, 20)))) for i in range(80)] + [(100, None), (101, ""), (102, "ab" * 50_000), (None, "ab baé"), (7, "abab"), (7, "abab")]
    needles = [(i, word()) for i in range(40)] + [(50, ""), (51, None), (52, "ab"), (53, "ab"), (54, "b" * 9), (None, "aé"), (55, "ab" * 40)]
    named = lambda rows, kind: spark.createDataFrame([(*r, 1, 2) for r in rows], f"{kind}, size int, gram int")
    got = substring.contains_pairs(named(texts, "id long, text string").repartition(3), "id", "text", named(needles, "at int, needle string"), "at", "needle")
    want = sorted(((t, n) for t, text in texts for n, needle in needles if text is not None and needle is not None and needle in text), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) > 300
    plan = got._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    none = named([], "id long, text string")
    assert substring.contains_pairs(none, "id", "text", named(needles, "at int, needle string"), "at", "needle").count() == 0
    assert substring.contains_pairs(named(texts, "id long, text string"), "id", "text", named([], "at int, needle string"), "at", "needle").count() == 0


def test_grams_pass_the_filter_that_holds_them(spark):
    data = bytes(range(256)) * 9
    assert substring.windows(b"abc", 2).tolist() == [0x6162, 0x6263] and len(substring.windows(b"a", 2)) == 0
    for size in substring.SIZES:
        grams = substring.grams_of(data, size)
        places = substring._place(grams, size, substring.FILTER_BITS)
        held = substring._filter(spark.createDataFrame([(int(p),) for p in places], "place long"))
        assert (substring.grams_of(data, size, __import__("numpy").frombuffer(held, "u1")) == grams).all()


def test_grams_of_texts_together_are_those_of_each(monkeypatch):
    monkeypatch.setattr(substring, "BLOCK", 300)
    rng = random.Random(8)
    texts = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", None, "a" * 900, "ab"]
    held = np.full(substring.FILTER_BITS // 8, 0x5A, np.uint8)
    for size in substring.SIZES:
        out = list(substring._text_grams(SimpleNamespace(value=held.tobytes()), [size])(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["at", "text"])])))
        got = {(i, g) for b in out for i, g in zip(b.column(0).to_pylist(), b.column(2).to_pylist())}
        want = {(i, g) for i, t in enumerate(texts) if t for g in substring.grams_of(t.encode(), size, held).view("<i8").tolist()}
        assert got == want and sum(b.num_rows for b in out) == len(want)
        assert len(out) < 20  # not one batch a text


def test_overlaps_of_intervals_once_each(spark):
    rng = random.Random(8)
    span = lambda: (lambda a: (a, a + rng.choice([0, 1, 3, 40, 700, -2])))(rng.randint(-300, 300))
    left, right = ([(rng.choice([1, 1, 2, None]), i, *span()) for i in range(n)] + [(1, 900, None, 5)] for n in (90, 110))
    a = spark.createDataFrame(left, "k int, l long, l0 long, l1 long")
    b = spark.createDataFrame(right, "k int, r long, r0 long, r1 long")
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] is not None and x[0] == y[0] and None not in x[2:] + y[2:] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    for width in (1, 10, 5000):
        got = J.overlap_join(a, b, "k", ("l0", "l1"), ("r0", "r1"), width)
        assert sorted((r.l, r.r) for r in got.collect()) == want and len(want) > 300
    assert J.overlap_join(a.limit(0), b, "k", ("l0", "l1"), ("r0", "r1"), 10).count() == 0


@pytest.mark.parametrize("width", [3, 7, None])
def test_islands_over_ranges(spark, width):
    rng = random.Random(2)
    rows = [(rng.randint(0, 3), rng.randint(0, 150)) for _ in range(150)]
    want = []
    for k in range(4):
        run = []
        for x in sorted(x for j, x in rows if j == k):
            if run and x - run[-1] > 4:
                want.append((k, run[0], run[-1], len(run)))
                run = []
            run.append(x)
        want.append((k, run[0], run[-1], len(run)))
    got = S.islands(spark.createDataFrame(rows, "k int, x long"), "k", "x", 4, width)
    assert sorted((r.k, r.first, r.last, r.n) for r in got.collect()) == sorted(want)


def test_as_of_carries_over_buckets(spark):
    rng = random.Random(3)
    left = [(i, rng.choice([0, 1, None]), rng.randint(0, 99)) for i in range(120)]
    right = {(rng.randint(0, 1), rng.randint(0, 99)): rng.random() for _ in range(25)}
    got = J.as_of(spark.createDataFrame(left, "id int, k int, x int"), spark.createDataFrame([(k, x, v) for (k, x), v in right.items()], "k int, x int, v double"), "k", "x", "v", F.floor(F.col("x") / 10))
    want = {i: next((right[k, y] for y in range(x, -1, -1) if (k, y) in right), None) for i, k, x in left}
    assert {r.id: r.v for r in got.collect()} == want


def test_ranked_rows(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 5), rng.random(), i) for i in range(500)]
    got = S.ranked(spark.createDataFrame(rows, "a int, b double, i int").repartition(7), [F.desc("a"), F.col("b")], "place").collect()
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert {r.i: r.place for r in got} == {r[2]: n for n, r in enumerate(order)}
    assert S.ranked(spark.createDataFrame([], "a int"), [F.col("a")]).count() == 0


@pytest.mark.parametrize("block", [256, 2])
def test_retrieval_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(T, "QUERY_BLOCK", block)
    monkeypatch.setattr(T, "RECORD_BLOCK", 7)
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "ab", "abc", "xy", "yz", "zz", "q"])
    records = [(f"r{i:02}", " ".join(word() for _ in range(rng.randint(0, 4))), rng.choice([word(), None]), rng.choice(["f", "g"])) for i in range(40)]
    queries = [(i, " ".join(word() for _ in range(rng.randint(0, 3))), rng.choice(["f", "g", None])) for i in range(6)]
    fields = {"issue_summary": F.col("one"), "strategy": F.col("two")}
    got = T.retrieve(spark.createDataFrame(queries, "q int, text string, kind string"), "q", "text", spark.createDataFrame(records, "r string, one string, two string, kind string").repartition(3), "r", fields, 3, ["kind"])
    want = set()
    for q, text, kind in queries:
        terms = text.split()
        scored = sorted((-round(sum(w * sum(t in (x or "") for t in terms) / max(1, len(terms)) for w, x in ((0.40, one), (0.05, two))), 6), r) for r, one, two, k in records if k != kind)
        want |= {(q, r, n, -s) for n, (s, r) in enumerate(scored[:3], 1)}
    assert {(r.query_id, r.r, r.rank, r.score) for r in got.collect()} == want
    best = T.best_overlap(spark.createDataFrame(queries, "q int, text string, kind string"), "q", "text", spark.createDataFrame(records, "r string, one string, two string, kind string"), "r", "one")
    shares = {r: [(sum(t in one for t in text.split()) / max(1, len(text.split())), -q) for q, text, _ in queries] for r, one, _, _ in records}
    assert {(r.r, r.q, r.overlap) for r in best.collect()} == {(r, -max(s)[1], max(s)[0]) for r, s in shares.items()}


def test_several_exclusions_share_a_pass(spark):
    records = spark.createDataFrame([(f"r{i:02}", " ".join("abcd"[: i % 4 + 1]), "fg"[i % 2]) for i in range(30)], "r string, one string, kind string")
    queries = spark.createDataFrame([(1, "a b", "f"), (2, "c", "g"), (3, "d a", None)], "q int, text string, kind string")
    given = (queries, "q", "text", records, "r", {"issue_summary": F.col("one")}, 3)
    got = T.retrieve_modes(*given, {"all": (), "other": ("kind",)})
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    for mode, exclude in (("all", ()), ("other", ("kind",))):
        assert sorted(map(tuple, got.filter(F.col("mode") == mode).drop("mode").collect())) == sorted(map(tuple, T.retrieve(*given, exclude).collect()))


def test_loader_refuses_bad_records(spark):
    good = [("sft_v1", ["system", "user", "assistant"], True, True)]
    schema = "record_type string, roles array<string>, public_pass boolean, hidden_pass boolean"
    assert G.loaded(spark.createDataFrame(good, schema), "sft").count() == 1
    for bad in (("x", ["system", "user", "assistant"], True, True), ("sft_v1", ["user"], True, True), ("sft_v1", None, True, True), ("sft_v1", ["system", "user", "assistant"], True, None)):
        frame = spark.createDataFrame([*good, bad], schema)
        assert G.loader_errors(frame, "sft").filter("size(errors) = 1").count() == 1
        with pytest.raises(Exception, match="invalid record"):
            G.loaded(frame, "sft").collect()


def test_paths_and_ties(spark):
    paths = ["src/a.py", "src/.git/a.py", "lib/b.py", "src/x.txt", "src/d/a_1.py"]
    rows = [(p, "one\ntwo\none") for p in paths]
    found = files.grep(spark.createDataFrame(rows, "path string, text string"), "path", "text", "one", prefix="src/", glob="*a*.py", max_matches=3).collect()
    assert [(r.path, r.n) for r in found] == [("src/a.py", 1), ("src/a.py", 3), ("src/d/a_1.py", 1)]
    one, two = (spark.createDataFrame(x, "id int, v string") for x in ([(1, "b"), (1, "a")], [(1, "c"), (2, "d"), (2, "c")]))
    assert sorted(map(tuple, files.merge_manifests(one, two, "id").select("id", "v").collect())) == [(1, "a"), (2, "c")]


def test_json_sources_skip_blank_lines_and_refuse_bad_ones(spark):
    path = store.scratch_path(spark, "lines")
    spark.createDataFrame([('{"a": 1}',), ("",), ("  ",), ('{"a": 2}',)], "value string").coalesce(1).write.text(path)
    assert sorted(r.a for r in files.read_json_lines(spark, path, "a int").collect()) == [1, 2]
    bad = store.scratch_path(spark, "bad")
    spark.createDataFrame([('{"a": 1}',), ("{broken",)], "value string").coalesce(1).write.text(bad)
    with pytest.raises(Exception):
        files.read_json_lines(spark, bad, "a int").collect()
    assert [r.a for r in files.read_json_lines(spark, bad, "a int", strict=False).collect()] == [1]
    assert files.read_json_lines(spark, bad + "-absent", "a int").count() == 0


def test_a_stream_goes_on_where_it_ended(spark):
    source, folder = store.scratch_path(spark, "source"), store.scratch_path(spark, "sink")
    schema = "k long, kind string"
    seen = defaultdict(set)
    for turn, rows in enumerate(([(1, "a"), (2, "b")], [(1, "b"), (3, "a")], [])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        out = streams.upserted(spark.readStream.schema(schema).parquet(source), "rows", folder=folder)
        for k, kind in rows:
            seen[k].add(kind)
        got = [(r.k, r.kind) for r in out.collect()]
        assert sorted(got) == sorted((k, x) for k, kinds in seen.items() for x in kinds), turn


def test_shared_folder_must_be_named_off_a_local_master(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        store.shared_root(Session())


def brute_search(docs, queries, k, lexical=1.0, static=None):
    toks = lambda text: T._tokens((text or "").lower())
    counts = {d: Counter(toks(t)) for d, t in docs}
    df = Counter(w for c in counts.values() for w in c)
    out = []
    for q, text in queries:
        asked = toks(text)
        scored = []
        for d, c in counts.items():
            hit = [w for w in asked if w in c]
            part = sum((math.log((len(docs) + 1) / (df[w] + 1)) + 1) * (tf := c[w] / max(c.values())) * 2.2 / (tf + 1.2) for w in hit) / max(1, len(asked))
            if static is None and hit:
                scored.append((-round(part, 6), d))
            elif static is not None and d in static:
                scored.append((-round(lexical * part + static[d], 6), d))
        out += [(q, d, r, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_index_gives_the_best_of_all_documents_and_skips_blocks(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    draw = lambda n: " ".join(words[min(299, int(rng.paretovariate(0.6)))] for _ in range(n))
    docs = [(i, draw(rng.choice([3, 10, 60, 300]))) for i in range(600)] + [(900, None), (901, ""), (902, "rare_word here")]
    queries = [(i, draw(4)) for i in range(8)] + [(50, "rare_word w299"), (51, "unknown_thing"), (52, None), (53, "w1 w1 w1 w2")]
    d, q = spark.createDataFrame(docs, "d long, t string").repartition(3), spark.createDataFrame(queries, "q int, t string")
    index = N.build_index(d, "d", "t", 4)
    rows = lambda found: sorted((r.q, r.doc, r["rank"], round(r.score, 6)) for r in found.best.collect())
    close = lambda a, b: [x[:3] for x in a] == [x[:3] for x in b] and all(abs(x[3] - y[3]) < 1.1e-6 for x, y in zip(a, b))
    found = N.search(index, q, "q", "t", 3)
    assert close(rows(found), brute_search(docs, queries, 3))
    one = N.search(index, q.filter("q = 50"), "q", "t", 3)
    all_of = index.blocks.join(q.filter("q = 50").select(F.explode(N.identifier_tokens(F.col("t"))).alias("term")).distinct(), "term").agg(F.sum("n")).first()[0]
    assert one.touched.agg(F.sum("n")).first()[0] <= all_of
    common = N.search(index, q.filter("q = 53"), "q", "t", 3)
    assert common.touched.agg(F.sum("n")).first()[0] < 0.7 * index.terms.filter("term in ('w1', 'w2')").agg(F.sum("df")).first()[0]
    static = {i: rng.choice([0.0, 0.1, 0.4]) for i in [*range(0, 600, 2), 900, 902]}
    part = spark.createDataFrame(list(static.items()), "doc long, static double")
    assert close(rows(N.search(index, q, "q", "t", 3, 0.5, part)), brute_search(docs, queries, 3, 0.5, static))
    path = store.scratch_path(spark, "kept-index")
    index.save(path)
    assert rows(N.search(N.open_index(spark, path), q, "q", "t", 3)) == rows(found)
    empty = N.build_index(d.limit(0), "d", "t")
    assert N.search(empty, q, "q", "t").best.count() == 0 and N.search(index, q.limit(0), "q", "t").best.count() == 0


def test_no_postings_are_shuffled(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} common") for i in range(60)], "d long, t string")
    index = N.build_index(docs, "d", "t", 4)
    assert index.placed.count() == 60 and index.blocks.agg(F.max("n")).first()[0] <= 4
    assert "Join" not in N.search(index, docs.limit(5), "d", "t").best._jdf.queryExecution().toString()


def test_static_parts_are_kept_with_the_index(spark):
    docs = [(i, f"w{i % 7} w{i % 5} common", None if i % 3 == 0 else (i % 4) / 10) for i in range(60)] + [(70, None, 0.25), (71, "w1", None)]
    d, q = spark.createDataFrame(docs, "d long, t string, s double"), [(1, "w1 w2"), (2, None), (3, "nothing")]
    found = N.search(N.build_index(d, "d", "t", 4, "s"), spark.createDataFrame(q, "q int, t string"), "q", "t", 3, 0.5, True).best
    want = brute_search([x[:2] for x in docs], q, 3, 0.5, {i: s for i, _, s in docs if s is not None})
    assert sorted((r.q, r.doc, r["rank"], round(r.score, 6)) for r in found.collect()) == [(*x[:3], pytest.approx(x[3], abs=1.1e-6)) for x in want]


def test_a_range_is_closed_by_its_postings_and_packed(spark, monkeypatch):
    monkeypatch.setattr(N, "STEP", 7)
    docs = [(i, " ".join(f"w{(i * 37 + j) % 900}" for j in range(50 + 60 * (i % 9)))) for i in range(60)]
    docs += [(70, " ".join(["rare"] * 300 + ["w1"] * 2)), (71, "most " * 70_000 + "rare w2"), (72, " ".join(f"w{j}" for j in range(1200))), (73, None), (74, "")]
    d, q = spark.createDataFrame(docs, "d long, t string").coalesce(1), [(1, "w1 w2 w3"), (2, "rare most"), (3, "w899 w899 rare")]
    index = N.build_index(d, "d", "t")
    sizes = index.blocks.groupBy("range").agg(F.sum("n").alias("n")).join(index.ranges.select("range", F.size("ids").alias("docs")), "range", "right").collect()
    assert all((r.n or 0) <= 512 or r.docs == 1 for r in sizes) and max(r.docs for r in sizes) <= 8 and sum(r.docs for r in sizes) == len(docs)
    df = Counter(w for _, t in docs for w in set(T._tokens((t or "").lower())))
    assert {r.term: r.df for r in index.terms.collect()} == df
    assert all(0 < r.most <= 1 for r in index.blocks.collect())
    assert "array<string>" not in index.ranges.schema.simpleString()
    found = N.search(index, spark.createDataFrame(q, "q int, t string"), "q", "t", 4)
    assert sorted((r.q, r.doc, r["rank"], round(r.score, 6)) for r in found.best.collect()) == [(*x[:3], pytest.approx(x[3], abs=1.1e-6)) for x in brute_search(docs, q, 4)]


def test_ranges_that_a_filter_leaves_out_are_not_unpacked(spark):
    docs = [(i, f"w{i % 7} w{i % 5} common", 0.1 if i < 8 else None) for i in range(40)]
    index = N.build_index(spark.createDataFrame(docs, "d long, t string, s double").coalesce(1), "d", "t", 4, "s")
    table = index.ranges.orderBy("range").toArrow()
    held = [any(x is not None for x in r) for r in table.column("static").to_pylist()]
    table = table.set_column(table.schema.get_field_index("at"), "at", pa.array([a if h else b"" for a, h in zip(table.column("at").to_pylist(), held)], pa.binary()))
    asked = N._Asked([1], [Row(query=1, term=w, c=1.0) for w in ("w1", "common")], pa.int32())
    found = [r for b in N._searcher(asked, 3, 0.5, True, False)(iter(table.combine_chunks().to_batches())) for r in b.to_pylist()]
    assert not all(held) and {r["doc"] for r in found} <= set(range(8)) and len(found) >= 3


def test_code_search_moves_no_text_to_its_files(spark, monkeypatch):
    from kilnwork.plans import base, queries  # noqa: F401

    seen, build = [], N.build_index
    monkeypatch.setattr(N, "build_index", lambda docs, *a, **b: seen.append(docs) or build(docs, *a, **b))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        assert base.QUERIES["code_search"](spark, "/root/testdata/sf0.001").count() > 0
        assert "SortMergeJoin" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tasks_give_rows_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(T, "OUT_ROWS", 50)
    texts = pa.array([" ".join(f"w{j}" for j in range(10))] * 400)
    out = list(T._term_rows("d")(iter([pa.RecordBatch.from_arrays([pa.array(range(400)), texts], ["d", "t"])])))
    assert sum(b.num_rows for b in out) == 4000 and max(b.num_rows for b in out) <= 60
    assert out[0].schema.names == ["d", "term", "tf", "most"]


def test_stateful_folds_equal_their_batch_twins(spark):
    rng = random.Random(6)
    actions, paths = ["read_file", "edit_file", "run_test", "git_diff", "search_repo"], ["a", "b", None]
    rows = [(k, o, rng.choice(actions), rng.choice(paths), rng.choice(["x", "y", None])) for k in range(25) for o in range(rng.randint(1, 30))]
    schema = "k long, o int, action string, path string, old string"
    frame = spark.createDataFrame(rows, schema).withColumn("guarded", F.col("path").eqNullSafe("a").cast("string"))
    shuffled = rng.sample(rows, len(rows))
    source = store.scratch_path(spark, "steps")
    wanted = {
        stateful.RepairGuard: (("action", "path", "old"), {r.k: (r.rejected, r.repeated) for r in S.repair_guard(frame.fillna("", ["path", "old"]), "k", "o", "action", "path", "old").collect()}, lambda r: (r.rejected, r.repeated)),
        stateful.UnsurfacedAccess: (("action", "path", "guarded"), {r.k: r.leaked for r in S.unsurfaced_access(frame, "k", "o", "action", "path", F.col("path") == "a").collect()}, lambda r: r.leaked == 1),
    }
    folders = {kind: store.scratch_path(spark, "fold") for kind in wanted}
    for turn in range(3):  # each turn is a stream that starts again; the last one repeats rows
        part = shuffled[turn * len(rows) // 2 :][: len(rows) // 2 + 1] if turn < 2 else shuffled[:40]
        spark.createDataFrame(part, schema).withColumn("guarded", F.col("path").eqNullSafe("a").cast("string")).coalesce(1).write.mode("append").parquet(source)
        for kind, (columns, want, read) in wanted.items():
            with stateful.state_store(spark):
                out = streams.upserted(stateful.folded(spark.readStream.schema(frame.schema).parquet(source), kind, "k", "o", columns), "fold", "update", folders[kind])
            last = {}
            for r in sorted(out.collect(), key=lambda r: r.epoch):
                last[r.k] = r
            if turn == 0:
                assert any(r.waiting for r in last.values())
            else:
                assert {k: read(r) for k, r in last.items()} == want
                assert not any(r.waiting for r in last.values()) and sum(r.steps for r in last.values()) == len(rows)


def test_bad_lines_are_kept_apart_and_late_rows_counted(spark):
    source = store.scratch_path(spark, "log")
    spark.createDataFrame([('{"id": 1, "ts": "2024-01-01 00:10:00"}',), ("not json",), ("",), ('{"id": "x"',), ('{"id": 2, "ts": "2024-01-03 00:00:00"}',)], "value string").coalesce(1).write.text(source)
    schema = "id long, ts timestamp"
    good, bad = streams.quarantined(streams.json_stream(spark, source, schema), "quarantine")
    assert sorted(r.id for r in good.collect()) == [1, 2] and sorted(r.bad for r in bad.collect()) == ["not json", '{"id": "x"']
    folder, kept = store.scratch_path(spark, "late"), lambda: streams.json_stream(spark, source, schema).filter("bad is null").withColumn("kind", F.lit("a"))
    first = streams.upserted(streams.windowed_counts(kept(), "ts", "kind", "1 hour", "1 hour"), "late", "update", folder)
    assert streams.dropped_late(first) == 0
    spark.createDataFrame([('{"id": 3, "ts": "2024-01-01 00:20:00"}',), ('{"id": 4, "ts": "2024-01-03 00:30:00"}',)], "value string").coalesce(1).write.mode("append").text(source)
    out = streams.upserted(streams.windowed_counts(kept(), "ts", "kind", "1 hour", "1 hour"), "late", "update", folder)
    assert streams.dropped_late(out) == 1
    last = {r.start.isoformat(): r.n for r in sorted(out.collect(), key=lambda r: r.epoch)}
    assert last == {"2024-01-01T00:00:00": 1, "2024-01-03T00:00:00": 2}
