"""Literal cases of the scalar functions."""

from pyspark.sql import functions as F

from kilnwork.functions import code, diff as D, payload as P, reward as R, text as X
from kilnwork.operators.substring import contains_pairs
from kilnwork.operators import aggregates as A, checks as V, joins as J, retrieval as T, sequence as S


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


L = F.lit
TWO_FILES = "diff --git a/src/app.py b/src/app.py\n--- a/src/app.py\n+++ b/src/app.py\n-a\n+b\ndiff --git a/tests/test_app.py b/tests/test_app.py\n"


def test_text(spark):
    r = one(
        spark, none=X.term_overlap(L(""), L("something")), far=X.term_overlap(L("xyz"), L("abc def")), near=X.term_overlap(L("json parsing"), L("fix json parsing bug in config")),
        short=X.truncate(L("hello world this is long"), 10), tokens=X.identifier_tokens(L("a b c def")), parts=X.identifier_tokens(L("parse_config")), path=X.path_proximity(L("src/lib/parser.py"), L("src/lib")),
        up=X.normalise_path(L("a/../../b")), few=X.token_estimate(L("")), query=X.issue_query(L("It is with that the")), leaks=X.leaked_terms(L("see Tests__Hidden")), family=X.family(L("None in error"), L(5)), level=X.family(L("zzz"), L(45)),
        passed=X.count_before(L("1 failed, 2 passed\n3  passed"), "passed"), loose=X.loose_pass_count(L("1 failed, 1 passed")), title=X.issue_summary(L("x\n # Title \nmore")),
    )
    assert (r.none, r.far, r.near, r.short) == (0.0, 0.0, 1.0, "hello w...")
    assert r.tokens == ["def"] and r.parts == ["parse", "config", "parse_config"]
    assert abs(r.path - 2 / 3) < 1e-9 and r.up is None and r.few == 1 and r.leaks == ["hidden_test", "tests_hidden"][1:]
    assert (r.family, r.level, r.passed, r.loose, r.title) == ("edge_case_none", "advanced_repair", 5, 2, "Title")


def test_logs(spark):
    log = "\n".join(f"line {i}" for i in range(200))
    failing = log.replace("line 100", "FAILED here")
    r = one(spark, short=X.compact_log(L("a\nb")), long=X.compact_log(L(log)), failing=X.compact_log(L(failing)), cut=X.truncate_middle(L("x" * 50), 20), tail=X.tail_lines(L("a\nb\nc"), 2), part=X.line_range(L("a\nb\nc"), 2, 9))
    assert r.short == "a\nb" and len(r.long.split("\n")) == 31 and "FAILED here" in r.failing
    assert r.cut == "x" * 12 + "\n...[30 chars truncated]...\n" + "x" * 8
    assert (r.tail, r.part) == ("b\nc", "b\nc")


def test_diffs_and_rewards(spark):
    r = one(
        spark, files=D.changed_files(L(TWO_FILES)), lines=D.changed_lines(L(TWO_FILES)), tests=D.modifies_tests(L(TWO_FILES)), hard=D.hardcode_reasons(L('+    return "fixed"\n+if x == test_y:\n+n = 7.5'), numbers=[7.5, 5]),
        off=D.unrelated_files(L(TWO_FILES), F.array(L("src/app.py"))), ratio=D.overlap_ratio(L(""), F.array(L("a"))), none=D.patch_summary(L("")),
        reward=R.total_reward(L(False), L(True), L(2), L(2), L(True), L(False), L(False), L(True), L(0)), empty=R.total_reward(L(True), L(True), L(0), L(0), L(False), L(False), L(None).cast("boolean"), L(False), L(0)),
        late=R.failure_class(L(True), L(124), L("")), syntax=R.failure_class(L(True), L(1), L("IndentationError")), broken=R.failure_class(L(True), L(1), L("Traceback ValueError")), none_run=R.failure_class(L(True), L(None).cast("int"), L("")),
        asserted=R.failure_class(L(True), L(1), L("AssertionError")), risk=R.risk(L(True), L(False), L(False)), narrow=R.too_narrow(L(True), L(2)),
    )
    assert r.files == ["src/app.py", "tests/test_app.py"] and r.lines == 2 and r.tests and r.off == ["tests/test_app.py"]
    assert r.hard == ["number: 7.5", "pattern 2", "test branch"] and r.ratio == 1.0 and r.none == "(no patch)"
    assert r.reward == 0.3 and r.empty == 1.2
    assert (r.late, r.syntax, r.broken, r.none_run, r.asserted, r.risk, r.narrow) == ("hidden_timeout", "hidden_import_or_syntax", "hidden_exception", "none", "hidden_assertion_fail", "medium", True)


def test_payloads(spark):
    r = one(
        spark, bad=P.action_error(L("{x")), text=P.action_error(L('"s"')), unknown=P.action_error(L('{"action_name": "fly"}')), lacks=P.action_error(L('{"action_name": "edit_file", "action_input": {"file_path": "a"}}')),
        shape=P.action_error(L('{"action_name": "git_diff", "action_input": 3}')), fine=P.action_error(L('{"action_name": "run_test", "action_input": {"command": "x"}}')),
        clean=P.sanitizer()(L('{"b": [{"stdout": 1, "c": "gold.patch"}], "a": null}')), broken=P.sanitizer()(L("nope")),
    )
    assert (r.bad, r.text, r.unknown, r.lacks, r.shape, r.fine) == ("invalid_json", "invalid_json", "unknown_tool", "missing_args", "missing_args", "")
    assert r.clean == '{"a": null, "b": [{"c": "[redacted]"}]}' and r.broken is None


def test_operators(spark):
    df = spark.createDataFrame([(f"k{i:02d}", i) for i in range(12)], "k string, v long")
    split = {r.k: r.split for r in A.every_nth_split(df, "k").collect()}
    assert [k for k, s in split.items() if s == "eval"] and {k for k, s in split.items() if s == "eval"} == {"k04", "k09"}
    two = A.every_nth_split(df.filter("v < 2"), "k").orderBy("k").collect()
    assert [r.split for r in two] == ["train", "eval"]
    assert [r.split for r in A.every_nth_split(df.filter("v < 1"), "k").collect()] == ["train"]
    items = spark.createDataFrame([(1, "trace", "tool_trace", 950), (1, "issue", "issue", 100), (1, "log", "tool_trace", 50)], "p int, i string, role string, t long")
    kept = {r.i: r.kept for r in S.pack_budget(items, "p", "i", F.col("role"), "t", 1000).collect()}
    assert kept == {"issue": True, "log": True, "trace": False}
    snap = spark.createDataFrame([("a", 3), ("b", 1)], "k string, n long")
    assert V.not_shrunk(snap, snap, "k", "n").count() == 0 and V.not_shrunk(snap, snap.filter("k = 'a'"), "k", "n").count() == 1
    texts = spark.createDataFrame([(1, "one two three four"), (2, "one two"), (3, "xtwo threey")], "d int, t string")
    needles = spark.createDataFrame([(7, "one two three"), (8, "two three")], "n int, s string")
    assert sorted(map(tuple, contains_pairs(texts, "d", "t", needles, "n", "s").collect())) == [(1, 7), (1, 8), (3, 8)]
    rate = spark.createDataFrame([], "f boolean").agg(A.rate(F.col("f")).alias("r")).first().r
    assert rate == 0.0
    assert T.seeded_sample(df, "k", 3, 1).count() == 3


def test_sources(spark, tmp_path):
    from kilnwork.sources import files as S

    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    (tmp_path / "b.json").write_text('[{"x": 1}, {"x": 2}, {"x": 3}]')
    (tmp_path / "c.json").write_text('{\n  "x": 5\n}')
    assert S.read_json_lines(spark, str(tmp_path / "a.jsonl"), "x int").count() == 2
    assert S.read_json_lines(spark, str(tmp_path / "none.jsonl"), "x int").count() == 0
    assert [S.read_json_any(spark, str(tmp_path / f), "x int").count() for f in ("a.jsonl", "b.json", "c.json")] == [2, 3, 1]
    (tmp_path / "src" / ".git").mkdir(parents=True)
    (tmp_path / "src" / "m.py").write_text("x = 1\n")
    (tmp_path / "src" / ".git" / "n.py").write_text("y = 1\n")
    assert [r.content for r in S.read_text_files(spark, str(tmp_path / "src"), "*.py").collect()] == ["x = 1\n"]
    df = spark.createDataFrame([(1, "é"), (2, None)], "b int, a string")
    S.write_json_lines(df, str(tmp_path / "out"), files=1)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"a":"é","b":1}', '{"a":null,"b":2}']
    assert S.table_digest(df).first() == S.table_digest(df.repartition(3)).first()
    named = spark.createDataFrame([("b", "2"), ("a", "1")], "name string, content string")
    import hashlib

    assert S.package_digest(named).first().digest == hashlib.sha256(b"a\x001\x00b\x002\x00").hexdigest()


def test_code():
    source = "'''Doc.'''\nimport os\n\nclass A:\n    def m(self):\n        pass\n\ndef f():\n    pass\nX = 1\nY = 2\n"
    kinds = [(c[0], c[1]) for c in code.chunks(source)]
    assert kinds == [("module_docstring", ""), ("class", "A"), ("method", "m"), ("function", "f"), ("file_level", ""), ("file_level", "")]
    assert code.symbols("def (") == [("", "syntax_error")] and code.imports("from a.b import c\nimport d") == [("a.b", "a/b.py"), ("d", "d.py")] and code.chunks("def (") == []
