"""Queries over text, diff and reward functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import diff as D, reward as R, text as X
from ..operators import retrieval as T
from .base import query

_LINES = "string_split(text, chr(10))"
_FILES = "[regexp_replace(string_split(x, ' ')[4], '^b/', '') for x in string_split(patch, chr(10)) if starts_with(x, 'diff --git ')]"
_ADDED = "[x[2:] for x in string_split(patch, chr(10)) if starts_with(x, '+') AND NOT starts_with(x, '+++')]"
_CHANGED = "len([x for x in string_split(patch, chr(10)) if (starts_with(x, '+') AND NOT starts_with(x, '+++')) OR (starts_with(x, '-') AND NOT starts_with(x, '---'))])"
_TESTS = r"len([f for f in " + _FILES + r" if regexp_matches(f, '(^|/)(tests|tests_hidden)/|(^|/)test_[^/]+\.py$')]) > 0"
_TEXT = f"array_to_string({_ADDED}, chr(10))"
_BRANCH = rf"len([x for x in {_ADDED} if regexp_matches(x, '^\s*(if|elif|while)\s+(.+):') AND contains(regexp_extract(x, '^\s*(if|elif|while)\s+(.+):', 2), 'test_')]) > 0"
_PATTERNS = (r"if\s+.*(task_00\d|pytest|tests_hidden)", r"return\s+[''\x22](expected|fixed|success|pass)[''\x22]", r"==\s*[''\x22][^''\x22]{20,}[''\x22]")
_HARD = f"({' OR '.join(f"regexp_matches({_TEXT}, '{p}')" for p in _PATTERNS)} OR {_BRANCH})"


@query(r"""
    WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]*')) AS w FROM documents),
         p AS (SELECT doc_id, w FROM t WHERE length(w) >= 2 UNION ALL
               SELECT doc_id, unnest(string_split(w, '_')) FROM t WHERE contains(w, '_') AND length(w) > 3)
    SELECT doc_id, count(*) AS n_tokens, count(DISTINCT w) AS n_terms FROM p WHERE length(w) >= 2 GROUP BY doc_id""")
def tokenize_identifiers(t):
    tokens = t("documents").select("doc_id", F.explode(X.identifier_tokens(F.col("text"))).alias("w"))
    return tokens.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_distinct("w").alias("n_terms"))


_STOP = ", ".join(f"'{x}'" for x in X.TOKEN_STOP)
_BOOST = ", ".join(f"'{x}'" for x in X.TOKEN_BOOST)


@query(f"""
    WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]{{2,}}')) AS token FROM benchmark),
         s AS (SELECT item_id, token, sum(CASE WHEN token IN ({_BOOST}) THEN 3 ELSE 1 END)::BIGINT AS weight FROM w WHERE token NOT IN ({_STOP}) GROUP BY ALL)
    SELECT item_id, token, weight, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, token) AS rank FROM s""")
def issue_tokens(t):
    from pyspark.sql import Window

    tokens = t("benchmark").select("item_id", F.explode(X.keyword_tokens(F.col("text"))).alias("token"))
    scored = tokens.groupBy("item_id", "token").agg(F.sum(X.token_weight(F.col("token"))).alias("weight"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("weight"), "token")))


@query("""
    SELECT doc_id, coalesce([x for x in regexp_extract_all(lower(text), '[A-Za-z_]{4,}') if x NOT IN ('should', 'with', 'from', 'this', 'that', 'currently', 'when', 'file', 'files')][1], 'def') AS query
    FROM documents""")
def issue_query(t):
    return t("documents").select("doc_id", X.issue_query(F.col("text")).alias("query"))


@query("""
    WITH b AS (SELECT item_id, [x for x in regexp_split_to_array(lower(text), '\\s+') if x <> ''] AS q FROM benchmark),
         s AS (SELECT doc_id, item_id, len([x for x in q if contains(lower(d.text), x)]) / greatest(1, len(q))::DOUBLE AS overlap FROM documents d CROSS JOIN b),
         r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, item_id) AS n FROM s)
    SELECT doc_id, item_id, round_even(overlap, 6) AS overlap FROM r WHERE n = 1""")
def term_overlap(t):
    """For each document the item of the whole benchmark, of which it holds the largest share of words."""
    best = T.best_overlap(t("benchmark"), "item_id", "text", t("documents"), "doc_id", "text")
    return best.withColumn("overlap", F.bround("overlap", 6))


@query("""
    SELECT doc_id, sha256(replace(replace(replace('tests_hidden ' || text || ' metadata.json gold.patch', 'tests_hidden', '[redacted]'), 'metadata.json', '[redacted]'), 'gold.patch', '[redacted]')) AS redacted
    FROM documents""")
def redact_terms(t):
    return t("documents").select("doc_id", F.sha2(X.redact(F.concat(F.lit("tests_hidden "), "text", F.lit(" metadata.json gold.patch"))), 256).alias("redacted"))


@query("SELECT conv_id, turn, CASE WHEN NOT contains(lower(text), 'the') AND NOT contains(lower(text), 'que') THEN sha256(text) END AS allowed FROM conversations")
def filter_payload(t):
    return t("conversations").select("conv_id", "turn", F.sha2(X.drop_if_forbidden(F.col("text"), ("the", "que")), 256).alias("allowed"))


@query("""
    SELECT task_id, substr(sha256(patch), 1, 16) AS patch_hash FROM run_rewards WHERE patch <> ''
    UNION ALL SELECT task_id, '' FROM run_rewards WHERE patch = ''""")
def content_hash(t):
    return t("run_rewards").select("task_id", X.content_hash(F.col("patch")).alias("patch_hash"))


@query("SELECT doc_id, CASE WHEN text = '' THEN '' ELSE substr(sha256(encode(text)[1:200]), 1, 16) END AS pattern_hash FROM documents")
def issue_pattern_hash(t):
    return t("documents").select("doc_id", X.pattern_hash(F.col("text")).alias("pattern_hash"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 77) || '...' ELSE text END AS short FROM documents")
def truncate_text(t):
    return t("documents").select("doc_id", X.truncate(F.col("text"), 80).alias("short"))


@query("""
    SELECT doc_id, sha256(CASE WHEN length(text) > 1000 THEN substr(text, 1, 600) || chr(10) || '...[' || (length(text) - 1000)::VARCHAR || ' chars truncated]...' || chr(10) || substr(text, length(text) - 399) ELSE text END) AS cut
    FROM documents""")
def truncate_output(t):
    return t("documents").select("doc_id", F.sha2(X.truncate_middle(F.col("text"), 1000), 256).alias("cut"))


@query(f"SELECT doc_id, sha256(array_to_string(({_LINES})[-3:], chr(10))) AS tail FROM documents")
def tail_lines(t):
    return t("documents").select("doc_id", F.sha2(X.tail_lines(F.col("text"), 3), 256).alias("tail"))


@query("SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(t):
    return t("documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


#: A log of a text: each line with how long it is, and passed or failed by that.
_LOG = "array_to_string([x || ' ' || length(x)::VARCHAR || CASE WHEN length(x) % 3 = 0 THEN ' failed' ELSE '  passed' END FOR x IN string_split(text, chr(10))], chr(10))"


def _log():
    line = lambda x: F.concat(x, F.lit(" "), F.length(x).cast("string"), F.when(F.length(x) % 3 == 0, " failed").otherwise("  passed"))
    return F.array_join(F.transform(F.split("text", "\n", -1), line), "\n")


def _summed(found: str) -> str:
    return f"coalesce(list_sum([x::BIGINT FOR x IN {found}]), 0)::BIGINT"


@query(rf"""
    WITH o AS (SELECT doc_id, {_LOG} AS out FROM documents)
    SELECT doc_id, {_summed("regexp_extract_all(out, '([0-9]+)[ ]+passed', 1)")} AS n_passed, {_summed("regexp_extract_all(out, '([0-9]+)[ ]+failed', 1)")} AS n_failed,
           CASE WHEN contains(out, ' passed') THEN {_summed(r"[w FOR w IN regexp_split_to_array(out, '\s+') IF regexp_full_match(w, '[0-9]+')]")} ELSE 0 END AS n_loose FROM o""")
def test_counts(t):
    """Counts over whole logs made of each text's lines."""
    logs = t("documents").select("doc_id", _log().alias("out"))
    return logs.select("doc_id", X.count_before(F.col("out"), "passed").alias("n_passed"), X.count_before(F.col("out"), "failed").alias("n_failed"), X.loose_pass_count(F.col("out")).alias("n_loose"))


@query("""
    WITH x AS (SELECT doc_id, replace(lower(text || CASE WHEN doc_id % 8 = 0 THEN ' Tests_Hidden' WHEN doc_id % 8 = 1 THEN ' ORACLE' ELSE '' END), '_', '') AS flat FROM documents)
    SELECT doc_id, array_to_string(list_sort([t for t in ['diff --git', 'gold.patch', 'hidden_test', 'tests_hidden', 'oracle', 'evaluator'] if contains(flat, replace(t, '_', ''))]), ',') AS leaked FROM x""")
def leak_terms(t):
    text = F.concat("text", F.when(F.col("doc_id") % 8 == 0, " Tests_Hidden").when(F.col("doc_id") % 8 == 1, " ORACLE").otherwise(""))
    return t("documents").select("doc_id", F.array_join(X.leaked_terms(text), ",").alias("leaked"))


@query(r"""
    SELECT doc_id, array_to_string(regexp_extract_all('def test_a' || (doc_id % 9)::VARCHAR || '():' || chr(10) || text || chr(10) || 'def test_z(x):', 'def (test_\w+)', 1), ',') AS names FROM documents""")
def extract_test_names(t):
    code = F.concat(F.lit("def test_a"), (F.col("doc_id") % 9).cast("string"), F.lit("():\n"), "text", F.lit("\ndef test_z(x):"))
    return t("documents").select("doc_id", F.array_join(X.test_names(code), ",").alias("names"))


#: A log of a text's lines after the first: one that begins with a test's name tells of it.
_RUN_LOG = rf"""array_to_string([CASE WHEN starts_with(x, w) THEN w || CASE WHEN length(x) % 2 = 0 THEN ' PASSED' ELSE ' FAILED' END WHEN length(x) % 7 = 0 THEN x || ' failed' ELSE x || ' passed' END FOR x IN string_split(text, chr(10))[2:]], chr(10))"""


@query(f"""
    WITH d AS (SELECT doc_id, text, 'The' AS w FROM documents), o AS (SELECT doc_id, w, {_RUN_LOG} AS out FROM d)
    SELECT doc_id, CASE WHEN contains(out, w || ' PASSED') THEN true WHEN contains(out, w || ' FAILED') THEN false ELSE contains(out, ' passed') AND NOT contains(out, ' failed') END AS passed FROM o""")
def test_passed(t):
    """What whole logs, made of each text's lines after the first, say of one test."""
    def line(x):
        named = F.concat(F.lit("The"), F.when(F.length(x) % 2 == 0, " PASSED").otherwise(" FAILED"))
        return F.when(x.startswith("The"), named).otherwise(F.concat(x, F.when(F.length(x) % 7 == 0, " failed").otherwise(" passed")))

    lines = F.split("text", "\n", -1)
    out = F.array_join(F.transform(F.slice(lines, F.lit(2), F.size(lines)), line), "\n")
    return t("documents").select("doc_id", X.test_passed(out, F.lit("mod::The")).alias("passed"))


@query("""
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
         m AS (SELECT doc_id, a, [x for x in a[6:len(a) - 5] if regexp_matches(x, '(?i)(FAILED|Error|Traceback|AssertionError|assert\\b|\\bFAIL\\b|the )')] AS f FROM l)
    SELECT doc_id, sha256(CASE WHEN len(a) <= 10 THEN array_to_string(a, chr(10)) ELSE array_to_string(a[1:5] || CASE WHEN len([x for x in f if regexp_matches(x, '(?i)(FAILED|Error|Traceback|AssertionError|assert\\b|\\bFAIL\\b)')]) > 0
        THEN ['... [failure signal preserved] ...'] || ([x for x in f if regexp_matches(x, '(?i)(FAILED|Error|Traceback|AssertionError|assert\\b|\\bFAIL\\b)')])[-8:] ELSE ['... [truncated] ...'] END || a[len(a) - 4:], chr(10)) END) AS compacted
    FROM m""")
def compact_log(t):
    return t("documents").select("doc_id", F.sha2(X.compact_log(F.col("text"), most=10), 256).alias("compacted"))


_FAMILY = " ".join(f"WHEN contains(lower(s), '{k}') THEN '{v}'" for k, v in X.FAMILIES)


@query(f"""
    WITH x AS (SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN ' config' WHEN 1 THEN ' CSV file' WHEN 2 THEN ' an Error' ELSE '' END AS s FROM documents)
    SELECT doc_id, CASE {_FAMILY} WHEN doc_id <= 20 THEN 'basic_repair' WHEN doc_id <= 40 THEN 'intermediate_repair' WHEN doc_id <= 60 THEN 'advanced_repair' ELSE 'complex_repair' END AS family FROM x""")
def family_classify(t):
    k = F.col("doc_id") % 6
    text = F.concat("text", F.when(k == 0, " config").when(k == 1, " CSV file").when(k == 2, " an Error").otherwise(""))
    return t("documents").select("doc_id", X.family(text, F.col("doc_id")).alias("family"))


@query("""
    SELECT doc_id, sha256(CASE doc_id % 3 WHEN 0 THEN trim(text) WHEN 1 THEN 'Title ' || doc_id::VARCHAR ELSE trim(text) END) AS summary FROM documents""")
def issue_summary(t):
    k = F.col("doc_id") % 3
    prompt = F.when(k == 0, F.concat(F.lit("Fix it.\nIssue:\n"), "text")).when(k == 1, F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit("\nbody"))).otherwise(F.col("text"))
    return t("documents").select("doc_id", F.sha2(X.issue_summary(prompt), 256).alias("summary"))


_PARTS = "[x FOR x IN string_split(regexp_extract({}, '://([^?#]*)', 1), '/') IF x <> '']"


@query(rf"""
    WITH u AS (SELECT page_id, {_PARTS.format('url')} AS a FROM pages), v AS (SELECT page_id // 8 AS g, max_by({_PARTS.format('url')}, page_id) AS b FROM pages GROUP BY ALL),
         c AS (SELECT page_id, a, b, [i FOR i IN range(1, least(len(a), len(b)) + 1) IF a[i] <> b[i]] AS off FROM u JOIN v ON v.g = page_id // 8)
    SELECT page_id, CASE WHEN greatest(len(a), len(b)) = 0 THEN 1.0 ELSE round_even(coalesce(list_min(off) - 1, least(len(a), len(b))) / greatest(len(a), len(b))::DOUBLE, 6) END AS proximity FROM c""")
def path_proximity(t):
    """Of each url's host and path to those of the last page of its group of eight."""
    path = F.regexp_extract("url", "://([^?#]*)", 1)
    own = t("pages").select("page_id", path.alias("path"), F.floor(F.col("page_id") / 8).alias("g"))
    last = own.groupBy("g").agg(F.max_by("path", "page_id").alias("bias"))
    return own.join(last, "g").select("page_id", F.bround(X.path_proximity(F.col("path"), F.col("bias")), 6).alias("proximity"))


@query(r"""
    WITH u AS (SELECT page_id, rtrim(regexp_extract(url, '://[^/]*/([^?#]*)', 1), '/') AS p FROM pages)
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'src/' || p WHEN 1 THEN p WHEN 2 THEN regexp_replace(p, '/?[^/]*$', '') || '/a.py' END AS path FROM u""")
def normalise_path(t):
    """Paths of urls with detours; those that lead out of the tree are null."""
    k, p = F.col("page_id") % 4, F.regexp_extract("url", r"://[^/]*/([^?#]*)", 1)
    raw = F.when(k == 0, F.concat(F.lit("./src//x/../"), p)).when(k == 1, F.concat(F.lit("src/../"), p)).when(k == 2, F.concat(p, F.lit("/../a.py"))).otherwise(F.concat(F.lit("a/../../"), p))
    return t("pages").select("page_id", X.normalise_path(raw).alias("path"))


@query(f"""
    WITH x AS (SELECT *, CASE task_id % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class' WHEN 3 THEN 'module_docstring' ELSE 'file_level' END AS kind, task_id % 2 = 0 AS doc FROM run_rewards),
         b AS (SELECT task_id, patch, CASE kind WHEN 'function' THEN 1.0 WHEN 'method' THEN 0.9 WHEN 'class' THEN 0.8 WHEN 'module_docstring' THEN 0.6 ELSE 0.5 END AS s, doc FROM x),
         c AS (SELECT task_id, patch, CASE WHEN doc THEN least(1.0, s + 0.1) ELSE s END AS s FROM b)
    SELECT task_id, round_even((CASE WHEN len(string_split(patch, chr(10))) BETWEEN 3 AND 30 THEN least(1.0, s + 0.1) ELSE s END)::DOUBLE, 6) AS score FROM c""")
def structural_score(t):
    k = F.col("task_id") % 5
    kind = F.when(k == 0, "function").when(k == 1, "method").when(k == 2, "class").when(k == 3, "module_docstring").otherwise("file_level")
    doc = F.when(F.col("task_id") % 2 == 0, "text").otherwise("")
    return t("run_rewards").select("task_id", F.bround(X.structural_score(kind, doc, F.col("patch")), 6).alias("score"))


@query("""
    WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS n FROM pages)
    SELECT page_id, n, line FROM l WHERE contains(line, 'href')""")
def grep_lines(t):
    from ..sources.files import grep

    return grep(t("pages"), "page_id", "html", "href").select("page_id", "n", "line")


@query("""
    WITH f AS (SELECT page_id, 'site' || (page_id % 3)::VARCHAR || CASE WHEN page_id % 7 = 0 THEN '/.git' ELSE '' END || '/p' || page_id::VARCHAR || CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '.txt' END AS path, html FROM pages),
         l AS (SELECT path, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS n FROM f WHERE starts_with(path, 'site1/') AND path LIKE '%.html' AND NOT contains(path, '/.git/')),
         r AS (SELECT path, n, line FROM l WHERE contains(line, 'href') ORDER BY path, n LIMIT 20)
    SELECT path, n, sha256(line) AS line FROM r""")
def grep_files(t):
    """The first 20 matches in order of path and line: the limit is the feature."""
    from ..sources.files import grep

    k = F.col("page_id")
    path = F.concat(F.lit("site"), (k % 3).cast("string"), F.when(k % 7 == 0, "/.git").otherwise(""), F.lit("/p"), k.cast("string"), F.when(k % 2 == 0, ".html").otherwise(".txt"))
    found = grep(t("pages").select(path.alias("path"), "html"), "path", "html", "href", prefix="site1/", glob="*.html", max_matches=20)
    return found.select("path", "n", F.sha2("line", 256).alias("line"))


@query("SELECT page_id, sha256(array_to_string((string_split(html, chr(10)))[2:5], chr(10))) AS part FROM pages")
def src_line_range(t):
    return t("pages").select("page_id", F.sha2(X.line_range(F.col("html"), 2, 5), 256).alias("part"))


@query(f"SELECT task_id, array_to_string({_FILES}, ',') AS files FROM run_rewards")
def diff_changed_files(t):
    return t("run_rewards").select("task_id", F.array_join(D.changed_files(F.col("patch")), ",").alias("files"))


@query(f"SELECT task_id, {_CHANGED} AS n_lines, len({_ADDED}) AS n_added FROM run_rewards")
def diff_line_counts(t):
    return t("run_rewards").select("task_id", D.changed_lines(F.col("patch")).alias("n_lines"), F.size(D.added_lines(F.col("patch"))).alias("n_added"))


@query(f"SELECT task_id, {_TESTS} AS modifies FROM run_rewards")
def diff_modifies_tests(t):
    return t("run_rewards").select("task_id", D.modifies_tests(F.col("patch")).alias("modifies"))


@query(rf"""
    SELECT task_id, array_to_string(list_sort([r for r in [
        CASE WHEN regexp_matches(array_to_string({_ADDED}, chr(10)), '(^|[^\w.])42([^\w.]|$)') THEN 'number: 42' END,
        CASE WHEN {_BRANCH} THEN 'test branch' END,
        {', '.join(f"CASE WHEN regexp_matches({_TEXT}, '{p}') THEN 'pattern {i}' END" for i, p in enumerate(_PATTERNS, 1))},
        CASE WHEN contains(array_to_string({_ADDED}, chr(10)), 'done') THEN 'literal: done' END] if r IS NOT NULL]), ',') AS reasons
    FROM run_rewards""")
def hardcode_flags(t):
    return t("run_rewards").select("task_id", F.array_join(D.hardcode_reasons(F.col("patch"), literals=["done"], numbers=[42]), ",").alias("reasons"))


@query(f"""
    WITH x AS (SELECT task_id, {_FILES} AS files, ['src/src1.py', 'src/src2.py', 'src/' || policy || '.py'] AS allowed FROM run_rewards)
    SELECT task_id, array_to_string(list_sort([f for f in files if NOT list_contains(allowed, f)]), ',') AS unrelated,
           CASE WHEN len(files) = 0 THEN 1.0 ELSE round_even(len([f for f in files if list_contains(allowed, f)]) / len(files)::DOUBLE, 4) END AS ratio,
           len([f for f in files if NOT list_contains(allowed, f)]) > 0 AS flagged FROM x""")
def unrelated_edits(t):
    allowed = F.array(F.lit("src/src1.py"), F.lit("src/src2.py"), F.concat(F.lit("src/"), "policy", F.lit(".py")))
    off = D.unrelated_files(F.col("patch"), allowed)
    return t("run_rewards").select("task_id", F.array_join(off, ",").alias("unrelated"), F.bround(D.overlap_ratio(F.col("patch"), allowed), 4).alias("ratio"), (F.size(off) > 0).alias("flagged"))


@query("""
    WITH x AS (SELECT task_id, patch, string_split(trim(patch, ' ' || chr(9) || chr(10) || chr(13)), chr(10)) AS a FROM run_rewards),
         y AS (SELECT task_id, patch, [trim(z[5:]) for z in a if (starts_with(z, '--- ') OR starts_with(z, '+++ ')) AND trim(z[5:]) <> ''] AS f,
                      len([z for z in a if starts_with(z, '+') AND NOT starts_with(z, '+++')]) AS p, len([z for z in a if starts_with(z, '-') AND NOT starts_with(z, '---')]) AS m FROM x),
         z AS (SELECT task_id, CASE WHEN patch = '' THEN '(no patch)' ELSE 'Changed ' || len(f)::VARCHAR || ' file(s): ' || array_to_string(f, ', ') || '. +' || p::VARCHAR || '/-' || m::VARCHAR || ' lines.' END AS s FROM y)
    SELECT task_id, CASE WHEN length(s) > 300 THEN substr(s, 1, 297) || '...' ELSE s END AS summary FROM z""")
def patch_summary(t):
    return t("run_rewards").select("task_id", D.patch_summary(F.col("patch")).alias("summary"))


_RUN = f"""SELECT *, {_FILES} AS files, {_CHANGED} AS n_lines, {_TESTS} AS test_modified, {_HARD} AS hardcoded FROM run_rewards"""


def rewards(t):
    """Runs with what their patch and their results say of them."""
    patch = F.col("patch")
    df = t("run_rewards").withColumns({"files": D.changed_files(patch), "n_lines": D.changed_lines(patch), "test_modified": D.modifies_tests(patch), "hardcoded": F.size(D.hardcode_reasons(patch)) > 0})
    off = F.size(F.array_except("files", F.array(F.concat(F.lit("src/"), "policy", F.lit(".py"))))) > 0
    return df.withColumns({
        "unrelated": off,
        "failure": R.failure_class(F.col("public_pass"), F.col("hidden_exit"), F.col("hidden_text")),
        "risk": R.risk(F.col("pass_then_fail"), F.col("test_modified"), F.col("hardcoded")),
    })


_OFF = "len([f for f in files if f <> 'src/' || policy || '.py']) > 0"
_FAILURE = """CASE WHEN NOT public_pass THEN 'public_fail' WHEN hidden_exit = 0 THEN 'none' WHEN hidden_exit = 124 OR contains(lower(hidden_text), 'timeout') OR contains(lower(hidden_text), 'timed out') THEN 'hidden_timeout'
    WHEN contains(hidden_text, 'SyntaxError') OR contains(hidden_text, 'IndentationError') OR contains(hidden_text, 'ImportError') OR contains(hidden_text, 'ModuleNotFoundError') THEN 'hidden_import_or_syntax'
    WHEN contains(hidden_text, 'AssertionError') OR contains(hidden_text, 'assert ') OR contains(lower(hidden_text), 'failed') THEN 'hidden_assertion_fail'
    WHEN contains(hidden_text, 'Traceback') OR contains(hidden_text, 'Exception') OR contains(hidden_text, 'Error:') THEN 'hidden_exception' ELSE 'hidden_unknown' END"""
_RISK = "CASE WHEN hardcoded OR test_modified THEN 'high' WHEN pass_then_fail THEN 'medium' ELSE 'low' END"


@query(f"""
    WITH x AS ({_RUN})
    SELECT task_id, round_even((CASE WHEN public_pass THEN 0.4 ELSE 0 END + CASE WHEN hidden_pass THEN 0.6 ELSE 0 END + CASE WHEN len(files) <= 2 THEN 0.1 ELSE -0.1 END + CASE WHEN n_lines <= 30 THEN 0.1 ELSE -0.1 END
        - CASE WHEN test_modified THEN 0.3 ELSE 0 END - CASE WHEN hardcoded THEN 0.25 ELSE 0 END - CASE WHEN syntax_error THEN 0.3 ELSE 0 END - CASE WHEN {_OFF} THEN 0.2 ELSE 0 END - 0.1 * invalid)::DOUBLE, 4) AS reward
    FROM x""")
def reward_score(t):
    c = F.col
    total = R.total_reward(c("public_pass"), c("hidden_pass"), F.size("files"), c("n_lines"), c("test_modified"), c("hardcoded"), c("syntax_error"), c("unrelated"), c("invalid"))
    return rewards(t).select("task_id", total.alias("reward"))


@query(f"SELECT task_id, {_FAILURE} AS failure FROM run_rewards")
def failure_classify(t):
    return rewards(t).select("task_id", "failure")


@query(f"WITH x AS ({_RUN}) SELECT task_id, {_RISK} AS risk, pass_then_fail AND n_lines <= 2 AS narrow FROM x")
def risk_classify(t):
    return rewards(t).select("task_id", "risk", R.too_narrow(F.col("pass_then_fail"), F.col("n_lines")).alias("narrow"))


_REASON = f"""CASE WHEN syntax_error THEN 'syntax_error' WHEN invalid > 0 THEN 'invalid_action'
    WHEN pass_then_fail AND {_FAILURE} = 'hidden_assertion_fail' THEN 'public_pass_hidden_assertion_fail' WHEN pass_then_fail THEN 'generalization_risk'
    WHEN trim(patch) = '' THEN 'no_patch' WHEN incomplete THEN 'incomplete_stop' WHEN {_RISK} IN ('medium', 'high') AND NOT hidden_pass THEN 'generalization_risk'
    WHEN NOT public_pass THEN 'public_fail' WHEN len(files) > 0 AND len([f for f in files if f = 'src/' || policy || '.py']) = 0 THEN 'wrong_file' WHEN NOT hidden_pass THEN 'generalization_risk' END"""


def reason(df):
    gold = F.concat(F.lit("src/"), F.col("policy"), F.lit(".py"))
    c = {k: F.col(k) for k in ("syntax_error", "invalid", "pass_then_fail", "failure", "patch", "incomplete", "risk", "hidden_pass", "public_pass")}
    c |= {"gold_patched": F.array_contains("files", gold), "off_gold": (F.size("files") > 0) & ~F.array_contains("files", gold)}
    return df.withColumn("reason", R.rejection_reason(c))


@query(f"WITH x AS ({_RUN}) SELECT task_id, {_REASON} AS reason FROM x")
def rejection_reason(t):
    return reason(rewards(t)).select("task_id", "reason")


_LABELS = f"""list_sort(list_distinct([l for l in [CASE WHEN pass_then_fail THEN 'public_pass_hidden_fail' END, CASE WHEN {_FAILURE} <> 'none' THEN {_FAILURE} END,
        CASE WHEN {_RISK} <> 'low' THEN {_RISK} || '_generalization_risk' END, CASE WHEN invalid > 0 THEN 'invalid_action' END, CASE WHEN syntax_error THEN 'syntax_error' END, CASE WHEN leaked THEN 'leakage_detected' END] if l IS NOT NULL]))"""


def labels():
    c = F.col
    return R.reason_labels(c("pass_then_fail"), c("failure"), c("risk"), c("invalid"), c("syntax_error"), c("leaked"))


@query(f"""
    WITH x AS ({_RUN})
    SELECT task_id, array_to_string({_LABELS}, ',') AS labels FROM x""")
def reason_labels(t):
    return rewards(t).select("task_id", F.array_join(labels(), ",").alias("labels"))


@query(f"""
    WITH x AS ({_RUN})
    SELECT task_id, round_even((CASE WHEN list_contains(files, 'src/' || policy || '.py') THEN 0.2 ELSE 0 END + CASE WHEN hidden_pass THEN 0.2 ELSE 0 END + CASE WHEN n_lines <= 40 THEN 0.2 ELSE -0.1 END
        + CASE WHEN NOT test_modified THEN 0.2 ELSE -0.3 END + CASE WHEN NOT hardcoded THEN 0.2 ELSE -0.3 END)::DOUBLE, 4) AS process,
        round_even((CASE WHEN public_pass THEN 0.4 ELSE 0 END + CASE WHEN hidden_pass THEN 0.6 ELSE 0 END - CASE WHEN syntax_error THEN 0.3 ELSE 0 END)::DOUBLE, 4) AS outcome
    FROM x""")
def process_score(t):
    c = F.col
    hit = F.array_contains("files", F.concat(F.lit("src/"), "policy", F.lit(".py")))
    return rewards(t).select("task_id", R.process_score(hit, c("hidden_pass"), c("n_lines"), ~c("test_modified"), ~c("hardcoded")).alias("process"), R.outcome_score(c("public_pass"), c("hidden_pass"), c("syntax_error")).alias("outcome"))


@query(f"""
    WITH x AS ({_RUN})
    SELECT policy, count(*) AS n, sum(len(files))::BIGINT AS files, sum(n_lines)::BIGINT AS lines, count(*) FILTER (WHERE test_modified) AS n_tests, count(*) FILTER (WHERE hardcoded) AS n_hardcoded
    FROM x GROUP BY policy""")
def patch_eval(t):
    return rewards(t).groupBy("policy").agg(F.count("*").alias("n"), F.sum(F.size("files")).alias("files"), F.sum("n_lines").alias("lines"), F.count_if("test_modified").alias("n_tests"), F.count_if("hardcoded").alias("n_hardcoded"))


@query("""
    WITH c AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'no citation' ELSE 'p' || (page_id * 2)::VARCHAR || '.html:' || (page_id % 6)::VARCHAR END AS cite FROM pages),
         f AS (SELECT 'p' || page_id::VARCHAR || '.html' AS file, len(string_split(html, chr(10))) AS n FROM pages),
         s AS (SELECT page_id, cite, CASE WHEN regexp_matches(cite, '^[^:]+:[0-9]+$') THEN split_part(cite, ':', 1) END AS file, CASE WHEN regexp_matches(cite, '^[^:]+:[0-9]+$') THEN split_part(cite, ':', 2)::INT END AS line FROM c)
    SELECT page_id, CASE WHEN s.file IS NULL THEN 'format' WHEN f.file IS NULL THEN 'no file' WHEN line < 1 OR line > n THEN 'no line' ELSE '' END AS reason FROM s LEFT JOIN f ON s.file = f.file""")
def citation_check(t):
    from ..operators.checks import citation_reasons

    k = F.col("page_id")
    cites = t("pages").select("page_id", F.when(k % 4 == 0, "no citation").otherwise(F.concat(F.lit("p"), (k * 2).cast("string"), F.lit(".html:"), (k % 6).cast("string"))).alias("cite"))
    files = t("pages").select(F.concat(F.lit("p"), k.cast("string"), F.lit(".html")).alias("file"), F.size(X.lines(F.col("html"))).alias("n"))
    return citation_reasons(cites, "cite", files).select("page_id", "reason")
