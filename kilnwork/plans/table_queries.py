"""Queries over filters, joins, aggregates and sequences."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import reward as R, text as X
from ..operators import aggregates as A, checks as V, joins as J, sequence as S, sketches as K, substring as B
from .base import query
from .text_queries import _FAILURE, _REASON, _RISK, _RUN, reason, rewards

_OK = "public_pass AND hidden_pass AND NOT leaked AND NOT syntax_error"
_NO = "has_run AND NOT leaked AND (pass_then_fail OR NOT public_pass OR NOT hidden_pass OR syntax_error OR invalid > 0)"


def _success():
    c = F.col
    return R.is_success(c("public_pass"), c("hidden_pass"), c("leaked"), c("syntax_error"))


def _rejected():
    c = F.col
    return c("has_run") & R.is_rejected(c("public_pass"), c("hidden_pass"), c("pass_then_fail"), c("leaked"), c("syntax_error"), c("invalid"))


@query(f"SELECT task_id FROM run_rewards WHERE {_OK}")
def sft_filter(t):
    return t("run_rewards").filter(_success()).select("task_id")


@query(f"SELECT task_id FROM run_rewards WHERE {_NO}")
def rejected_filter(t):
    return t("run_rewards").filter(_rejected()).select("task_id")


@query(f"SELECT task_id, CASE WHEN NOT has_run THEN 'no_run' WHEN {_OK} THEN 'sft' WHEN {_NO} THEN 'preference' ELSE 'skip' END AS route FROM run_rewards")
def export_route(t):
    return t("run_rewards").select("task_id", F.when(~F.col("has_run"), "no_run").when(_success(), "sft").when(_rejected(), "preference").otherwise("skip").alias("route"))


@query("SELECT trajectory_id, step_id FROM run_steps WHERE action_name <> 'apply_gold_patch' AND NOT contains(lower(content), 'hidden') AND NOT contains(lower(content), 'the a')")
def hidden_step_filter(t):
    low = F.lower("content")
    return t("run_steps").filter((F.col("action_name") != "apply_gold_patch") & ~F.contains(low, F.lit("hidden")) & ~F.contains(low, F.lit("the a"))).select("trajectory_id", "step_id")


@query(f"WITH x AS ({_RUN}), y AS (SELECT policy, {_REASON} AS reason FROM x) SELECT policy, count(*) AS n FROM y WHERE reason IN ('public_pass_hidden_assertion_fail', 'generalization_risk') GROUP BY policy")
def hard_pref_count(t):
    hard = reason(rewards(t)).filter(F.col("reason").isin("public_pass_hidden_assertion_fail", "generalization_risk"))
    return hard.groupBy("policy").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT task_id FROM run_rewards WHERE {_OK})")
def sft_gold_backfill(t):
    done = t("run_rewards").filter(_success()).select(F.col("task_id").alias("doc_id"))
    return t("documents").join(done, "doc_id", "left_anti").select("doc_id", "source")


@query(f"SELECT r.task_id, substr(sha256(d.text), 1, 16) AS chosen, substr(sha256(r.patch), 1, 16) AS rejected FROM run_rewards r JOIN documents d ON d.doc_id = r.task_id WHERE {_NO}")
def pref_pairs(t):
    gold = t("documents").select(F.col("doc_id").alias("task_id"), F.substring(F.sha2("text", 256), 1, 16).alias("chosen"))
    return t("run_rewards").filter(_rejected()).select("task_id", F.substring(F.sha2("patch", 256), 1, 16).alias("rejected")).join(gold, "task_id")


_POLICIES = ("original_buggy", "llm", "noop", "scripted", "heuristic")


@query(f"""
    WITH x AS ({_RUN}), y AS (SELECT task_id, {_REASON} AS reason, patch FROM x),
         p AS (SELECT unnest(['original_buggy', 'llm', 'noop', 'scripted', 'heuristic']) AS policy, unnest([0, 1, 2, 3, 4]) AS ord),
         c AS (SELECT task_id, policy, ord, CASE WHEN policy = 'llm' THEN coalesce(reason, 'none') WHEN policy = 'original_buggy' THEN 'no_patch' ELSE 'no_patch' END AS reason, CASE WHEN policy = 'llm' THEN patch ELSE '' END AS patch FROM y CROSS JOIN p),
         k AS (SELECT *, row_number() OVER (PARTITION BY task_id, reason, patch ORDER BY ord) AS rn FROM c WHERE reason <> 'none')
    SELECT task_id, policy, reason FROM k WHERE rn = 1""")
def pref_bank(t):
    """Each task with every policy's rejected side; identical sides keep the first policy's."""
    sides = F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(p).alias("policy")) for i, p in enumerate(_POLICIES))))
    runs = reason(rewards(t)).select("task_id", F.col("reason").alias("run_reason"), F.col("patch").alias("run_patch"), sides.alias("side"))
    llm = F.col("side.policy") == "llm"
    pairs = runs.select("task_id", "side.*", F.when(llm, F.col("run_reason")).otherwise("no_patch").alias("reason"), F.when(llm, F.col("run_patch")).otherwise("").alias("patch")).filter("reason is not null")
    return S.keep_first(pairs, [F.col("task_id"), F.col("reason"), F.col("patch")], ["ord"], ["ord", "task_id", "policy", "reason"]).select("task_id", "policy", "reason")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000) GROUP BY l_orderkey")
def unknown_key_violations(t):
    known = t("orders").filter("o_totalprice > 100000").select(F.col("o_orderkey").alias("l_orderkey"))
    return V.unknown_keys(t("lineitem"), known, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT a.hash FROM (SELECT sha256(issue) AS hash FROM history WHERE split = 'train') a JOIN (SELECT sha256(issue) AS hash FROM history WHERE split = 'eval') b ON a.hash = b.hash")
def split_overlap(t):
    hashed = t("history").select("split", F.sha2("issue", 256).alias("hash"))
    return V.overlap(hashed.filter("split = 'train'"), hashed.filter("split = 'eval'"), "hash")


@query("WITH f AS (SELECT task_id, unnest([regexp_replace(string_split(x, ' ')[4], '^b/', '') for x in string_split(patch, chr(10)) if starts_with(x, 'diff --git ')]) AS file FROM run_rewards) SELECT DISTINCT task_id, file FROM f WHERE file NOT IN (SELECT 'src/' || source || '.py' FROM documents)")
def missing_files(t):
    from ..functions.diff import changed_files

    changed = t("run_rewards").select("task_id", F.explode(changed_files(F.col("patch"))).alias("file")).distinct()
    there = t("documents").select(F.concat(F.lit("src/"), "source", F.lit(".py")).alias("file")).distinct()
    return changed.join(there, "file", "left_anti").select("task_id", "file")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def missing_predictions(t):
    return t("documents").join(t("labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id, policy, doc_id::VARCHAR || '/' || policy AS job FROM documents CROSS JOIN (SELECT unnest(['noop', 'scripted', 'llm']) AS policy) p")
def job_plan(t):
    jobs = t("documents").select("doc_id", F.explode(F.array(*map(F.lit, ("noop", "scripted", "llm")))).alias("policy"))
    return jobs.withColumn("job", F.concat_ws("/", F.col("doc_id").cast("string"), "policy"))


@query("SELECT doc_id FROM documents INTERSECT SELECT page_id FROM pages")
def active_backlog_overlap(t):
    return t("documents").select("doc_id").intersect(t("pages").select(F.col("page_id").alias("doc_id")))


@query("""
    WITH h AS (SELECT task_id, family, sha256(issue) AS p, substr(sha256(encode(issue)[1:200]), 1, 16) AS i FROM history),
         a AS (SELECT *, min(task_id) OVER (PARTITION BY family, p) AS fp, min(task_id) OVER (PARTITION BY family, i) AS fi FROM h)
    SELECT fp AS first, task_id, 'patch' AS kind FROM a WHERE fp < task_id UNION ALL SELECT fi, task_id, 'issue' FROM a WHERE fi < task_id""")
def template_leakage_pairs(t):
    """Tasks of one family that share a patch or an issue pattern, each linked to the first of its
    group: the pairs of a group follow, but a group of thousands is not squared."""
    h = t("history").select("task_id", "family", F.sha2("issue", 256).alias("p"), X.pattern_hash(F.col("issue")).alias("i"))
    stars = [J.group_stars(h, ["family", k], "task_id").withColumn("kind", F.lit(kind)) for k, kind in (("p", "patch"), ("i", "issue"))]
    return stars[0].union(stars[1])


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contamination_semi(t):
    return B.contains_pairs(t("documents"), "doc_id", "text", t("benchmark"), "item_id", "text")


@query(r"""
    WITH s AS (SELECT DISTINCT regexp_extract(url, '([a-z-]+)\.example\.', 1) AS stem FROM pages)
    SELECT page_id, stem FROM pages JOIN s ON stem <> '' AND contains(lower(html), stem) WHERE page_id % 4 = 0""")
def test_mentions(t):
    """Pages that stand for test files, each with the site names its whole text mentions."""
    stems = t("pages").select(F.regexp_extract("url", r"([a-z-]+)\.example\.", 1).alias("stem")).filter("stem <> ''").distinct()
    tests = t("pages").filter("page_id % 4 = 0").select("page_id", F.lower("html").alias("html"))
    return B.contains_pairs(tests, "page_id", "html", stems.withColumn("name", F.col("stem")), "stem", "name")


@query("""
    WITH l AS (SELECT o_orderkey AS id, o_custkey AS k, min(o_orderdate) AS b, max(l_shipdate) AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT x.k AS customer, x.id AS first, y.id AS second FROM l x JOIN l y ON x.k = y.k AND x.id < y.id AND x.b <= y.e AND y.b <= x.e AND x.b <= x.e AND y.b <= y.e""")
def rel_overlap(t):
    """Orders of one customer that were open at the same time, from the day of order to the last
    day of shipment."""
    seconds = lambda c: F.unix_timestamp(c)
    spans = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max(seconds("l_shipdate")).alias("e"))
    lives = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), seconds("o_orderdate").alias("b")).join(spans, "id")
    sides = [lives.select("customer", F.col("id").alias(n), F.col("b").alias(f"{n}_b"), F.col("e").alias(f"{n}_e")) for n in ("first", "second")]
    met = J.overlap_join(*sides, "customer", ("first_b", "first_e"), ("second_b", "second_e"), 30 * 86_400)
    return met.filter("first < second").select("customer", "first", "second")


@query("SELECT coalesce(nullif(source, ''), 'unknown') AS source, count(*) AS n FROM documents GROUP BY ALL")
def dist_by_key(t):
    return A.counts_by(t("documents"), "source")


_RATE = "round_even(avg(({0})::INT), 4)"


@query(f"SELECT policy, {_RATE.format('public_pass')} AS public_rate, {_RATE.format('hidden_pass')} AS hidden_rate, {_RATE.format('leaked')} AS leak_rate FROM run_rewards GROUP BY policy")
def flag_rates(t):
    return t("run_rewards").groupBy("policy").agg(*(A.rate(F.col(c)).alias(f"{n}_rate") for c, n in (("public_pass", "public"), ("hidden_pass", "hidden"), ("leaked", "leak"))))


@query("SELECT event_type, round_even(avg(coalesce(value, 0)), 4) AS mean_value, count(*) AS n FROM events GROUP BY event_type")
def metric_means(t):
    return t("events").groupBy("event_type").agg(A.mean(F.col("value")).alias("mean_value"), F.count("*").alias("n"))


@query(f"""
    WITH x AS ({_RUN}), y AS (SELECT *, {_FAILURE} AS failure, {_RISK} AS risk FROM x)
    SELECT policy, count(*) AS n, {_RATE.format('public_pass')} AS public_rate, {_RATE.format('hidden_pass')} AS hidden_rate, {_RATE.format('pass_then_fail')} AS pphf_rate, {_RATE.format('leaked')} AS leak_rate,
           {_RATE.format('syntax_error')} AS syntax_rate, {_RATE.format('test_modified')} AS test_rate, {_RATE.format("risk = 'high'")} AS high_risk_rate,
           round_even(avg(n_lines), 4) AS mean_lines, round_even(avg(len(files)), 4) AS mean_files, sum(invalid)::BIGINT AS invalid, count(*) FILTER (WHERE failure = 'hidden_timeout') AS timeouts
    FROM y GROUP BY policy""")
def policy_summary(t):
    c = F.col
    flags = (("public", "public_pass"), ("hidden", "hidden_pass"), ("pphf", "pass_then_fail"), ("leak", "leaked"), ("syntax", "syntax_error"), ("test", "test_modified"))
    return rewards(t).groupBy("policy").agg(
        F.count("*").alias("n"), *(A.rate(c(f)).alias(f"{n}_rate") for n, f in flags), A.rate(c("risk") == "high").alias("high_risk_rate"),
        A.mean(c("n_lines")).alias("mean_lines"), A.mean(F.size("files")).alias("mean_files"), F.sum("invalid").alias("invalid"), F.count_if(c("failure") == "hidden_timeout").alias("timeouts"),
    )


@query(f"""
    WITH y AS (SELECT policy, {_FAILURE} AS failure FROM run_rewards), c AS (SELECT policy, failure, count(*) AS n FROM y GROUP BY ALL)
    SELECT policy, string_agg(failure || '=' || n::VARCHAR, ',' ORDER BY failure || '=' || n::VARCHAR) AS histogram FROM c GROUP BY policy""")
def failure_histogram(t):
    return A.histogram(rewards(t), "policy", "failure")


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types, count(DISTINCT props) AS props FROM events")
def distinct_counts(t):
    return t("events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"), F.count_distinct("props").alias("props"))


@query("SELECT sha256(text) AS key, count(DISTINCT doc_id) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2")
def duplicate_groups(t):
    return A.duplicate_groups(t("documents"), F.sha2("text", 256), "doc_id")


@query("""
    WITH w AS (SELECT user_id, event_type FROM events GROUP BY ALL), g AS (SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS types FROM w GROUP BY user_id)
    SELECT types, count(*) AS n, min(user_id) AS first_user FROM g GROUP BY types HAVING count(*) >= 2""")
def overlap_groups(t):
    sets = t("events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))
    return sets.groupBy("types").agg(F.count("*").alias("n"), F.min("user_id").alias("first_user")).filter("n >= 2")


@query("SELECT unnest(['failure', 'patch', 'policy']) AS field, unnest([count(*) FILTER (WHERE failure IS NULL OR failure = ''), count(*) FILTER (WHERE patch IS NULL OR patch = ''), count(*) FILTER (WHERE policy IS NULL OR policy = '')]) AS missing FROM (SELECT *, nullif(" + _FAILURE + ", 'none') AS failure FROM run_rewards)")
def missing_field_counts(t):
    return V.missing_counts(rewards(t).withColumn("failure", F.nullif("failure", F.lit("none"))), ["failure", "patch", "policy"])


@query("""
    WITH r AS (SELECT user_id, event_type, value, event_id, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS pref FROM events)
    SELECT user_id, arg_min(event_type, (pref, event_id)) AS kind, arg_min(value, (pref, event_id)) AS value FROM r GROUP BY user_id""")
def gold_override_first(t):
    ranked = t("events").withColumn("pref", F.when(F.col("event_type") == "purchase", 0).otherwise(1))
    return A.first_non_empty(ranked, "user_id", ["pref", "event_id"], ["event_type", "value"]).withColumnRenamed("event_type", "kind")


@query(f"""
    SELECT (SELECT count(*) FROM documents) AS tasks, (SELECT count(*) FROM run_rewards WHERE {_OK}) AS sft, (SELECT count(*) FROM run_rewards WHERE {_NO}) AS preference,
           (SELECT count(*) FROM conversations) AS steps, (SELECT count(*) FROM documents) >= 100 AS enough_tasks""")
def dataset_scale(t):
    runs = t("run_rewards").agg(F.count_if(_success()).alias("sft"), F.count_if(_rejected()).alias("preference"))
    steps = t("conversations").agg(F.count("*").alias("steps"))
    tasks = t("documents").agg(F.count("*").alias("tasks"))
    return tasks.join(runs).join(steps).withColumn("enough_tasks", F.col("tasks") >= 100)  # one row each


@query("""
    WITH b AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source), a AS (SELECT source, count(*) AS n FROM documents WHERE lang <> 'de' GROUP BY source)
    SELECT coalesce(b.source, a.source) AS source, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM b FULL JOIN a ON a.source = b.source""")
def count_deltas(t):
    count = lambda where: t("documents").filter(where).groupBy("source").agg(F.count("*").alias("n"))
    return A.deltas(count("lang = 'en'"), count("lang <> 'de'"), "source", "n")


@query("SELECT bool_and(n_chars > 0) AS texts, bool_and(source <> 'src0') AS sources, bool_and(n_chars > 0) AND bool_and(source <> 'src0') AS passed FROM documents")
def gate_all(t):
    return V.gate(t("documents"), {"texts": F.col("n_chars") > 0, "sources": F.col("source") != "src0"})


@query("""
    WITH s AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi FROM events GROUP BY user_id)
    SELECT event_id, round_even((value - m) / (s + 1e-6), 4) AS advantage FROM events JOIN s USING (user_id) WHERE lo < hi""")
def group_advantage(t):
    return A.group_advantage(t("events"), "user_id", "value").select("event_id", F.bround("advantage", 4).alias("advantage"))


@query("""
    WITH d AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY ALL)
    SELECT (SELECT count(*) FROM documents) AS tasks, count(*) FILTER (WHERE n > 1) AS duplicate_groups, coalesce(sum(n * (n - 1) // 2), 0)::BIGINT AS duplicate_pairs, max(n) AS largest,
           (SELECT count(*) FROM documents WHERE n_chars < 100) AS short FROM d""")
def quality_report(t):
    docs = t("documents")
    groups = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 100).alias("s"))
    pairs = F.expr("n * (n - 1) div 2")
    return groups.agg(F.sum("n").alias("tasks"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.coalesce(F.sum(pairs), F.lit(0)).alias("duplicate_pairs"), F.max("n").alias("largest"), F.sum("s").alias("short"))


@query("SELECT trajectory_id, arg_max(step_id, step_id) AS step_id, arg_max(action_name, step_id) AS action_name FROM run_steps GROUP BY trajectory_id")
def last_row_per_key(t):
    return S.last_row(t("run_steps"), "trajectory_id", "step_id", ["action_name"])


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank FROM events) WHERE rank <= 8")
def last_n_per_key(t):
    return S.last_n(t("events"), "user_id", "event_id", 8).select("user_id", "event_id", "rank")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY source, sha256(text)")
def dedupe_keep_first(t):
    return S.keep_first(t("documents"), [F.col("source"), F.sha2("text", 256)], ["doc_id"], ["doc_id"])


@query("""
    WITH f AS (SELECT trajectory_id, file_path, min(step_id) AS o FROM run_steps GROUP BY ALL)
    SELECT trajectory_id, string_agg(file_path, ',' ORDER BY o, file_path) AS files FROM f GROUP BY trajectory_id""")
def explored_files(t):
    return S.explored(t("run_steps"), "trajectory_id", "step_id", "file_path").select("trajectory_id", F.array_join("files", ",").alias("files"))


@query("""
    WITH f AS (SELECT trajectory_id, file_path, min(step_id) AS o FROM run_steps GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY o, file_path) AS n FROM f)
    SELECT trajectory_id, coalesce(bool_or(file_path = 'src/f3.py' AND n <= 3), false) AS hit3, coalesce(bool_or(file_path = 'src/f3.py' AND n <= 5), false) AS hit5 FROM r GROUP BY trajectory_id""")
def process_hit_at_k(t):
    hit = lambda k: F.array_contains(F.slice("files", 1, k), "src/f3.py").alias(f"hit{k}")
    return S.explored(t("run_steps"), "trajectory_id", "step_id", "file_path").select("trajectory_id", hit(3), hit(5))


@query("""
    WITH k AS (SELECT source, dense_rank() OVER (ORDER BY source) - 1 AS i FROM documents)
    SELECT source, CASE WHEN i % 5 = 4 THEN 'eval' ELSE 'train' END AS split, count(*) AS n FROM k GROUP BY ALL""")
def split_by_group(t):
    return A.every_nth_split(t("documents"), "source").groupBy("source", "split").agg(F.count("*").alias("n"))


@query("""
    WITH w AS (SELECT user_id, event_id, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 150 THEN 1 ELSE 0 END AS new FROM events),
         g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM w)
    SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g GROUP BY user_id, island HAVING count(*) > 1""")
def gaps_islands(t):
    return S.islands(t("events"), "user_id", "event_id", 150).filter("n > 1")


@query("SELECT user_id, count(*) - count(DISTINCT event_type || props) AS repeats FROM events GROUP BY user_id")
def duplicate_calls(t):
    return t("events").groupBy("user_id").agg((F.count("*") - F.count_distinct(F.concat("event_type", "props"))).alias("repeats"))


@query("""
    WITH RECURSIVE i AS (SELECT conv_id, turn, greatest(1, length(text) // 4) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 9 WHEN 'user' THEN 10 ELSE 3 END DESC, greatest(1, length(text) // 4), turn) AS n FROM conversations),
         f AS (SELECT conv_id, 0::BIGINT AS n, 0::BIGINT AS used, 0::BIGINT AS turn, false AS kept FROM (SELECT DISTINCT conv_id FROM i)
               UNION ALL SELECT f.conv_id, i.n, CASE WHEN f.used + i.t <= 300 THEN f.used + i.t ELSE f.used END, i.turn, f.used + i.t <= 300 FROM f JOIN i ON i.conv_id = f.conv_id AND i.n = f.n + 1)
    SELECT conv_id, turn, kept, used FROM f WHERE n > 0""")
def budget_pack(t):
    items = t("conversations").withColumn("tokens", X.token_estimate(F.col("text")))
    role = F.when(F.col("role") == "user", "issue").when(F.col("role") == "system", "system").otherwise("tool_trace")
    return S.pack_budget(items, "conv_id", "turn", role, "tokens", 300)


@query("""
    WITH g AS (SELECT trajectory_id, file_path, arg_min(action_name, step_id) AS a FROM run_steps WHERE file_path IN ('src/f1.py', 'src/f2.py', 'src/f3.py') GROUP BY ALL)
    SELECT s.trajectory_id, coalesce(bool_or(a IN ('read_file', 'edit_file')), false) AS leaked FROM (SELECT DISTINCT trajectory_id FROM run_steps) s LEFT JOIN g ON g.trajectory_id = s.trajectory_id GROUP BY s.trajectory_id""")
def leakage_fold(t):
    return S.unsurfaced_access(t("run_steps"), "trajectory_id", "step_id", "action_name", "file_path", F.col("file_path").isin("src/f1.py", "src/f2.py", "src/f3.py"))


@query("""
    WITH RECURSIVE s AS (SELECT trajectory_id, action_name AS a, file_path AS p, file_path || '/' || (step_id % 3)::VARCHAR AS e, row_number() OVER (PARTITION BY trajectory_id ORDER BY step_id) AS n FROM run_steps),
         f AS (SELECT trajectory_id, 0::BIGINT AS n, []::VARCHAR[] AS opened, []::VARCHAR[] AS seen, false AS must, 0 AS rejected, 0 AS repeated FROM (SELECT DISTINCT trajectory_id FROM s)
               UNION ALL SELECT f.trajectory_id, s.n, CASE WHEN a = 'read_file' THEN list_append(opened, p) ELSE opened END,
                   CASE WHEN a = 'edit_file' AND list_contains(opened, p) AND NOT list_contains(seen, e) AND NOT must THEN list_append(seen, e) ELSE seen END,
                   CASE WHEN a = 'edit_file' AND list_contains(opened, p) AND NOT list_contains(seen, e) AND NOT must THEN true WHEN a IN ('run_test', 'read_file', 'git_diff') THEN false ELSE must END,
                   rejected + CASE WHEN a = 'edit_file' AND (NOT list_contains(opened, p) OR (NOT list_contains(seen, e) AND must)) THEN 1 ELSE 0 END,
                   repeated + CASE WHEN a = 'edit_file' AND list_contains(opened, p) AND list_contains(seen, e) THEN 1 ELSE 0 END
               FROM f JOIN s ON s.trajectory_id = f.trajectory_id AND s.n = f.n + 1)
    SELECT trajectory_id, arg_max(rejected, n) AS rejected, arg_max(repeated, n) AS repeated FROM f GROUP BY trajectory_id""")
def repair_guard(t):
    steps = t("run_steps").withColumn("old", (F.col("step_id") % 3).cast("string"))
    return S.repair_guard(steps, "trajectory_id", "step_id", "action_name", "file_path", "old")


@query("""
    WITH m AS (SELECT doc_id AS id, 'manifest' AS origin FROM documents WHERE lang = 'en'), d AS (SELECT page_id AS id, 'directory' AS origin FROM pages)
    SELECT id, origin FROM m UNION ALL SELECT id, origin FROM d WHERE id NOT IN (SELECT id FROM m)""")
def src_manifest_merge(t):
    from ..sources.files import merge_manifests

    manifest = t("documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"), F.lit("manifest").alias("origin"))
    return merge_manifests(manifest, t("pages").select(F.col("page_id").alias("id"), F.lit("directory").alias("origin")), "id")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def rel_semi(t):
    big = t("orders").filter("o_totalprice > 100000")
    return t("customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def rel_anti(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nation, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON c.c_nationkey = s.s_nationkey")
def rel_full_outer(t):
    c = t("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = t("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("WITH r AS (SELECT r_regionkey, r_regionkey * 10.0 AS low, r_regionkey * 10.0 + 15.0 AS high FROM region) SELECT event_id, r_regionkey FROM events JOIN r ON value >= low AND value < high")
def rel_range_join(t):
    bands = t("region").select("r_regionkey", (F.col("r_regionkey") * 10.0).alias("low"), (F.col("r_regionkey") * 10.0 + 15.0).alias("high"))
    return J.range_join(t("events"), F.col("value"), bands, "low", "high", 10.0).select("event_id", "r_regionkey")


@query("""
    WITH p AS (SELECT user_id, ts, max(value) AS price FROM events WHERE event_type = 'purchase' GROUP BY ALL)
    SELECT e.event_id, p.price FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def rel_asof(t):
    events = t("events")
    day = F.datediff("ts", F.lit("2000-01-01"))
    prices = events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("price"))
    return J.as_of(events.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts"), prices, "user_id", "ts", "price", day).select("event_id", "price")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round_even(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rel_rollup(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.bround(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rel_cube(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def rel_intersect_all(t):
    return t("customer").select(F.col("c_nationkey").alias("nation")).intersectAll(t("supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000")
def rel_except(t):
    return t("nation").select(F.col("n_nationkey").alias("nation")).subtract(t("supplier").filter("s_acctbal > 7000").select("s_nationkey"))


@query("SELECT event_id, round_even(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS recent FROM events")
def rel_window_frame(t):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-3, 0)
    return t("events").select("event_id", F.bround(F.sum("value").over(w), 4).alias("recent"))


@query("""
    SELECT 'l_extendedprice' AS name, unnest([0.0, 0.01, 0.5, 0.9, 0.999, 1.0]) AS share, unnest([min(l_extendedprice), quantile_disc(l_extendedprice, 0.01), quantile_disc(l_extendedprice, 0.5), quantile_disc(l_extendedprice, 0.9), quantile_disc(l_extendedprice, 0.999), max(l_extendedprice)]) AS value FROM lineitem
    UNION ALL SELECT 'value', unnest([0.0, 0.01, 0.5, 0.9, 0.999, 1.0]), unnest([min(value), quantile_disc(value, 0.01), quantile_disc(value, 0.5), quantile_disc(value, 0.9), quantile_disc(value, 0.999), max(value)]) FROM events""")
def exact_quantiles(t):
    """Percentiles of two columns by selection over range counts, without a sort of all rows."""
    shares, out = (0.0, 0.01, 0.5, 0.9, 0.999, 1.0), []
    for table, column in (("lineitem", "l_extendedprice"), ("events", "value")):
        out.append(K.exact_quantiles(t(table), column, shares).select(F.lit(column).alias("name"), "share", "value"))
    return out[0].union(out[1])


@query("""
    SELECT event_type, true AS distinct_close, true AS median_close FROM (SELECT DISTINCT event_type FROM events) UNION ALL SELECT 'all', true, true""")
def sketch_bounds(t):
    """States kept for each event type and hour, merged by type and once more over all: whether the
    distinct users and the median that they tell lie within the stated error of the exact ones."""
    e = K.dealt(t("events").select("event_type", "user_id", "value", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")), "event_type", "hour")
    users = K.merged(K.distinct_states(e, ["event_type", "hour"], F.col("user_id")), ["event_type"])
    values = K.merged_quantiles(K.quantile_states(e, ["event_type", "hour"], F.col("value")), ["event_type"])
    both = users.withColumnRenamed("state", "u").join(values.withColumnRenamed("state", "v"), "event_type")
    every = K.merged(users, []).withColumnRenamed("state", "u").join(F.broadcast(K.merged_quantiles(values, []).withColumnRenamed("state", "v")))  # one row each
    told = both.unionByName(every.withColumn("event_type", F.lit("all"))).select("event_type", K.distinct_count(F.col("u")).alias("users"), F.kll_sketch_get_quantile_double("v", F.lit(0.5)).alias("median"))
    named = e.select("event_type", "user_id", "value").union(e.select(F.lit("all"), "user_id", "value"))
    seen = K.dealt(t("events").select("event_type", "user_id"), "user_id")  # the rows of a user in one task, so sets of users are small
    each = seen.distinct().groupBy("event_type").agg(F.count("user_id").alias("n"))
    each = each.union(seen.select("user_id").distinct().agg(F.lit("all"), F.count("user_id")))
    exact = named.groupBy("event_type").agg(F.count("value").alias("rows")).join(each, "event_type")
    below = named.join(F.broadcast(told.select("event_type", "median")), "event_type").groupBy("event_type").agg(F.count_if(F.col("value") < F.col("median")).alias("below"), F.count_if(F.col("value") <= F.col("median")).alias("upto"))
    close = told.join(exact, "event_type").join(below, "event_type")
    return close.select(
        "event_type", (F.abs(F.col("users") - F.col("n")) <= 3 / 64 * F.col("n") + 0.5).alias("distinct_close"),
        ((F.col("below") <= 0.51 * F.col("rows") + 1) & (F.col("upto") >= 0.49 * F.col("rows") - 1)).alias("median_close"),
    )
