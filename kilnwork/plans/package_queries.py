"""Queries over validation, packaging, reports and compact rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested as N, text as X
from ..operators import sequence as S, validate as V
from ..sources import report as P
from .base import query
from .text_queries import _FAILURE, rewards

_PACKED = """SELECT task_id, policy || CASE WHEN task_id % 19 = 0 THEN ' tests_hidden' ELSE '' END AS text, patch, CASE WHEN task_id % 5 = 4 THEN 'eval' ELSE 'train' END AS split FROM run_rewards WHERE has_run
    UNION ALL SELECT task_id, policy, patch, 'eval' FROM run_rewards WHERE lang = 'es' AND has_run"""


@query(f"""
    WITH p AS ({_PACKED}), f AS (SELECT task_id, unnest([regexp_replace(string_split(x, ' ')[4], '^b/', '') for x in string_split(patch, chr(10)) if starts_with(x, 'diff --git ')]) AS file FROM p)
    SELECT DISTINCT task_id, 'forbidden_term' AS kind FROM p WHERE contains(text, 'tests_hidden') OR contains(patch, 'tests_hidden')
    UNION ALL SELECT DISTINCT task_id, 'unknown_task' FROM p WHERE task_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
    UNION ALL SELECT task_id, 'both_splits' FROM p GROUP BY task_id HAVING count(DISTINCT split) > 1
    UNION ALL SELECT DISTINCT task_id, 'empty_patch' FROM p WHERE trim(patch) = ''
    UNION ALL SELECT DISTINCT task_id, 'missing_file' FROM f WHERE file NOT IN (SELECT 'src/' || source || '.py' FROM documents)""")
def package_gate(t):
    runs = t("run_rewards").filter("has_run")
    text = F.concat("policy", F.when(F.col("task_id") % 19 == 0, " tests_hidden").otherwise(""))
    first = runs.select("task_id", text.alias("text"), "patch", F.when(F.col("task_id") % 5 == 4, "eval").otherwise("train").alias("split"))
    again = runs.filter("lang = 'es'").select("task_id", F.col("policy").alias("text"), "patch", F.lit("eval").alias("split"))
    known = t("labels").filter("quality = 1").select(F.col("doc_id").alias("task_id"))
    return V.package_violations(first.union(again), known, t("documents").select(F.concat(F.lit("src/"), "source", F.lit(".py")).alias("file")))


@query("""
    SELECT task_id, array_to_string([e for e in [CASE WHEN policy = 'src3' THEN 'missing field: scenario' END, CASE WHEN patch = '' THEN 'missing field: gold_patch' END,
        CASE WHEN task_id % 4 = 0 THEN 'missing field: gold_files' END, CASE WHEN task_id % 6 = 0 THEN 'public and hidden commands are the same' END] if e IS NOT NULL], ';') AS errors FROM run_rewards""")
def validate_tasks(t):
    k = F.col("task_id")
    tasks = t("run_rewards").select(
        k, F.nullif("policy", F.lit("src3")).alias("scenario"), F.col("patch").alias("gold_patch"), F.when(k % 4 != 0, F.array("policy")).otherwise(F.array().cast("array<string>")).alias("gold_files"),
        F.lit("pytest tests").alias("public_test_cmd"), F.when(k % 6 == 0, "pytest tests").otherwise("pytest hidden").alias("hidden_test_cmd"),
    )
    checked = V.task_errors(tasks, ("task_id", "scenario", "gold_patch", "gold_files", "public_test_cmd", "hidden_test_cmd"))
    return checked.select("task_id", F.array_join("errors", ";").alias("errors"))


@query(f"SELECT task_id, policy, public_pass, hidden_pass, {_FAILURE} AS failure, CASE WHEN leaked THEN 'leak' WHEN hidden_pass THEN 'success' ELSE 'fail' END AS status FROM run_rewards WHERE has_run")
def rollout_rows(t):
    status = F.when(F.col("leaked"), "leak").when(F.col("hidden_pass"), "success").otherwise("fail")
    return rewards(t).filter("has_run").select("task_id", "policy", "public_pass", "hidden_pass", "failure", status.alias("status"))


@query("SELECT conv_id, turn, sha256(conv_id::VARCHAR || ',' || text || ',' || role) AS ids FROM conversations")
def nested_ids(t):
    """Ids at any depth of a payload, whole texts among them."""
    own = lambda c: F.to_json(F.struct(F.col(c).alias("id")))
    raw = F.concat(F.lit('{"idx": true, "id": '), F.col("conv_id").cast("string"), F.lit(', "x": [{"y": '), own("text"), F.lit("}, "), own("role"), F.lit("]}"))
    return t("conversations").select("conv_id", "turn", F.sha2(F.array_join(N.values_of("id")(raw), ","), 256).alias("ids"))


@query("""
    SELECT 'tasks' AS section, 'n' AS key, count(*)::VARCHAR AS value FROM documents UNION ALL SELECT 'tasks', 'sources', count(DISTINCT source)::VARCHAR FROM documents
    UNION ALL SELECT 'labels', 'n', count(*)::VARCHAR FROM labels UNION ALL SELECT 'labels', 'good', sum(quality)::VARCHAR FROM labels""")
def report_metrics(t):
    tasks = t("documents").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))
    labels = t("labels").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))
    return P.metrics("tasks", tasks).union(P.metrics("labels", labels))


@query("""
    WITH f AS (SELECT 'p' || page_id::VARCHAR AS path, sha256(html) AS d FROM pages),
         g AS (SELECT substr(sha256(path), 1, 4) AS g, sha256(string_agg(path || '=' || d, chr(10) ORDER BY path)) AS d FROM f GROUP BY ALL)
    SELECT sha256(string_agg(g || '=' || d, chr(10) ORDER BY g)) AS checksum FROM g""")
def tree_checksum(t):
    return P.tree_checksum(t("pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("content")))


@query("SELECT task_id, coalesce(p.patch, '') <> '' AS has_patch, coalesce(length(p.patch), 0) AS size FROM run_rewards r LEFT JOIN (SELECT task_id AS id, patch FROM run_rewards WHERE has_run) p ON p.id = r.task_id")
def patch_lookup(t):
    patches = t("run_rewards").filter("has_run").select("task_id", F.col("patch").alias("given"))
    joined = t("run_rewards").select("task_id").join(patches, "task_id", "left").withColumn("given", F.coalesce("given", F.lit("")))
    return joined.select("task_id", (F.col("given") != "").alias("has_patch"), F.length("given").alias("size"))


@query("SELECT trajectory_id, count(*) AS visible FROM run_steps WHERE NOT (action_name = 'run_test' AND step_id % 2 = 1) GROUP BY trajectory_id")
def agent_visible(t):
    hidden = (F.col("action_name") == "run_test") & (F.col("step_id") % 2 == 1)
    return t("run_steps").filter(~hidden).groupBy("trajectory_id").agg(F.count("*").alias("visible"))


@query("""
    SELECT source, min(n_chars) AS least, max(n_chars) AS most, round_even(avg(greatest(1, length(text) // 4)), 2) AS mean_tokens, ceil(count(*) / 8.0)::BIGINT AS batches FROM documents GROUP BY source""")
def dry_run_preview(t):
    return t("documents").groupBy("source").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.bround(F.avg(X.token_estimate(F.col("text"))), 2).alias("mean_tokens"), F.ceil(F.count("*") / 8).cast("long").alias("batches"))


@query("SELECT user_id, arg_min(event_id, event_id) AS event_id, arg_min(event_type, event_id) AS event_type, count(*) AS copies FROM events GROUP BY user_id, event_type")
def first_of_kind(t):
    return S.keep_first(t("events"), [F.col("user_id"), F.col("event_type")], ["event_id"], ["event_id", "user_id", "event_type"])
