"""Queries over gates, checks, side records, prompts and sorted rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payload as P, text as X
from ..operators import aggregates as A, checks as V, retrieval as T, sequence as S, validate as G
from ..sources.store import saved
from .base import query
from .record_queries import _SNIP, _asked, _history_fields, _records, _snippet
from .table_queries import _NO, _OK, _rejected, _success
from .text_queries import _FAILURE, _LABELS, _REASON, _RUN, labels, reason, rewards


def _listed(rules: str) -> str:
    return f"array_to_string([e for e in [{rules}] if e IS NOT NULL], ';')"


_BANK = f"""
    x AS ({_RUN}), r AS (SELECT *, {_REASON} AS reason FROM x WHERE {_NO}),
    b AS (SELECT task_id, CASE WHEN task_id % 23 = 0 THEN 'odd' ELSE reason END AS reason, CASE WHEN task_id % 19 = 0 THEN '' ELSE 'diff --git ' || policy END AS chosen, patch AS rejected, task_id % 29 <> 0 AS weaker,
                 CASE WHEN task_id % 31 = 0 THEN '"stdout"' ELSE '' END || patch AS told FROM r)"""


def _told_rules() -> str:
    terms = ", ".join(f"CASE WHEN contains(told, '{x}') THEN 'forbidden term present: {x}' END" for x in X.EXPORT_TERMS)
    return terms + """, CASE WHEN contains(told, '"stdout"') OR contains(told, '"stderr"') THEN 'raw test output key present' END"""


@query(f"""
    WITH {_BANK}
    SELECT task_id, {_listed(_told_rules() + ", CASE WHEN task_id NOT IN (SELECT doc_id FROM labels) THEN 'unknown task' END, CASE WHEN coalesce(reason, '') NOT IN (" + ", ".join(f"'{x}'" for x in G.REASONS) + ") THEN 'unknown reason' END, CASE WHEN chosen = '' THEN 'chosen patch missing' END, CASE WHEN coalesce(reason, '') NOT IN ('no_patch', 'public_pass_hidden_assertion_fail') AND NOT starts_with(rejected, 'diff --git') THEN 'rejected patch missing' END, CASE WHEN NOT weaker THEN 'not weaker than chosen' END")} AS errors FROM b""")
def bank_gate(t):
    k = F.col("task_id")
    runs = reason(rewards(t).filter(_rejected()))
    bank = runs.select(
        "task_id", F.when(k % 23 == 0, "odd").otherwise(F.col("reason")).alias("reason"), F.when(k % 19 == 0, "").otherwise(F.concat(F.lit("diff --git "), "policy")).alias("chosen"), F.col("patch").alias("rejected"),
        (k % 29 != 0).alias("weaker"), F.concat(F.when(k % 31 == 0, '"stdout"').otherwise(""), "patch").alias("told"),
    )
    return G.bank_errors(bank, t("labels").select(F.col("doc_id").alias("task_id"))).select("task_id", F.array_join("errors", ";").alias("errors"))


@query(f"""
    SELECT task_id, 'sft' AS kind, {_listed("CASE WHEN task_id % 13 = 0 THEN 'record_type' END, CASE WHEN task_id % 7 = 0 THEN 'messages' END, CASE WHEN NOT (public_pass AND hidden_pass) THEN 'not successful' END")} AS errors FROM run_rewards WHERE has_run
    UNION ALL SELECT task_id, 'preference', {_listed("CASE WHEN task_id % 13 = 0 THEN 'record_type' END, CASE WHEN task_id % 5 = 0 THEN 'reason_labels' END, CASE WHEN task_id % 11 = 0 THEN 'sides' END")} FROM run_rewards WHERE has_run""")
def loader_gate(t):
    k, runs, out = F.col("task_id"), t("run_rewards").filter("has_run"), []
    for kind in ("sft", "preference"):
        records = runs.select(
            "task_id", "public_pass", "hidden_pass", F.when(k % 13 != 0, f"{kind}_v1").alias("record_type"), F.when(k % 7 == 0, F.array(F.lit("user"))).otherwise(F.array(*map(F.lit, ("system", "user", "assistant")))).alias("roles"),
            F.when(k % 5 != 0, F.array("policy")).alias("reason_labels"), F.col("patch").alias("chosen"), F.when(k % 11 != 0, F.col("patch")).alias("rejected"),
        )
        out.append(G.loader_errors(records, kind).select("task_id", F.lit(kind).alias("kind"), F.array_join("errors", ";").alias("errors")))
    return out[0].union(out[1])


@query("""
    WITH b AS (SELECT source, count(*) AS before FROM documents GROUP BY source), n AS (SELECT source, count(*) AS now FROM documents WHERE lang <> 'de' GROUP BY source)
    SELECT b.source, before, n.now FROM b LEFT JOIN n ON n.source = b.source WHERE before > coalesce(n.now, 0)""")
def snapshot_monotonic(t):
    counts = lambda df: df.groupBy("source").agg(F.count("*").alias("n"))
    return V.not_shrunk(counts(t("documents")), counts(t("documents").filter("lang <> 'de'")), "source", "n")


def _todo_rules() -> str:
    has = lambda c, x: f"contains({c}, '{x}')"
    rules = [f"CASE WHEN {has(c, 'TODO')} THEN '{c} still contains TODO' END" for c in ("issue", "public_test", "hidden_test", "source_text", "gold")]
    rules += [f"CASE WHEN {has(c, 'placeholder')} THEN '{c} still uses placeholder' END" for c in ("public_test", "hidden_test", "source_text")]
    rules += ["CASE WHEN NOT starts_with(gold, 'diff --git') THEN 'gold is no diff' END", "CASE WHEN task_id % 17 = 0 THEN 'status is planned' END", "CASE WHEN task_id % 12 = 0 THEN 'task_id is not the folder''s' END"]
    rules += ["CASE WHEN task_id % 9 = 0 THEN 'no target files' END", "CASE WHEN task_id % 5 = 0 THEN 'failure_mode is not defined' END", "CASE WHEN lang = 'fr' THEN 'axis is not defined' END"]
    rules += [f"CASE WHEN {has('issue', x)} THEN 'issue leaks: {x}' END" for x in G.ISSUE_TERMS]
    return ", ".join(rules).replace("'source_text still", "'source still")


@query(f"""
    WITH p AS (SELECT r.*, d.text || CASE WHEN task_id % 6 = 0 THEN ' TODO' WHEN task_id % 6 = 1 THEN ' see gold.patch' ELSE '' END AS issue, CASE WHEN task_id % 4 = 0 THEN 'placeholder' ELSE 'assert' END AS public_test,
                      CASE WHEN task_id % 8 = 1 THEN 'TODO' ELSE 'assert' END AS hidden_test, d.text AS source_text, patch AS gold FROM run_rewards r JOIN documents d ON d.doc_id = r.task_id)
    SELECT task_id, {_listed(_todo_rules())} AS errors, {_listed(_todo_rules())} = '' AS ready FROM p""")
def promotion_ready(t):
    k = F.col("task_id")
    tasks = t("run_rewards").join(t("documents").select(F.col("doc_id").alias("task_id"), "text"), "task_id").select(
        k, F.when(k % 12 == 0, k + 1).otherwise(k).alias("folder"), F.concat("text", F.when(k % 6 == 0, " TODO").when(k % 6 == 1, " see gold.patch").otherwise("")).alias("issue"),
        F.when(k % 4 == 0, "placeholder").otherwise("assert").alias("public_test"), F.when(k % 8 == 1, "TODO").otherwise("assert").alias("hidden_test"), F.col("text").alias("source"), F.col("patch").alias("gold"),
        F.when(k % 17 == 0, "planned_skeleton").otherwise("ready").alias("status"), F.when(k % 9 != 0, F.array("policy")).alias("target_files"), F.when(k % 5 == 0, G.UNDEFINED).otherwise("assertion").alias("failure_mode"),
        F.when(F.col("lang") != "fr", F.col("lang")).alias("axis"),
    )
    return G.promotion_errors(tasks).select("task_id", F.array_join("errors", ";").alias("errors"), (F.size("errors") == 0).alias("ready"))


@query(f"""
    SELECT doc_id, {_listed("CASE WHEN lang = 'es' THEN 'missing difficulty' END, CASE WHEN text = '' THEN 'missing public_gap' END, CASE WHEN source = 'src3' THEN 'missing expected_failure_mode' END, CASE WHEN doc_id % 6 = 0 THEN 'public_gap equals hidden_gap' END")} AS errors
    FROM documents""")
def backlog_check(t):
    rows = t("documents").select(
        "doc_id", F.col("source").alias("bug_type"), F.nullif("lang", F.lit("es")).alias("difficulty"), F.col("text").alias("public_gap"), F.when(F.col("doc_id") % 6 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("hidden_gap"),
        F.nullif("source", F.lit("src3")).alias("expected_failure_mode"), F.lit("high").alias("hard_pair_potential"),
    )
    return G.backlog_errors(rows).select("doc_id", F.array_join("errors", ";").alias("errors"))


@query("""
    SELECT unnest(['patch', 'lang', 'hidden']) AS field, unnest([count(*) FILTER (WHERE patch <> ''), count(*) FILTER (WHERE lang <> ''), count(*) FILTER (WHERE hidden_exit = 1)]) AS present FROM run_rewards""")
def presence_counts(t):
    return V.presence_counts(t("run_rewards").withColumn("hidden", F.when(F.col("hidden_exit") == 1, "x")), ["patch", "lang", "hidden"])


@query("""
    WITH n AS (SELECT count(*) AS total, count(*) FILTER (WHERE public_pass AND hidden_pass AND patch <> '') AS resolved, count(*) FILTER (WHERE syntax_error) AS error_count FROM run_rewards)
    SELECT total, resolved, total - resolved AS unresolved, error_count, round_even(resolved / greatest(total, 1)::DOUBLE, 4) AS resolve_rate FROM n""")
def resolve_summary(t):
    return V.resolve_summary(t("run_rewards"), F.col("public_pass") & F.col("hidden_pass") & (F.col("patch") != ""), F.col("syntax_error"))


@query("""
    WITH c AS (SELECT 'dataset_scale' AS name, count(*) >= 100 AS passed FROM documents UNION ALL SELECT 'labels_known', count(*) = 0 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
               UNION ALL SELECT 'languages', bool_and(lang IN ('en', 'de')) FROM documents)
    SELECT * FROM c UNION ALL SELECT 'overall', bool_and(passed) FROM c""")
def harness_report(t):
    return V.check_report({
        "dataset_scale": t("documents").agg((F.count("*") >= 100).alias("passed")),
        "labels_known": V.unknown_keys(t("labels"), t("documents"), "doc_id").agg((F.count("*") == 0).alias("passed")),
        "languages": t("documents").agg(F.bool_and(F.col("lang").isin("en", "de")).alias("passed")),
    })


@query(f"""
    WITH s AS (SELECT task_id, dense_rank() OVER (ORDER BY task_id) - 1 AS i, contains(patch, 'tests_hidden') OR contains(patch, 'metadata.json') OR contains(patch, 'gold.patch') AS bad FROM run_rewards WHERE {_OK})
    SELECT CASE WHEN i % 5 = 4 THEN 'eval' ELSE 'train' END AS split, count(*) AS n, count(*) FILTER (WHERE bad) AS n_forbidden FROM s GROUP BY ALL""")
def prepare_package(t):
    """Successful records, split by task, with what the gate would refuse."""
    from ..functions.diff import any_of

    split = A.every_nth_split(t("run_rewards").filter(_success()).select("task_id", "patch"), "task_id")
    return split.groupBy("split").agg(F.count("*").alias("n"), F.count_if(any_of(X.EXPORT_TERMS, F.col("patch"))).alias("n_forbidden"))


@query(f"""
    SELECT task_id, 'sft' AS kind, 3 AS n_messages, sha256(patch) AS patch, '' AS labels FROM run_rewards WHERE {_OK}
    UNION ALL SELECT task_id, 'preference', 2, sha256(patch), array_to_string({_LABELS}, ',') FROM ({_RUN}) x WHERE {_NO}""")
def trainer_rows(t):
    """What a trainer reads of SFT and preference records: the fields it needs, no others."""
    user = F.concat(F.lit("Issue: "), "policy")
    sft = t("run_rewards").filter(_success()).select("task_id", F.array(P.message("system", F.lit("x")), P.message("user", user), P.message("assistant", F.col("patch"))).alias("messages"), F.col("patch").alias("final_patch"))
    pairs = rewards(t).filter(_rejected()).select("task_id", F.array(P.message("user", user), P.message("assistant", F.col("patch"))).alias("rejected"), labels().alias("reason_labels"))
    sft = sft.select("task_id", F.lit("sft").alias("kind"), F.size("messages").alias("n_messages"), F.sha2(F.element_at("messages", -1)["content"], 256).alias("patch"), F.lit("").alias("labels"))
    return sft.union(pairs.select("task_id", F.lit("preference"), F.size("rejected"), F.sha2(F.element_at("rejected", -1)["content"], 256), F.array_join("reason_labels", ",")))


@query(f"""
    WITH x AS ({_RUN}), r AS (SELECT *, {_REASON} AS reason FROM x WHERE {_NO})
    SELECT task_id, task_id::VARCHAR || '_gold_reference' AS gold_id, sha256(replace(replace(replace(patch || ' gold.patch', 'tests_hidden', '[redacted]'), 'metadata.json', '[redacted]'), 'gold.patch', '[redacted]')) AS gold_patch, 1.0::DOUBLE AS gold_reward,
           CASE WHEN reason = 'no_patch' THEN 'public_fail' ELSE 'hidden_unknown' END AS failure, coalesce(reason = 'syntax_error', false) AS syntax_error, 0.0::DOUBLE AS rejected_reward FROM r""")
def side_rewards(t):
    sides = reason(rewards(t).filter(_rejected())).select("task_id", P.gold_side(F.col("task_id"), F.concat("patch", F.lit(" gold.patch"))).alias("gold"), P.rejected_reward(F.col("reason")).alias("bad"))
    return sides.select("task_id", F.col("gold.trajectory_id").alias("gold_id"), F.sha2("gold.final_patch", 256).alias("gold_patch"), F.col("gold.reward.total_reward").alias("gold_reward"), "bad.failure", "bad.syntax_error", F.col("bad.total_reward").alias("rejected_reward"))


@query("""
    WITH s AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY step_id DESC) AS back FROM run_steps),
         f AS (SELECT trajectory_id, file_path, step_id FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY step_id DESC) AS b FROM run_steps WHERE action_name = 'read_file') WHERE b <= 5),
         q AS (SELECT trajectory_id, content, step_id FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY step_id DESC) AS b FROM run_steps WHERE action_name = 'search_repo') WHERE b <= 5),
         k AS (SELECT DISTINCT trajectory_id FROM run_steps)
    SELECT k.trajectory_id, sha256('Opened files:' || chr(10) || coalesce((SELECT string_agg(file_path, ', ' ORDER BY step_id) FROM f WHERE f.trajectory_id = k.trajectory_id), '') || chr(10) || 'Searched queries:' || chr(10)
        || coalesce((SELECT string_agg(content, ', ' ORDER BY step_id) FROM q WHERE q.trajectory_id = k.trajectory_id), '') || chr(10) || 'Recent allowed observations:' || chr(10)
        || coalesce((SELECT string_agg(action_name || ': ' || content, chr(10) ORDER BY step_id) FROM s WHERE s.trajectory_id = k.trajectory_id AND back <= 8 AND action_name <> 'edit_file'), '')) AS prompt FROM k""")
def assemble_prompt(t):
    shown = S.recent_context(t("run_steps"), "trajectory_id", "step_id", "action_name", "file_path", "content")
    parts = (F.lit("Opened files:"), F.array_join("files", ", "), F.lit("Searched queries:"), F.array_join("queries", ", "), F.lit("Recent allowed observations:"), F.array_join("observations", "\n"))
    return shown.select("trajectory_id", F.sha2(X.redact(F.concat_ws("\n", *parts)), 256).alias("prompt"))


_COMMAND = "CASE step_id % 4 WHEN 0 THEN 'pytest Tests_Hidden' WHEN 1 THEN 'pytest tests' ELSE content END"
_PHASE = "CASE step_id % 3 WHEN 0 THEN 'Public' WHEN 1 THEN 'hidden_eval' ELSE '' END"


def _commands(t):
    k = F.col("step_id")
    command = F.when(k % 4 == 0, "pytest Tests_Hidden").when(k % 4 == 1, "pytest tests").otherwise(F.col("content"))
    return t("run_steps").withColumns({"command": command, "phase": F.when(k % 3 == 0, "Public").when(k % 3 == 1, "hidden_eval").otherwise("")})


@query(f"SELECT trajectory_id, step_id, NOT (contains(lower({_COMMAND}), 'tests_hidden') OR contains(lower({_PHASE}), 'hidden')) AND (contains(lower({_COMMAND}), 'test') OR contains(lower({_PHASE}), 'public')) AS public FROM run_steps")
def public_test(t):
    return _commands(t).select("trajectory_id", "step_id", P.is_public_test(F.col("command"), F.col("phase")).alias("public"))


@query(f"SELECT trajectory_id, step_id, contains(lower({_COMMAND}), 'hidden') OR contains(lower({_COMMAND}), 'metadata.json') OR contains(lower({_COMMAND}), 'gold.patch') OR file_path = 'gold.patch' AS forbidden FROM run_steps")
def forbidden_args(t):
    payload = F.to_json(F.struct("command", "file_path"))
    return _commands(t).select("trajectory_id", "step_id", P.is_forbidden(payload, F.col("command")).alias("forbidden"))


@query(f"""
    WITH x AS ({_RUN}), r AS (SELECT *, {_REASON} AS reason, {_FAILURE} AS failure, array_to_string({_LABELS}, ', ') AS labels FROM x)
    SELECT task_id, CASE WHEN task_id % 2 = 0 THEN coalesce(nullif(CASE WHEN task_id % 4 = 0 THEN reason END, ''), labels, '') WHEN failure = 'none' THEN 'public_passes' ELSE failure END AS signal FROM r""")
def failure_signal(t):
    k = F.col("task_id")
    runs = reason(rewards(t)).withColumn("given", F.when(k % 4 == 0, F.col("reason")))
    return runs.select("task_id", P.failure_signal(F.when(k % 2 == 0, "preference").otherwise("sft"), F.col("given"), labels(), F.col("failure")).alias("signal"))


@query(f"""
    WITH v AS (SELECT lower({_SNIP}) AS s FROM history)
    SELECT unnest(['basic_retrieval', 'exclude_task_id', 'exclude_family', 'exclude_patch_hash', 'no_full_diff', 'no_hidden_test', 'no_gold_patch']) AS name,
           unnest([true, true, true, true, bool_and(NOT contains(s, 'diff --git')), bool_and(NOT contains(s, 'hidden_test') AND NOT contains(s, 'tests_hidden')), bool_and(NOT contains(s, 'gold_patch'))]) AS passed FROM v""")
def retrieval_checks(t):
    """Self-checks of the index: something is found, what is excluded is not, and no snippet leaks."""
    asked, records = _asked(t), _records(t)
    modes = {"basic": (), "task_id": ("task_id",), "family": ("family",), "patch_hash": ("patch_hash",)}
    every = saved(T.retrieve_modes(asked, "query_id", "q", records, "experience_id", _history_fields(), 5, modes), "retrieved")
    found = lambda mode: every.filter(F.col("mode") == mode)
    checks = {"basic_retrieval": found("basic").agg((F.count("*") > 0).alias("passed"))}
    keys = ("task_id", "family", "patch_hash")
    own = every.filter("mode <> 'basic'").join(records.select("experience_id", *(F.col(c).alias(f"_r_{c}") for c in keys)), "experience_id").join(asked.select("query_id", *keys), "query_id")
    told = saved(own, "told")
    for c in keys:
        checks[f"exclude_{c}"] = told.filter(F.col("mode") == c).agg((F.count_if(F.col(f"_r_{c}") == F.col(c)) == 0).alias("passed"))
    low, clean = F.lower(_snippet()), {}
    for name, terms in (("no_full_diff", ("diff --git",)), ("no_hidden_test", ("hidden_test", "tests_hidden")), ("no_gold_patch", ("gold_patch",))):
        leak = F.lit(False)
        for x in terms:
            leak |= F.contains(low, F.lit(x))
        clean[name] = F.bool_and(~leak)
    snippets = saved(records.agg(*(c.alias(name) for name, c in clean.items())), "snippets")  # one pass for all three
    checks |= {name: snippets.select(F.col(name).alias("passed")) for name in clean}
    return V.check_report(checks).filter("name <> 'overall'")


@query("SELECT doc_id AS id FROM documents UNION SELECT page_id FROM pages")
def set_union(t):
    return t("documents").select(F.col("doc_id").alias("id")).union(t("pages").select("page_id")).distinct()


@query("SELECT doc_id, row_number() OVER (ORDER BY source, n_chars DESC, doc_id) - 1 AS place FROM documents")
def sorted_rows(t):
    """Every row with its place in an order of several keys."""
    return S.ranked(t("documents").select("doc_id", "source", "n_chars"), [F.col("source"), F.desc("n_chars"), F.col("doc_id")], "place").select("doc_id", "place")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def limit_ordered(t):
    """The first rows of a total order: the limit is the feature."""
    return t("documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)
