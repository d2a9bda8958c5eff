"""Validation of task records and training packages: every problem as a message or a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.diff import any_of, changed_files
from ..functions.text import EXPORT_TERMS
from .checks import is_missing, row_errors

# What a task must have, and the levels it may name.
REQUIRED = (
    "task_id", "scenario", "bug_type", "difficulty", "repo_path", "issue_path", "gold_files", "gold_functions", "gold_patch",
    "public_test_cmd", "hidden_test_cmd", "forbidden_behaviors", "source", "split",
)


def task_errors(tasks: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Adds errors: missing fields, absent columns and empty lists among them, and a hidden command
    that the public one already runs."""
    rules: dict[str, Column] = {}
    kinds = dict(tasks.dtypes)
    for name in required:
        if name not in kinds:
            rules[f"missing field: {name}"] = F.lit(True)
        elif kinds[name].startswith("array"):
            rules[f"missing field: {name}"] = F.col(name).isNull() | (F.size(name) == 0)
        else:
            rules[f"missing field: {name}"] = is_missing(F.col(name))
    if {"public_test_cmd", "hidden_test_cmd"} <= set(kinds):
        rules["public and hidden commands are the same"] = F.coalesce((F.col("public_test_cmd") == F.col("hidden_test_cmd")) & ~is_missing(F.col("public_test_cmd")), F.lit(False))
    return tasks.withColumn("errors", row_errors(rules))


def package_violations(records: DataFrame, known: DataFrame, repo_files: DataFrame, terms=EXPORT_TERMS) -> DataFrame:
    """task_id, kind of every violation in packaged records (task_id, split, text, patch): a
    forbidden term, an unknown task, a task in both splits, an empty patch, a changed file that is
    not there. ``known``: task_id; ``repo_files``: file. Empty if the package passes."""
    def kind(df, name):
        return df.select("task_id", F.lit(name).alias("kind")).distinct()

    found = [
        kind(records.filter(any_of(terms, F.concat_ws("\n", "text", "patch"))), "forbidden_term"),
        kind(records.join(known.select("task_id"), "task_id", "left_anti"), "unknown_task"),
        kind(records.groupBy("task_id").agg(F.count_distinct("split").alias("n")).filter("n > 1"), "both_splits"),
        kind(records.filter(F.trim(F.coalesce("patch", F.lit(""))) == ""), "empty_patch"),
        kind(records.select("task_id", F.explode(changed_files(F.col("patch"))).alias("file")).join(repo_files.select("file").distinct(), "file", "left_anti"), "missing_file"),
    ]
    return reduce(DataFrame.union, found)


# Reasons that a preference record may give, and those whose rejected side may lack a patch.
REASONS = (
    "no_patch", "wrong_file", "syntax_error", "public_fail", "public_pass_hidden_assertion_fail", "generalization_risk",
    "invalid_action", "incomplete_stop", "unsafe_patch",
)
NO_PATCH_REASONS = ("no_patch", "public_pass_hidden_assertion_fail")
RAW_KEYS = ("stdout", "stderr")
UNDEFINED = "to_be_defined"
ISSUE_TERMS = ("tests_hidden", "metadata.json", "gold.patch", "apply_gold_patch")
BACKLOG = ("bug_type", "difficulty", "public_gap", "hidden_gap", "expected_failure_mode", "hard_pair_potential")


def bank_errors(records: DataFrame, known: DataFrame) -> DataFrame:
    """task_id and errors of each preference record (task_id, reason, chosen, rejected, weaker, told:
    the record as text). ``known``: task_id. A record without errors has an empty list."""
    tasks = known.select("task_id").distinct().withColumn("_known", F.lit(True))
    starts = lambda c: F.coalesce(F.col(c).startswith("diff --git"), F.lit(False))
    rules = {f"forbidden term present: {x}": F.contains("told", F.lit(x)) for x in EXPORT_TERMS}
    rules["raw test output key present"] = reduce(Column.__or__, (F.contains("told", F.lit(f'"{k}"')) for k in RAW_KEYS))
    rules |= {
        "unknown task": F.col("_known").isNull(),
        "unknown reason": ~F.coalesce(F.col("reason").isin(*REASONS), F.lit(False)),
        "chosen patch missing": ~starts("chosen"),
        "rejected patch missing": ~F.coalesce(F.col("reason").isin(*NO_PATCH_REASONS), F.lit(False)) & ~starts("rejected"),
        "not weaker than chosen": ~F.coalesce(F.col("weaker"), F.lit(False)),
    }
    return records.join(tasks, "task_id", "left").select("task_id", row_errors(rules).alias("errors"))


def loader_errors(records: DataFrame, kind: str) -> DataFrame:
    """Adds errors to packaged records of the kind ``sft`` (record_type, roles, public_pass,
    hidden_pass) or ``preference`` (record_type, reason_labels, chosen, rejected)."""
    rules: dict[str, Column] = {"record_type": ~F.coalesce(F.col("record_type") == f"{kind}_v1", F.lit(False))}
    if kind == "sft":
        rules["messages"] = ~F.coalesce(F.array_join("roles", ",") == "system,user,assistant", F.lit(False))
        rules["not successful"] = ~(F.coalesce("public_pass", F.lit(False)) & F.coalesce("hidden_pass", F.lit(False)))
    else:
        rules["reason_labels"] = F.coalesce(F.size("reason_labels"), F.lit(0)) <= 0
        rules["sides"] = F.col("chosen").isNull() | F.col("rejected").isNull()
    return records.withColumn("errors", row_errors(rules))


def loaded(records: DataFrame, kind: str) -> DataFrame:
    """The records; a job that reads one with errors fails."""
    checked = loader_errors(records, kind)
    message = F.concat(F.lit("invalid record: "), F.array_join("errors", ", "))
    return checked.filter(F.when(F.size("errors") == 0, True).otherwise(F.raise_error(message).cast("boolean"))).drop("errors")


def promotion_errors(tasks: DataFrame) -> DataFrame:
    """Adds errors: what keeps a planned task (task_id, folder, issue, public_test, hidden_test,
    source, gold, status, target_files, failure_mode, axis) from being ready."""
    has = lambda c, x: F.contains(F.coalesce(F.col(c), F.lit("")), F.lit(x))
    rules = {f"{c} still contains TODO": has(c, "TODO") for c in ("issue", "public_test", "hidden_test", "source", "gold")}
    rules |= {f"{c} still uses placeholder": has(c, "placeholder") for c in ("public_test", "hidden_test", "source")}
    rules |= {
        "gold is no diff": ~F.coalesce(F.col("gold").startswith("diff --git"), F.lit(False)),
        "status is planned": F.coalesce(F.col("status") == "planned_skeleton", F.lit(False)),
        "task_id is not the folder's": ~F.col("task_id").eqNullSafe(F.col("folder")),
        "no target files": F.coalesce(F.size("target_files"), F.lit(0)) <= 0,
    }
    rules |= {f"{c} is not defined": is_missing(F.col(c)) | (F.col(c) == UNDEFINED) for c in ("failure_mode", "axis")}
    rules |= {f"issue leaks: {x}": has("issue", x) for x in ISSUE_TERMS}
    return tasks.withColumn("errors", row_errors(rules))


def backlog_errors(rows: DataFrame) -> DataFrame:
    """Adds errors to backlog rows: missing fields, and a public gap that is the hidden one."""
    rules = {f"missing {c}": is_missing(F.col(c)) for c in BACKLOG}
    rules["public_gap equals hidden_gap"] = F.col("public_gap").eqNullSafe(F.col("hidden_gap"))
    return rows.withColumn("errors", row_errors(rules))
