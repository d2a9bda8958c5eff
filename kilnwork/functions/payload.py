"""Functions of JSON payloads: projections, sanitizing, actions, messages."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .text import EXPORT_TERMS, redact

# The actions an agent may take and what they need.
ACTIONS = ("repo_tree", "search_repo", "read_file", "edit_file", "run_test", "git_diff", "finish", "semantic_search_repo")
REQUIRED = {"search_repo": ("query",), "read_file": ("file_path",), "edit_file": ("file_path", "old_text", "new_text"), "run_test": ("command",)}
UNSAFE_KEYS = ("stdout", "stderr", "hidden_stdout", "hidden_stderr")


def key_subset(payload: Column, keys: Sequence[str]) -> Column:
    """The JSON object with only these keys, sorted; keys it lacks stay absent."""
    parsed = F.from_json(payload, "map<string,string>")
    return F.transform(F.array_sort(F.map_entries(F.map_filter(parsed, lambda k, v: k.isin(*keys)))), lambda e: F.concat_ws("=", e["key"], e["value"]))


def sanitizer(terms: Sequence[str] = EXPORT_TERMS, unsafe: Sequence[str] = UNSAFE_KEYS, mark: str = "[redacted]"):
    """A function column -> column that walks JSON of any depth: unsafe keys go, terms in strings
    are redacted, keys are sorted. Depth is unknown to a schema, so it runs as an Arrow function;
    text that is no JSON becomes null."""

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if k not in unsafe}
        if isinstance(x, list):
            return [clean(v) for v in x]
        if isinstance(x, str):
            for t in terms:
                x = x.replace(t, mark)
        return x

    def one(text):
        try:
            return None if text is None else json.dumps(clean(json.loads(text)), sort_keys=True, ensure_ascii=False)
        except ValueError:
            return None

    @F.arrow_udf(StringType())
    def walk(payloads: pa.Array) -> pa.Array:
        return pa.array([one(x) for x in payloads.to_pylist()], pa.string())

    return walk


def action_error(raw: Column) -> Column:
    """The kind of error in an action's JSON: invalid_json, missing_args, unknown_tool; else empty."""
    v = F.try_parse_json(raw)
    kind = F.schema_of_variant(v)
    name = F.try_variant_get(v, "$.action_name", "string")
    given = F.try_variant_get(v, "$.action_input", "map<string,variant>")
    lacks = F.lit(False)
    for action, args in REQUIRED.items():
        for a in args:
            lacks |= (name == action) & ~F.coalesce(F.array_contains(F.map_keys(given), a), F.lit(False))
    has_input = F.try_variant_get(v, "$.action_input", "variant").isNotNull()
    return (
        F.when(v.isNull() | ~kind.startswith("OBJECT"), "invalid_json")
        .when(F.coalesce(name, F.lit("")) == "", "missing_args")
        .when(~name.isin(*ACTIONS), "unknown_tool")
        .when(has_input & given.isNull(), "missing_args")
        .when(lacks, "missing_args")
        .otherwise("")
    )


def render_chat(messages: Column) -> Column:
    """Messages (role, content) as one text with role and end marks."""
    told = F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"]))
    return F.concat(F.array_join(told, "\n"), F.lit("\n<|end|>"))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def safe_snippet(issue: Column, failure: Column, patch: Column, strategy: Column, files: Column, most: int = 600) -> Column:
    """Labelled, capped parts joined by `` | `` and capped again; empty parts are left out."""
    part = lambda label, text, n: F.when(F.length(text) > 0, F.concat(F.lit(f"{label}: "), F.substring(text, 1, n) if n else text))
    whole = F.concat_ws(" | ", part("Issue", issue, 200), part("Failure", failure, 150), part("Fix", patch, 150), part("Strategy", strategy, 100), part("Files", F.array_join(F.slice(files, 1, 5), ", "), 0))
    return F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most - 3), F.lit("..."))).otherwise(whole)


def is_public_test(command: Column, phase: Column) -> Column:
    """Whether a test run is a public one: nothing hidden in it, and a test or the public phase."""
    low = [F.lower(F.coalesce(c.cast("string"), F.lit(""))) for c in (command, phase)]
    hidden = F.contains(low[0], F.lit("tests_hidden")) | F.contains(low[1], F.lit("hidden"))
    return ~hidden & (F.contains(low[0], F.lit("test")) | F.contains(low[1], F.lit("public")))


def is_forbidden(payload: Column, command: Column, terms: Sequence[str] = EXPORT_TERMS) -> Column:
    """Whether an action's arguments name evaluator files or its command runs hidden tests."""
    low = F.lower(F.coalesce(payload, F.lit("")))
    out = F.contains(F.lower(F.coalesce(command, F.lit(""))), F.lit("hidden"))
    for t in terms:
        out |= F.contains(low, F.lit(t))
    return out


def failure_signal(kind: Column, reason: Column, labels: Column, failure: Column) -> Column:
    """Of a preference record its reason, else its labels; of others the class of failure, if any."""
    told = F.coalesce(F.nullif(reason, F.lit("")), F.array_join(labels, ", "), F.lit(""))
    other = F.when(F.coalesce(failure, F.lit("")).isin("", "none"), "public_passes").otherwise(failure)
    return F.when(kind == "preference", told).otherwise(other)


def gold_side(task_id: Column, patch: Column) -> Column:
    """The chosen side made of a task's reference patch: a success by definition."""
    reward = F.struct(F.lit(True).alias("public_pass"), F.lit(True).alias("hidden_pass"), F.lit(False).alias("leakage_detected"), F.lit(False).alias("syntax_error"), F.lit(1.0).alias("total_reward"))
    return F.struct(F.concat(task_id.cast("string"), F.lit("_gold_reference")).alias("trajectory_id"), redact(patch).alias("final_patch"), reward.alias("reward"))


def rejected_reward(reason: Column) -> Column:
    """The reward of a rejected side that has none of its own."""
    failure = F.when(reason == "no_patch", "public_fail").otherwise("hidden_unknown")
    return F.struct(F.lit(False).alias("public_pass"), F.lit(False).alias("hidden_pass"), failure.alias("failure"), F.coalesce(reason == "syntax_error", F.lit(False)).alias("syntax_error"), F.lit(0.0).alias("total_reward"))
