"""Reward, failure class, risk, and reasons as ordered conditions over reward columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .diff import any_of


def yes(flag: Column) -> Column:
    """A missing flag is false."""
    return F.coalesce(flag.cast("boolean"), F.lit(False))


def failure_class(public_pass: Column, hidden_exit: Column, hidden_text: Column, status: Column | None = None) -> Column:
    """Class of the hidden run's failure, the first that applies; ``none`` without a hidden run."""
    low = F.lower(hidden_text)
    timed_out = (hidden_exit == 124) | any_of(("timeout", "timed out"), low)
    if status is not None:
        timed_out |= F.coalesce(F.lower(status) == "timeout", F.lit(False))
    return (
        F.when(~yes(public_pass), "public_fail")
        .when(hidden_exit.isNull() | (hidden_exit == 0), "none")
        .when(timed_out, "hidden_timeout")
        .when(any_of(("SyntaxError", "IndentationError", "ImportError", "ModuleNotFoundError"), hidden_text), "hidden_import_or_syntax")
        .when(any_of(("AssertionError", "assert "), hidden_text) | F.contains(low, F.lit("failed")), "hidden_assertion_fail")
        .when(any_of(("Traceback", "Exception", "Error:"), hidden_text), "hidden_exception")
        .otherwise("hidden_unknown")
    )


def risk(pass_then_fail: Column, test_modified: Column, hardcoded: Column) -> Column:
    return F.when(yes(hardcoded) | yes(test_modified), "high").when(yes(pass_then_fail), "medium").otherwise("low")


def too_narrow(pass_then_fail: Column, n_lines: Column) -> Column:
    return yes(pass_then_fail) & (n_lines <= 2)


def total_reward(public_pass, hidden_pass, n_files, n_lines, test_modified, hardcoded, regression, unrelated, invalid) -> Column:
    """Weighted sum, half-even at four digits. An empty diff still earns both size bonuses."""
    part = lambda flag, value: F.when(yes(flag), value).otherwise(0.0)
    total = (
        part(public_pass, 0.4) + part(hidden_pass, 0.6) + F.when(n_files <= 2, 0.1).otherwise(-0.1) + F.when(n_lines <= 30, 0.1).otherwise(-0.1)
        + part(test_modified, -0.3) + part(hardcoded, -0.25) + part(regression, -0.3) + part(unrelated, -0.2) - 0.1 * F.coalesce(invalid, F.lit(0))
    )
    return F.bround(total, 4)


def process_score(file_hit, function_hit, patch_size, no_deletion, no_hardcode) -> Column:
    pick = lambda flag, good, bad: F.when(yes(flag), good).otherwise(bad)
    total = pick(file_hit, 0.2, 0.0) + pick(function_hit, 0.2, 0.0) + F.when(F.coalesce(patch_size, F.lit(10_000)) <= 40, 0.2).otherwise(-0.1)
    return F.bround(total + pick(no_deletion, 0.2, -0.3) + pick(no_hardcode, 0.2, -0.3), 4)


def outcome_score(public_pass, hidden_pass, regression) -> Column:
    part = lambda flag, value: F.when(yes(flag), value).otherwise(0.0)
    return F.bround(part(public_pass, 0.4) + part(hidden_pass, 0.6) + part(regression, -0.3), 4)


def is_success(public_pass, hidden_pass, leaked, syntax_error) -> Column:
    return yes(public_pass) & yes(hidden_pass) & ~yes(leaked) & ~yes(syntax_error)


def is_rejected(public_pass, hidden_pass, pass_then_fail, leaked, syntax_error, invalid) -> Column:
    return ~yes(leaked) & (yes(pass_then_fail) | ~yes(public_pass) | ~yes(hidden_pass) | yes(syntax_error) | (F.coalesce(invalid, F.lit(0)) > 0))


def rejection_reason(c: dict[str, Column]) -> Column:
    """Why a run is no good, by fixed precedence; null if nothing speaks against it.

    ``c``: syntax_error, invalid, pass_then_fail, failure, patch, incomplete, risk, hidden_pass,
    public_pass, gold_patched, off_gold.
    """
    return (
        F.when(yes(c["syntax_error"]), "syntax_error")
        .when(F.coalesce(c["invalid"], F.lit(0)) > 0, "invalid_action")
        .when(yes(c["pass_then_fail"]) & (c["failure"] == "hidden_assertion_fail"), "public_pass_hidden_assertion_fail")
        .when(yes(c["pass_then_fail"]), "generalization_risk")
        .when(F.trim(F.coalesce(c["patch"], F.lit(""))) == "", "no_patch")
        .when(yes(c["incomplete"]), "incomplete_stop")
        .when(c["risk"].isin("medium", "high") & ~yes(c["hidden_pass"]), "generalization_risk")
        .when(~yes(c["public_pass"]), "public_fail")
        .when(~yes(c["gold_patched"]) & yes(c["off_gold"]), "wrong_file")
        .when(~yes(c["hidden_pass"]), "generalization_risk")
    )


def reason_labels(pass_then_fail, failure, risk_level, invalid, syntax_error, leaked) -> Column:
    """All labels that apply, sorted and distinct."""
    labels = [
        F.when(yes(pass_then_fail), F.lit("public_pass_hidden_fail")),
        F.when(F.coalesce(failure, F.lit("none")) != "none", failure),
        F.when(F.coalesce(risk_level, F.lit("low")) != "low", F.concat(risk_level, F.lit("_generalization_risk"))),
        F.when(F.coalesce(invalid, F.lit(0)) > 0, F.lit("invalid_action")),
        F.when(yes(syntax_error), F.lit("syntax_error")),
        F.when(yes(leaked), F.lit("leakage_detected")),
    ]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))
