"""Scalar text functions on Spark columns: tokens, hashes, truncation, scans, log compaction."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Fixed values that results depend on.
ISSUE_STOP = ("should", "with", "from", "this", "that", "currently", "when", "file", "files")
TOKEN_STOP = (
    "the", "and", "for", "with", "from", "this", "that", "are", "but", "can",
    "should", "currently", "when", "where", "file", "files", "value", "values",
    "running", "accepted", "output", "remain", "remains", "through",
)
TOKEN_BOOST = (
    "config", "yaml", "path", "cache", "csv", "cli", "parse", "parser", "amount", "discount", "region",
    "uppercase", "formatter", "calculator",
)
EXPORT_TERMS = ("tests_hidden", "metadata.json", "gold.patch")
LEAK_TERMS = ("diff --git", "gold.patch", "hidden_test", "tests_hidden", "oracle", "evaluator")
FAMILIES = (
    ("yaml", "config_parsing"), ("config", "config_parsing"), ("json", "data_parsing"), ("csv", "data_parsing"),
    ("parse", "parsing"), ("path", "path_handling"), ("import", "import_handling"), ("validate", "validation"),
    ("email", "validation"), ("sort", "sorting"), ("filter", "filtering"), ("empty", "edge_case_empty"),
    ("none", "edge_case_none"), ("null", "edge_case_null"), ("upper", "text_transform"), ("lower", "text_transform"),
    ("text", "text_transform"), ("crash", "error_handling"), ("error", "error_handling"), ("format", "formatting"),
    ("version", "version_handling"), ("missing", "missing_implementation"), ("helper", "helper_function"), ("nested", "nested_structure"),
)
FAMILY_LEVELS = ((20, "basic_repair"), (40, "intermediate_repair"), (60, "advanced_repair"))
FAILURE_LINE = r"(?i)(FAILED|Error|Traceback|AssertionError|assert\b|\bFAIL\b)"


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def bind(value: Column, use) -> Column:
    """``use(value)`` with value computed once, however often ``use`` needs it."""
    return F.transform(F.array(value), use)[0]


def identifier_tokens(text: Column) -> Column:
    """Identifiers in lower case, before each compound one its parts; all of two characters or more."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z_][a-zA-Z0-9_]*"), F.lit(0))
    parts = F.transform(
        found,
        lambda t: F.when(F.contains(t, F.lit("_")) & (F.length(t) > 3), F.concat(F.filter(F.split(t, "_"), lambda p: F.length(p) >= 2), F.array(t))).otherwise(F.array(t)),
    )
    return F.filter(F.flatten(parts), lambda t: F.length(t) >= 2)


def issue_query(text: Column) -> Column:
    """The first word of four letters or more that says something, else ``def``."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z_]{4,}"), F.lit(0))
    return F.coalesce(F.get(F.filter(found, lambda t: ~t.isin(*ISSUE_STOP)), F.lit(0)), F.lit("def"))


def keyword_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z_][a-zA-Z0-9_]{2,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*TOKEN_STOP))


def token_weight(token: Column) -> Column:
    return F.when(token.isin(*TOKEN_BOOST), 3).otherwise(1)


def redact(text: Column, terms: Sequence[str] = EXPORT_TERMS, mark: str = "[redacted]") -> Column:
    """Replace each term in turn, case-sensitively."""
    return reduce(lambda c, t: F.replace(c, F.lit(t), F.lit(mark)), terms, text)


def drop_if_forbidden(text: Column, terms: Sequence[str]) -> Column:
    """Null where the text has a term, whatever its case."""
    low = F.lower(text)
    return F.when(~reduce(lambda a, b: a | b, (F.contains(low, F.lit(t)) for t in terms)), text)


def content_hash(text: Column, digits: int = 16) -> Column:
    return F.when(F.length(text) > 0, F.substring(F.sha2(text, 256), 1, digits)).otherwise("")


def pattern_hash(text: Column, n_bytes: int = 200, digits: int = 16) -> Column:
    """Hash of the first bytes, so that one pattern with other details is one group."""
    head = F.substring(F.encode(text, "UTF-8"), 1, n_bytes)
    return F.when(F.length(text) > 0, F.substring(F.sha2(head, 256), 1, digits)).otherwise("")


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def truncate_middle(text: Column, most: int) -> Column:
    """Keep the first 60 % and the last 40 % of ``most`` characters around a marker."""
    head = int(most * 0.6)
    cut = F.concat(
        F.substring(text, 1, head), F.lit("\n...["), (F.length(text) - most).cast("string"), F.lit(" chars truncated]...\n"), F.expr("''") if most == head else F.right(text, F.lit(most - head))
    )
    return F.when(F.length(text) > most, cut).otherwise(text)


def tail_lines(text: Column, n: int) -> Column:
    return bind(lines(text), lambda a: F.array_join(F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, n), "\n"))


def line_range(text: Column, start: int, end: int) -> Column:
    """Lines ``start`` to ``end``, from 1, both included, as far as there are any."""
    first = max(1, start)
    return F.array_join(F.slice(lines(text), first, max(0, end - first + 1)), "\n")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def query_terms(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), r"\s+"), lambda t: t != "")


def terms_within(terms: Column, low: Column) -> Column:
    """Share of ``terms`` found anywhere in a text that is in lower case already."""
    return F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.greatest(F.lit(1), F.size(terms))


def term_overlap(query: Column, document: Column) -> Column:
    """Share of the query's words found anywhere in the document; a repeated word counts again."""
    return bind(F.lower(document), lambda low: bind(query_terms(query), lambda a: terms_within(a, low)))


def leaked_terms(text: Column, terms: Sequence[str] = LEAK_TERMS) -> Column:
    """Terms found with case and underscores ignored, sorted."""
    def found(flat):
        return F.array_sort(F.array_compact(F.array(*(F.when(F.contains(flat, F.lit(t.replace("_", ""))), F.lit(t)) for t in terms))))

    return bind(F.replace(F.lower(text), F.lit("_"), F.lit("")), found)


def count_before(text: Column, label: str) -> Column:
    """Sum of the numbers that stand before ``label``, as in ``3 passed``."""
    found = F.regexp_extract_all(text, F.lit(rf"(\d+)\s+{label}"), F.lit(1))
    return F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def loose_pass_count(text: Column) -> Column:
    """Every number between white space, if anything passed: the count older exports carry."""
    words = F.filter(F.split(text, r"\s+"), lambda t: t.rlike(r"^\d+$"))
    return F.when(F.contains(text, F.lit(" passed")), F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))).otherwise(F.lit(0).cast("long"))


def test_names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"def (test_\w+)"), F.lit(1))


def test_passed(output: Column, name: Column) -> Column:
    """What a run's output says of one test: named as passed or failed, else the run as a whole."""
    name = F.element_at(F.split(name, "::"), -1)
    return (
        F.when(F.contains(output, F.concat(name, F.lit(" PASSED"))), True)
        .when(F.contains(output, F.concat(name, F.lit(" FAILED"))), False)
        .otherwise(F.contains(output, F.lit(" passed")) & ~F.contains(output, F.lit(" failed")))
    )


def compact_log(text: Column, most: int = 30, keep: int = 8) -> Column:
    """A longer log is its head, the last failure lines of its middle, and its tail."""
    half = most // 2

    def shorten(a):
        failures = F.filter(F.slice(a, half + 1, F.size(a) - 2 * half), lambda x: x.rlike(FAILURE_LINE))
        last = bind(failures, lambda f: F.slice(f, F.greatest(F.size(f) - keep, F.lit(0)) + 1, keep))
        marked = bind(last, lambda f: F.when(F.size(f) > 0, F.concat(F.array(F.lit("... [failure signal preserved] ...")), f)).otherwise(F.array(F.lit("... [truncated] ..."))))
        return F.array_join(F.concat(F.slice(a, 1, half), marked, F.slice(a, F.size(a) - half + 1, half)), "\n")

    return bind(lines(text), lambda a: F.when(F.size(a) > most, shorten(a)).otherwise(F.array_join(a, "\n")))


def family(summary: Column, number: Column) -> Column:
    """The first keyword's family in their fixed order, else a level by the task's number."""
    low = F.lower(summary)
    out = F.when(F.contains(low, F.lit(FAMILIES[0][0])), FAMILIES[0][1])
    for word, name in FAMILIES[1:]:
        out = out.when(F.contains(low, F.lit(word)), name)
    out = out.when(number.isNull(), "unknown")
    for most, name in FAMILY_LEVELS:
        out = out.when(number <= most, name)
    return out.otherwise("complex_repair")


def issue_summary(text: Column) -> Column:
    """What follows the ``Issue:`` line, else the first title line, else the text."""
    after = F.element_at(F.split(text, "Issue:\n", 2), 2)
    title = F.get(F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: x.startswith("# ")), F.lit(0))
    return F.when(F.contains(text, F.lit("Issue:\n")), F.trim(after)).when(title.isNotNull(), F.trim(F.substring(title, 3, 1 << 30))).otherwise(F.trim(text))


def path_proximity(a: Column, b: Column) -> Column:
    """Common leading parts of two paths over the deeper one's depth."""
    def score(x, y):
        same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
        common = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
        return F.when(F.greatest(F.size(x), F.size(y)) == 0, 1.0).otherwise(common / F.greatest(F.size(x), F.size(y)))

    parts = lambda p: F.filter(F.split(p, "/"), lambda x: x != "")
    return bind(parts(a), lambda x: bind(parts(b), lambda y: score(x, y)))


def structural_score(kind: Column, docstring: Column, text: Column, prefer_functions: bool = True) -> Column:
    base = (
        F.when(kind == "function", 1.0 if prefer_functions else 0.8)
        .when(kind == "method", 0.9 if prefer_functions else 0.7)
        .when(kind == "class", 0.8)
        .when(kind == "module_docstring", 0.6)
        .otherwise(0.5)
    )
    base = F.when(F.length(docstring) > 0, F.least(F.lit(1.0), base + 0.1)).otherwise(base)
    return F.when(F.size(lines(text)).between(3, 30), F.least(F.lit(1.0), base + 0.1)).otherwise(base)


def normalise_path(path: Column) -> Column:
    """Parts joined again without empty ones, dots, and what a double dot takes back; null if the
    path leaves its root."""
    def step(s, p):
        up = F.when(F.size(s) > 0, F.slice(s, 1, F.size(s) - 1)).otherwise(F.lit(None).cast("array<string>"))
        return F.when(p == "..", up).when(p.isin("", "."), s).otherwise(F.concat(s, F.array(p)))

    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step, lambda s: F.array_join(s, "/"))
