"""The registry of queries, and the reference entities built from the driver tables.

The tables stand in for the entities: documents and labels for tasks with their runs' rewards and
patches, conversations for trajectories, events for logs, pages for files.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

Tables = Callable[[str], DataFrame]


#: Tables of texts, on which a row is much work.
TEXTS = ("documents", "pages", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def entity(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A DataFrame from SQL whose {names} are driver tables."""
    names = {n for _, n, _, _ in string.Formatter().parse(text) if n}
    return spark.sql(text, **{n: read(spark, sf_dir, n) for n in names})


def plain(text: str) -> str:
    """The same SQL with the tables' own names."""
    return text.format_map({n: n for _, n, _, _ in string.Formatter().parse(text) if n})


def query(sql: str | None = None, **named: str):
    """Register a query. It takes one function: the name of an entity or a table gives its
    DataFrame. ``sql`` is the DuckDB equivalent; an entity it names becomes a WITH table."""

    def add(make: Callable[[Tables], DataFrame]):
        name = make.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(lambda t: entity(spark, sf_dir, ENTITIES[t]) if t in ENTITIES else read(spark, sf_dir, t))

        QUERIES[name] = run
        if sql is not None:
            used = [e for e in ENTITIES if e in sql]
            head = ", ".join(f"{e} AS ({plain(ENTITIES[e])})" for e in used)
            body = sql.strip()
            if head and body[:4].upper() == "WITH":
                rest = body[4:].lstrip()
                recursive = rest[:9].upper() == "RECURSIVE"
                body = f"WITH {'RECURSIVE ' if recursive else ''}{head}, {rest[9:] if recursive else rest}"
            elif head:
                body = f"WITH {head} {body}"
            SQL[name] = body
        return make

    return add


_DIFF = """'diff --git a/src/' || d.source || '.py b/src/' || d.source || '.py' || chr(10) || '--- a/src/' || d.source || '.py' || chr(10)
    || '+++ b/src/' || d.source || '.py' || chr(10) || '-old line' || chr(10) || '+' || replace(d.text, chr(10), chr(10) || '+')
    || CASE WHEN d.doc_id % 4 = 0 THEN chr(10) || 'diff --git a/tests/test_x.py b/tests/test_x.py' || chr(10) || '+    assert value == 42' ELSE '' END
    || CASE WHEN d.doc_id % 6 = 0 THEN chr(10) || '+    if name == test_case:' || chr(10) || '+        x = 1' ELSE '' END
    || CASE WHEN d.doc_id % 7 = 0 THEN chr(10) || '+    return "expected"' ELSE '' END
    || CASE WHEN d.doc_id % 9 = 0 THEN chr(10) || 'diff --git a/src/other.py b/src/other.py' || chr(10) || '+++ b/src/other.py' || chr(10) || '+done' ELSE '' END"""

#: Entities as SQL that Spark and DuckDB both read.
ENTITIES = {
    "run_rewards": f"""
        SELECT d.doc_id AS task_id, d.source AS policy, d.lang AS lang, l.quality IS NOT NULL AS has_run,
               coalesce(l.quality = 1, false) AS public_pass, coalesce(l.quality = 1, false) AND d.doc_id % 3 <> 0 AS hidden_pass,
               coalesce(l.quality = 1, false) AND d.doc_id % 3 = 0 AS pass_then_fail,
               coalesce(l.toxic = 1, false) AS leaked, d.doc_id % 17 = 0 AS syntax_error,
               CASE WHEN d.doc_id % 5 = 0 THEN 1 ELSE 0 END AS invalid, d.doc_id % 13 = 0 AS incomplete,
               CASE WHEN d.doc_id % 3 <> 0 THEN 0 WHEN d.doc_id % 11 = 0 THEN 124 ELSE 1 END AS hidden_exit,
               CASE d.doc_id % 4 WHEN 0 THEN 'AssertionError: ' WHEN 1 THEN 'ImportError: ' WHEN 2 THEN 'Traceback ' ELSE 'lost ' END || d.text AS hidden_text,
               CASE WHEN d.doc_id % 10 = 7 THEN '' ELSE {_DIFF} END AS patch
        FROM {{documents}} d LEFT JOIN {{labels}} l ON d.doc_id = l.doc_id""",
    "run_steps": """
        SELECT conv_id AS trajectory_id, turn AS step_id, text AS content,
               CASE role WHEN 'user' THEN 'search_repo' WHEN 'assistant' THEN CASE WHEN turn % 4 = 1 THEN 'read_file' ELSE 'edit_file' END ELSE 'run_test' END AS action_name,
               'src/f' || cast(length(text) % 7 AS string) || '.py' AS file_path
        FROM {conversations}""",
    "history": """
        SELECT 'exp_' || cast(doc_id AS string) AS experience_id, doc_id AS task_id, source AS family,
               CASE WHEN doc_id % 5 = 4 THEN 'eval' ELSE 'train' END AS split, lang AS failure_signal, text AS issue
        FROM {documents}""",
}
