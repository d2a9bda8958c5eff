"""Queries over sources and sinks: each writes to the shared folder and scans it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import substring as B
from ..sources import files as S, report as P
from ..sources.store import scratch_path
from .base import query


@query("SELECT doc_id, lang, sha256(text) AS text FROM documents")
def src_json_lines(t):
    docs = t("documents").select("doc_id", "lang", "text")
    path = scratch_path(docs.sparkSession, "json-lines")
    S.write_json_lines(docs, path)
    return S.read_json_lines(docs.sparkSession, path, docs.schema).select("doc_id", "lang", F.sha2("text", 256).alias("text"))


@query("""
    SELECT 'array' AS kind, item_id, sha256(text) AS text FROM benchmark UNION ALL SELECT 'lines', item_id, sha256(text) FROM benchmark""")
def src_json_any(t):
    """The same records as one JSON array and as JSON lines, both found out by the reader."""
    items = t("benchmark").select("item_id", "text")
    spark, out = items.sparkSession, []
    for kind in ("array", "lines"):
        path = scratch_path(spark, f"json-{kind}")
        if kind == "array":
            S.write_json_document(items.agg(F.collect_list(F.struct("item_id", "text")).alias("items")), path, "items")  # a benchmark is small
        else:
            S.write_json_lines(items, path)
        out.append(S.read_json_any(spark, path, items.schema).select(F.lit(kind).alias("kind"), "item_id", F.sha2("text", 256).alias("text")))
    return out[0].union(out[1])


@query("SELECT item_id, sha256(text || chr(10)) AS content FROM benchmark")
def src_text_files(t):
    items = t("benchmark").select("text", "item_id")
    path = scratch_path(items.sparkSession, "text-files")
    items.repartition("item_id").write.partitionBy("item_id").text(path)
    found = S.read_text_files(items.sparkSession, path, "*.txt")
    return found.select(F.regexp_extract("path", r"item_id=(\d+)/", 1).cast("long").alias("item_id"), F.sha2("content", 256).alias("content"))


@query("SELECT 'src/lib' AS folder, sum(length(html) + 1)::BIGINT AS chars FROM pages WHERE page_id % 3 = 0")
def src_tree_scan(t):
    """All files below a folder that fit a glob; ignored folders are left out at any depth."""
    pages = t("pages")
    path = scratch_path(pages.sparkSession, "tree")
    for i, folder in enumerate(("src/lib", "node_modules/src", "src/__pycache__")):
        pages.filter(F.col("page_id") % 3 == i).select("html").write.text(f"{path}/{folder}")
    pages.limit(3).select("page_id").write.json(f"{path}/src/lib2")
    found = S.read_text_files(pages.sparkSession, path, "*.txt")
    return found.groupBy(F.regexp_extract("path", r"kilnwork-tree-[0-9a-f]+/(.*)/[^/]*$", 1).alias("folder")).agg(F.sum(F.length("content")).alias("chars"))


@query("SELECT (SELECT count(*) FROM benchmark) AS n, item_id, sha256(text) AS text FROM benchmark")
def src_json_document(t):
    """A document over several lines with nested records."""
    items = t("benchmark")
    path = scratch_path(items.sparkSession, "json-document")
    S.write_json_document(items.agg(F.count("*").alias("n"), F.collect_list(F.struct("item_id", "text")).alias("items")), path)
    doc = S.read_json_any(items.sparkSession, path, "n long, items array<struct<item_id: long, text: string>>")
    return doc.select("n", F.explode("items").alias("i")).select("n", "i.item_id", F.sha2("i.text", 256).alias("text"))


_LINE = """'{"doc_id":' || doc_id::VARCHAR || ',"lang":' || to_json(lang)::VARCHAR || ',"text":' || to_json(text)::VARCHAR || '}'"""


@query(f"SELECT sha256({_LINE}) AS line FROM documents")
def snk_json_sorted(t):
    docs = t("documents").select("text", "lang", "doc_id")
    path = scratch_path(docs.sparkSession, "json-sorted")
    S.write_json_lines(docs, path)
    return docs.sparkSession.read.text(path).select(F.sha2("value", 256).alias("line"))


@query("""SELECT '{"source":' || to_json(source)::VARCHAR || ',"doc_id":' || doc_id::VARCHAR || ',"absent":null}' AS line FROM documents""")
def snk_json_as_is(t):
    docs = t("documents").select("source", "doc_id", F.lit(None).cast("string").alias("absent"))
    path = scratch_path(docs.sparkSession, "json-as-is")
    S.write_json_lines(docs, path, sort_keys=False)
    return docs.sparkSession.read.text(path).select(F.col("value").alias("line"))


@query("SELECT count(*) AS tasks, count(DISTINCT source) AS sources, min(n_chars) AS least FROM documents")
def snk_manifest(t):
    """A summary of one row as a JSON document, read back."""
    row = t("documents").agg(F.count("*").alias("tasks"), F.count_distinct("source").alias("sources"), F.min("n_chars").alias("least"))
    path = scratch_path(row.sparkSession, "manifest")
    S.write_json_document(row, path)
    return S.read_json_any(row.sparkSession, path, row.schema)


@query("""
    SELECT '# Data' || chr(10) || chr(10) || '## labels' || chr(10) || chr(10) || '| metric | value |' || chr(10) || '| --- | --- |' || chr(10) || '| good | ' || (SELECT sum(quality) FROM labels)::VARCHAR || ' |' || chr(10)
        || '| n | ' || (SELECT count(*) FROM labels)::VARCHAR || ' |' || chr(10) || chr(10) || '## tasks' || chr(10) || chr(10) || '| metric | value |' || chr(10) || '| --- | --- |' || chr(10)
        || '| n | ' || (SELECT count(*) FROM documents)::VARCHAR || ' |' || chr(10) AS report""")
def snk_markdown(t):
    labels = t("labels").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))
    table = P.metrics("labels", labels).union(P.metrics("tasks", t("documents").agg(F.count("*").alias("n"))))
    return table.sparkSession.createDataFrame([(P.markdown("Data", table),)], "report string")


_DIGEST = """SELECT '{0}' AS name, sha256(string_agg(g || '=' || d, chr(10) ORDER BY g)) AS content FROM (
    SELECT substr(sha256(path), 1, 4) AS g, sha256(string_agg(path || '=' || d, chr(10) ORDER BY path)) AS d FROM (SELECT {1}::VARCHAR AS path, sha256({2}) AS d FROM {0}) GROUP BY ALL)"""
_PARTS = (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("labels", "doc_id", "coalesce(cast(quality AS VARCHAR), '') || '/' || coalesce(cast(toxic AS VARCHAR), '')"))


@query(f"WITH f AS ({' UNION ALL '.join(_DIGEST.format(*p) for p in _PARTS)}) SELECT sha256(string_agg(name || chr(0) || content || chr(0), '' ORDER BY name)) AS digest FROM f")
def package_digest(t):
    """A digest over the contents of a package's files in order of their names; each file's own is a
    tree of digests of its rows, so that no task holds a file."""
    label = F.concat(F.coalesce(F.col("quality").cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.col("toxic").cast("string"), F.lit("")))
    parts = []
    for name, key, content in (("documents", "doc_id", F.col("text")), ("pages", "page_id", F.col("html")), ("labels", "doc_id", label)):
        rows = t(name).select(F.col(key).cast("string").alias("path"), content.alias("content"))
        parts.append(P.tree_checksum(rows).select(F.lit(name).alias("name"), F.col("checksum").alias("content")))
    return S.package_digest(parts[0].union(parts[1]).union(parts[2]))


@query("""
    WITH l AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'exports' ELSE 'train_package' END AS folder, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT folder, item_id, count(*) AS n FROM l JOIN (SELECT item_id, substr(text, 1, 12) AS term FROM benchmark) b ON contains(line, term) GROUP BY ALL""")
def artifact_term_scan(t):
    """Lines of the text files below two folders that hold a forbidden term, counted by folder and
    term."""
    docs = t("documents")
    path = scratch_path(docs.sparkSession, "artifacts")
    for i, folder in enumerate(("exports", "train_package")):
        docs.filter(F.col("doc_id") % 2 == i).select("text").write.text(f"{path}/{folder}")
    lines = docs.sparkSession.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    named = lines.select(F.struct(F.regexp_extract("_metadata.file_path", "/([a-z_]+)/[^/]*$", 1).alias("folder")).alias("at"), "value")
    terms = t("benchmark").select("item_id", F.substring("text", 1, 12).alias("term"))
    found = B.contains_pairs(named, "at", "value", terms, "item_id", "term")
    return found.groupBy(F.col("at.folder").alias("folder"), "item_id").agg(F.count("*").alias("n"))
