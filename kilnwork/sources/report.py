"""Reports: small tables of metrics as Markdown, rendered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MOST_ROWS = 1000


def metrics(section: str, row: DataFrame) -> DataFrame:
    """section, key, value of a one-row table."""
    named = row.select(*(F.col(c).cast("string").alias(c) for c in row.columns))
    return named.unpivot([], row.columns, "key", "value").select(F.lit(section).alias("section"), "key", "value")


def markdown(title: str, table: DataFrame) -> str:
    """A long table of metrics (section, key, value) as Markdown; more than MOST_ROWS is an error,
    as a report is no place for data."""
    rows = table.orderBy("section", "key").limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report of over {MOST_ROWS} rows")
    out, section = [f"# {title}"], None
    for r in rows:
        if r.section != section:
            section = r.section
            out += ["", f"## {section}", "", "| metric | value |", "| --- | --- |"]
        out.append(f"| {r.key} | {'' if r.value is None else str(r.value).replace('|', chr(92) + '|')} |")
    return "\n".join(out) + "\n"


def tree_checksum(files: DataFrame, path: str = "path", content: str = "content", digits: int = 4) -> DataFrame:
    """One row: SHA-256 over a tree of digests. Files are dealt by the first hex ``digits`` of their
    path's SHA-256; each group has the digest of its ordered ``path=digest`` lines, and the checksum
    is that of the ordered ``group=digest`` lines, at most 16 ** digits of them."""
    def over(name, digest):
        listed = F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(digest).alias("d"))))
        return F.sha2(F.array_join(F.transform(listed, lambda x: F.concat_ws("=", x["n"], x["d"])), "\n"), 256)

    each = files.select(path, F.sha2(content, 256).alias("_d"), F.substring(F.sha2(F.col(path), 256), 1, digits).alias("_g"))
    groups = each.groupBy("_g").agg(over(path, "_d").alias("_d"))
    return groups.agg(over("_g", "_d").alias("checksum"))
