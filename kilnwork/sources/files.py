"""Sources and sinks of records and files: JSON lines, JSON documents, text files, line search."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

# Folders that scans leave out.
IGNORED = (".git", ".venv", "__pycache__", ".pytest_cache", "node_modules")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: a small file of one row group is
    one task else. A table of more splits stays as it is, so nothing is shuffled at scale."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """Records of a JSON-lines path. ``strict``: a malformed line fails the job, else it is left
    out. A path without files gives no rows."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target):
        return spark.createDataFrame([], schema)
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json_any(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON array or document, or JSON lines: lines if the first one that is not blank is an
    object by itself."""
    line = spark.read.text(path).filter(F.trim("value") != "")
    first = line.select((F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull()).alias("whole")).first()
    return spark.read.schema(schema).option("multiLine", not (first is None or first.whole)).json(path)


def read_text_files(spark: SparkSession, path: str, glob: str = "*", ignored: Sequence[str] = IGNORED) -> DataFrame:
    """path and content of all files below ``path`` that fit ``glob`` and lie in no ignored folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return named.filter(~in_ignored(F.col("path"), ignored))


def merge_manifests(primary: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Rows of both by ``key``; where both have one, the primary one stays, and of several from one
    side the first by its values."""
    both = primary.withColumn("_from", F.lit(0)).unionByName(found.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(key).orderBy("_from", *(c for c in both.columns if c not in (key, "_from"))))
    return both.withColumn("_n", first).filter("_n = 1").drop("_n", "_from")


def in_ignored(path: Column, ignored: Sequence[str] = IGNORED) -> Column:
    """Whether a part of the path is an ignored folder."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ignored)))


def fits_glob(path: Column, glob: str) -> Column:
    """Whether the whole path fits a pattern of ``*``, ``?`` and ``[...]``."""
    return path.rlike("^" + fnmatch.translate(glob).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + "$")


def grep(files: DataFrame, key: str, text: str, term: str, regex: bool = False, prefix: str = "", glob: str = "", max_matches: int | None = None) -> DataFrame:
    """key, n (line number from 1) and line of every line with the term. With a ``prefix`` or
    ``glob`` the key is a path, and only files that fit and lie in no ignored folder are read;
    ``max_matches`` are the first ones in order of key and line."""
    if prefix or glob:
        files = files.filter(F.col(key).startswith(prefix) & ~in_ignored(F.col(key)))
        files = files.filter(fits_glob(F.col(key), glob)) if glob else files
    rows = files.select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "line"))
    found = rows.filter(F.col("line").rlike(term) if regex else F.contains("line", F.lit(term))).withColumn("n", F.col("n") + 1)
    return found if max_matches is None else found.orderBy(key, "n").limit(max_matches)


def write_json_lines(df: DataFrame, path: str, sort_keys: bool = True, files: int | None = None) -> None:
    """JSON lines, keys in order of their names or of the columns; ``files``: how many, else one a
    partition."""
    out = df.select(*sorted(df.columns)) if sort_keys else df
    (out.coalesce(files) if files else out).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json_document(row: DataFrame, path: str, column: str | None = None) -> None:
    """A one-row table as a JSON document over several lines, or only its ``column``. It is one
    value in one task: for manifests and small lists."""
    value = F.col(column) if column else F.struct(*sorted(row.columns))
    row.select(F.to_json(value, {"pretty": "true", "ignoreNullFields": "false"})).coalesce(1).write.mode("overwrite").text(path)


def table_digest(df: DataFrame) -> DataFrame:
    """One row: number of rows and an order-free digest of their values."""
    h = F.xxhash64(*sorted(df.columns))
    return df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("digest"))


def package_digest(parts: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """SHA-256 over the names and contents of a few files in order of their names: one row."""
    ordered = F.array_sort(F.collect_list(F.struct(name, content)))
    joined = F.array_join(F.transform(ordered, lambda x: F.concat(x[name], F.lit("\0"), x[content], F.lit("\0"))), "")
    return parts.agg(F.sha2(joined, 256).alias("digest"))
