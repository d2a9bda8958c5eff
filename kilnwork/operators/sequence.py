"""Operators over ordered rows of a key: last and first rows, islands, folds, budgets, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.store import saved

# What a context keeps first, and its size.
PRIORITY = {"issue": 10, "system": 9, "test_summary": 8, "repo_map": 7, "retrieved_file": 5, "history_rag": 4, "tool_trace": 3}
AVAILABLE_TOKENS = 8000 - 400 - 1200


def last_row(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The columns of each key's last row: an aggregate, no sort of the groups."""
    return df.groupBy(key).agg(F.max_by(F.struct(order, *columns), order).alias("_l")).select(key, "_l.*")


def last_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def keep_first(df: DataFrame, key: list[Column], order: list[str], columns: list[str]) -> DataFrame:
    """Of rows with equal key, the first in ``order``, and how many there were; by an aggregate,
    so that a key of many copies is combined before it is shuffled."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(key)]
    row = F.min(F.struct(*order, *[c for c in columns if c not in order]))
    return df.groupBy(*named).agg(row.alias("_f"), F.count("*").alias("copies")).select(*[F.col(f"_f.{c}") for c in columns], "copies")


def islands(df: DataFrame, key: str, order: str, gap: int, width: int | None = None) -> DataFrame:
    """key, first, last, n: runs of rows whose steps are at most ``gap`` apart.

    Rows of a key are dealt over ranges of ``width`` and runs are found in each; only the first and
    last run of a range can go on in another one, and only these are then ordered by key, so a key
    with many rows is no single task.
    """
    def runs(rows: DataFrame, parts: list[str], first: str, last: str, n) -> DataFrame:
        w = Window.partitionBy(*parts).orderBy(first)
        new = F.coalesce((F.col(first) - F.lag(last).over(w) > gap).cast("int"), F.lit(0))
        numbered = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy(*parts, "_run").agg(F.min(first).alias("first"), F.max(last).alias("last"), n.alias("n"))

    dealt = df.select(key, order, F.floor(F.col(order) / (width or 1000 * gap)).alias("_b"))
    inside = runs(dealt, [key, "_b"], order, order, F.count("*"))
    last_run = F.max("_run").over(Window.partitionBy(key, "_b"))
    inside = inside.withColumn("_edge", (F.col("_run") == 0) | (F.col("_run") == last_run)).drop("_run")
    joined = runs(inside.filter("_edge"), [key], "first", "last", F.sum("n"))
    return inside.filter("not _edge").select(key, "first", "last", "n").union(joined.select(key, "first", "last", "n"))


def pack_budget(items: DataFrame, pack: str, item: str, role: Column, tokens: str, available: int = AVAILABLE_TOKENS) -> DataFrame:
    """Adds used and kept to each item: greedy by priority, then fewer tokens, then the id; one
    that does not fit is left out and later ones may still fit. A pack's items are folded in
    order; packs are small (a context), and a fold is not a running sum."""
    weight = F.lit(0)
    for name, p in PRIORITY.items():
        weight = F.when(role == name, p).otherwise(weight)
    listed = F.array_sort(F.collect_list(F.struct((-weight).alias("p"), F.col(tokens).cast("long").alias("t"), F.col(item).alias("i"))))

    def step(state, x):
        fits = state["used"] + x["t"] <= available
        used = state["used"] + F.when(fits, x["t"]).otherwise(F.lit(0).cast("long"))
        return F.struct(used.alias("used"), F.concat(state["rows"], F.array(F.struct(x["i"].alias("i"), fits.alias("kept"), used.alias("used")))).alias("rows"))

    kind = dict(items.dtypes)[item]
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<i:{kind},kept:boolean,used:bigint>>").alias("rows"))
    folded = items.groupBy(pack).agg(listed.alias("_l")).select(pack, F.explode(F.aggregate("_l", start, step, lambda s: s["rows"])).alias("_r"))
    return folded.select(pack, F.col("_r.i").alias(item), F.col("_r.kept").alias("kept"), F.col("_r.used").alias("used"))


def unsurfaced_access(steps: DataFrame, key: str, order: str, action: str, path: str, gold: Column) -> DataFrame:
    """key, leaked: whether a gold file was read or edited before anything had shown it. A file is
    shown by any earlier step that names it, so the first step to name it decides: leaked if that
    one reads or edits. Sets of steps replace the ordered state."""
    firsts = steps.filter(gold).groupBy(key, path).agg(F.min_by(action, order).alias("_a"))
    leaks = firsts.groupBy(key).agg(F.bool_or(F.col("_a").isin("read_file", "edit_file")).alias("_l"))
    return steps.select(key).distinct().join(leaks, key, "left").select(key, F.coalesce("_l", F.lit(False)).alias("leaked"))


def repair_guard(steps: DataFrame, key: str, order: str, action: str, path: str, old: str) -> DataFrame:
    """key, rejected, repeated: edits that break the read-edit-check rules, by a fold over a
    trajectory's steps (bounded by the steps of one run).

    An edit needs its file opened before; the same edit twice is rejected; after an accepted edit,
    another one needs a run, a read or a diff between.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(action).alias("a"), F.col(path).alias("p"), F.col(old).alias("t"))))
    texts = F.array().cast("array<string>")
    start = F.struct(texts.alias("opened"), texts.alias("seen"), F.lit(False).alias("must_check"), F.lit(0).alias("rejected"), F.lit(0).alias("repeated"))

    def step(s, x):
        edit, name = x["a"] == "edit_file", F.concat_ws("\x1f", x["p"], x["t"])
        closed = edit & ~F.array_contains(s["opened"], x["p"])
        again = edit & ~closed & F.array_contains(s["seen"], name)
        unchecked = edit & ~closed & ~again & s["must_check"]
        fine = edit & ~closed & ~again & ~unchecked
        checks = x["a"].isin("run_test", "read_file", "git_diff")
        return F.struct(
            F.when(x["a"] == "read_file", F.array_union(s["opened"], F.array(x["p"]))).otherwise(s["opened"]).alias("opened"),
            F.when(fine, F.array_union(s["seen"], F.array(name))).otherwise(s["seen"]).alias("seen"),
            F.when(fine, True).when(checks, False).otherwise(s["must_check"]).alias("must_check"),
            (s["rejected"] + (closed | unchecked).cast("int")).alias("rejected"),
            (s["repeated"] + again.cast("int")).alias("repeated"),
        )

    folded = steps.groupBy(key).agg(F.aggregate(listed, start, step).alias("_s"))
    return folded.select(key, "_s.rejected", "_s.repeated")


def explored(steps: DataFrame, key: str, order: str, path: str) -> DataFrame:
    """key, files: the files of a run in order of their first step."""
    firsts = steps.groupBy(key, path).agg(F.min(order).alias("_o"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_o", path))), lambda x: x[path])
    return firsts.groupBy(key).agg(listed.alias("files"))


# What a prompt shows of a run.
SHOWN = ("repo_tree", "search_repo", "read_file", "run_test", "git_diff", "invalid_action")


def recent_context(steps: DataFrame, key: str, order: str, action: str, path: str, content: str, observations: int = 8, names: int = 5) -> DataFrame:
    """key and what a prompt shows of its run: the last ``names`` files read and queries asked, and
    those of the last ``observations`` steps that may be shown. A run's steps are bounded."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(action).alias("a"), F.col(path).alias("p"), F.col(content).alias("c"))))
    last = lambda a, n: F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, n)
    of = lambda name, field: F.transform(F.filter("_l", lambda x: x["a"] == name), lambda x: x[field])
    seen = F.filter(last(F.col("_l"), observations), lambda x: x["a"].isin(*SHOWN))
    grouped = steps.groupBy(key).agg(listed.alias("_l"))
    return grouped.select(key, last(of("read_file", "p"), names).alias("files"), last(of("search_repo", "c"), names).alias("queries"), F.transform(seen, lambda x: F.concat_ws(": ", x["a"], x["c"])).alias("observations"))


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the row's number from 0 in the order of several keys: rows are dealt by ranges, numbered
    within their partition and shifted by the sizes of those before, so no task holds them all."""
    placed = df.orderBy(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"))
    placed = saved(placed, "ranked")
    sizes = {r["_p"]: r["count"] for r in placed.groupBy("_p").count().collect()}  # one a partition
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    table = df.sparkSession.createDataFrame(before or [(0, 0)], "_p int, _before long")
    return placed.join(F.broadcast(table), "_p").withColumn(name, F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")
