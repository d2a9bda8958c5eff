"""Streaming queries, each run to the end of its input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.store import scratch_path
from ..streaming import stateful as K, streams as S
from . import table_queries  # noqa: F401  (their SQL)
from .base import ENTITIES, QUERIES, SQL, entity


def stream_query(sql: str | None = None):
    """Register a stream; ``sql`` is the DuckDB equivalent of what it has given by its end."""

    def add(make):
        QUERIES[make.__name__] = make
        if sql:
            SQL[make.__name__] = sql.strip()
        return make

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.event_stream(spark, f"{sf_dir}/events.parquet")


@stream_query("""
    WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, n FROM w""")
def st_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows, those still open too: the last row of each over the micro-batches."""
    rows = S.upserted(S.windowed_counts(_events(spark, sf_dir), "ts", "event_type", "1 hour", "30 days"), "windows", "update")
    last = rows.groupBy("start", "event_type").agg(F.max_by("n", "epoch").alias("n"))
    return last.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@stream_query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
         s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k
    HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def st_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that have closed; those that may still go on are not emitted. The file source gives
    events in no order of time, so one batch holds the log and the watermark closes after it."""
    done = S.finished(S.sessions(_events(spark, sf_dir), "ts", "user_id", "1 hour", "1 hour"), "sessions")
    return done.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@stream_query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def st_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = S.finished(S.deduped(_events(spark, sf_dir), "ts", ["user_id", "event_type"], "60 days").select("user_id", "event_type"), "dedupe")
    return done.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@stream_query("SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def st_rollout_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.upserted(S.running_state(_events(spark, sf_dir), "user_id", "event_type"), "rollout-state", "update")
    return rows.groupBy("user_id").agg(F.max_by("events", "epoch").alias("events"), F.max_by("kinds", "epoch").alias("kinds"))


@stream_query("SELECT event_id, event_type, round_even(value, 4) AS value FROM events WHERE event_type <> 'error'")
def st_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).filter("event_type <> 'error'").select("event_id", "event_type", F.bround("value", 4).alias("value"))
    return S.upserted(rows, "export").drop("epoch")


def _folded(spark: SparkSession, sf_dir: str, kind, columns: tuple[str, ...], name: str) -> DataFrame:
    """The steps of all runs as a stream in two goes: the odd ones come first and wait, then the
    query starts again and the even ones come; each key's last row."""
    steps = entity(spark, sf_dir, ENTITIES["run_steps"])
    steps = steps.withColumns({"old": (F.col("step_id") % 3).cast("string"), "guarded": F.col("file_path").isin("src/f1.py", "src/f2.py", "src/f3.py").cast("string")})
    source, folder = scratch_path(spark, f"{name}-source"), scratch_path(spark, name)
    with K.state_store(spark):
        for odd in (1, 0):
            steps.filter(F.col("step_id") % 2 == odd).write.mode("append").parquet(source)
            rows = S.upserted(K.folded(spark.readStream.schema(steps.schema).parquet(source), kind, "trajectory_id", "step_id", columns), name, "update", folder)
    return rows.groupBy("trajectory_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("trajectory_id", "epoch"))), "epoch").alias("x")).select("trajectory_id", "x.*")


@stream_query(SQL["repair_guard"])
def st_repair_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair guard over micro-batches in any order, with a restart between."""
    return _folded(spark, sf_dir, K.RepairGuard, ("action_name", "file_path", "old"), "repair-guard").select("trajectory_id", "rejected", "repeated")


@stream_query(SQL["leakage_fold"])
def st_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _folded(spark, sf_dir, K.UnsurfacedAccess, ("action_name", "file_path", "guarded"), "leakage")
    return found.select("trajectory_id", (F.col("leaked") == 1).alias("leaked"))


@stream_query("""
    WITH e AS (SELECT *, event_id % 50 = 0 AS withheld, ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS newest FROM events),
         mark AS (SELECT max(ts) - INTERVAL 2 HOUR AS at FROM e WHERE NOT withheld AND NOT newest),
         w AS (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts - INTERVAL 30 MINUTE) + INTERVAL 30 MINUTE]) AS start, withheld OR newest AS second FROM e)
    SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM w, mark WHERE NOT second OR start + INTERVAL 1 HOUR > mark.at GROUP BY ALL""")
def st_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows over a JSON log that comes in two goes. The second one brings the last day, and
    events of all days that were withheld: those of windows that had closed by then are dropped."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    last = events.agg(F.max("ts")).first()[0]
    late = (F.col("event_id") % 50 == 0) | (F.col("ts") >= F.lit(last) - F.expr("INTERVAL 1 DAY"))
    source, folder = scratch_path(spark, "late-source"), scratch_path(spark, "late")
    for rows in (events.filter(~late), events.filter(late)):
        rows.write.mode("append").json(source)
        log = S.json_stream(spark, source, "event_id long, ts timestamp, event_type string").filter("bad is null")
        out = S.upserted(S.windowed_counts(log, "ts", "event_type", "1 hour", "2 hours", "30 minutes"), "late", "update", folder)
    counts = out.groupBy("start", "event_type").agg(F.max_by("n", "epoch").alias("n"))
    return counts.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
