"""Structured Streaming over event logs: windows, sessions, dedupe, state, idempotent export.

Each stream runs over what is there (``availableNow``) into a Parquet folder that driver and
executors share, with its checkpoint beside it, and the sink is returned as a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..sources.store import scratch_path

def event_stream(spark: SparkSession, path: str, time: str = "ts") -> DataFrame:
    """The Parquet events of ``path`` as a stream, with a timestamp that watermarks accept."""
    schema = spark.read.parquet(path).schema
    # a pattern, as the source takes a plain path for a folder
    head, last = path[:-1], path[-1]
    return spark.readStream.schema(schema).parquet(f"{head}[{last}]").withColumn(time, F.col(time).cast("timestamp"))


def json_stream(spark: SparkSession, path: str, schema: StructType | str, files_a_batch: int | None = None) -> DataFrame:
    """The lines of a JSON log as a stream: the columns of ``schema``, and ``bad``, the line itself
    where it is no such record. Blank lines are left out."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    options = {"maxFilesPerTrigger": str(files_a_batch)} if files_a_batch else {}
    lines = spark.readStream.options(**options).text(path).filter(F.trim("value") != "")
    whole = StructType([*fields.fields, StructField("_bad", StringType())])
    record = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(record.alias("r")).select("r.*").withColumnRenamed("_bad", "bad")


def quarantined(stream: DataFrame, name: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run a ``json_stream`` to the end of its input: its records, and the bad lines kept apart. Each
    micro-batch has a folder of its own in both, and overwrites it if it runs again."""
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, name)
    kept = stream.drop("bad").schema

    def write(batch: DataFrame, epoch: int) -> None:
        batch.filter("bad is null").drop("bad").write.mode("overwrite").parquet(f"{folder}/records/batch-{epoch}")
        batch.filter("bad is not null").select("bad").write.mode("overwrite").parquet(f"{folder}/bad/batch-{epoch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    read = spark.read.option("recursiveFileLookup", "true")
    return read.schema(kept).parquet(f"{folder}/records"), read.schema("bad string").parquet(f"{folder}/bad")


def finished(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run the stream to the end of its input; the rows it emitted. With a ``folder`` of its own a
    stream goes on from where its last run there ended; else it is a fresh one."""
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, name)
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def upserted(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run the stream to the end of its input, each micro-batch into a folder of its epoch; all
    rows with their epoch. A batch that runs again after a failure has the same epoch and
    overwrites its folder, so no row is there twice. With a ``folder`` of its own a stream goes on
    from where its last run there ended, and the rows of all its runs are given."""
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, name)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/batch-{epoch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.option("recursiveFileLookup", "true").schema(StructType([*stream.schema.fields, StructField("epoch", LongType())])).parquet(f"{folder}/out")
    out._kilnwork_dropped = sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators)
    return out


def dropped_late(run: DataFrame) -> int:
    """How many rows of aggregates the run that gave this table dropped as too late."""
    return getattr(run, "_kilnwork_dropped", 0)


def windowed_counts(events: DataFrame, time: str, key: str, size: str, late: str, slide: str | None = None) -> DataFrame:
    """start, key, n by tumbling (or sliding) windows; windows close ``late`` after their end."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    counted = events.withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """key, start, end, n of sessions that end after a gap; open ones wait for later events."""
    found = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduped(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def running_state(events: DataFrame, key: str, kind: str) -> DataFrame:
    """key, events, kinds: counters of each key kept over micro-batches; the last row of a key is
    its state now."""

    def step(key_value: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, seen = state.get if state.exists else (0, "")
        kinds = set(filter(None, seen.split("\x1f")))
        for f in frames:
            n += len(f)
            kinds |= set(f[kind].dropna())
        state.update((n, "\x1f".join(sorted(kinds))))
        yield pd.DataFrame({key: [key_value[0]], "events": [n], "kinds": [len(kinds)]})

    return events.select(key, kind).groupBy(key).applyInPandasWithState(step, f"{key} long, events long, kinds long", "n long, seen string", "update", GroupStateTimeout.NoTimeout)
