"""Streaming: documents are independent, so redaction needs no state between batches."""

from __future__ import annotations

import heapq
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from redactlake.engine import Engine


def redact_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, engine: Engine | None = None, files_per_trigger: int = 16) -> StreamingQuery:
    """Redact Parquet documents as they arrive; results are Parquet, once each. Stops when all is read."""
    engine = engine or Engine()
    docs = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return engine.redact_with_review(docs).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, engine: Engine | None = None) -> StreamingQuery:
    """Events of each batch as JSON lines: queued, accepted, then done or error for each document."""
    engine = engine or Engine()
    docs = spark.readStream.schema("doc_id long, text string").parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        done = engine.redact_with_review(batch).select(
            F.to_json(F.struct(F.when(F.col("status") == 200, "done").otherwise("error").alias("event"), "doc_id", "status", "error", "review")).alias("value")
        )
        accepted = batch.select(F.inline(F.array(F.struct(F.lit("queued").alias("event"), "doc_id"), F.struct(F.lit("accepted").alias("event"), "doc_id"))))
        accepted.select(F.to_json(F.struct("event", "doc_id")).alias("value")).unionByName(done).write.mode("overwrite").text(f"{sink}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _greedy(seconds: float):
    """Arrow batches sorted by key, stage and time -> the same rows with ``sent``.

    A batch's last row waits for the next batch, as a stage's last event is always sent.
    """
    step = int(seconds * 1_000_000)

    def run(batches):
        last: tuple | None = None  # key and stage of the group at hand, and when it was last sent
        held: pa.RecordBatch | None = None
        held_sent = False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("key", "stage")), strict=True))
            sent = []
            for key, at in zip(keys, batch.column("ts").cast(pa.timestamp("us")).cast(pa.int64()).to_pylist(), strict=True):
                new = last is None or last[0] != key
                sent.append(new or at - last[1] >= step)
                if new and len(sent) > 1:
                    sent[-2] = True
                if new and len(sent) == 1:
                    held_sent = True
                if sent[-1]:
                    last = (key, at)
            if held is not None:
                yield held.append_column("sent", pa.array([held_sent]))
            yield batch.slice(0, batch.num_rows - 1).append_column("sent", pa.array(sent[:-1], pa.bool_()))
            held, held_sent = batch.slice(batch.num_rows - 1), sent[-1]
        if held is not None:
            yield held.append_column("sent", pa.array([True]))

    return run


def throttle(events: DataFrame, seconds: float = 0.25) -> DataFrame:
    """Progress events (key, stage, ts, seq) that are sent: spaced by ``seconds`` in a stage, and a stage's last always.

    Sorted within partitions by key and stage, and read once: no group is held in memory.
    """
    schema = T.StructType([*events.schema.fields, T.StructField("sent", T.BooleanType())])
    return events.repartition("key", "stage").sortWithinPartitions("key", "stage", "ts", "seq").mapInArrow(_greedy(seconds), schema)


def throttle_stream(events: DataFrame, seconds: float = 0.25) -> DataFrame:
    """The same over a stream of key, stage, ts (in order within a stage): the events that are sent, with the time of the last one as state.

    What is last in a stage isn't known before the stage's end, so the caller sends ``done`` events as a stage of their own.
    """

    def spaced(key, frames, state):
        last = state.get[0] if state.exists else None
        out = []
        for frame in frames:
            for ts in frame["ts"].sort_values():
                at = int(ts.value // 1000)
                if last is None or at - last >= int(seconds * 1_000_000):
                    last = at
                    out.append((*key, ts))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["key", "stage", "ts"])

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    output = f"key {kinds['key']}, stage {kinds['stage']}, ts timestamp"
    return events.groupBy("key", "stage").applyInPandasWithState(spaced, output, "last long", "append", "NoTimeout")


def keepalives(events: DataFrame, seconds: int = 10) -> DataFrame:
    """Silences of at least ``seconds`` in each key's events, and the keep-alive events they take."""
    w = Window.partitionBy("key").orderBy("ts", "seq")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(w)
    return events.withColumn("silence_us", gap).where(F.col("silence_us") >= seconds * 1_000_000).withColumn("keepalives", F.floor(F.col("silence_us") / (seconds * 1_000_000)).cast("long"))


def keepalive_stream(events: DataFrame, seconds: float = 10) -> DataFrame:
    """Keep-alive events over a stream of key and stage: one for each ``seconds`` of silence of a key, until its stage is done or error."""

    def watch(key, frames, state):
        sent = []
        if state.hasTimedOut:
            n = state.get[0] + 1
            state.update((n,))
            sent.append((*key, "keepalive", n))
        elif any(frame["stage"].isin(["done", "error"]).any() for frame in frames):
            state.remove()
        else:
            state.update((0,))
        if state.exists:
            state.setTimeoutDuration(int(seconds * 1000))
        yield pd.DataFrame(sent, columns=["key", "event", "n"])

    kind = events.schema["key"].dataType.simpleString()
    return events.groupBy("key").applyInPandasWithState(watch, f"key {kind}, event string, n int", "n int", "append", "ProcessingTimeTimeout")


def running(jobs: DataFrame) -> DataFrame:
    """How many jobs (key, start, end) run from each start on, by a sweep over starts and ends."""
    edges = jobs.select("key", F.col("start").alias("ts"), F.lit(1).alias("d")).unionByName(jobs.select("key", F.col("end").alias("ts"), F.lit(-1).alias("d")))
    by = edges.groupBy("key", "ts").agg(F.sum("d").alias("d"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("started"))
    w = Window.partitionBy("key").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return by.withColumn("running", F.sum("d").over(w)).where("started > 0").drop("d")


def progress(events: DataFrame) -> DataFrame:
    """Counters of each key's stages (key, stage, ts, seq): how many steps are done at each event, of how many in all."""
    w = Window.partitionBy("key", "stage")
    done = F.count(F.lit(1)).over(w.orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumns({"done": done, "total": F.count(F.lit(1)).over(w)})


def slots(jobs: DataFrame, n: int = 2) -> DataFrame:
    """When jobs (key, seq, arrival, micros) begin if ``n`` of a key run at a time, first come first served: began, queued.

    Sorted within partitions and read once; a key holds the ends of its n running jobs.
    """
    schema = T.StructType([*jobs.schema.fields, T.StructField("began", T.LongType()), T.StructField("queued", T.BooleanType())])

    def run(batches):
        group, ends = None, []
        for batch in batches:
            began = []
            arrivals = batch.column("arrival").to_pylist()
            for key, at, micros in zip(batch.column("key").to_pylist(), arrivals, batch.column("micros").to_pylist(), strict=True):
                if key != group:
                    group, ends = key, []
                start = at if len(ends) < n else max(at, heapq.heappop(ends))
                heapq.heappush(ends, start + micros)
                began.append(start)
            yield batch.append_column("began", pa.array(began, pa.int64())).append_column("queued", pa.array([b > a for a, b in zip(arrivals, began, strict=True)], pa.bool_()))

    return jobs.repartition("key").sortWithinPartitions("key", "arrival", "seq").mapInArrow(run, schema)


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Jobs that are started within can be stopped by cancel(spark, tag), from any thread."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop the jobs of a tag, between their tasks' batches: for a client that has gone."""
    spark.sparkContext.cancelJobsWithTag(tag)
