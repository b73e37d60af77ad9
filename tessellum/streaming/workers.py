"""Structured Streaming: event-time windows, a job-state stream and the evaluation outbox."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.session import shared_dir


def read_table(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream of its files; the schema is the table's."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def drain(stream: DataFrame, mode: str = "append", key: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream over all that there is, into a table of the shared folder, and return that table.

    ``complete`` results are written whole by every batch, each over the one before. ``update`` results are the changed
    rows of each batch, of which the latest of each ``key`` counts; a batch that runs again changes nothing, and what
    the watermark has passed is no longer held in the state.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "complete":
        q = stream.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out"))
    elif mode == "update":
        q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.withColumn("_batch", F.lit(n)).write.mode("append").parquet(f"{base}/out"))
    else:
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
    q.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    rest = [c for c in stream.columns if c not in key]
    out = spark.read.schema(f"{_ddl(stream)}, _batch int").parquet(f"{base}/out")
    return out.groupBy(*key).agg(F.max(F.struct("_batch", *rest)).alias("_r")).select(*key, "_r.*").select(*stream.columns)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def window_counts(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(bucket, event_type, n, total) per tumbling event-time window of a stream or table (ts, event_type, value)."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("at", late)
    g = e.groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("bucket"), "event_type", "n", "total")


def latest_states(events: DataFrame, key: str, at: str, state: str) -> DataFrame:
    """(key, state): the last state of each key, as a partial ``max_by`` that a stream keeps up to date."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(at, state)).alias(state))


def outbox(events: DataFrame, score, key: str = "id") -> DataFrame:
    """Score each event of a stream once: ``score`` maps a batch of new events to rows with the same key.

    A batch that runs again after a failure, or a repeated event, changes nothing: keys with a result are left out.
    """
    spark = events.sparkSession
    base = f"{shared_dir(spark)}/outbox-{uuid.uuid4().hex}"

    def work(batch: DataFrame, n: int) -> None:
        fresh = batch.dropDuplicates([key])
        try:
            done = spark.read.parquet(f"{base}/results").select(key)
            fresh = fresh.join(done, key, "left_anti")
        except Exception as e:  # no result has been written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        score(fresh).write.mode("append").parquet(f"{base}/results")

    events.writeStream.foreachBatch(work).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/results")


