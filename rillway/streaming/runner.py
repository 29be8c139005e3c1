"""Change streams: the batch steps and folds run once per micro-batch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillway.sinks.target import KeyedTarget

FLUSH_INTERVAL = "10 seconds"


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder of the cluster; the fallback only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not (configured or fallback):
        raise ValueError("set spark.checkpoint.dir or pass a checkpoint folder")
    return configured or fallback


def change_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Change files as a stream, a few files per micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, start: str = "latest", per_batch: int | None = None) -> DataFrame:
    """Queue messages from Kafka as (value, pos). Needs the connector on the class path."""
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).option("startingOffsets", start)
    )
    if per_batch:
        reader = reader.option("maxOffsetsPerTrigger", per_batch)
    return reader.load().select(F.col("value").cast("string").alias("value"), F.col("offset").alias("pos"))


def start(
    stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str,
    once: bool = False, interval: str = FLUSH_INTERVAL, name: str | None = None,
) -> StreamingQuery:
    """Run on_batch per micro-batch: everything there is and stop, or every interval."""
    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark keeps in the checkpoint: the same after a restart, another one for a new checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def begin_now(stream: DataFrame, checkpoint: str) -> None:
    """Let the stream begin with what comes from now on: what its source holds is committed to the checkpoint and not read.

    The batch is given to nobody, so Spark lists the source and runs no job. Call it once, before the first start; a later
    start with the checkpoint goes on from there. The stream should have no limit per batch.
    """
    start(stream, lambda batch, batch_id: None, checkpoint, once=True).awaitTermination()


def state(query: StreamingQuery) -> str:
    """run, stop (ended by an error) or done."""
    if query.isActive:
        return "run"
    return "stop" if query.exception() is not None else "done"


def progress_metrics(query: StreamingQuery) -> dict:
    """Rows read, rows per second and seconds spent, over the micro-batches Spark still remembers."""
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    rows = sum(p["numInputRows"] for p in batches)
    seconds = sum(p["durationMs"]["triggerExecution"] for p in batches) / 1000
    return {"full_read_count": rows, "rate": f"{int(rows / seconds) if seconds else 0}/s", "seconds": seconds, "batches": len(batches)}


def start_apply(
    stream: DataFrame, target: KeyedTarget, checkpoint: str, steps: Callable[[DataFrame], DataFrame] | None = None,
    compact_every: int = 20, **options,
) -> StreamingQuery:
    """Apply a change stream to a keyed target.

    Each micro-batch passes the steps (lookups inside them read their tables as they are then) and is
    stored under its batch id, so a batch repeated after a failure counts once. Every compact_every
    batches the log is folded into a new base.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        stream = stream_id(batch.sparkSession, checkpoint)
        target.append_batch(steps(batch) if steps else batch, batch_id, stream)
        if compact_every and batch_id % compact_every == compact_every - 1:
            target.compact(stream, batch_id)

    return start(stream, on_batch, checkpoint, **options)


def start_append(
    stream: DataFrame, path: str, checkpoint: str, steps: Callable[[DataFrame], DataFrame] | None = None, **options
) -> StreamingQuery:
    """Append each micro-batch's rows to files, one folder per batch."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        (steps(batch) if steps else batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return start(stream, on_batch, checkpoint, **options)
