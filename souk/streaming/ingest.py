"""Streams of order messages: sources, a sink that a batch may reach twice, totals over all batches, and how long a stream runs."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.listener import StreamingQueryListener

MESSAGE = "value STRING, topic STRING, partition INT, offset BIGINT, kafka_timestamp TIMESTAMP_NTZ"
#: The slice of a table that one batch of one writer fills.
BATCH = "_batch"


def read_messages(spark: SparkSession, path: str, files_per_batch: int = 100, schema: str = MESSAGE) -> DataFrame:
    """Messages that arrive as Parquet files, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def read_topic(spark: SparkSession, servers: str, topic: str, most_offsets: int = 100_000) -> DataFrame:
    """Messages of a Kafka topic from its start; needs Spark's Kafka package."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", most_offsets).load()
    return raw.select(F.col("value").cast("string"), "topic", "partition", "offset", F.col("timestamp").cast("timestamp_ntz").alias("kafka_timestamp"))


def to_bronze(messages: DataFrame) -> DataFrame:
    """Messages as they are, broken ones too, with the load time."""
    return messages.withColumn("_ingested_at", F.current_timestamp())


@dataclass
class Totals:
    """What a stream did from start to end: rows read, rows dropped as too late, batches."""

    rows: int = 0
    late: int = 0
    batches: int = 0


class Progress(StreamingQueryListener):
    """Adds up every batch of a query, however many there are; a query's own record keeps its last hundred only."""

    def __init__(self) -> None:
        self.totals: dict[str, Totals] = {}
        self.ended: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def _of(self, run_id: object) -> tuple[Totals, threading.Event]:
        with self.lock:
            return self.totals.setdefault(str(run_id), Totals()), self.ended.setdefault(str(run_id), threading.Event())

    def onQueryStarted(self, event) -> None:
        self._of(event.runId)

    def onQueryProgress(self, event) -> None:
        told = self._of(event.progress.runId)[0]
        told.rows += max(event.progress.numInputRows, 0)
        told.late += sum(x.numRowsDroppedByWatermark for x in event.progress.stateOperators)
        told.batches += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._of(event.runId)[1].set()

    def of(self, run_id: object, wait: float = 60.0) -> Totals:
        """The totals of a query that has ended: its events come in order, the last one being its end."""
        told, ended = self._of(run_id)
        if not ended.wait(wait):
            raise TimeoutError(f"no end of {run_id} was told")
        return told


def run(spark: SparkSession, writer: DataStreamWriter, every: str | None = None, timeout: float | None = None) -> Totals:
    """Runs a stream to its end and tells what it did: until all there is has been taken, or with `every` (a pause between batches)
    until it is stopped. timeout: seconds after which it is given up; the jobs set none."""
    progress = Progress()
    spark.streams.addListener(progress)
    try:
        query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
        try:
            if timeout is None:
                query.awaitTermination()
            elif not query.awaitTermination(timeout):
                raise TimeoutError(f"the stream has not ended within {timeout} seconds")
        finally:
            if query.isActive:
                query.stop()
        return progress.of(query.runId)
    finally:
        spark.streams.removeListener(progress)


def batch_sink(path: str, writer: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch as the slice of its number. A batch that comes again, because the stream died between write and commit,
    replaces what it wrote. Streams with checkpoints of their own need names of their own."""

    def write(df: DataFrame, number: int) -> None:
        df.withColumn(BATCH, F.lit(f"{writer}-{number}")).write.partitionBy(BATCH).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)

    return write


def append(stream: DataFrame, path: str, checkpoint: str, every: str | None = None, writer: str = "stream", timeout: float | None = None, mode: str = "append") -> Totals:
    """Appends a stream to Parquet, each input once over restarts, whatever the restart was for."""
    sink = stream.writeStream.foreachBatch(batch_sink(path, writer)).option("checkpointLocation", checkpoint).outputMode(mode)
    return run(stream.sparkSession, sink, every, timeout)


def drop_redeliveries(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """The first delivery of each key; deliveries further apart than the delay are not recognised."""
    return stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay).dropDuplicatesWithinWatermark([key]).drop("_at")


def tumbling_counts(stream: DataFrame, at: str, width: str, by: list[str], delay: str) -> DataFrame:
    """Rows for each window and group."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay)
    counted = timed.groupBy(F.window("_at", width), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *by, "n")
