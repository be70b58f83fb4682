"""Incremental ingest (STM-3): each micro-batch of graph rows is one source, so it can be replayed and undone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kgspark.operators.kb import KnowledgeBase
from kgspark.plans.graph import graph
from kgspark.streaming.store import Store

#: A stream row is a node (kind node: id, label, type) or an edge (kind edge: id, source, target, label).
ROW = "kind string, id string, label string, type string, source string, target string"


def start(rows: DataFrame, path: str, checkpoint: str, compact_every: int = 50) -> StreamingQuery:
    """Folds a stream of rows into the store under ``path``: batch n is the source ``batch-n``.

    A replayed batch that had been stored whole is passed over, and one that had not is written anew. Every so many
    numbers the store is compacted, so that a read meets a bounded number of deltas.
    """

    def fold(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, path)
        nodes = batch.where("kind = 'node'").select("id", "label", "type").dropDuplicates(["id"])
        edges = batch.where("kind = 'edge'").select("id", "source", "target", "label")
        done = store.ingest(graph(nodes, edges), f"batch-{number}", created=number)
        if done.done and done.number % compact_every == 0:
            store.compact()

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, batch: int | None = None) -> KnowledgeBase:
    """The knowledge base now, or as it was right after a batch."""
    store = Store(spark, path)
    return store.read(None if batch is None else store.number_of(f"batch-{batch}"))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and tumbling window, with a watermark; the same for a stream or a table."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.count("*").alias("events"), F.sum("value").alias("total")
    ).select(F.col("w.start").alias("start"), "event_type", "events", "total")
