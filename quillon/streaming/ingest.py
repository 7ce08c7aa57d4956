"""Keeping a store current from a stream of file events.

An event is path, kind (add, change, unlink), ts and the text after it. Bursts of events of a path count as one (the
debounce), within a micro-batch the last one wins, and one that is delivered again changes nothing, as the stored hash
is the same. A batch is one commit to the store: chunks, structure, embeddings, index and edges of the files that
changed are added, those before are removed, and nothing else is written. Deletes without events are found by
comparing a listing with the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillon.engine import ContextEngine

EVENTS = T.StructType([T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("text", T.StringType())])
#: Fixed value: events of a path this close together are one.
DEBOUNCE = "300 milliseconds"


def debounced(events: DataFrame, gap: str = DEBOUNCE) -> DataFrame:
    """Streaming or not: one row per path and burst of events less than `gap` apart, with the burst's last event."""
    return events.groupBy(F.session_window("ts", gap).alias("burst"), "path").agg(F.max(F.struct("ts", "kind", "text")).alias("e"), F.count("*").alias("n_events")).select("path", "e.kind", "e.ts", "e.text", "n_events")


def vanished(chunks: DataFrame, listing: DataFrame) -> DataFrame:
    """Unlink events for stored file paths that a listing no longer has."""
    stored = chunks.where("source = 'file' AND path IS NOT NULL").select("path").distinct()
    return stored.join(listing.select("path").distinct(), "path", "left_anti").select("path", F.lit("unlink").alias("kind"), F.current_timestamp().alias("ts"), F.lit(None).cast("string").alias("text"))


def read_current(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk table of the store's newest commit."""
    return ContextEngine.load(spark, folder).tables["chunks"]


def merge_batch(folder: str, **options: object) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that commits each batch's changes to the store, and nothing if there are none."""

    def run(events: DataFrame, batch: int) -> None:
        engine = ContextEngine.load(events.sparkSession, folder, **options)
        burst = debounced(events.where("path IS NOT NULL")).drop("n_events")
        if not engine.apply_events(burst).isEmpty():
            engine.save(folder)

    return run


def watch(spark: SparkSession, events_folder: str, table_folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Follow a folder of event files (JSON lines) and keep the chunk table current.

    `once` takes what is there and ends; else new files are picked up as they come.
    """
    stream = spark.readStream.schema(EVENTS).json(events_folder)
    writer = stream.writeStream.foreachBatch(merge_batch(table_folder)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events per window and kind; on a stream, later than `late` they no longer count."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def newest_rows(rows: DataFrame, key: str, time: str) -> DataFrame:
    """One row per key, the newest: what a last-writer-wins store holds."""
    order = Window.partitionBy(key).orderBy(F.desc(time))
    return rows.withColumn("_nr", F.row_number().over(order)).where("_nr = 1").drop("_nr")
