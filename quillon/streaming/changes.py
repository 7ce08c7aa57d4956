"""What file events change in a chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.store import already_current


def last_per_path(events: DataFrame) -> DataFrame:
    """The last event of every path, by time; of equal times the one that deletes, then the greater text."""
    rest = F.struct("ts", F.col("kind").alias("kind"), "text")
    return events.where("path IS NOT NULL").groupBy("path").agg(F.max(rest).alias("e")).select("path", "e.kind", "e.ts", "e.text")


def file_changes(chunks: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths whose rows go (path), and files to be taken in anew (path, ts, text).

    A file whose stored whole-file hash is the same is neither, so it keeps its ids, embeddings and times.
    """
    last = last_per_path(events)
    live = last.where("kind <> 'unlink' AND text IS NOT NULL")
    tops = chunks.where("parentId IS NULL").select("path", F.get_json_object("metadata", "$.contentHash").alias("hash"))
    current = already_current(live.select("path", "text"), tops).select("path").distinct()
    return last.select("path").join(current, "path", "left_anti"), live.join(current, "path", "left_anti").select("path", "ts", "text")
