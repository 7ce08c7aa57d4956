"""The store on disk: tables as lists of segments, deletions as tombstones, and a manifest that says what counts.

A commit writes only what was added (a segment per table) and the ids that were removed (tombstones), and then the
manifest, a small file that names all segments; readers see the newest complete manifest, so a commit that fails
half-way is never seen. A row counts unless a later commit removed the chunk it belongs to. After `COMPACT_AT`
commits tables are written anew and what no manifest of the last `KEEP` names is deleted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Commits after which tables are written as one segment again, and manifests that are kept.
COMPACT_AT, KEEP = 20, 3
#: The columns by which rows of a table belong to chunks.
OWNERS = {"chunks": ("id",), "dependencies": ("fromId", "toId"), "code_symbols": ("chunkId",), "code_references": ("chunkId",), "chunk_embeddings": ("chunkId",), "postings": ("chunkId",), "text_lengths": ("chunkId",)}
TOMBSTONES = "_removed"
_TOMBSTONE = T.StructType([T.StructField("gone", T.StringType()), T.StructField("at", T.IntegerType())])


class Folder:
    """A store's folder on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        p = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def commits(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("_manifests") if n.endswith(".json") and n[:-5].isdigit()]

    def manifest(self, commit: int) -> dict[str, list[list]]:
        """Per table its segments, each with its folder and the commit that wrote it."""
        stream = self._fs.open(self._path(f"{self.root}/_manifests/{commit:09d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict[str, list[list]]]:
        have = self.commits()
        return (have[-1], self.manifest(have[-1])) if have else (0, {})

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        """A table as the newest manifest has it."""
        _, manifest = self.newest()
        out = None
        for folder, commit in manifest.get(name, []):
            part = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
            for owner in OWNERS.get(name, ()):
                later = [f"{self.root}/{f}" for f, c in manifest.get(TOMBSTONES, []) if c > commit]
                if later:
                    gone = self.spark.read.schema(_TOMBSTONE).parquet(*later).select("gone")
                    part = part.join(gone, F.col(owner) == F.col("gone"), "left_anti")
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], schema) if out is None else out

    def commit(self, added: dict[str, DataFrame], removed: DataFrame | None = None, anew: bool = False) -> int:
        """Write a commit: rows added after `removed` (column id) are gone; `anew` leaves nothing of what was."""
        last, manifest = self.newest()
        commit = last + 1
        manifest = {} if anew else {k: list(v) for k, v in manifest.items()}
        token = uuid.uuid4().hex[:8]
        if removed is not None and not anew:
            folder = f"{TOMBSTONES}/{commit:09d}-{token}"
            removed.select(F.col("id").alias("gone"), F.lit(commit).alias("at")).distinct().write.parquet(f"{self.root}/{folder}")
            manifest.setdefault(TOMBSTONES, []).append([folder, commit])
        for name, rows in added.items():
            folder = f"{name}/{commit:09d}-{token}"
            rows.write.parquet(f"{self.root}/{folder}")
            manifest.setdefault(name, []).append([folder, commit])
        # the manifest appears under its name only when it is whole; of two writers one fails here
        draft, final = self._path(f"{self.root}/_manifests/.{commit:09d}-{token}"), self._path(f"{self.root}/_manifests/{commit:09d}.json")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"another writer has committed {commit} to {self.root}")
        return commit

    def tidy(self) -> None:
        """Delete manifests but the last `KEEP`, and segments that none of these names."""
        have = self.commits()
        named = {f for c in have[-KEEP:] for rows in self.manifest(c).values() for f, _ in rows}
        for c in have[:-KEEP]:
            self._fs.delete(self._path(f"{self.root}/_manifests/{c:09d}.json"), False)
        for name in [n for n in self._names("") if n != "_manifests"]:
            for segment in self._names(name):
                if f"{name}/{segment}" not in named and segment.split("-")[0].isdigit():
                    self._fs.delete(self._path(f"{self.root}/{name}/{segment}"), True)
