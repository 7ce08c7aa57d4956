"""The k most similar vectors for every vector, by multiprobe p-stable hashing.

1. Usable vectors, the latest per item; equal vectors form one class, so copies are compared once.
2. Every class is hashed into `tables` tables of `hashes` p-stable functions floor((a.x + b) / w) over its
   unit vector. It is stored in its own bucket of each table and looks into the `probes` buckets that
   differ in the fewest, nearest boundaries (own bucket first), in order of estimated success.
3. Looking up is an equi-join on the bucket. Both sides carry a 128-bit sign sketch, and the join keeps
   only pairs whose sketches differ in no more bits than vectors of the wanted similarity do, less than
   one in 100,000 aside; so a bucket's pairs are never emitted.
4. Distinct pairs get their exact cosine in double precision and are ranked.

A bucket with more than `bucket_rows` classes is compared as a whole too, but by blocks: what is stored in it
and what looks into it are cut into blocks of at most `BLOCK` rows on average, every pair of blocks is one group,
and a group takes all its cosines as a matrix product. Of these only each vector's best `k`, and what can't be
told from them, become pairs, so a dense group's pairs are never emitted.
"""

from __future__ import annotations

import functools
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.materialize import materialize

#: Bits of the sign sketch.
SKETCH = 128
#: Standard deviations of the sketch distance that are allowed for.
SIGMAS = 4.5
#: Fewest tables, and the probability with which a pair at the wanted similarity is to be found.
TABLES, SURE = 10, 0.9
#: Rows of a block of a crowded bucket.
BLOCK = 2048
#: What a cosine in single precision, or one rounded to 6 decimals, may be off by.
BLUR = 1e-5


def usable_vectors(rows: DataFrame, item: str, vector: str, model: str, dims: str, time: str) -> DataFrame:
    """Per item its latest usable vector: item, model, v. Equal times: the greater model and vector."""
    v = F.col("v")
    flat = rows.select(F.col(item).alias("item"), F.col(model).alias("model"), F.col(vector).cast("array<float>").alias("v"), F.col(dims).cast("long").alias("n"), F.col(time).cast("timestamp").alias("t"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = flat.where(F.col("item").isNotNull() & F.col("model").isNotNull() & v.isNotNull() & (F.size(v) == F.col("n")) & (F.col("n") > 0) & ~bad & F.exists(v, lambda x: x != 0))
    return fine.groupBy("item").agg(F.max(F.struct("t", "model", "v")).alias("m")).select("item", "m.model", "m.v")


def _probe_sets(hashes: int) -> list[tuple[int, ...]]:
    """Perturbation sets: none, one or two of the 2 * hashes boundaries, at most one per function."""
    one = range(2 * hashes)
    return [(), *((j,) for j in one), *(p for p in itertools.combinations(one, 2) if p[0] // 2 != p[1] // 2)]


@functools.cache
def success(hashes: int, probes: int, width: float, similarity: float, samples: int = 20_000) -> float:
    """Share of pairs at `similarity` that one table finds, from either side; simulated, the same on every call."""
    rng = np.random.default_rng(hashes)
    sets = _probe_sets(hashes)
    member = np.zeros((2 * hashes, len(sets)))
    for s, own in enumerate(sets):
        member[list(own), s] = 1
    found = 0
    for _ in range(0, samples, 2_000):
        here = rng.random((2_000, hashes))
        there = here + rng.standard_normal((2_000, hashes)) * (math.sqrt(max(0.0, 2 - 2 * similarity)) / width)
        step = np.floor(there)
        hit = np.zeros(2_000, bool)
        for part, way in ((here, step), (there - step, -step)):
            cost = np.stack([part**2, (1 - part) ** 2], axis=2).reshape(2_000, -1) @ member
            moved = np.stack([way == -1, way == 1], axis=2).reshape(2_000, -1)
            mine = np.where(moved, np.stack([part**2, (1 - part) ** 2], axis=2).reshape(2_000, -1), 0).sum(axis=1)
            hit |= (np.abs(way) <= 1).all(axis=1) & (moved.sum(axis=1) <= 2) & ((cost < mine[:, None] - 1e-12).sum(axis=1) < probes)
        found += int(hit.sum())
    return found / samples


def tables_for(hashes: int, probes: int, width: float, similarity: float) -> int:
    """The fewest tables, at least `TABLES`, that find a pair at `similarity` with a probability of `SURE`."""
    p = success(hashes, probes, width, similarity)
    if p == 0:
        raise ValueError(f"pairs at {similarity} aren't found with {hashes} hashes of width {width}; a greater width is needed")
    return max(TABLES, math.ceil(math.log(1 - SURE) / math.log1p(-p))) if p < 1 else TABLES


def _hasher(tables: int, hashes: int, probes: int, width: float, seed: int, looking: bool):
    """A mapInArrow function: (cid, model, v) to (cid, key, s1, s2), one row per table (and probe)."""
    sets = _probe_sets(hashes)
    probes = min(probes, len(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        member = np.zeros((2 * hashes, len(sets)))
        for s, own in enumerate(sets):
            member[list(own), s] = 1

        def functions(d: int) -> tuple:
            if d not in known:
                rng = np.random.default_rng([seed, d])
                known[d] = (rng.standard_normal((d, tables * hashes)), rng.random(tables * hashes) * width, rng.integers(-(2**62), 2**62, (tables, hashes)), rng.standard_normal((d, SKETCH)), rng.integers(-(2**62), 2**62, tables))
            return known[d]

        for batch in batches:
            vectors = batch.column("v")
            sizes = np.diff(vectors.offsets.to_numpy())
            values, cid = vectors.flatten().to_numpy(zero_copy_only=False), batch.column("cid").to_numpy(zero_copy_only=False)
            model = np.array([zlib.crc32((m or "").encode()) for m in batch.column("model").to_pylist()], dtype=np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = values[starts[at][:, None] + np.arange(d)].astype(np.float64)
                # scaled by the largest part first, so that squares of extreme values stay finite
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                a, b, mix, planes, salt = functions(int(d))
                spot = ((x @ a + b) / width).reshape(len(at), tables, hashes)
                cell = np.floor(spot)
                part = spot - cell
                with np.errstate(over="ignore"):
                    key = (cell.astype(np.int64) * mix).sum(axis=2) + salt + model[at][:, None] * np.int64(0x5851F42D4C957F2D)
                    if looking:
                        cost = np.stack([part**2, (1 - part) ** 2], axis=3).reshape(len(at), tables, 2 * hashes) @ member
                        pick = np.argpartition(cost, probes - 1, axis=2)[:, :, :probes]
                        step = np.stack([-mix, mix], axis=2).reshape(tables, 2 * hashes)
                        shift = np.stack([step[:, list(own)].sum(axis=1) if own else np.zeros(tables, np.int64) for own in sets], axis=1)
                        key = key[:, :, None] + np.take_along_axis(np.broadcast_to(shift, (len(at), *shift.shape)), pick, axis=2)
                signs = np.packbits(x @ planes > 0, axis=1).view(np.int64)
                per = key[0].size
                out = [np.repeat(cid[at], per), key.reshape(-1), np.repeat(signs[:, 0], per), np.repeat(signs[:, 1], per)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["cid", "key", "s1", "s2"])

    return run


def _best_of_blocks(k: int, min_similarity: float):
    """An applyInArrow function for a group of one stored and one looking block: each row's best pairs (a, b), a < b.

    For either side a row's best `k` partners of at least `min_similarity` are kept, and all that come within
    `BLUR` of the last of them; ties and exact cosines are settled later.
    """

    def unit(side: pa.Table) -> np.ndarray:
        vectors = side.column("v").combine_chunks()
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)

    def run(group: pa.Table) -> pa.Table:
        side = group.column("looks").to_numpy()
        left, right = group.filter(pa.array(side)), group.filter(pa.array(~side))
        out = np.zeros((0, 2), np.int64)
        if len(left) and len(right):
            a, b = left.column("cid").to_numpy(), right.column("cid").to_numpy()
            cosine = unit(left) @ unit(right).T
            cosine[a[:, None] == b[None, :]] = -2
            keep = np.zeros(cosine.shape, bool)
            for axis in (0, 1):
                n = cosine.shape[axis]
                last = np.partition(cosine, n - k, axis=axis).take([n - k], axis=axis) if n > k else np.float32(-1)
                keep |= cosine >= np.maximum(last, np.float32(min_similarity)) - np.float32(BLUR)
            i, j = np.nonzero(keep & (cosine > -1.5))
            out = np.stack([np.minimum(a[i], b[j]), np.maximum(a[i], b[j])], axis=1)
        return pa.table({"a": pa.array(out[:, 0]), "b": pa.array(out[:, 1])})

    return run


def _crowded(classes: DataFrame, stored: DataFrame, looking: DataFrame, hot: DataFrame, k: int, min_similarity: float) -> DataFrame:
    """Pairs (a, b) of the buckets in `hot` (key, n): all that lies in a bucket against all that looks into it."""
    lookups = materialize(looking.join(hot, "key", "left_semi").select("cid", "key"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    sizes = hot.join(lookups.groupBy("key").agg(F.count("*").alias("m")), "key").select("key", blocks(F.col("n")).alias("here"), blocks(F.col("m")).alias("there"))
    own = lambda n: F.pmod(F.xxhash64(F.lit(11), "cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = lookups.join(sizes, "key").withColumn("p", own("there")).select("cid", "key", "p", every("here").alias("q"), F.lit(True).alias("looks"))
    right = stored.select("cid", "key").join(sizes, "key").withColumn("q", own("here")).select("cid", "key", every("there").alias("p"), "q", F.lit(False).alias("looks"))
    rows = left.unionByName(right).join(classes.select("cid", "v"), "cid")
    return rows.groupBy("key", "p", "q").applyInArrow(_best_of_blocks(k, min_similarity), "a long, b long")


def _candidates(classes: DataFrame, tables: int, hashes: int, probes: int, width: float, bits: int, bucket_rows: int, k: int, min_similarity: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of classes that share a probed bucket and have close sketches."""
    schema = "cid long, key long, s1 long, s2 long"
    stored = classes.mapInArrow(_hasher(tables, hashes, probes, width, 0, False), schema)
    looking = classes.mapInArrow(_hasher(tables, hashes, probes, width, 0, True), schema)
    here = stored.select(F.col("cid").alias("b"), "key", F.col("s1").alias("t1"), F.col("s2").alias("t2"))
    hot = materialize(stored.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows))
    crowded = not hot.isEmpty()
    close = (F.col("cid") != F.col("b")) & (F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("t2"))) <= bits)
    calm = here.join(hot, "key", "left_anti") if crowded else here
    met = looking.join(calm, "key").where(close).select(F.least("cid", "b").alias("a"), F.greatest("cid", "b").alias("b"))
    if crowded:
        met = met.unionByName(_crowded(classes, stored, looking, hot, k, min_similarity))
    return met.distinct()


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        va, vb = batch.column("va"), batch.column("vb")
        sizes = np.diff(va.offsets.to_numpy())
        fa, fb = va.flatten().to_numpy(zero_copy_only=False), vb.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
        sim = np.zeros(len(sizes))
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            where = starts[at][:, None] + np.arange(d)
            x, y = fa[where].astype(np.float64), fb[where].astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            y /= np.abs(y).max(axis=1, keepdims=True)
            sim[at] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(np.round(sim, 6))], ["a", "b", "sim"])


def nearest(rows: DataFrame, item: str = "chunkId", vector: str = "embedding", model: str = "model", dims: str = "dimensions", time: str = "timestamp", k: int = 5, min_similarity: float = 0.85, tables: int | None = None, hashes: int | None = None, probes: int = 24, width: float | None = None, bucket_rows: int = 5000) -> DataFrame:
    """Per item its up to `k` most similar items of the same model: item, neighbour, similarity, rank.

    Similarity is the cosine in double precision, rounded to 6 decimals, at least `min_similarity`; ties go
    to the smaller neighbour. Unusable rows (null item, model or vector; null, NaN or infinite parts; all
    zero; length other than `dims`) are ignored; of several usable rows of an item the latest counts, a
    null time being the earliest. Items without a neighbour have no row; an empty input gives none.
    `hashes` defaults to 8 up to a million vectors and one more for each further factor of 4.
    `tables` defaults to as many as find a pair at `min_similarity` with a probability of `SURE` at these
    hashes, probes and width; `width` to 1, and more for similarities below 0.85, by their distance.
    """
    latest = usable_vectors(rows, item, vector, model, dims, time).withColumn("h1", F.xxhash64("model", "v")).withColumn("h2", F.xxhash64(F.lit(7), "v", "model"))
    classes = materialize(latest.groupBy("h1", "h2").agg(F.first("model").alias("model"), F.first("v").alias("v")).withColumn("cid", F.monotonically_increasing_id()))
    if hashes is None:
        hashes = 8 + max(0, math.ceil(math.log(max(1, classes.count()) / 1e6, 4)))
    if width is None:
        width = max(1.0, math.sqrt((1 - min_similarity) / 0.15))
    if tables is None:
        tables = tables_for(hashes, probes, width, min_similarity)
    p = math.acos(min_similarity) / math.pi
    bits = math.ceil(SKETCH * p + SIGMAS * math.sqrt(SKETCH * p * (1 - p)))
    pairs = _candidates(classes.select("cid", "model", "v"), tables, hashes, probes, width, bits, bucket_rows, k, min_similarity)
    va, vb = classes.select(F.col("cid").alias("a"), F.col("v").alias("va")), classes.select(F.col("cid").alias("b"), F.col("v").alias("vb"))
    sims = pairs.join(va, "a").join(vb, "b").select("a", "b", "va", "vb").mapInArrow(_cosines, "a long, b long, sim double").where(F.col("sim") >= min_similarity)
    near = sims.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "sim").select("p.a", "p.b", "sim")
    members = latest.select("item", "h1", "h2").join(classes.select("h1", "h2", "cid"), ["h1", "h2"]).select("cid", "item")
    heads = members.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy("item"))).where(F.col("r") <= k + 1).select(F.col("cid").alias("b"), F.col("item").alias("neighbour"), "r")
    shared = heads.groupBy(F.col("b").alias("a")).agg(F.max("r").alias("n")).where("n > 1").select("a", F.col("a").alias("b"), F.lit(1.0).alias("sim"))
    ranked = near.unionByName(shared).join(heads.drop("r"), "b").withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), F.asc("neighbour")))).where(F.col("r") <= k + 1)
    lists = ranked.groupBy(F.col("a").alias("cid")).agg(F.sort_array(F.collect_list(F.struct("r", "neighbour", "sim"))).alias("best"))
    mine = members.join(lists, "cid").select("item", F.slice(F.filter("best", lambda e: e["neighbour"] != F.col("item")), 1, k).alias("best"))
    return mine.select("item", F.posexplode("best").alias("pos", "e")).select(F.col("item"), F.col("e.neighbour").alias("neighbour"), F.col("e.sim").alias("similarity"), (F.col("pos") + 1).alias("rank"))


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """Unordered pairs of `nearest`: a, b with a < b."""
    return near.select(F.least("item", "neighbour").alias("a"), F.greatest("item", "neighbour").alias("b")).distinct()
