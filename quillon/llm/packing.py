"""Filling containers of fixed capacity: vector bin packing with the dot-product heuristic.

Items carry three demands (tokens, one segment, loss-bearing tokens), containers a limit for each. A
container is filled by taking, again and again, the fitting item whose demands have the largest dot product
with the room left, both relative to the limits; the demands are weighted by how scarce they are overall.
Items with equal demands are interchangeable, so the choice is made among the distinct demands only.

Texts are counted and packed in shards of about `SHARD` items by a hash of their key; the half-empty
containers of all shards are opened again and their items packed together in a last, smaller round. A text
over the capacity is divided: full containers of its own, and a last piece that is packed like any item.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.materialize import materialize, widen

#: Items packed together. A shard's work grows with its distinct demands, of which there are at most as many.
SHARD = 8_000
#: A container of the first round with less of its capacity in use is opened again.
REOPEN = 0.98
#: Rounds of reopening at most; each has far fewer items than the one before.
ROUNDS = 4
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public byte-level BPE cuts text before merging.
BPE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: roles of chat formats whose lines are prompts, for which no loss is taken; those of the model aren't here.
PROMPT_LINE = r"(?mi)^[ \t]*[\[<(*#|]*(?:user|human|prompter|customer|question|prompt|instruction|input|system|task|developer|dev|reviewer)(?:[ \t]*[\])>*|:]).*$"


@cache
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("quillon-bpe", pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(rows: DataFrame, item: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """`item`, tokens, loss_tokens. Null and empty texts have 0 tokens; prompt lines of chats bear no loss."""

    # the driver's file goes to the executors, which needn't have it
    rows.sparkSession.sparkContext.addFile(tokenizer)
    name = tokenizer.rstrip("/").rsplit("/", 1)[-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        from pyspark import SparkFiles

        prompt, encode = re.compile(PROMPT_LINE), _encoder(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            n, free = [], []
            for t in batch["t"]:
                t = t or ""
                n.append(len(encode(t)))
                free.append(min(n[-1], sum(len(encode(m[0])) for m in prompt.finditer(t))))
            yield pd.DataFrame({"i": batch["i"], "tokens": n, "loss_tokens": [a - b for a, b in zip(n, free)]})

    texts = rows.select(F.col(item).alias("i"), F.col(text).alias("t"))
    return widen(texts).mapInPandas(run, f"i {dict(texts.dtypes)['i']}, tokens long, loss_tokens long").withColumnRenamed("i", item)


def pack_shard(demands: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number (from 0) of every row of `demands`; each row must fit an empty container."""
    n = len(demands)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    kinds, of = np.unique(demands, axis=0, return_inverse=True)
    of = of.reshape(-1)
    waiting: dict[int, list[int]] = defaultdict(list)
    for i in range(n - 1, -1, -1):
        waiting[int(of[i])].append(i)
    left = np.bincount(of, minlength=len(kinds))
    scarce = demands.sum(axis=0) / limits
    worth = kinds / limits * (scarce / max(1e-9, scarce.max()))
    # kinds in the order of their first demand: what doesn't fit the room left is a suffix
    out = np.empty(n, dtype=np.int64)
    alive = np.arange(len(kinds))
    number, rest = 0, n
    while rest:
        room = limits.astype(float).copy()
        while True:
            alive = alive[left[alive] > 0] if (left[alive] == 0).sum() * 4 > len(alive) else alive
            upto = np.searchsorted(kinds[alive, 0], room[0], side="right")
            some = alive[:upto]
            ok = some[(left[some] > 0) & (kinds[some, 1:] <= room[1:]).all(axis=1)]
            if not len(ok):
                break
            best = ok[np.argmax(worth[ok] @ (room / limits))]
            out[waiting[int(best)].pop()] = number
            left[best] -= 1
            room -= kinds[best]
            rest -= 1
        number += 1
    return out


def pack(counted: DataFrame, item: str = "doc_id", capacity: int = 2048, max_segments: int = 256, max_loss: int | None = None, shard_items: int = SHARD) -> DataFrame:
    """Containers of texts: container (string), `item`, piece, offset, tokens, loss_tokens.

    `counted` has a row per text with tokens and loss_tokens. Rows without tokens (null or none) are not
    placed; every other row is placed once, whole unless it alone exceeds `capacity` (or, with the share of
    its loss, `max_loss`, by default the capacity). Divided texts have pieces from 0 with their offset in
    tokens. No container exceeds `capacity` tokens, `max_segments` pieces or `max_loss` loss-bearing tokens.
    Equal keys are different rows. Container names are stable for the same input, and without meaning.
    """
    loss_limit = capacity if max_loss is None else max_loss
    limits = np.array([capacity, max_segments, loss_limit], dtype=np.int64)
    base = counted.select(F.col(item).alias("i"), F.col("tokens").cast("long").alias("n"), F.least(F.coalesce(F.col("loss_tokens"), F.col("tokens")).cast("long"), F.col("tokens").cast("long")).alias("loss")).where("n > 0")
    # a piece is short enough that even wholly loss-bearing it fits
    size = F.when((F.col("n") <= capacity) & (F.col("loss") <= loss_limit), F.col("n")).otherwise(F.lit(min(capacity, loss_limit)))
    pieces = base.withColumn("size", size).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("size")))))
    pieces = pieces.select("i", F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.col("size")).alias("offset"), F.least("size", F.col("n") - F.col("piece") * F.col("size")).alias("tokens"), "n", "loss")
    pieces = pieces.withColumn("loss_tokens", F.least("tokens", F.ceil(F.col("loss") * F.col("tokens") / F.col("n")))).select("i", "piece", "offset", "tokens", "loss_tokens")
    todo = materialize(pieces.withColumn("nr", F.monotonically_increasing_id()))
    kind = dict(todo.dtypes)["i"]
    schema = f"container string, i {kind}, piece int, offset long, tokens long, loss_tokens long, nr long, used long"

    def packer(name: str):
        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["tokens", "nr"], ascending=[False, True], kind="stable")
            demands = np.column_stack([group["tokens"], np.ones(len(group), dtype=np.int64), group["loss_tokens"]]).astype(np.int64)
            at = pack_shard(demands, limits)
            used = np.bincount(at, weights=demands[:, 0]).astype(np.int64)
            return pd.DataFrame({"container": [f"{name}-{key[0]}-{c}" for c in at], "i": group["i"].to_numpy(), "piece": group["piece"].to_numpy(), "offset": group["offset"].to_numpy(), "tokens": group["tokens"].to_numpy(), "loss_tokens": group["loss_tokens"].to_numpy(), "nr": group["nr"].to_numpy(), "used": used[at]})

        return run

    done = None
    for round_ in range(ROUNDS):
        count = todo.count()
        if not count:
            break
        shards = max(1, -(-count // shard_items))
        # one shard a task: they are small, and by their size alone adaptive execution would pack them one after the other
        sharded = todo.withColumn("shard", F.pmod(F.xxhash64("nr"), F.lit(shards)).cast("int")).repartitionByRange(shards, "shard")
        packed = materialize(sharded.groupBy("shard").applyInPandas(packer(f"r{round_}"), schema))
        last = shards == 1 or round_ == ROUNDS - 1
        kept = packed if last else packed.where(F.col("used") >= REOPEN * capacity)
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        todo = packed.where(F.col("used") < REOPEN * capacity).select(todo.columns)
    if done is None:
        done = materialize(todo.select(F.lit("").alias("container"), "i", "piece", "offset", "tokens", "loss_tokens", "nr", F.lit(0).cast("long").alias("used")).limit(0))
    return done.select("container", F.col("i").alias(item), "piece", "offset", "tokens", "loss_tokens")


def pack_summary(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, pieces, tokens, unused_share."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("p"))
    return per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("p"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.round(1 - F.sum("t") / (F.count("*") * capacity), 6).alias("unused_share"))
