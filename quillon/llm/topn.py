"""Top N items within every group, by per-group score histograms.

1. One pass gives every group's number of rows and the range of its scores.
2. Every group of more than N rows gets a histogram over its own range, with about two bins for every N of its
   rows, so small groups have few bins and large ones fine ones. Each (group, bin) holds its lowest score and a bit
   mask with the bits of its items' hashes. Read from the top bin downwards, the masks are or-ed together; the
   number of set bits never exceeds the number of distinct items seen, so once N bits are set, at least N distinct
   items score no less than the lowest score so far: the group's threshold.
3. Rows below their group's threshold can't be in the answer; the survivors are ranked exactly with tie keys.

Ranges, histograms and the best score per item combine on the map side, so a group holding a third of all rows
sends a bounded number of small rows per map task and is never gathered anywhere. Ranges and thresholds meet the
rows by broadcast while they are at most `BROADCAST_GROUPS`; beyond that the groups with most rows do, and the
others, none of which can be large then, by a shuffle join on the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.materialize import materialize

#: Fewest and most bins of a group.
LEAST_BINS, MOST_BINS = 8, 16_384
#: Most groups whose ranges or thresholds are broadcast (about 80 bytes each).
BROADCAST_GROUPS = 250_000
#: Bits of one mask word.
WORD = 64


def _bin(score: Column, low: Column, high: Column, bins: Column) -> Column:
    """The score's bin of `bins` equal ones over [low, high]; infinities have bins of their own."""
    # halves keep the difference of extreme scores finite
    place = F.coalesce(F.try_divide(score / 2 - low / 2, high / 2 - low / 2), F.lit(0.0))
    inner = F.least(bins - 1, F.floor(place * bins).cast("int"))
    return F.when(score == float("inf"), bins).when(score == float("-inf"), F.lit(-1)).otherwise(inner)


def _attach(keyed: DataFrame, table: DataFrame, heavy: DataFrame | None, how: str) -> DataFrame:
    """`keyed` joined to a table of groups by (k1, k2): all by broadcast, or only those in `heavy`."""
    key = ["k1", "k2"]
    if heavy is None:
        return keyed.join(F.broadcast(table), key, how)
    held = F.broadcast(heavy.select(*key))
    hot = keyed.join(held, key, "left_semi").join(F.broadcast(table.join(held, key, "left_semi")), key, how)
    cold = keyed.join(held, key, "left_anti").join(table.join(held, key, "left_anti").hint("merge"), key, how)
    return hot.unionByName(cold)


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int = 10, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """The `n` best distinct items of every group: columns `group`, `item`, `score`, `rank` (1..n).

    An item counts with its best score. Ties go to the smaller item (by code point). Rows with a null
    group, a null item, or a null or NaN score are ignored; infinities are scores. A group with fewer than
    `n` items returns all of them; an empty input returns no rows. Empty strings are groups and items like
    any other. Further columns are dropped. `broadcast_groups` changes no result.
    """
    if n < 1:
        raise ValueError("n must be positive")
    words = -(-n * 2 // WORD)
    s = F.col(score).cast("double")
    live = rows.select(F.col(group).alias("g"), F.col(item).alias("i"), s.alias("s")).where("g IS NOT NULL AND i IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
    # groups travel as 128 bits; a collision would need about 2^64 groups
    keyed = live.withColumn("k1", F.xxhash64("g")).withColumn("k2", F.xxhash64(F.lit(1), F.col("g")))
    finite = F.when(F.abs("s") < float("inf"), F.col("s"))
    bins = F.least(F.lit(MOST_BINS), F.greatest(F.lit(LEAST_BINS), F.ceil(F.col("held") * 2 / n))).cast("int")
    ranges = materialize(keyed.groupBy("k1", "k2").agg(F.count("*").alias("held"), F.min(finite).alias("low"), F.max(finite).alias("high")).where(F.col("held") > n).select("k1", "k2", "held", "low", "high", bins.alias("bins")))
    heavy = None
    if ranges.count() > broadcast_groups:
        heavy = materialize(ranges.orderBy(F.desc("held"), "k1", "k2").limit(broadcast_groups).select("k1", "k2"))
    bit = F.pmod(F.xxhash64("i"), F.lit(words * WORD)).cast("int")
    masks = [F.bit_or(F.when(F.floor(bit / WORD) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(WORD)).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in range(words)]
    placed = _attach(keyed, ranges.drop("held"), heavy, "inner").withColumn("b", _bin(F.col("s"), F.col("low"), F.col("high"), F.col("bins")))
    histogram = placed.groupBy("k1", "k2", "b").agg(F.min("s").alias("lo"), *masks)
    down = Window.partitionBy("k1", "k2").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    distinct = sum((F.bit_count(F.bit_or(f"m{w}").over(down)) for w in range(1, words)), F.bit_count(F.bit_or("m0").over(down)))
    least = histogram.select("k1", "k2", distinct.alias("d"), F.min("lo").over(down).alias("at")).where(F.col("d") >= n).groupBy("k1", "k2").agg(F.max("at").alias("at"))
    above = _attach(keyed, materialize(least), heavy, "left").where("at IS NULL OR s >= at")
    best = above.groupBy("g", "i").agg(F.max("s").alias("s"))
    order = Window.partitionBy("g").orderBy(F.desc("s"), F.asc("i"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("rank"))
