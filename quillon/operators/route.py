"""Scoring chunks for a task and routing them to hot, warm and cold tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import vector as V

# fixed values: weights, thresholds and steps
SEMANTIC, TYPE, RECENCY, REDUNDANCY, DEPENDENCY = 0.3, 0.25, 0.2, 0.1, 0.15
HOT, WARM, HOT_SHARE = 0.7, 0.4, 0.6
REDUNDANT_SIMILARITY, REDUNDANT_STEP, NEIGHBOURS, NO_CHECK = 0.8, 0.3, 20, 0.95
LINK_STEP, LINK_CAP, CLOSURE_STEP, SWEEPS = 0.15, 0.5, 0.1, 10


def type_score(type_: Column) -> Column:
    return F.when(type_ == "constraint", 1.0).when(type_ == "instruction", 0.5).otherwise(0.2)


def link_counts(edges: DataFrame) -> DataFrame:
    """chunk_id, links: edges at either end; a self-loop counts at both."""
    return edges.select(F.explode(F.array("fromId", "toId")).alias("chunk_id")).where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.count("*").alias("links"))


def redundancy(chunks: DataFrame, order: str = "ord", item: str = "chunk_id", vector: str = "embedding", semantic: str = "semantic", group: str = "task_id") -> DataFrame:
    """`group`, `item`, redundancy (1 is best): 0.3 less for each close one among the first 20 other chunks.

    A chunk looks at the first 20 others in the order of `order`, so only the first 21 of a group are on the
    other side of the join. Chunks more than 0.95 similar to the task aren't checked.
    """
    numbered = chunks.withColumn("nr", F.row_number().over(Window.partitionBy(group).orderBy(order, item)))
    first = numbered.where(F.col("nr") <= NEIGHBOURS + 1).select(F.col(group), F.col("nr").alias("o_nr"), F.col(vector).alias("o_v"))
    pairs = numbered.where(F.col(semantic) <= NO_CHECK).join(first, group).where((F.col("nr") != F.col("o_nr")) & ((F.col("o_nr") <= NEIGHBOURS) | (F.col("nr") <= NEIGHBOURS)))
    close = pairs.where(F.round(V.cosine(F.col(vector), F.col("o_v")), 12) > REDUNDANT_SIMILARITY).groupBy(group, item).agg(F.count("*").alias("n"))
    penalty = F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) * REDUNDANT_STEP)
    return numbered.select(group, item).join(close, [group, item], "left").select(group, item, F.round(F.greatest(F.lit(0.0), 1 - penalty), 6).alias("redundancy"), (F.coalesce("n", F.lit(0)) > 0).alias("redundant"))


def score_chunks(rows: DataFrame, edges: DataFrame, now: Column, item: str = "chunk_id") -> DataFrame:
    """Adds score: semantic, type, recency, redundancy and links, weighted and clamped to 0..1.

    `rows` has semantic, redundancy, type and timestamp besides `item`. The closure boost is `closure_boost`.
    """
    counts = link_counts(edges).withColumnRenamed("chunk_id", item)
    linked = F.least(F.lit(LINK_CAP), F.coalesce("links", F.lit(0)) * LINK_STEP)
    total = SEMANTIC * F.col("semantic") + TYPE * type_score(F.col("type")) + RECENCY * V.recency(F.col("timestamp"), now) + REDUNDANCY * F.col("redundancy") + DEPENDENCY * linked
    return rows.join(counts, item, "left").withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 9)).drop("links")


def assign_tiers(scored: DataFrame, group: str = "task_id", item: str = "chunk_id") -> DataFrame:
    """Adds tier: by thresholds, with constraints and instructions promoted, redundant ones demoted, and hot capped.

    At most 60 % of a group (one at least) stay hot; of equal scores those that come first by `item` are demoted.
    """
    s, t = F.col("score"), F.col("type")
    base = F.when(s >= HOT, "hot").when(s >= WARM, "warm").otherwise("cold")
    up = F.when((base != "hot") & (((t == "constraint") & (s > 0.3)) | ((t == "instruction") & (s > 0.5))), "hot").otherwise(base)
    tier = F.when((up == "hot") & F.coalesce(F.col("redundant"), F.lit(False)), "warm").otherwise(up)
    return _cap_hot(scored.withColumn("tier", tier), group, item)


def _cap_hot(rows: DataFrame, group: str, item: str) -> DataFrame:
    hot = F.col("tier") == "hot"
    best = Window.partitionBy(group, hot).orderBy(F.desc("score"), F.desc(item))
    most = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy(group)) * HOT_SHARE))
    return rows.withColumn("_most", most).withColumn("_nr", F.row_number().over(best)).withColumn("tier", F.when(hot & (F.col("_nr") > F.col("_most")), "warm").otherwise(F.col("tier"))).drop("_most", "_nr")


def token_demotion(rows: DataFrame, max_tokens: int, group: str = "task_id", item: str = "chunk_id", tokens: str = "tokens") -> DataFrame:
    """Demotes the lowest-scored hot chunks until the hot tier has at most `max_tokens`."""
    hot = F.col("tier") == "hot"
    lowest = Window.partitionBy(group, hot).orderBy("score", item)
    before = F.coalesce(F.sum(tokens).over(lowest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(tokens).over(Window.partitionBy(group, hot))
    return rows.withColumn("_over", hot & (total - before > max_tokens)).withColumn("tier", F.when(F.col("_over"), "warm").otherwise(F.col("tier"))).drop("_over")


def _neighbours(links: list) -> dict[str, list[tuple[str, float]]]:
    near: dict[str, list[tuple[str, float]]] = {}
    for a, b, w in links:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    return near


def close_and_promote(scored: DataFrame, edges: DataFrame, group: str = "task_id", item: str = "chunk_id", max_tokens: int | None = None) -> DataFrame:
    """The order-dependent rules of a task: closure boost, tiers, promotion of neighbours of hot chunks, demotion.

    A task scores the few chunks of its candidate set (the prefilter keeps 50), so one group fits one worker;
    groups are taken in the order of `ord`. Returns the group, item, score and tier.
    """
    ends = scored.select(F.col(group).alias("g"), F.col(item).alias("end_id")).distinct()
    a, b = ends.select("g", F.col("end_id").alias("fromId")), ends.select(F.col("g").alias("g2"), F.col("end_id").alias("toId"))
    inner = edges.select("fromId", "toId", F.coalesce("weight", F.lit(0.5)).alias("weight")).join(a, "fromId").join(b, "toId").where("g = g2").groupBy("g").agg(F.sort_array(F.collect_list(F.struct("fromId", "toId", "weight"))).alias("links"))
    packed = scored.groupBy(F.col(group).alias("g")).agg(F.sort_array(F.collect_list(F.struct(F.col("ord").cast("long").alias("o"), F.col(item).cast("string").alias("i"), "type", F.col("score").alias("s"), F.coalesce("redundant", F.lit(False)).alias("r"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("t")))).alias("rows")).join(inner, "g", "left")
    kind = dict(scored.dtypes)[group]

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for g, rows, links in zip(batch["g"], batch["rows"], batch["links"]):
                near = _neighbours([(x["fromId"], x["toId"], x["weight"]) for x in (links if links is not None else [])])
                ids = [x["i"] for x in rows]
                score = {x["i"]: x["s"] for x in rows}
                for i in ids:
                    boost = sum(CLOSURE_STEP * w for other, w in near.get(i, []) if score.get(other, 0) > HOT)
                    if boost > 0:
                        score[i] = min(1.0, score[i] + boost)
                tier = {}
                for x in rows:
                    v, t = score[x["i"]], x["type"]
                    level = "hot" if v >= HOT else "warm" if v >= WARM else "cold"
                    if level != "hot" and (t == "constraint" and v > 0.3 or t == "instruction" and v > 0.5):
                        level = "hot"
                    tier[x["i"]] = "warm" if level == "hot" and x["r"] else level
                most = max(1, int(len(ids) * HOT_SHARE))

                def hot_ids() -> list[str]:
                    return [i for i in ids if tier[i] == "hot"]

                def cap() -> None:
                    hot = sorted(hot_ids(), key=lambda i: score[i])
                    for i in hot[: max(0, len(hot) - most)]:
                        tier[i] = "warm"

                cap()
                changed, sweeps = True, 0
                while changed and sweeps < SWEEPS and len(hot_ids()) < most:
                    changed, sweeps = False, sweeps + 1
                    for i in ids:
                        if tier[i] != "hot":
                            continue
                        for other, _ in near.get(i, []):
                            if len(hot_ids()) >= most:
                                break
                            if tier.get(other) == "warm":
                                tier[other], changed = "hot", True
                cap()
                if max_tokens is not None:
                    size = {x["i"]: x["t"] for x in rows}
                    total = sum(size[i] for i in hot_ids())
                    for i in sorted(hot_ids(), key=lambda i: score[i]):
                        if total <= max_tokens:
                            break
                        tier[i] = "warm"
                        total -= size[i]
                out += [(g, i, score[i], tier[i]) for i in ids]
            yield pd.DataFrame(out, columns=["g", "i", "score", "tier"])

    routed = packed.mapInPandas(run, f"g {kind}, i string, score double, tier string")
    return routed.select(F.col("g").alias(group), F.col("i").alias(item), F.round("score", 9).alias("score"), "tier")
