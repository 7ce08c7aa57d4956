"""The dependency graph: finding edges in chunks, and walking it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans.materialize import materialize

# fixed values: weights of the rules
REFERENCES, CONTAINS, SUMMARIZES, OVERRIDES = 0.7, 0.9, 0.8, 0.6
#: A hop is joined again with what it finds at most so often.
MOST_HOPS = 10


def _mentions(chunks: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """chunk_id and `name` for every text that contains a name, without comparing each pair.

    Names are paths or ids. The longest piece of letters, digits, - and _ between separators that a name has is
    its key; texts are cut into the same pieces (and those beginning or ending within a longer one can't match
    a whole piece at the name's inside), pieces join by equality, and `contains` decides. Names of one or two pieces
    have the last four characters of the last one as their key, shorter ones their first three; texts are cut into
    these too. Only keys are shuffled: the text is fetched for what met, and a text's copy counts as the text.
    """
    piece = r"[A-Za-z0-9_\-]+"
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(f"({piece})"), 1))
    grams = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - (n - 1))), lambda i: F.substring(w, i, F.lit(n)))
    pieces = F.regexp_extract_all(F.col(name), F.lit(f"({piece})"), 1)
    # only an inner piece is bounded by separators within the name itself; first and last may be cut in a text
    inner = F.when(F.size(pieces) > 2, F.slice(pieces, 2, F.size(pieces) - 2))
    longest = F.array_sort(inner, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0)))[0]
    last = F.right(F.regexp_extract(name, r"([A-Za-z0-9_\-]+)[^A-Za-z0-9_\-]*$", 1), F.lit(4))
    how = F.when(inner.isNotNull(), F.struct(F.lit("piece").alias("how"), longest.alias("key"))).when(F.length(last) == 4, F.struct(F.lit("gram").alias("how"), last.alias("key"))).otherwise(F.struct(F.lit("start").alias("how"), F.left(name, F.lit(3)).alias("key")))
    keyed = materialize(names.select(name).where(F.col(name).isNotNull() & (F.col(name) != "")).distinct().select(name, how.alias("k")).select(name, "k.how", "k.key"))
    texts = chunks.select(F.col("id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text")).where("chunk_id IS NOT NULL").withColumn("copy", F.xxhash64("text"))
    cuts = {"piece": words(F.col("text")), "gram": F.flatten(F.transform(words(F.col("text")), lambda w: grams(w, 4))), "start": F.flatten(F.array(*(grams(F.col("text"), n) for n in (1, 2, 3))))}
    present = [r.how for r in keyed.select("how").distinct().collect()]
    met = None
    for kind in present:
        own = texts.select("chunk_id", "copy", F.explode(F.array_distinct(cuts[kind])).alias("key")).join(keyed.where(F.col("how") == kind).select(name, "key"), "key").select("chunk_id", "copy", name)
        met = own if met is None else met.unionByName(own)
    if met is None:
        return texts.select("chunk_id", F.lit(None).cast("string").alias(name)).limit(0)
    return met.distinct().join(texts.dropDuplicates(["chunk_id", "copy"]), ["chunk_id", "copy"]).where(F.col("text").contains(F.col(name))).select("chunk_id", name).distinct()


def find_edges(chunks: DataFrame) -> DataFrame:
    """fromId, toId, type, weight by four rules: texts naming a path, parents, summaries naming ids, constraints
    naming a path. An edge of a type is found once; a chunk has none of the naming rules to itself."""
    ids = chunks.select(F.col("id").alias("toId"), "path").where("toId IS NOT NULL")
    types = chunks.select(F.col("id").alias("fromId"), "type").where("fromId IS NOT NULL").distinct()
    by_path = _mentions(chunks, chunks, "path").join(ids.where("path IS NOT NULL AND path <> ''").distinct(), "path").select(F.col("chunk_id").alias("fromId"), "toId").where("fromId <> toId")

    def edge(rows: DataFrame, type_: str, weight: float) -> DataFrame:
        return rows.select("fromId", "toId", F.lit(type_).alias("type"), F.lit(weight).alias("weight"))

    naming = edge(by_path, "references", REFERENCES)
    overriding = edge(by_path.join(types.where("type = 'constraint'"), "fromId", "left_semi"), "overrides", OVERRIDES)
    parents = chunks.select(F.col("parentId").alias("fromId"), F.col("id").alias("toId")).where("fromId IS NOT NULL AND toId IS NOT NULL").join(types.select("fromId").distinct(), "fromId", "left_semi")
    summaries = chunks.where("type = 'summary'")
    summing = _mentions(summaries, chunks.select("id"), "id")
    by_id = summing.select(F.col("chunk_id").alias("fromId"), F.col("id").alias("toId")).where("fromId <> toId")
    every = naming.unionByName(edge(parents, "contains", CONTAINS)).unionByName(edge(by_id, "summarizes", SUMMARIZES)).unionByName(overriding)
    return every.dropDuplicates(["fromId", "toId", "type"])


def incident(edges: DataFrame) -> DataFrame:
    """a, b for either direction of every edge: two equi-joins instead of a join on either end."""
    both = edges.select("fromId", "toId").where("fromId IS NOT NULL AND toId IS NOT NULL")
    return both.select(F.col("fromId").alias("a"), F.col("toId").alias("b")).unionByName(both.select(F.col("toId").alias("a"), F.col("fromId").alias("b"))).distinct()


def expand(seeds: DataFrame, edges: DataFrame, hops: int, most: int | Column | None = None) -> DataFrame:
    """Breadth-first from query_id, chunk_id over edges in either direction: query_id, chunk_id, hop, score.

    score is 1 / hop; seeds aren't returned. `most` keeps that many per query, nearest first, ties by chunk_id.
    Every hop is written to the checkpoint folder, so plans don't grow with the hops.
    """
    if not 0 <= hops <= MOST_HOPS:
        raise ValueError(f"hops must be from 0 to {MOST_HOPS}")
    near = incident(edges)
    visited = seeds.select("query_id", "chunk_id").distinct().withColumn("hop", F.lit(0))
    frontier = visited
    for hop in range(1, hops + 1):
        step = frontier.join(near, frontier["chunk_id"] == near["a"]).select("query_id", F.col("b").alias("chunk_id")).distinct().join(visited.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        frontier = materialize(step.withColumn("hop", F.lit(hop)))
        visited = visited.unionByName(frontier)
    from quillon.operators.arms import ranked

    found = visited.where("hop > 0").withColumn("score", F.when(F.col("hop") > 0, 1 / F.greatest(F.lit(1), F.col("hop"))))
    return ranked(found, most).drop("rank") if most is not None else found


def legitimacy(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """chunk_id, inbound: over its exported symbols, the sum of other chunks that refer to them by name."""
    exported = symbols.where("isExported").select(F.col("chunkId").alias("chunk_id"), F.col("normalizedName").alias("name")).where("name <> ''").distinct()
    users = references.select(F.col("chunkId").alias("user"), F.regexp_replace(F.regexp_extract("normalizedTarget", r"([^.:]*)$", 1), r"[^a-z0-9_$]", "").alias("name")).where("name <> ''").distinct()
    # users are counted per name first, so a name used everywhere makes no pairs
    totals = users.groupBy("name").agg(F.count("*").alias("n"))
    own = exported.join(users, (exported["name"] == users["name"]) & (exported["chunk_id"] == users["user"]), "left_semi").withColumn("own", F.lit(1))
    counted = exported.join(totals, "name", "left").join(own, ["chunk_id", "name"], "left")
    return counted.groupBy("chunk_id").agg(F.sum(F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("inbound"))
