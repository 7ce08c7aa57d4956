"""Queries of the training-data operators over the tables of a data folder, and the SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.abuse import flagged_rates, score_documents
from quillon.llm.leakage import leaks
from quillon.llm.neighbours import nearest, neighbour_pairs, usable_vectors
from quillon.llm.packing import count_tokens, pack
from quillon.llm.provenance import judge_files
from quillon.llm.secrets import credentials, redacted
from quillon.llm.splitting import split_oversized
from quillon.llm.topn import top_n
from quillon.operators.arms import ranked, vector
from quillon.plans.materialize import materialize


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_n(_table(spark, folder, "routing_history"), "taskText", "chunkId", "score", 10).select("taskText", "chunkId")


def p1_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return top_n(_table(spark, folder, "routing_history"), "taskText", "chunkId", "score", 10)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neighbour_pairs(nearest(_table(spark, folder, "chunk_embeddings")))
    return pairs.select(F.col("a").alias("chunkIdA"), F.col("b").alias("chunkIdB"))


def p2_recall(spark: SparkSession, folder: str) -> DataFrame:
    """The true neighbours of every chunk whose id ends in 0, against all, and whether at least nine in ten are found."""
    rows = _table(spark, folder, "chunk_embeddings")
    latest = materialize(usable_vectors(rows, "chunkId", "embedding", "model", "dimensions", "timestamp"))
    asked, exact = latest.where("right(item, 1) = '0'").withColumnRenamed("item", "query_id"), None
    for (model,) in latest.select("model").distinct().collect():
        own = F.col("model") == model
        near = vector(asked.where(own), latest.where(own), 6, query_vector="v", doc="item", vector_="v").where("score >= 0.85 AND query_id <> chunk_id")
        exact = near if exact is None else exact.unionByName(near)
    if exact is None:
        return spark.createDataFrame([(0, True)], "n_pairs long, recalled boolean")
    true = ranked(exact.select("query_id", "chunk_id", "score"), 5)
    found = nearest(rows).select(F.col("item").alias("query_id"), F.col("neighbour").alias("chunk_id"), F.lit(1).alias("hit"))
    both = true.join(found, ["query_id", "chunk_id"], "left").agg(F.count("*").alias("n_pairs"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_found"))
    return both.select("n_pairs", (F.col("n_found") >= 0.9 * F.col("n_pairs")).alias("recalled"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return judge_files(_table(spark, folder, "chunks")).where("machine_made").select("path").distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = split_oversized(_table(spark, folder, "chunks"))
    return pieces.where("pieceIndex = 0").select(F.col("parentId").alias("id")).distinct()


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces with the fields of a chunk; rows repeated in the table give their pieces once."""
    keep = ("source", "type", "path", "language")
    pieces = split_oversized(_table(spark, folder, "chunks").dropDuplicates(["id", "text"]), keep=keep)
    ident = F.sha2(F.concat_ws("|", "parentId", F.col("pieceIndex").cast("string"), "pieceText"), 256)
    return pieces.select(ident.alias("id"), *keep, "parentId", "pieceIndex", "pieceCount", "startChar", "overlapChars", "tokensEstimate", F.col("pieceText").alias("text"))


def p5_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """Per oversized text what its pieces make together: their hash without overlaps, and whether each fits and overlaps as asked."""
    texts = _table(spark, folder, "chunks").dropDuplicates(["id", "text"]).withColumn("textHash", F.sha2("text", 256))
    pieces = split_oversized(texts, keep=("textHash",))
    own = F.substring("pieceText", F.col("overlapChars") + 1, F.length("pieceText"))
    per = pieces.withColumn("own", own).groupBy("parentId", F.col("textHash")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pieceIndex", "own"))), lambda x: x["own"]), "").alias("text"),
        F.max(F.ceil(F.length("pieceText") / 4)).alias("most"), F.min(F.when(F.col("pieceIndex") > 0, F.col("overlapChars"))).alias("least_overlap"), F.max("overlapChars").alias("most_overlap"), F.count("*").alias("n"), F.max("pieceCount").alias("count"),
    )
    return per.select(F.col("parentId").alias("id"), F.left(F.sha2("text", 256), F.lit(16)).alias("hash"), F.length("text").cast("long").alias("chars"), (F.col("most") <= 2000).alias("fits"), ((F.col("least_overlap") == 800) & (F.col("most_overlap") == 800)).alias("overlaps"), (F.col("n") == F.col("count")).alias("complete"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return credentials(_table(spark, folder, "chunks")).select("id", "lineNo").distinct()


def p6_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redacted(_table(spark, folder, "chunks")).where("n_redacted > 0")


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    counted = materialize(count_tokens(_table(spark, folder, "documents")))
    return pack(counted).select("container", "doc_id", "piece", "offset", "tokens")


def p7_checked(spark: SparkSession, folder: str) -> DataFrame:
    """One row of what every filling must keep: texts placed, capacity, each piece once and whole, division only of the oversized."""
    counted = materialize(count_tokens(_table(spark, folder, "documents")))
    packed = materialize(pack(counted))
    full = packed.groupBy("container").agg(F.sum("tokens").alias("t")).agg((F.max("t") <= 2048).alias("within_capacity"))
    per = packed.groupBy("doc_id").agg(F.sum("tokens").alias("placed"), F.count("*").alias("pieces"), F.countDistinct("piece", "offset").alias("different"))
    both = counted.where("tokens > 0").join(per, "doc_id", "full").agg(
        F.count("placed").alias("n_placed"), F.bool_and(F.col("placed").eqNullSafe(F.col("tokens")) & (F.col("pieces") == F.col("different"))).alias("once"), F.bool_and((F.col("pieces") == 1) | (F.col("tokens") > 2048)).alias("only_oversized_divided")
    )
    return both.join(F.broadcast(full))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(_table(spark, folder, "documents"), _table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(_table(spark, folder, "documents")).where("flagged").select("doc_id").distinct()


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    return flagged_rates(score_documents(_table(spark, folder, "documents"), keep=("source",)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p1_ranked, p2_found, p2_recall, p3_found, p5_found, p5_pieces, p5_rejoined, p6_found, p6_redacted, p7_packed, p7_checked, p8_found, p9_found, p9_rates]
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    best = """WITH best AS (SELECT taskText, chunkId, max(score) AS score FROM routing_history
        WHERE taskText IS NOT NULL AND chunkId IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY taskText, chunkId),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY taskText ORDER BY score DESC, chunkId) AS rank FROM best)"""
    return {
        "p1_found": best + " SELECT taskText, chunkId FROM ranked WHERE rank <= 10",
        "p1_ranked": best + " SELECT taskText, chunkId, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10",
        "p2_recall": """WITH usable AS (SELECT chunkId, model, CAST(embedding AS DOUBLE[]) AS v, timestamp FROM chunk_embeddings WHERE chunkId IS NOT NULL AND model IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = dimensions AND dimensions > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
  latest AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY chunkId ORDER BY timestamp DESC NULLS LAST, model DESC, v DESC) = 1),
  sims AS (SELECT a.chunkId AS a, b.chunkId AS b, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM latest a JOIN latest b ON right(a.chunkId, 1) = '0' AND a.model = b.model AND len(a.v) = len(b.v) AND a.chunkId <> b.chunkId),
  near AS (SELECT * FROM sims WHERE s >= 0.85 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
 SELECT CAST(count(*) AS BIGINT) AS n_pairs, true AS recalled FROM near""",
        "p5_rejoined": "SELECT id, left(sha256(text), 16) AS hash, CAST(length(text) AS BIGINT) AS chars, true AS fits, true AS overlaps, true AS complete FROM (SELECT DISTINCT id, text FROM chunks) WHERE ceil(length(text) / 4.0) > 2000",
        "p7_checked": "SELECT CAST(count(*) AS BIGINT) AS n_placed, true AS once, true AS only_oversized_divided, true AS within_capacity FROM documents WHERE length(text) > 0",
        "p5_found": "SELECT DISTINCT id FROM chunks WHERE ceil(length(text) / 4.0) > 2000",
    }
