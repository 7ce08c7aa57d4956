"""Compressing the chunks of a task into a summary, without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as X

# fixed values: sizes, and words that are no keywords
KEYWORDS, FACTS, SIGNATURES, FACT_CHARS = 8, 8, 8, 220
KEYWORD_STOP = "that this with from have been were will would could should than then into when where which their there these those your about also only".split()


def keywords(texts: DataFrame, task: str = "task_id", text: str = "text", most: int = KEYWORDS) -> DataFrame:
    """task, keywords: the most frequent words of four letters and more; ties by word."""
    words = texts.select(F.col(task), F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([a-z][a-z0-9_]{3,})"), 1)).alias("w")).where(~F.col("w").isin(*KEYWORD_STOP))
    counts = words.groupBy(task, "w").agg(F.count("*").alias("n")).withColumn("nr", F.row_number().over(Window.partitionBy(task).orderBy(F.desc("n"), "w"))).where(F.col("nr") <= most)
    return counts.groupBy(task).agg(F.transform(F.array_sort(F.collect_list(F.struct("nr", "w"))), lambda x: x["w"]).alias("keywords"))


def extractive_summary(chunks: DataFrame, task: str = "task_id", item: str = "id", most: int = FACTS) -> DataFrame:
    """task, summary, facts, constraints, sourceIds, original_tokens, tokens.

    Constraints stay verbatim; of the others the first sentence is a fact and declarations are signatures, in
    the order of rank, up to the limits, which are taken before anything is gathered.
    """
    rows = chunks.withColumn("flat", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))
    hard = F.col("type") == "constraint"
    order = Window.partitionBy(task, hard).orderBy("rank", item)
    placed = rows.withColumn("nr", F.row_number().over(order))
    sums = rows.groupBy(task).agg(F.count("*").alias("n"), F.sum(X.token_estimate(F.col("text"))).alias("original_tokens"))
    told = placed.where(F.col("nr") <= most).select(task, item, "nr", hard.alias("hard"), F.when(hard, F.col("flat")).otherwise(X.truncate(X.first_sentence(F.col("flat")), FACT_CHARS)).alias("said"), F.slice(X.code_signatures(F.coalesce("text", F.lit(""))), 1, SIGNATURES).alias("sigs"))

    def texts(which: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(which & (F.col("said") != ""), F.struct("nr", "said")))), lambda x: x["said"])

    parts = told.groupBy(task).agg(texts(F.col("hard")).alias("constraints"), texts(~F.col("hard")).alias("facts"), F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nr", "sigs"))), lambda x: x["sigs"]))), 1, SIGNATURES).alias("signatures"), F.array_sort(F.collect_set(item)).alias("sourceIds"))
    joined = sums.join(parts, task, "left").join(keywords(chunks, task), task, "left")

    def section(title: str, c: str, joint: str = "\n- ") -> Column:
        return F.when(F.size(c) > 0, F.concat(F.lit(f"\n{title}:{joint}"), F.array_join(c, joint))).otherwise(F.lit(""))

    summary = F.concat(F.lit("Context ("), F.col("n").cast("string"), F.lit(" chunks)"), section("Keywords", "keywords", " "), section("Constraints", "constraints"), section("Facts", "facts"), section("Code", "signatures"))
    return joined.select(task, summary.alias("summary"), "facts", "constraints", "sourceIds", "original_tokens", X.token_estimate(summary).alias("tokens"))


def llm_sections(responses: DataFrame, item: str, text: str = "text", headings: tuple[str, ...] = ("SUMMARY", "FACTS", "CONSTRAINTS")) -> DataFrame:
    """Bullets under each heading of a model's answer, up to the next heading in capitals."""
    rows = responses.select(F.col(item), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = [F.filter(F.transform(F.split(F.regexp_extract("t", rf"(?s)(?:^|\n){h}:[ \t]*\n?(.*?)(?=\n[A-Z][A-Z ]+:|\z)", 1), "\n"), lambda line: F.trim(F.regexp_replace(line, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))), lambda s: s != "").alias(h.lower()) for h in headings]
    return rows.select(item, *found)


def compression_ratio(original: Column, compressed: Column) -> Column:
    """Words-based tokens of the compressed over those of the original text."""
    return F.try_divide(X.word_token_estimate(compressed).cast("double"), X.word_token_estimate(original).cast("double"))
