"""The inverted index and the stem index, as plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as X


def postings(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """term, doc, tf. Repeated rows of a document count as one longer text."""
    return docs.select(F.col(doc).alias("doc"), F.explode(X.index_terms(F.coalesce(F.col(text), F.lit("")))).alias("term")).groupBy("term", "doc").agg(F.count("*").alias("tf"))


def doc_stats(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, dl: the number of terms of every document, 0 for empty ones."""
    return docs.select(F.col(doc).alias("doc"), F.size(X.index_terms(F.coalesce(F.col(text), F.lit("")))).alias("n")).groupBy("doc").agg(F.sum("n").alias("dl"))


def stem_index(symbols: DataFrame) -> DataFrame:
    """stem, terms: the distinct names and name parts of the symbols that share a stem, in order."""
    raw = symbols.select(F.explode(F.concat(F.array("name"), X.split_identifier(F.col("name")))).alias("raw"))
    named = raw.select(X.normalize_symbol(F.col("raw")).alias("term")).where((F.length("term") > 2) & ~F.col("term").isin(*X.SPARSE_STOP)).distinct()
    stemmed = named.withColumn("stem", X.stem(F.col("term"))).where(F.length("stem") >= 3)
    return stemmed.groupBy("stem").agg(F.sort_array(F.collect_set("term")).alias("terms"))
