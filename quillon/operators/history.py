"""Tasks and changes from version control: listings of changed files, logs of commits, tasks without their symbols."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as X

# fixed values: separators of the log's records and fields, and what stands for a symbol of a kind
RECORD, FIELD = "\x1e", "\x1f"
STANDS_FOR = {"the relevant function": ("function", "method"), "the relevant component": ("class", "interface", "type", "struct", "enum", "trait"), "the relevant value": ("constant",)}
STANDS_FOR_ANY = "the relevant code"
#: The command whose output `commits` reads.
LOG_FORMAT = "--pretty=format:%x1e%H%x1f%s%x1f%b%x1f --name-only"


def name_status(listings: DataFrame, text: str = "text") -> DataFrame:
    """filePath, changeType, hunks (0) of listings with a status and a path a line; other statuses count as modified."""
    lines = listings.where(F.col(text).isNotNull()).select(F.explode(F.split(text, r"\r?\n")).alias("line")).select(F.split(F.trim("line"), r"\s+").alias("w")).where(F.size("w") >= 2)
    return lines.select(F.col("w")[1].alias("filePath"), F.when(F.col("w")[0] == "A", "added").when(F.col("w")[0] == "D", "deleted").otherwise("modified").alias("changeType"), F.lit(0).alias("hunks"))


def commits(logs: DataFrame, text: str = "text") -> DataFrame:
    """hash, subject, body, files of every record of logs written with `LOG_FORMAT`; incomplete records are left out."""
    records = logs.where(F.col(text).isNotNull()).select(F.explode(F.split(text, RECORD)).alias("r")).select(F.split("r", FIELD).alias("f")).where(F.size("f") >= 3)
    files = F.filter(F.transform(F.split(F.coalesce(F.get("f", F.lit(3)), F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda p: p != "")
    return records.select(F.trim(F.col("f")[0]).alias("hash"), F.trim(F.col("f")[1]).alias("subject"), F.regexp_replace(F.col("f")[2], r"\s+$", "").alias("body"), files.alias("files")).where("hash <> ''")


def _placeholder(kind: Column) -> Column:
    out = F
    for words, kinds in STANDS_FOR.items():
        out = out.when(kind.isin(*kinds), words)
    return out.otherwise(STANDS_FOR_ANY)


def _rewritten(tasks: DataFrame, defined: DataFrame, pattern: str, names: Callable[[Column], list[Column]], least: int, kept: Callable[[Column], Column]) -> DataFrame:
    """task_id, text, removed with every match of `pattern` that is defined or code-shaped by a placeholder.

    Texts are taken apart at the matches and put together again in their order; names meet the symbols by equality.
    """
    parts = tasks.select("task_id", "removed", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s)({pattern}|.)"), 1)).alias("pos", "part"))
    candidates = names(F.col("part"))
    marked = parts.withColumn("is_name", F.col("part").rlike(f"^(?:{pattern})$"))
    named = marked.select("*", *(F.when(F.col("is_name"), c).alias(f"n{i}") for i, c in enumerate(candidates)))
    for i in range(len(candidates)):
        named = named.join(defined.select(F.col("name").alias(f"d{i}"), F.col("kind").alias(f"k{i}")), F.col(f"n{i}") == F.col(f"d{i}"), "left")
    found = F.coalesce(*(F.col(f"d{i}") for i in range(len(candidates))))
    shaped = F.col("is_name") & X.code_shaped(F.col("n0")) & (F.length("n0") >= least)
    gone = F.when(found.isNotNull(), found).when(shaped, F.col("n0"))
    put = F.when(found.isNotNull(), _placeholder(F.coalesce(*(F.col(f"k{i}") for i in range(len(candidates)))))).when(shaped, STANDS_FOR_ANY).when(F.col("is_name"), kept(F.col("part"))).otherwise(F.col("part"))
    rows = named.select("task_id", "removed", "pos", put.alias("put"), gone.alias("gone"))
    whole = rows.groupBy("task_id", "removed").agg(F.array_sort(F.collect_list(F.struct("pos", "put", "gone"))).alias("all"))
    return whole.select("task_id", F.array_join(F.transform("all", lambda x: x["put"]), "").alias("text"), F.array_distinct(F.concat("removed", F.filter(F.transform("all", lambda x: x["gone"]), lambda g: g.isNotNull()))).alias("removed"))


def without_symbols(tasks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Tasks (task_id, text) with names of symbols (name, kind) and code-shaped words replaced: task_id, text, removed.

    First what stands in backticks, by its first name, then every other name, whole or by its first part. White space
    is squeezed. Of symbols with one name the first kind counts. Empty texts stay; null ones are left out.
    """
    defined = symbols.where("name IS NOT NULL").groupBy("name").agg(F.min("kind").alias("kind"))
    name = r"[A-Za-z_$][A-Za-z0-9_$]*"
    bare = lambda p: F.trim(F.regexp_replace(p, "`", ""))
    some = tasks.where("text IS NOT NULL AND text <> ''").select("task_id", "text", F.array().cast("array<string>").alias("removed"))
    spans = _rewritten(some, defined, r"`[^`]+`", lambda p: [F.regexp_extract(bare(p), r"^([A-Za-z0-9_$.]*)", 1)], 1, bare)
    every = _rewritten(spans, defined, rf"\b{name}(?:\.{name})*\b", lambda p: [p, F.regexp_extract(p, r"^([^.]+)", 1)], 4, lambda p: p)
    out = every.select("task_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), "removed")
    return out.unionByName(tasks.where("text = ''").select("task_id", "text", F.array().cast("array<string>").alias("removed")))
