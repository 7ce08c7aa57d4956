"""From ranked candidates to a context: selection policy, budget, greedy fill, compression and the pack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as X

# fixed values: the selection policy
TARGETS = {"focused": {"narrow": 6_000, "moderate": 13_000, "broad": 18_000}, "broad": {"narrow": 16_000, "moderate": 28_000, "broad": 40_000}}
KEEP = {"focused": (3, 0.35, 2), "broad": (5, 0.2, 3)}
SCORE_FLOOR = 1 / (60 + 200)
COMPRESS_MOST, COMPRESS_SHARE, COMPRESS_LEAST = 5, 0.1, 50
HOT_EDGES = 3
DEFAULT_MAX_TOKENS = 200_000


def policy(queries: DataFrame, mode: str | Column = "focused", hard_budget: int | Column = DEFAULT_MAX_TOKENS, limit: str | None = None) -> DataFrame:
    """Adds the policy columns to a table with query_id, complexity and top_k.

    mode: focused, broad or exhaustive (no floor, no cap, the whole budget). `limit`: a column with the most
    candidates to return, by default top_k.
    """
    m = F.lit(mode) if isinstance(mode, str) else mode
    hard = F.lit(hard_budget).cast("long") if isinstance(hard_budget, int) else hard_budget.cast("long")
    target = F.when(m == "exhaustive", hard)
    for name, by in TARGETS.items():
        for scope, tokens in by.items():
            target = target.when((m == name) & (F.col("complexity") == scope), F.least(hard, F.lit(tokens).cast("long")))

    def pick(at: int, otherwise: object) -> Column:
        return F.when(m == "focused", F.lit(KEEP["focused"][at])).when(m == "broad", F.lit(KEEP["broad"][at])).otherwise(F.lit(otherwise))

    return queries.select(
        "*", m.alias("mode"), hard.alias("hard_budget"), target.alias("target_budget"), F.col(limit or "top_k").cast("int").alias("candidate_limit"), pick(0, 0).alias("min_keep"), pick(1, 0.0).alias("score_ratio"),
        F.when(m == "exhaustive", 0.0).otherwise(F.lit(SCORE_FLOOR)).alias("score_floor"), pick(2, None).cast("int").alias("max_per_path"),
    )


def select_candidates(ranked: DataFrame, chunks: DataFrame, policies: DataFrame) -> DataFrame:
    """Every ranked candidate with `selected` and, if it isn't, the reason: the input's rows with those columns.

    In the order of rank: unknown chunks and split parents go; the first min_keep are protected; the others must
    reach the score threshold and their path's cap; past the limit all are dropped. Something is always kept.
    """
    meta = chunks.select(F.col("id").alias("chunk_id"), F.coalesce(*(F.col(c).cast("string") for c in ("path", "source", "id"))).alias("path_key"), F.coalesce(F.get_json_object("metadata", "$.split") == "true", F.lit(False)).alias("parent"), F.lit(True).alias("known")).dropDuplicates(["chunk_id"])
    p = policies.select("query_id", "mode", "candidate_limit", "min_keep", "score_ratio", "score_floor", "max_per_path")
    rows = ranked.join(meta, "chunk_id", "left").join(p, "query_id")
    live = F.coalesce("known", F.lit(False)) & ~F.coalesce("parent", F.lit(False))
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    so_far = by_rank.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("live", live).withColumn("place", F.sum(F.col("live").cast("int")).over(so_far) - 1)
    rows = rows.withColumn("top", F.first(F.when(F.col("live"), F.col("score")), ignorenulls=True).over(by_rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    threshold = F.greatest(F.col("top") * F.col("score_ratio"), F.col("score_floor"))
    rows = rows.withColumn("threshold", threshold).withColumn("protected", F.col("live") & (F.col("place") < F.col("min_keep")))
    weak = ~F.col("protected") & (F.col("threshold") > 0) & (F.col("score") < F.col("threshold"))
    rows = rows.withColumn("passes", F.col("live") & ~weak)
    # a protected chunk counts for its path but isn't stopped by the cap; among the others the cap leaves the
    # first ones, so those counted so far are the protected ones and the others up to what is left
    per_path = Window.partitionBy("query_id", "path_key").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n_protected", F.sum((F.col("passes") & F.col("protected")).cast("int")).over(per_path)).withColumn("n_other", F.sum((F.col("passes") & ~F.col("protected")).cast("int")).over(per_path))
    capped = F.col("passes") & ~F.col("protected") & F.col("max_per_path").isNotNull() & (F.col("n_protected") + F.col("n_other") > F.col("max_per_path"))
    rows = rows.withColumn("capped", capped).withColumn("fits", F.col("passes") & ~F.col("capped"))
    rows = rows.withColumn("n_fits", F.sum(F.col("fits").cast("int")).over(so_far))
    chosen = F.col("fits") & (F.col("n_fits") <= F.col("candidate_limit"))
    whole = Window.partitionBy("query_id")
    rows = rows.withColumn("chosen", chosen).withColumn("any", F.max("chosen").over(whole))
    late = F.col("live") & (F.col("n_fits") - F.col("fits").cast("int") >= F.col("candidate_limit"))
    reason = (
        F.when(F.col("known").isNull(), "chunk not found").when(F.col("parent"), "split parent metadata chunk").when(late, "after candidate limit")
        .when(weak & (F.col("score") < F.col("score_floor")), "below absolute relevance floor").when(weak, F.concat(F.lit("below "), F.col("mode"), F.lit(" score threshold"))).when(F.col("capped"), "per-path candidate cap")
    )
    selected = F.col("chosen") | (~F.col("any") & F.col("live") & (F.col("place") == 0))
    return rows.select(*[ranked[c] for c in ranked.columns], selected.alias("selected"), F.when(~selected, reason).alias("dropped"))


def effective_budget(selected: DataFrame, tokens: DataFrame, policies: DataFrame) -> DataFrame:
    """query_id, budget: the target, or the tokens of the first min_keep if those are more; never over the hard one."""
    order = Window.partitionBy("query_id").orderBy("rank")
    p = policies.select("query_id", "mode", "hard_budget", "target_budget", "min_keep")
    first = selected.where("selected").withColumn("nr", F.row_number().over(order)).join(p, "query_id").where(F.col("nr") <= F.col("min_keep")).join(tokens.select("chunk_id", "tokens"), "chunk_id", "left")
    sums = first.groupBy("query_id").agg(F.sum("tokens").alias("protected_tokens"))
    budget = F.when(F.col("mode") == "exhaustive", F.col("hard_budget")).otherwise(F.least("hard_budget", F.greatest("target_budget", F.coalesce("protected_tokens", F.lit(0)))))
    return p.join(sums, "query_id", "left").select("query_id", budget.alias("budget"))


def fill_budget(candidates: DataFrame, budgets: DataFrame, collapse_siblings: bool = False) -> DataFrame:
    """Greedy fill: query_id, chunk_id, position, tokens, tier, reason, running.

    `candidates`: query_id, chunk_id, rank, tokens, hot (and parent_id to collapse siblings). Hot chunks go first
    in the order of rank, then the others; what doesn't fit is skipped and later, smaller chunks still go in, so
    this is a fold and no running sum. A skipped hot chunk is tried again in the second phase. Only ids and
    numbers are folded; a query's candidates are the few its ranking kept.
    """
    parent = F.col("parent_id").cast("string") if "parent_id" in candidates.columns else F.lit(None).cast("string")
    item = F.struct(F.col("rank").cast("long").alias("rank"), F.col("chunk_id").cast("string").alias("chunk_id"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"), F.coalesce(F.col("hot"), F.lit(False)).alias("hot"), parent.alias("parent_id"))
    lists = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items")).join(budgets.select("query_id", F.col("budget").cast("long").alias("budget")), "query_id")
    done_type = "array<struct<chunk_id:string,tokens:bigint,tier:string,reason:string,running:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<string>").alias("inside"), F.array().cast(done_type).alias("done"))

    def step(state: Column, it: Column, hot_phase: bool) -> Column:
        fits = state["total"] + it["tokens"] <= F.col("budget")
        sibling = F.lit(collapse_siblings and not hot_phase) & it["parent_id"].isNotNull() & F.array_contains(state["inside"], it["parent_id"])
        skip = F.array_contains(state["inside"], it["chunk_id"])
        take = fits & ~sibling
        reason = F.when(sibling, "parent already included").when(~fits, "hot but exceeds budget" if hot_phase else "exceeds remaining budget")
        tier = F.when(take, F.when(it["hot"], "hot").otherwise("warm"))
        entry = F.struct(it["chunk_id"].alias("chunk_id"), it["tokens"].alias("tokens"), tier.alias("tier"), reason.alias("reason"), F.when(take, state["total"] + it["tokens"]).otherwise(state["total"]).alias("running"))
        go = F.struct(
            F.when(take, state["total"] + it["tokens"]).otherwise(state["total"]).alias("total"),
            F.when(take, F.array_append(state["inside"], it["chunk_id"])).otherwise(state["inside"]).alias("inside"),
            F.concat(state["done"], F.array(entry)).cast(done_type).alias("done"),
        )
        return F.when(skip, state).otherwise(go)

    hot = F.aggregate(F.filter("items", lambda x: x["hot"]), start, lambda s, x: step(s, x, True))
    folded = lists.withColumn("first", hot).withColumn("state", F.aggregate("items", F.col("first"), lambda s, x: step(s, x, False)))
    return folded.select("query_id", F.posexplode("state.done").alias("position", "d")).select("query_id", "d.chunk_id", "position", "d.tokens", "d.tier", "d.reason", "d.running")


def budget_summary(filled: DataFrame, budgets: DataFrame) -> DataFrame:
    """query_id, n_selected, n_omitted, total_tokens, budget, utilization."""
    sums = filled.groupBy("query_id").agg(F.sum(F.col("tier").isNotNull().cast("long")).alias("n_selected"), F.sum(F.col("tier").isNull().cast("long")).alias("n_omitted"), F.coalesce(F.sum(F.when(F.col("tier").isNotNull(), F.col("tokens"))), F.lit(0)).alias("total_tokens"))
    return budgets.join(sums, "query_id", "left").select("query_id", F.coalesce("n_selected", F.lit(0)).alias("n_selected"), F.coalesce("n_omitted", F.lit(0)).alias("n_omitted"), F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"), "budget", F.when(F.col("budget") > 0, F.coalesce("total_tokens", F.lit(0)) / F.col("budget")).otherwise(0.0).alias("utilization"))


def deterministic_summary(chunks: DataFrame, doc: str = "id", text: str = "text", type_: str = "type") -> DataFrame:
    """`doc`, summary, tokens: constraints verbatim, else the first sentence and the code's signatures, cut to fit."""
    body = F.coalesce(F.col(text), F.lit(""))
    signatures = F.array_join(X.code_signatures(body), "; ")
    short = F.concat_ws(" | ", F.nullif(X.truncate(X.first_sentence(F.regexp_replace(body, r"\s+", " ")), 200), F.lit("")), F.nullif(X.truncate(signatures, 200), F.lit("")))
    summary = F.when(F.col(type_) == "constraint", body).otherwise(short)
    return chunks.select(F.col(doc), summary.alias("summary"), X.token_estimate(summary).alias("tokens"))


def compress_omitted(filled: DataFrame, budgets: DataFrame, scores: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summaries that still fit: query_id, chunk_id (with the suffix __compressed), tokens, tier, summary.

    Of the chunks omitted for want of room in the second phase the five best are tried in the order of score;
    both the estimate (a tenth, 50 at least) and the summary itself must fit.
    """
    used = filled.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("tier").isNotNull(), F.col("tokens"))), F.lit(0)).alias("used"))
    # a hot chunk skipped in the first phase has a second entry from the second
    left = filled.where("reason = 'exceeds remaining budget'").select("query_id", "chunk_id", "tokens").join(scores.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "chunk_id")
    tried = left.withColumn("nr", F.row_number().over(order)).where(F.col("nr") <= COMPRESS_MOST).join(summaries.select("chunk_id", "summary", F.col("tokens").cast("long").alias("summary_tokens")), "chunk_id")
    estimate = F.greatest(F.lit(COMPRESS_LEAST).cast("long"), F.floor(F.col("tokens") * COMPRESS_SHARE).cast("long"))
    item = F.struct("nr", "chunk_id", F.greatest(estimate, F.col("summary_tokens")).alias("need"), F.col("summary_tokens").alias("cost"))
    lists = tried.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items")).join(used, "query_id").join(budgets.select("query_id", "budget"), "query_id")
    start = F.struct(F.col("used").cast("long").alias("total"), F.array().cast("array<string>").alias("taken"))
    state = F.aggregate("items", start, lambda s, x: F.when(s["total"] + x["need"] <= F.col("budget"), F.struct((s["total"] + x["cost"]).alias("total"), F.array_append(s["taken"], x["chunk_id"]).alias("taken"))).otherwise(s))
    taken = lists.select("query_id", F.explode(state["taken"]).alias("chunk_id"))
    return taken.join(tried, ["query_id", "chunk_id"]).select("query_id", F.concat("chunk_id", F.lit("__compressed")).alias("chunk_id"), F.col("summary_tokens").alias("tokens"), F.lit("compressed").alias("tier"), "summary")


def context_pack(filled: DataFrame, chunks: DataFrame, queries: DataFrame, most_listed: int = 12) -> DataFrame:
    """query_id, pack: one Markdown text per query, its stable part (chunks in the order of path and id) first.

    The chunks' texts are only those that fit the budget; omitted ones are listed by id with their reason.
    """
    bodies = chunks.select(F.col("id").alias("chunk_id"), F.coalesce("path", "source").alias("where_"), "type", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["chunk_id"])
    inside = filled.where("tier IS NOT NULL").join(bodies, "chunk_id")
    section = F.concat(F.lit("## "), F.coalesce("where_", F.col("chunk_id")), F.lit(" ("), F.coalesce("type", F.lit("fact")), F.lit(", "), F.col("tier"), F.lit(")\n\n"), F.col("text"), F.lit("\n"))
    packs = inside.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("where_", F.lit("")).alias("w"), "chunk_id", section.alias("s")))).alias("sections"), F.sum("tokens").alias("tokens"))
    order = Window.partitionBy("query_id").orderBy("position")
    out = filled.where("tier IS NULL").withColumn("nr", F.row_number().over(order)).where(F.col("nr") <= most_listed)
    omitted = out.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("nr", F.concat(F.lit("- "), F.col("chunk_id"), F.lit(": "), F.col("reason")).alias("s")))).alias("left_out"))
    joined = queries.select("query_id", "text").join(packs, "query_id", "left").join(omitted, "query_id", "left")
    lines = lambda c: F.transform(F.col(c), lambda x: x["s"])
    pack = F.concat(
        F.lit("# Context\n\n"), F.coalesce(F.array_join(lines("sections"), "\n"), F.lit("")), F.lit("\n---\n\nTask: "), F.coalesce("text", F.lit("")), F.lit("\nTokens: "), F.coalesce("tokens", F.lit(0)).cast("string"), F.lit("\n"),
        F.coalesce(F.concat(F.lit("\nOmitted:\n"), F.array_join(lines("left_out"), "\n"), F.lit("\n")), F.lit("")),
    )
    return joined.select("query_id", pack.alias("pack"))
