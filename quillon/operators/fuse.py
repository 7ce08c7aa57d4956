"""Fusing ranked arms, boosting exact names, reranking, and the path for unreliable vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.functions import vector as V
from quillon.operators.arms import ranked, substring_hits
from quillon.plans.materialize import materialize, spread

# fixed values: constants of the fusion, and weights per strategy (structural, vector, fts, dependency, graph)
RRF_K = 60
VECTOR_FLOOR = 0.2
RERANK_WINDOW = 20
RERANK_WEIGHT = 3
TOP_CONTRIBUTION = 1 / (RRF_K + 1)
SOURCES = ("structural", "vector", "fts", "dependency", "graph")
WEIGHTS = {
    ("structural", True): (0.20, 0.70, 0.70, 0.03, 0.0),
    ("structural", False): (0.09, 0.0, 0.88, 0.03, 0.0),
    ("vector", True): (0.0, 1.0, 0.0, 0.0, 0.0),
    ("text", True): (0.0, 0.0, 1.0, 0.0, 0.0),
    ("graph", True): (0.0, 0.0, 0.0, 0.0, 1.0),
    ("hybrid", True): (0.0, 0.55, 0.40, 0.0, 0.05),
}
SPARSE_TERMS, SPARSE_EXPANSIONS = 40, 6
# fixed values: names in lower-case text, and where they are declared or stand as fields
NAME_IN_TEXT = r"([a-z0-9_$]+)"
VARIABLE_IN_TEXT = r"\b(?:const|let|var)\s+([a-z0-9_$]+)\s*(?::[^=;]+)?="
DECLARED_IN_TEXT = r"\b(?:function|class|interface|type|def)\s+([a-z0-9_$]+)"
FIELD_IN_TEXT = r"(?<![a-z0-9_$])([a-z0-9_$]+)\??\s*:"


def fusion_weights(strategy: str, reliable_vectors: bool = True) -> dict[str, float]:
    found = WEIGHTS.get((strategy, reliable_vectors)) or WEIGHTS.get((strategy, True))
    if found is None:
        raise ValueError(f"unknown strategy {strategy!r}")
    return dict(zip(SOURCES, found))


def fuse(arms: dict[str, DataFrame], weights: dict[str, float], vector_floor: float = VECTOR_FLOOR, score: str = "score") -> DataFrame:
    """Weighted reciprocal rank fusion: query_id, chunk_id, fused and the contribution of every source.

    An arm's rows below its floor are dropped before ranking (vector: `vector_floor`; structural and
    dependency: above 0), as are scores that aren't finite. Ties within an arm go to the smaller chunk_id.
    """
    parts = []
    for source, rows in arms.items():
        weight = weights.get(source, 0.0)
        if weight <= 0:
            continue
        s = F.col(score)
        fine = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
        if source == "vector":
            fine &= s >= vector_floor
        elif source in ("structural", "dependency"):
            fine &= s > 0
        order = Window.partitionBy("query_id").orderBy(F.desc(score), F.asc("chunk_id"))
        parts.append(rows.where(fine).select("query_id", "chunk_id", F.lit(source).alias("source"), (F.lit(weight) / (RRF_K + F.row_number().over(order))).alias("part")))
    if not parts:
        raise ValueError("no arm has a weight above 0")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    sums = [F.sum(F.when(F.col("source") == s, F.col("part"))).alias(s) for s in SOURCES]
    fused = every.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("fused"), *sums, F.array_sort(F.collect_set("source")).alias("sources"))
    return fused.withColumn("fused", F.round("fused", 12))


def exact_identifier_boost(fused: DataFrame, structural: DataFrame, planned: DataFrame) -> DataFrame:
    """Adds to fused chunks whose exact symbol or reference matches are among the query's strong identifiers."""
    strong = planned.select("query_id", F.transform("strong", X.normalize_symbol).alias("strong_norm"))
    named = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda n: F.array_contains("strong_norm", X.normalize_symbol(n)))
    marks = structural.join(strong, "query_id").select("query_id", "chunk_id", F.size(named("exact_symbols")).alias("n_symbols"), F.size(named("exact_references")).alias("n_references"))
    boost = F.when(F.col("n_symbols") > 0, TOP_CONTRIBUTION * (3 + F.least(F.lit(1.0), F.col("n_symbols") * 0.3))).otherwise(0.0) + F.when(F.col("n_references") > 0, TOP_CONTRIBUTION).otherwise(0.0)
    boosts = marks.select("query_id", "chunk_id", boost.alias("boost")).where("boost > 0")
    joined = fused.join(boosts, ["query_id", "chunk_id"], "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    return joined.withColumn("fused", F.round(F.col("fused") + F.col("boost"), 12)).withColumn("structural", F.when(F.col("boost") > 0, F.coalesce("structural", F.lit(0.0)) + F.col("boost")).otherwise(F.col("structural")))


def overlap_score(words: Column, low: Column) -> Column:
    """The deterministic reranker: occurrences of the query's words over their number; may exceed 1.

    Both are columns that are computed already (words: those of more than two characters, in lower case, as is the
    document), since what stands in a lambda is computed for every word.
    """
    # occurrences of a literal: the difference in length once it is removed
    count = F.aggregate(words, F.lit(0.0), lambda n, w: n + (F.length(low) - F.length(F.replace(low, w))) / F.length(w))
    return F.when(F.size(words) > 0, count / F.size(words)).otherwise(F.lit(0.0))


def rerank(ranked_: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = 50, query: str = "text", doc: str = "id", text: str = "text", path: str = "path") -> DataFrame:
    """The first `RERANK_WINDOW` of each query in the order of fused and reranker score, the rest as they are.

    `ranked_` has query_id, chunk_id, fused; the result adds final and rank. Text is joined for the window only.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), F.asc("chunk_id"))
    placed = ranked_.withColumn("fused_rank", F.row_number().over(order)).where(F.col("fused_rank") <= k)
    window = placed.where(F.col("fused_rank") <= RERANK_WINDOW)
    document = F.concat(F.coalesce(F.col(path), F.lit("")), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))
    inside = window.select("chunk_id").distinct()
    bodies = chunks.select(F.col(doc).alias("chunk_id"), F.lower(document).alias("body")).join(inside, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.max("body").alias("body"))
    asked = queries.select("query_id", F.filter(F.split(F.lower(F.coalesce(F.col(query), F.lit(""))), r"\s+"), lambda w: F.length(w) > 2).alias("asked"))
    met = spread(window.select("query_id", "chunk_id").join(bodies, "chunk_id").join(asked, "query_id"), "query_id", "chunk_id")
    scored = met.select("query_id", "chunk_id", overlap_score(F.col("asked"), F.col("body")).alias("overlap"))
    joined = placed.join(scored, ["query_id", "chunk_id"], "left")
    final = F.when(F.col("fused_rank") <= RERANK_WINDOW, F.col("fused") + F.coalesce("overlap", F.lit(0.0)) * TOP_CONTRIBUTION * RERANK_WEIGHT).otherwise(F.col("fused"))
    out = joined.withColumn("final", F.round(final, 12))
    last = Window.partitionBy("query_id").orderBy((F.col("fused_rank") > RERANK_WINDOW), F.desc("final"), F.asc("chunk_id"))
    return out.withColumn("rank", F.row_number().over(last))


def weighed_terms(planned: DataFrame) -> DataFrame:
    """query_id, pos, term, weight, origin: the terms that a query itself has."""
    s = F.col("structural")
    each = lambda a, w, origin: F.transform(a, lambda x: F.struct(X.normalize_symbol(x).alias("term"), F.lit(w).alias("weight"), F.lit(origin).alias("origin")))
    base = F.concat(s["tokens"], s["identifierParts"])
    stemmed = F.filter(F.transform(base, lambda t: F.struct(X.stem(t).alias("term"), F.lit(0.45).alias("weight"), F.lit("stem").alias("origin"), t.alias("of"))), lambda x: x["term"] != x["of"])
    stems_only = F.transform(stemmed, lambda x: F.struct(x["term"].alias("term"), x["weight"].alias("weight"), x["origin"].alias("origin")))
    every = F.concat(each(base, 0.55, "query"), stems_only, each(s["identifiers"], 0.8, "identifier"), each(F.flatten(F.transform(s["identifiers"], X.split_identifier)), 0.55, "identifier"))
    rows = planned.select("query_id", F.posexplode(every).alias("pos", "t")).select("query_id", "pos", "t.*").where((F.length("term") > 1) & ~F.col("term").isin(*X.SPARSE_STOP))
    # the heaviest entry of a term counts, of equals the first
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "term").orderBy(F.desc("weight"), "pos"))).where("r = 1").drop("r")


def sparse_terms(planned: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """query_id, term, weight, origin: the weighted terms of the path for unreliable vectors, at most 40 a query.

    With `stems` (see `stem_index`) up to six corpus names per term are added that share its stem.
    """
    return expanded_terms(weighed_terms(planned), stems)


def expanded_terms(best: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """The result of `sparse_terms` from that of `weighed_terms`."""
    if stems is not None:
        with_stem = best.withColumn("stem", X.stem(F.col("term"))).where(F.length("stem") >= 3).join(stems, "stem")
        related = F.slice(F.filter("terms", lambda t: t != F.col("term")), 1, SPARSE_EXPANSIONS)
        more = with_stem.select("query_id", F.col("pos").alias("pos"), F.explode(related).alias("term"), F.least(F.lit(0.5), F.col("weight") * 0.7).alias("weight"), F.lit("corpus").alias("origin"))
        more = more.where(~F.col("term").isin(*X.SPARSE_STOP))
        best = best.unionByName(more).withColumn("r", F.row_number().over(Window.partitionBy("query_id", "term").orderBy(F.desc("weight"), "pos"))).where("r = 1").drop("r")
    first = Window.partitionBy("query_id").orderBy(F.desc("weight"), "pos", "term")
    return best.withColumn("n", F.row_number().over(first)).where(F.col("n") <= SPARSE_TERMS).select("query_id", "term", "weight", "origin")


def path_intent(planned: DataFrame, chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, chunk_id, path_score: 5 per term in the file's name, else 8 per term in its folders, at most 12."""
    asked = intent_terms(planned, terms)
    base = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]+$", "")
    paths = chunks.select("path").where("path IS NOT NULL AND path <> ''").distinct()
    parts = paths.select("path", X.field_tokens(base).alias("names"), F.explode(F.array_distinct(X.field_tokens(F.col("path")))).alias("term"))
    points = parts.select("path", "term", F.when(F.array_contains("names", F.col("term")), 5).otherwise(8).alias("points"))
    sums = asked.join(points, "term").groupBy("query_id", "path").agg(F.least(F.lit(12.0), F.sum("points").cast("double")).alias("path_score"))
    return sums.join(chunks.select(F.col("id").alias("chunk_id"), "path").distinct(), "path").select("query_id", "chunk_id", "path_score")


def intent_terms(planned: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, term: what a query says of paths."""
    s = F.col("structural")
    own = F.concat(s["tokens"], s["identifierParts"], F.flatten(F.transform(s["identifiers"], X.split_identifier)))
    asked = planned.select("query_id", F.explode(F.transform(own, X.normalize_symbol)).alias("term")).unionByName(terms.where("weight >= 0.8 AND origin = 'identifier'").select("query_id", "term"))
    return asked.where((F.length("term") > 2) & ~F.col("term").isin(*X.PATH_INTENT_STOP)).distinct()


def sparse_fields(terms: DataFrame, chunks: DataFrame, symbols: DataFrame, references: DataFrame) -> DataFrame:
    """query_id, chunk_id, sparse_score: per term the best field, capped by the kind of that field, at most 12 (7).

    Distinct names, paths and targets meet the terms once, by equality of the name, a part or a substring (of four
    characters and more). The higher cap holds for chunks with an exactly named interface or type.
    """
    asked = terms.select("term").distinct()

    def fields(rows: DataFrame, key: list[str], norm: Column, exact: Column, exact_cap: Column, parts: Column, part: Column, partial: Column) -> DataFrame:
        """Candidates (key, term, points per weight, cap per weight) of a table of distinct names."""
        named = rows.select(*key, norm.alias("norm"), exact.alias("e"), exact_cap.alias("c"), parts.alias("ps"), part.alias("p"), partial.alias("s"))
        a = named.join(asked.withColumnRenamed("term", "norm"), "norm").select(*key, F.col("norm").alias("term"), F.col("e").alias("points"), F.col("c").alias("cap"))
        b = named.select(*key, "p", F.explode(F.array_distinct("ps")).alias("term")).join(asked, "term").select(*key, "term", F.col("p").alias("points"), F.lit(1.6).alias("cap"))
        c = substring_hits(named, [*key, "s"], "norm", asked, 4).select(*key, "term", F.col("s").alias("points"), F.lit(1.6).alias("cap"))
        return a.unionByName(b).unionByName(c)

    ids = chunks.select(F.col("id").alias("chunk_id"), "path").where("chunk_id IS NOT NULL").distinct()
    base = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]+$", "")
    paths = ids.select("path").where("path IS NOT NULL AND path <> ''").distinct()
    names = fields(paths, ["path"], X.normalize_symbol(base), F.lit(1.05), F.lit(1.6), X.field_tokens(base), F.lit(0.8), F.lit(0.18))
    folders = paths.select("path", X.normalize_symbol(F.col("path")).alias("norm"), F.array_distinct(X.field_tokens(F.col("path"))).alias("ps"), X.normalize_symbol(base).alias("base"))
    in_path = folders.select("path", F.explode("ps").alias("term")).join(asked, "term").select("path", "term", F.lit(0.42).alias("points"), F.lit(1.6).alias("cap"))
    part_of_path = substring_hits(folders, ["path"], "norm", asked, 4).select("path", "term", F.lit(0.18).alias("points"), F.lit(1.6).alias("cap"))
    segments = folders.where("base = 'index'").select("path", F.explode(F.filter("ps", lambda p: p != "index")).alias("part"))
    plural = asked.select("term", F.explode(F.array_distinct(F.array("term", F.concat("term", F.lit("s")), F.regexp_replace("term", "s$", ""), F.regexp_replace("term", "ies$", "y"), F.regexp_replace("term", "y$", "ies")))).alias("part"))
    index_files = segments.join(plural, "part").where(X.singular_plural_match(F.col("term"), F.col("part"))).select("path", "term", F.lit(1.1).alias("points"), F.lit(1.6).alias("cap"))
    by_path = names.unionByName(in_path).unionByName(part_of_path).unionByName(index_files).join(ids, "path").select("chunk_id", "term", "points", "cap")
    skey = ["name", "symbol_kind", "shown"]
    own = symbols.select(F.col("chunkId").alias("chunk_id"), "name", F.coalesce("kind", F.lit("")).alias("symbol_kind"), F.coalesce("isExported", F.lit(False)).alias("shown"), "signature").where("name IS NOT NULL AND chunk_id IS NOT NULL")
    out, contract = F.when(F.col("shown"), 1.1).otherwise(1.0), F.col("symbol_kind").isin("interface", "type")
    by_name = fields(own.select(*skey).distinct(), skey, X.normalize_symbol(F.col("name")), F.when(contract, 1.5 * 2.1).otherwise(1.2) * out, F.when(contract, 3.2).otherwise(2.4), F.transform(X.split_identifier(F.col("name")), X.normalize_symbol), 0.62 * out, 0.38 * out)
    by_symbol = by_name.join(own.select("chunk_id", *skey).distinct(), skey).select("chunk_id", "term", "points", "cap")
    signed = own.select("chunk_id", out.alias("out"), X.normalize_symbol(F.coalesce("signature", F.lit(""))).alias("sig")).where("sig <> ''")
    texts = substring_hits(signed.select("sig").distinct(), ["sig"], "sig", asked, 4)
    by_signature = signed.join(texts, "sig").select("chunk_id", "term", (0.22 * F.col("out")).alias("points"), F.lit(1.6).alias("cap"))
    targets = references.select("target").where("target IS NOT NULL").distinct()
    by_target = fields(targets, ["target"], X.normalize_symbol(F.col("target")), F.lit(0.42), F.lit(1.6), F.transform(X.split_identifier(F.col("target")), X.normalize_symbol), F.lit(0.24), F.lit(0.16))
    by_reference = by_target.join(references.select(F.col("chunkId").alias("chunk_id"), "target").distinct(), "target").select("chunk_id", "term", "points", "cap")
    every = by_path.unionByName(by_symbol).unionByName(by_signature).unionByName(by_reference)
    best = every.groupBy("chunk_id", "term").agg(F.max(F.struct("points", "cap")).alias("b")).select("chunk_id", "term", "b.points", "b.cap")
    scored = terms.join(best, "term").select("query_id", "chunk_id", F.least(F.col("points"), F.col("cap")).alias("each"), "weight", "cap")
    sums = scored.groupBy("query_id", "chunk_id").agg(F.sum(F.col("each") * F.col("weight")).alias("s"), F.max("cap").alias("cap"))
    return sums.select("query_id", "chunk_id", F.round(F.least(F.col("s"), F.when(F.col("cap") >= 3.2, 12.0).otherwise(7.0)), 6).alias("sparse_score"))


def strong_text(planned: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, text_score, exact: declarations 6.5, fields 2.2, occurrences 0.25 each up to 1.5.

    Names, declared names and field names are extracted from each text once, and meet the queries by equality.
    """
    asked = planned.select("query_id", F.explode(F.array_distinct(F.transform("strong", X.normalize_symbol))).alias("name")).where("name <> ''")
    wanted = asked.select("name").distinct()
    low = chunks.select(F.col("id").alias("chunk_id"), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    kinds = F.array(
        *(
            F.struct(F.lit(points).alias("points"), F.regexp_extract_all("low", F.lit(pattern), 1).alias("names"))
            for points, pattern in ((0.0, NAME_IN_TEXT), (6.5, VARIABLE_IN_TEXT), (6.5, DECLARED_IN_TEXT), (2.2, FIELD_IN_TEXT))
        )
    )
    found = low.select("chunk_id", F.explode(kinds).alias("k")).select("chunk_id", "k.points", F.explode("k.names").alias("name"))
    counts = found.join(wanted, "name", "left_semi").groupBy("chunk_id", "name").agg(F.sum((F.col("points") == 0).cast("long")).alias("n"), F.max("points").alias("points"))
    seen = counts.select("chunk_id", "name", (F.col("points") + F.least(F.lit(1.5), F.col("n") * 0.25)).alias("points"), (F.col("points") > 0).alias("exact"))
    return asked.join(seen, "name").groupBy("query_id", "chunk_id").agg(F.sum("points").alias("text_score"), F.max("exact").alias("exact"))


def deterministic_structural(planned: DataFrame, chunks: DataFrame, symbols: DataFrame, references: DataFrame, lexical: DataFrame, structural: DataFrame, stems: DataFrame | None = None, k: int = 50) -> DataFrame:
    """Ranking where vectors can't be trusted: scores are added, there is no rank fusion.

    Lexical scores are compressed; exact symbols and paths seed 12 and 10 plus their structural score; sparse
    fields, strong identifiers in the text and the intent of the path add theirs.
    """
    # each part reads the terms several times
    terms = materialize(sparse_terms(planned, stems))
    strong = planned.select("query_id", F.transform("strong", X.normalize_symbol).alias("strong_norm"), F.size("structural.pathFragments").alias("n_paths"))
    named = F.exists(F.coalesce("exact_symbols", F.array().cast("array<string>")), lambda n: F.array_contains("strong_norm", X.normalize_symbol(n)))
    seeds = structural.join(strong, "query_id").select("query_id", "chunk_id", F.when(named, 12 + F.col("structural_score")).when((F.col("n_paths") > 0) & F.col("path_exact"), 10 + F.col("structural_score")).alias("points")).where("points IS NOT NULL")
    parts = [
        lexical.select("query_id", "chunk_id", V.compress_lexical(F.col("score")).alias("points"), F.lit("fts").alias("source")),
        seeds.withColumn("source", F.lit("structural")),
        sparse_fields(terms, chunks, symbols, references).select("query_id", "chunk_id", F.col("sparse_score").alias("points"), F.lit("structural").alias("source")),
        strong_text(planned, chunks).select("query_id", "chunk_id", F.col("text_score").alias("points"), F.lit("structural").alias("source")),
        path_intent(planned, chunks, terms).select("query_id", "chunk_id", F.col("path_score").alias("points"), F.lit("structural").alias("source")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    parents = chunks.where(F.get_json_object("metadata", "$.split") == "true").select(F.col("id").alias("chunk_id")).distinct()
    sums = every.groupBy("query_id", "chunk_id").agg(F.round(F.sum("points"), 6).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))
    return ranked(sums.where("score > 0").join(parents, "chunk_id", "left_anti"), k)
