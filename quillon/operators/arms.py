"""Retrieval arms. Each takes a table of queries and a corpus and gives ranked rows for all queries at once.

Results have query_id, chunk_id, score and rank (from 1, ties by chunk_id). The tables of queries are small next
to the corpus, but no size is assumed: joins are declared and the optimizer chooses, by size, what to broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillon.functions import text as X
from quillon.functions import vector as V
from quillon.operators.index import doc_stats, postings
from quillon.plans.materialize import materialize, widen
from quillon.plans.planner import bound, compound, locates

# fixed values: constants of the rankings
FTS_K1, FTS_B = 1.2, 0.75
LEXICAL_TEXT, LEXICAL_PATH = 2, 3
DEPENDENCY_CAP, MOST_REASONS = 0.12, 6
#: Depth of every arm, or the query's own if that is more.
DEPTH = 50


def ranked(scored: DataFrame, k: int | Column, score: str = "score") -> DataFrame:
    """The `k` best of every query; ties go to the smaller chunk_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), F.asc("chunk_id"))
    limit = F.lit(k) if isinstance(k, int) else k
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


#: Most distinct terms that are handed to the scan of a stored index as a filter.
TERM_FILTER = 2000


def full_text(queries: DataFrame, docs: DataFrame, k: int = DEPTH, query_id: str = "query_id", query: str = "text", doc: str = "id", text: str = "text", index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """BM25 over the words of the documents; every term of the query counts as often as it stands there.

    Only postings of terms that some query has are kept before anything is shuffled by document. `index` gives
    stored postings (doc, term, tf) and lengths (doc, dl), so that no text is read; postings lie sorted by term, and
    up to `TERM_FILTER` terms are a filter of the scan.
    """
    terms = queries.select(F.col(query_id).alias("query_id"), F.explode(X.fts_terms(F.coalesce(F.col(query), F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    wanted = terms.select("term").distinct()
    have, stats = index if index is not None else (postings(docs, doc, text), doc_stats(docs, doc, text))
    corpus = stats.agg(F.count("*").alias("total"), F.avg("dl").alias("mean_dl"))
    if index is not None:
        few = [r.term for r in wanted.limit(TERM_FILTER + 1).collect()]
        have = have.where(F.col("term").isin(few)) if len(few) <= TERM_FILTER else have
    found = have.join(wanted, "term", "left_semi")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.col("tf") * (FTS_K1 + 1) / (F.col("tf") + FTS_K1 * (1 - FTS_B + FTS_B * F.col("dl") / F.col("mean_dl")))
    weighed = found.join(stats, "doc").join(F.broadcast(corpus)).select("doc", "term", weight.alias("w"))
    scored = terms.join(df.join(F.broadcast(corpus.select("total"))).select("term", V.fts_idf(F.col("total"), F.col("df")).alias("idf")), "term").join(weighed, "term")
    sums = scored.groupBy("query_id", F.col("doc").alias("chunk_id")).agg(F.sum(F.col("times") * F.col("idf") * F.col("w")).alias("score"))
    return ranked(sums.withColumn("score", F.round("score", 9)), k)


def term_hits(terms: DataFrame, chunks: DataFrame, doc: str = "id", text: str = "text", path: str = "path") -> DataFrame:
    """chunk_id, term, in_path for every term found as a substring of a chunk's text or path.

    Terms consist of name characters, so they lie within a word. Up to `TERMS_HELD` terms are held by the tasks, which
    look them up in each text's words; more are searched in the vocabulary, the distinct words of the corpus, and words
    meet the chunks by equality. No text is searched for a term.
    """
    wanted = terms.select("term").where("term <> ''").distinct()
    held = _held(wanted)
    if held is not None:
        low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
        rows = widen(chunks.select(F.col(doc).alias("chunk_id"), low(text).alias("low"), low(path).alias("low_path")))
        kind = rows.schema["chunk_id"].dataType
        found = rows.mapInArrow(_terms_of(held), f"chunk_id {kind.simpleString()}, term string, in_path boolean")
        return found.groupBy("chunk_id", "term").agg(F.max("in_path").alias("in_path"))
    word = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"([a-z0-9_$]+)"), 1))
    laid = F.array(F.struct(word(text).alias("words"), F.lit(False).alias("in_path")), F.struct(word(path).alias("words"), F.lit(True).alias("in_path")))
    words = chunks.select(F.col(doc).alias("chunk_id"), F.explode(laid).alias("w")).select("chunk_id", "w.in_path", F.explode("w.words").alias("word"))
    within = substring_hits(words.select("word").distinct(), ["word"], "word", wanted, 1)
    return words.join(within, "word").groupBy("chunk_id", "term").agg(F.max("in_path").alias("in_path"))


def lexical(queries: DataFrame, chunks: DataFrame, k: int = DEPTH, query_id: str = "query_id", query: str = "text", doc: str = "id", text: str = "text", path: str = "path") -> DataFrame:
    """Distinct terms as substrings: `LEXICAL_TEXT` each in text or path, `LEXICAL_PATH` more in the path."""
    terms = materialize(queries.select(F.col(query_id).alias("query_id"), F.explode(X.lexical_terms(F.coalesce(F.col(query), F.lit("")))).alias("term")))
    hits = term_hits(terms, chunks, doc, text, path)
    points = hits.select("chunk_id", "term", (F.lit(LEXICAL_TEXT) + F.when(F.col("in_path"), LEXICAL_PATH).otherwise(0)).alias("points"))
    sums = terms.join(points, "term").groupBy("query_id", "chunk_id").agg(F.sum("points").cast("double").alias("score"))
    return ranked(sums, k)


def merged_text(fts: DataFrame, lexical_: DataFrame, k: int = DEPTH) -> DataFrame:
    """Both text arms as one: raw scores are added; only the order counts afterwards."""
    both = fts.select("query_id", "chunk_id", "score").unionByName(lexical_.select("query_id", "chunk_id", "score"))
    return ranked(both.groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score")), k)


#: Query vectors, and stored vectors of a batch, that meet at a time.
QUERY_BLOCK, ROW_BLOCK = 4096, 1024


def _nearest(block: dict[int, tuple[list, np.ndarray]], k: int, kinds: list[pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function over (chunk_id, v): of a partition's rows the `k` best of every query of the block, and ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            vectors, ids = batch.column("v"), np.array(batch.column("chunk_id").to_pylist(), dtype=object)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
            rows = ((d, part) for d in set(np.unique(sizes).tolist()) & block.keys() for at in [np.flatnonzero(sizes == d)] for part in np.array_split(at, -(-len(at) // ROW_BLOCK)))
            for d, at in rows:
                x = flat[starts[at][:, None] + np.arange(d)]
                length = np.linalg.norm(x, axis=1, keepdims=True)
                score = np.round(block[d][1] @ np.divide(x, length, out=np.zeros_like(x), where=length > 0).T, 6) + 0.0
                score[np.isnan(score)] = 0.0
                held = best.get(d)
                if held:
                    score, own = np.concatenate([held[0], score], axis=1), np.concatenate([held[1], np.broadcast_to(ids[at], (len(score), len(at)))], axis=1)
                else:
                    own = np.broadcast_to(ids[at], score.shape)
                if score.shape[1] > 4 * k:
                    score, own = _cut(score, own, k)
                best[d] = (score, own)
        for d, (score, own) in best.items():
            score, own = _cut(score, own, k) if score.shape[1] > k else (score, own)
            q = np.repeat(np.arange(len(score)), score.shape[1])
            names = block[d][0]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q], kinds[0]), pa.array(own.reshape(-1).tolist(), kinds[1]), pa.array(score.reshape(-1))], ["query_id", "chunk_id", "score"])

    return run


def _cut(score: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The `k` best of every row; ties go to the smaller id."""
    keep = np.empty((len(score), k), dtype=np.int64)
    for r in range(len(score)):
        worth = np.flatnonzero(score[r] >= np.partition(score[r], score.shape[1] - k)[score.shape[1] - k])
        keep[r] = sorted(worth, key=lambda c: (-score[r, c], own[r, c]))[:k]
    return np.take_along_axis(score, keep, axis=1), np.take_along_axis(own, keep, axis=1)


def vector(queries: DataFrame, embeddings: DataFrame, k: int = DEPTH, query_id: str = "query_id", query_vector: str = "embedding", doc: str = "chunkId", vector_: str = "embedding") -> DataFrame:
    """Exact cosine of every query vector with every stored vector of its length, rounded to 6 decimals.

    Queries meet the stored vectors in blocks of `QUERY_BLOCK`, as one matrix product per batch, and only the `k`
    best of every query leave a partition. Vectors without length, and those with parts that are no numbers, have
    a similarity of 0.
    """
    stored = embeddings.select(F.col(doc).alias("chunk_id"), F.col(vector_).cast("array<double>").alias("v")).where("v IS NOT NULL AND chunk_id IS NOT NULL")
    asked = materialize(queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("q"), F.monotonically_increasing_id().alias("nr")).where("q IS NOT NULL"))
    kinds = [asked.schema["query_id"].dataType, stored.schema["chunk_id"].dataType]
    total = asked.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    found = None
    for n in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("nr"), F.lit(blocks)) == n).select("query_id", "q").collect()
        block: dict[int, tuple[list, np.ndarray]] = {}
        for d in {len(r.q) for r in part} - {0}:
            own = [r for r in part if len(r.q) == d]
            x = np.array([[np.nan if v is None else v for v in r.q] for r in own], dtype=np.float64)
            length = np.linalg.norm(x, axis=1, keepdims=True)
            block[d] = ([r.query_id for r in own], np.divide(x, length, out=np.zeros_like(x), where=length > 0))
        near = stored.mapInArrow(_nearest(block, k, [to_arrow_type(t) for t in kinds]), f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, score double")
        found = near if found is None else found.unionByName(near)
    return ranked(found, k)


#: Runs of name characters up to this length are cut into all their substrings; longer ones are searched.
LONGEST_RUN = 80


def substring_hits(names: DataFrame, key: list[str], value: str, terms: DataFrame, least: int) -> DataFrame:
    """The `key` columns and term for every term of at least `least` characters that a value contains.

    Terms consist of name characters (letters, digits, _ and $), so a hit lies within a run of them. Runs are short:
    all their substrings are laid out and meet the terms by equality, which grows with names plus terms instead of
    with their product. The few overlong runs are searched for each term.
    """
    wanted = terms.select("term").where(F.length("term") >= least).distinct()
    rows = names.select(*key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit(r"([a-z0-9_$]+)"), 1))).alias("run")).where(F.length("run") >= least)
    n = F.length("run")
    cut = F.flatten(F.transform(F.sequence(F.lit(1), n - least + 1), lambda i: F.transform(F.sequence(F.lit(least), n - i + 1), lambda k: F.substring(F.col("run"), i, k))))
    runs = rows.where(n <= LONGEST_RUN).select("run").distinct().select("run", F.explode(F.array_distinct(cut)).alias("term")).join(wanted, "term")
    short = rows.join(runs, "run").select(*key, "term")
    long = contained(rows.where(n > LONGEST_RUN).select(F.col("run").alias("value")).distinct(), wanted)
    return short.unionByName(rows.join(long.withColumnRenamed("value", "run"), "run").select(*key, "term")).distinct()


#: Most distinct terms that are held by the tasks, and runs whose terms are remembered in one.
TERMS_HELD, KEPT_RUNS = 250_000, 200_000


def _held(wanted: DataFrame) -> list[str] | None:
    """The terms, unless they are too many to be held."""
    few = [r.term for r in wanted.limit(TERMS_HELD + 1).collect()]
    return few if len(few) <= TERMS_HELD else None


def run_terms(terms: list[tuple[str, bool]]) -> Callable[[str], list[tuple[int, int]]]:
    """A function from a run of name characters to its terms, as numbers, and how often it has them.

    Terms consist of name characters, so they lie within a run of them: as substrings, or if a whole word is meant
    between its ends and its $.
    """
    within, whole = ({t: i for i, (t, w) in enumerate(terms) if w == kind} for kind in (False, True))
    sizes, held = sorted({len(t) for t in within}), {}

    def of(run: str) -> list[tuple[int, int]]:
        known = held.get(run)
        if known is not None:
            return known
        if len(run) > LONGEST_RUN:
            met = [t for t in within if t in run]
        else:
            met = {run[i : i + n] for n in sizes for i in range(len(run) - n + 1)} & within.keys()
        known = [*((within[t], run.count(t)) for t in met), *Counter(whole[w] for w in run.split("$") if w in whole).items()]
        if len(run) <= LONGEST_RUN:
            if len(held) >= KEPT_RUNS:
                held.clear()
            held[run] = known
        return known

    return of


def _terms_of(terms: list[str]):
    """A mapInArrow function over (chunk_id, low, low_path): chunk_id, term, in_path for every term in either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, runs, names = run_terms([(t, False) for t in terms]), re.compile("[a-z0-9_$]+").findall, pa.array(terms, pa.string())
        for batch in batches:
            at, nrs, named = [], [], []
            for j, (low, path) in enumerate(zip(batch.column("low"), batch.column("low_path").to_pylist())):
                in_path = {i for r in set(runs(path)) for i, _ in of(r)}
                every = in_path | {i for r in set(runs(low.as_py())) for i, _ in of(r)}
                at += [j] * len(every)
                nrs += every
                named += [i in in_path for i in every]
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id").take(pa.array(at, pa.int64())), names.take(pa.array(nrs, pa.int64())), pa.array(named, pa.bool_())], ["chunk_id", "term", "in_path"])

    return run


#: Characters of a term that are met by equality before the rest is compared.
PROBE = 6


def contained(values: DataFrame, terms: DataFrame) -> DataFrame:
    """value, term for every distinct `value` that contains a `term`: beginnings of terms meet pieces of values by equality.

    Only numbers and pieces are shuffled; a value is fetched again, by its number, for the terms whose beginning it has.
    """
    held = values.withColumn("nr", F.xxhash64("value"))
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.length("value")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(PROBE), F.length("value") - i + 1)), lambda k: F.substring(F.col("value"), i, k))))
    cut = held.where("value <> ''").select("nr", F.explode(F.array_distinct(pieces)).alias("piece"))
    met = cut.join(terms.select("term", F.left("term", F.lit(PROBE)).alias("piece")), "piece").select("nr", "term").distinct()
    return met.join(held, "nr").where(F.col("value").contains(F.col("term"))).select("value", "term")


def _asked(planned: DataFrame) -> DataFrame:
    """query_id, use, term, strong: the query features that the structural arm compares, normalised."""
    s = F.col("structural")
    long = lambda a, n: F.filter(a, lambda x: F.length(x) > n)
    looked_for = lambda w: w.rlike(r"^[a-z][a-z0-9_$]{5,}$")

    def names(c: Column) -> Column:
        written = F.filter(s["identifiers"], lambda w: compound(w) | (c["cue"] & looked_for(w)))
        exact = F.concat(long(c["normal"], 2), long(c["quoted"], 2))
        return F.struct(c["quoted"].alias("quoted"), exact.alias("exact"), F.concat(long(F.transform(written, X.normalize_symbol), 2), F.filter(exact, lambda w: c["cue"] & looked_for(w))).alias("strong"))

    def uses(c: Column) -> Column:
        parts = s["identifierParts"]
        terms = {
            "fragment": s["pathFragments"], "token": s["pathTokens"], "path_part": long(F.concat(parts, F.transform(s["tokens"], X.normalize_symbol)), 2), "extension": s["extensions"], "exact": c["exact"], "named": F.concat(c["exact"], c["strong"], c["quoted"]), "part": parts,
            "partial": long(F.concat(F.transform(parts, X.normalize_symbol), c["exact"]), 4),
        }
        return F.struct(c["strong"].alias("strong"), F.array(*(F.struct(F.lit(k).alias("use"), F.array_distinct(v).alias("terms")) for k, v in terms.items())).alias("laid"))

    said = F.struct(locates(s["raw"]).alias("cue"), F.transform(s["identifiers"], X.normalize_symbol).alias("normal"), F.transform(s["quotedTerms"], X.normalize_symbol).alias("quoted"))
    laid = materialize(planned.select("query_id", bound(said, lambda c: bound(names(c), uses)).alias("c")))
    rows = laid.select("query_id", "c.strong", F.explode("c.laid").alias("u")).select("query_id", "u.use", "strong", F.explode("u.terms").alias("term"))
    return rows.where("term <> ''").select("query_id", "use", "term", F.array_contains("strong", F.col("term")).alias("strong"))


def _points(rows: DataFrame, keys: list[str], kind: Column, structural: Column, dependency: Column | float, shown: Column, symbol_exact: Column | bool = False, path_exact: Column | bool = False) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select("query_id", *keys, kind.alias("kind"), structural.cast("double").alias("s"), lit(dependency).cast("double").alias("d"), shown.alias("shown"), lit(symbol_exact).alias("symbol_exact"), lit(path_exact).alias("path_exact"))


def _path_points(asked: DataFrame, paths: DataFrame) -> DataFrame:
    """Path rows of the weight table, per query and distinct path."""
    low = F.lower("path")
    base = F.regexp_extract(low, r"([^/]*)$", 1)
    rows = paths.select("path").distinct().select("path", low.alias("low"), F.regexp_replace(low, r"\.[^.]+$", "").alias("stem_"), base.alias("base"), F.regexp_replace(base, r"\.[^.]+$", "").alias("base_stem"))
    use = {u: asked.where(F.col("use") == u) for u in ("fragment", "token", "path_part", "extension")}
    # fragments have separators in them
    cased = use["fragment"].select("term", F.lower("term").alias("lowered")).distinct()
    within = contained(rows.select(F.col("low").alias("value")).distinct(), cased.select(F.col("lowered").alias("term")).distinct())
    seen = rows.join(within.select(F.col("value").alias("low"), F.col("term").alias("lowered")), "low").join(cased, "lowered").drop("lowered")
    f = F.lower("term")
    whole = F.concat(F.lit("/"), f)
    steps = [
        (3.2, "path exact match", (F.col("low") == f) | F.col("low").endswith(whole)), (2.6, "path stem exact match", (F.col("stem_") == f) | F.col("stem_").endswith(whole)),
        (2.4, "filename exact match", (F.col("base_stem") == f) | (F.col("base") == f)), (1.8, "filename match", F.col("base").contains(f)),
    ]
    points, kind = F, F
    for value, name, rule in steps:
        points, kind = points.when(rule, value), kind.when(rule, name)
    fragments = seen.select("path", "term", points.otherwise(1.1).alias("p"), kind.otherwise("path fragment match").alias("kind"))
    by_fragment = _points(use["fragment"].join(fragments, "term"), ["path"], F.col("kind"), F.col("p"), 0.0, F.col("term"), path_exact=F.col("p") == 3.2)
    in_path = substring_hits(rows, ["path"], "low", use["token"].select("term").unionByName(use["path_part"].select("term")), 2)
    by_token = _points(use["token"].join(in_path, "term"), ["path"], F.lit("path token match"), F.lit(0.12), 0.0, F.col("term"))
    in_base = substring_hits(rows, ["path"], "base", use["path_part"], 3).withColumn("order", F.lit(0))
    starts = rows.select("path", F.explode(F.array_distinct(X.split_identifier(F.col("base_stem")))).alias("b")).where(F.length("b") >= 4).select("path", F.left("b", F.lit(4)).alias("start")).distinct()
    fuzzy = use["path_part"].select("term", F.left("term", F.lit(4)).alias("start")).where(F.length("term") >= 4).distinct().join(starts, "start").select("path", "term", F.lit(2).alias("order"))
    first = in_base.unionByName(in_path.where(F.length("term") >= 3).withColumn("order", F.lit(1))).unionByName(fuzzy).groupBy("path", "term").agg(F.min("order").alias("order"))
    named = F.when(F.col("order") == 0, "filename token match").when(F.col("order") == 1, "path token match").otherwise("filename fuzzy match")
    by_part = _points(use["path_part"].join(first, "term"), ["path"], named, F.when(F.col("order") == 0, 0.5).when(F.col("order") == 1, 0.25).otherwise(0.28), 0.0, F.col("term"))
    endings = rows.select("path", F.regexp_extract("low", r"\.([a-z0-9]+)$", 1).alias("term"))
    by_ending = _points(use["extension"].join(endings, "term"), ["path"], F.lit("extension match"), F.lit(0.08), 0.0, F.col("term"))
    return by_fragment.unionByName(by_token).unionByName(by_part).unionByName(by_ending)


def _symbol_points(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbol rows of the weight table, per query and distinct (name, kind, exported)."""
    key = ["name", "symbol_kind", "out"]
    rows = symbols.select("name", F.coalesce("kind", F.lit("")).alias("symbol_kind"), F.coalesce("isExported", F.lit(False)).alias("out")).where("name IS NOT NULL").distinct().withColumn("term", X.normalize_symbol(F.col("name")))
    contract = F.col("symbol_kind").isin("interface", "type")
    met = asked.where("use = 'named'").join(rows, "term")
    strong = F.when(F.col("out"), 5.6).otherwise(5.2) + F.when(contract, 0.8).otherwise(0.3)
    plain = F.when(F.col("out"), 3.4).otherwise(3.1) + F.when(contract, 0.4).otherwise(0.0)
    exact = _points(met, key, F.when(F.col("strong"), "symbol strong exact match").otherwise("symbol exact match"), F.when(F.col("strong"), strong).otherwise(plain), 0.0, F.col("name"), symbol_exact=~F.col("strong"))
    done = met.select("query_id", *key).distinct()
    parts = rows.select(*key, F.explode(X.split_identifier(F.col("name"))).alias("term"))
    shared = asked.where("use = 'part'").join(parts, "term").groupBy("query_id", *key).agg(F.count("*").alias("n")).join(done, ["query_id", *key], "left_anti")
    token = _points(shared, key, F.lit("symbol token match"), F.least(F.lit(0.75), F.col("n") * 0.25) + F.when(F.col("out"), 0.05).otherwise(0.0), 0.0, F.col("name"))
    within = substring_hits(rows.withColumnRenamed("term", "norm"), key, "norm", asked.where("use = 'partial'"), 5)
    some = asked.where("use = 'partial'").join(within, "term").join(done, ["query_id", *key], "left_anti")
    partial = _points(some, key, F.lit("symbol partial match"), F.when(F.col("strong"), 0.75).otherwise(0.4), 0.0, F.col("name"))
    return exact.unionByName(token).unionByName(partial)


def _reference_points(asked: DataFrame, references: DataFrame) -> DataFrame:
    """Reference rows of the weight table, per query and distinct target."""
    key = ["target", "normalizedTarget"]
    rows = references.select(*key).where("normalizedTarget IS NOT NULL").distinct()
    strong = F.col("strong")
    met = asked.where("use = 'exact'").join(rows.withColumn("term", F.col("normalizedTarget")), "term")
    exact = _points(met, key, F.when(strong, "direct reference strong exact match").otherwise("direct reference exact match"), F.when(strong, 1.4).otherwise(0.7), F.when(strong, 0.10).otherwise(0.08), F.col("target"))
    within = substring_hits(rows, key, "normalizedTarget", asked.where("use IN ('exact', 'part')"), 3)
    longer = asked.where("use = 'exact'").where(F.length("term") > 4).join(within, "term").where(F.col("term") != F.col("normalizedTarget"))
    partial = _points(longer, key, F.when(strong, "direct reference strong partial match").otherwise("direct reference partial match"), F.when(strong, 0.5).otherwise(0.22), F.when(strong, 0.05).otherwise(0.03), F.col("target"))
    token = _points(asked.where("use = 'part'").join(within, "term"), key, F.lit("reference token boost"), F.lit(0.08), 0.02, F.col("target"))
    return exact.unionByName(partial).unionByName(token)


def structural(planned: DataFrame, chunks: DataFrame, symbols: DataFrame, references: DataFrame, k: int = DEPTH) -> DataFrame:
    """Scores by paths, symbols and references: adds structural_score, dependency_boost, reasons and exact flags.

    Names, paths and targets repeat all over a corpus, so each distinct one meets the queries' terms once, always
    by equality (of names, parts, four-letter starts or substrings), and what hits joins back to the chunks by that
    name. `planned` comes from `plan_queries` with a query_id.
    """
    asked = materialize(_asked(planned))
    paths = chunks.select(F.col("id").alias("chunk_id"), F.col("path")).where("path IS NOT NULL AND path <> '' AND chunk_id IS NOT NULL").distinct()
    owners = symbols.select(F.col("chunkId").alias("chunk_id"), "name", F.coalesce("kind", F.lit("")).alias("symbol_kind"), F.coalesce("isExported", F.lit(False)).alias("out")).where("chunk_id IS NOT NULL")
    users = references.select(F.col("chunkId").alias("chunk_id"), "target", "normalizedTarget").where("chunk_id IS NOT NULL")
    # points per distinct name are few next to what they place; scores and reasons both read them
    arms = [(materialize(_path_points(asked, paths)), ["path"], paths), (materialize(_symbol_points(asked, symbols)), ["name", "symbol_kind", "out"], owners), (materialize(_reference_points(asked, references)), ["target", "normalizedTarget"], users)]
    parts = None
    for points, key, places in arms:
        per_name = points.groupBy("query_id", *key).agg(F.sum("s").alias("s"), F.sum("d").alias("d"), F.max("symbol_exact").alias("symbol_exact"), F.max("path_exact").alias("path_exact"))
        placed = per_name.join(places, key).select("query_id", "chunk_id", "s", "d", "symbol_exact", "path_exact")
        parts = placed if parts is None else parts.unionByName(placed)
    sums = parts.groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 6).alias("structural_score"), F.round(F.least(F.lit(DEPENDENCY_CAP), F.sum("d")), 6).alias("dependency_boost"), F.max("symbol_exact").alias("symbol_exact"), F.max("path_exact").alias("path_exact"))
    best = materialize(ranked(sums.withColumn("score", F.round(F.col("structural_score") + F.col("dependency_boost"), 6)).where("score > 0"), k))
    # what was found is told for the best only
    chosen, told = best.select("query_id", "chunk_id"), None
    for points, key, places in arms:
        where = chosen.join(places.distinct(), "chunk_id")
        said = points.select("query_id", *key, "kind", "shown", "s").join(where, ["query_id", *key]).select("query_id", "chunk_id", "kind", "shown", "s")
        told = said if told is None else told.unionByName(said)
    why = told.groupBy("query_id", "chunk_id").agg(
        F.sort_array(F.collect_set(F.struct((-F.col("s")).alias("order"), F.concat_ws(": ", "kind", "shown").alias("reason")))).alias("why"),
        F.array_sort(F.collect_set(F.when(F.col("kind").isin("symbol exact match", "symbol strong exact match"), F.col("shown")))).alias("exact_symbols"),
        F.array_sort(F.collect_set(F.when(F.col("kind").isin("direct reference exact match", "direct reference strong exact match"), F.col("shown")))).alias("exact_references"),
    )
    reasons = why.withColumn("reasons", F.slice(F.array_distinct(F.transform("why", lambda w: w["reason"])), 1, MOST_REASONS)).drop("why")
    return best.join(reasons, ["query_id", "chunk_id"])
