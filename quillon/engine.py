"""The facade: a context store in a folder of tables, with one method per tool of the engine.

Methods take and return DataFrames, batches of tasks rather than single ones; a single task is a batch of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as N
from quillon.functions import vector as V
from quillon.operators import arms as A
from quillon.operators import compress as C
from quillon.operators import evaluate as E
from quillon.operators import fuse as U
from quillon.operators import graph as G
from quillon.operators import route as R
from quillon.operators import select as S
from quillon.operators import split as P
from quillon.operators import store as T
from quillon.operators import structure as X
from quillon.operators.index import doc_stats, postings, stem_index
from quillon.operators.ordered import running
from quillon.operators.segments import COMPACT_AT, OWNERS, Folder
from quillon.plans.materialize import materialize, materialize_all
from quillon.plans.planner import plan_queries
from quillon.schema import TABLES
from quillon.sources import files as files_source
from quillon.streaming.changes import file_changes

STRATEGIES = ("structural", "hybrid", "vector", "text", "graph")
MODES = ("focused", "broad", "exhaustive")
#: Chunks scored per task, and the rounds and budget of iterative retrieval.
SCORED, ROUNDS, ROUND_BUDGET, NEW_TERMS = 50, 2, 100_000, 10
#: Fixed value: a project of more files isn't indexed as a whole without being asked to.
SESSION_FILES = 20_000
Embedder = Callable[[DataFrame, str, str], DataFrame]


def embed_deterministic(rows: DataFrame, text: str, into: str) -> DataFrame:
    """The embedder that needs no model; its vectors tell equal texts from others and little else."""
    return rows.withColumn(into, F.transform(V.deterministic_embedding(F.coalesce(F.col(text), F.lit(""))), lambda x: x.cast("float")))


def validate(**given: object) -> None:
    """Check tool arguments: raises ValueError that names the argument."""
    rules: dict[str, Callable[[object], bool]] = {
        "query": lambda v: isinstance(v, str) and bool(v.strip()),
        "strategy": lambda v: v is None or v in STRATEGIES,
        "mode": lambda v: v is None or v in MODES,
        "max_tokens": lambda v: v is None or isinstance(v, int) and not isinstance(v, bool) and v > 0,
        "top_k": lambda v: v is None or isinstance(v, int) and not isinstance(v, bool) and 0 < v <= 1000,
        "max_hops": lambda v: v is None or isinstance(v, int) and not isinstance(v, bool) and 0 <= v <= G.MOST_HOPS,
        "path": lambda v: isinstance(v, str) and bool(v) and "\0" not in v,
        "rounds": lambda v: isinstance(v, int) and not isinstance(v, bool) and 1 <= v <= 10,
    }
    for name, value in given.items():
        if name not in rules:
            raise ValueError(f"unknown argument {name}")
        if not rules[name](value):
            raise ValueError(f"invalid {name}: {value!r}")


class ContextEngine:
    """Tables by name (see `quillon.schema.TABLES`); those not given are empty."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, embedder: Embedder = embed_deterministic, model: str = "deterministic", provider: str = "deterministic"):
        unknown = set(tables or {}) - set(TABLES)
        if unknown:
            raise ValueError(f"unknown tables: {', '.join(sorted(unknown))}")
        self.spark, self.embedder, self.model, self.provider = spark, embedder, model, provider
        self.tables = {name: (tables or {}).get(name) if tables and name in tables else spark.createDataFrame([], schema) for name, schema in TABLES.items()}
        self.warnings: list[str] = []
        # what has changed since the commit that was loaded: rows added per table, and ids removed before them
        self._base: tuple[str, int] | None = None
        self._added: dict[str, DataFrame] = {}
        self._removed: DataFrame | None = None
        if tables and "chunks" in tables and "text_lengths" not in tables:
            self.tables.update(self._indexed(self.tables["chunks"]))

    @classmethod
    def load(cls, spark: SparkSession, folder: str, **options: object) -> ContextEngine:
        """The newest commit of a store; an empty engine if there is none."""
        store = Folder(spark, folder)
        commit, _ = store.newest()
        engine = cls(spark, {name: store.read(name, schema) for name, schema in TABLES.items()}, **options)
        engine._base = (folder, commit)
        return engine

    def save(self, folder: str) -> int:
        """Commit to a store: what has changed, if this is the store's newest commit, or else everything."""
        store = Folder(self.spark, folder)
        commit, manifest = store.newest()
        same = self._base == (folder, commit) and commit > 0
        if same and not self._added and self._removed is None:
            return commit
        if same and max((len(v) for v in manifest.values()), default=0) < COMPACT_AT:
            commit = store.commit({n: self._laid(n, rows) for n, rows in self._added.items()}, self._removed)
        else:
            commit = store.commit({n: self._laid(n, rows) for n, rows in self.tables.items()}, anew=True)
        store.tidy()
        self._base, self._added, self._removed = (folder, commit), {}, None
        return commit

    @staticmethod
    def _laid(name: str, rows: DataFrame) -> DataFrame:
        """Postings are laid out by term, so that a scan for some terms skips the rest."""
        return rows.repartitionByRange("term").sortWithinPartitions("term") if name == "postings" else rows

    def _add(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows that a table gains, written once."""
        rows = materialize(rows.select(self.tables[name].columns))
        if rows.isEmpty():
            return rows
        self.tables[name] = self.tables[name].unionByName(rows)
        self._added[name] = self._added[name].unionByName(rows) if name in self._added else rows
        return rows

    @staticmethod
    def _indexed(chunks: DataFrame) -> dict[str, DataFrame]:
        """The inverted index of chunks: postings and text lengths."""
        return {"postings": postings(chunks, "id", "text").withColumnRenamed("doc", "chunkId"), "text_lengths": doc_stats(chunks, "id", "text").withColumnRenamed("doc", "chunkId")}

    # --- ingest ---------------------------------------------------------------------------------------
    def ingest(self, rows: DataFrame, now=None) -> DataFrame:
        """Add texts (source, text, path, language, ...): new chunks with structure, embeddings and edges."""
        now = F.current_timestamp() if now is None else now
        chunks = self.tables["chunks"]
        made = materialize(P.ingest(rows, now))
        return self._add_chunks(materialize(made.join(chunks.select("id").distinct(), "id", "left_anti")))

    def _add_chunks(self, fresh: DataFrame) -> DataFrame:
        """New chunks with what is derived from them: structure, embeddings, index, edges to their pieces."""
        tagged = materialize(X.extract_rows(fresh))
        whole = fresh.where(~F.coalesce(F.get_json_object("metadata", "$.split") == "true", F.lit(False)))
        vectors = self.embedder(whole.select("id", "text", "timestamp"), "text", "embedding").select(F.col("id").alias("chunkId"), "embedding", F.lit(self.model).alias("model"), F.size("embedding").alias("dimensions"), "timestamp").where("embedding IS NOT NULL")
        added = {"chunks": fresh, "code_symbols": X.symbols_of(tagged), "code_references": X.references_of(tagged), "chunk_embeddings": vectors, "dependencies": P.contains_edges(fresh), **self._indexed(fresh)}
        for name, extra in added.items():
            self._add(name, extra)
        return fresh

    def upsert_chunks(self, rows: DataFrame) -> DataFrame:
        """Chunks by id: new ones are added; those whose text changed lose their embedding, structure, index and edges
        for new ones; those with the same text only change their own fields. Of rows with one id the greatest counts."""
        chunks = self.tables["chunks"]
        one = materialize(T.upsert(chunks.limit(0), rows.select(chunks.columns), ["id"]))
        stored = chunks.select("id", F.col("text").alias("before")).dropDuplicates(["id"])
        known = materialize(one.join(stored, "id", "left").withColumn("same", F.col("text").eqNullSafe(F.col("before")) & F.col("before").isNotNull()))
        changed = known.where("NOT same").select(chunks.columns)
        kept = known.where("same").select(chunks.columns)
        # derived rows of unchanged texts are taken along, as a removal takes all rows of a chunk
        ids = kept.select("id")
        along = {n: materialize(self.tables[n].join(ids.withColumnRenamed("id", OWNERS[n][0]), OWNERS[n][0], "left_semi")) for n in ("code_symbols", "code_references", "chunk_embeddings", "postings", "text_lengths")}
        edges = self.tables["dependencies"]
        linked = materialize(edges.join(ids.withColumnRenamed("id", "fromId"), "fromId", "left_semi").unionByName(edges.join(ids.withColumnRenamed("id", "toId"), "toId", "left_semi")).select(edges.columns).distinct())
        gone = materialize(changed.select("id"))
        linked = linked.join(gone.withColumnRenamed("id", "fromId"), "fromId", "left_anti").join(gone.withColumnRenamed("id", "toId"), "toId", "left_anti")
        self.delete(one.select("id"))
        self._add("chunks", kept)
        for name, rest in {**along, "dependencies": linked}.items():
            self._add(name, rest)
        self._add_chunks(materialize(changed))
        return changed

    def apply_events(self, events: DataFrame) -> DataFrame:
        """Files that changed (path, kind, ts, text) with all that is derived from them; gives the paths touched.

        The last event of a path counts. A file whose stored whole-file hash is the same keeps its rows, so events
        that are delivered again change nothing.
        """
        touched, fresh = materialize_all(*file_changes(self.tables["chunks"], events))
        self.delete(self.tables["chunks"].join(touched, "path", "left_semi").select("id"))
        made = P.ingest(fresh.select(F.lit("file").alias("source"), "text", "path"), F.lit(0).cast("timestamp"))
        dated = made.drop("timestamp").join(fresh.select(N.normalize_path(F.col("path")).alias("path"), F.col("ts").alias("timestamp")), "path")
        self._add_chunks(materialize(dated.select(self.tables["chunks"].columns)))
        return touched

    def ingest_directory(self, root: str, allowed: list[str] = (), project: bool = False, most_files: int | None = None, **options: bool) -> DataFrame:
        """Read a directory below an allowed root and ingest its files; `project` takes only what tells about it."""
        validate(path=root)
        if "://" not in root and not files_source.within_roots(root, list(allowed)):
            raise ValueError(f"{root} lies outside the allowed folders")
        found = files_source.read_directory(self.spark, root)
        if most_files is not None and (n := found.select("path").count()) > most_files:
            raise ValueError(f"{root} holds {n} files, more than {most_files}")
        if project:
            kept = files_source.project_files(found, **options)
            sections = P.instruction_sections(kept.where("context_kind = 'agent-instruction'")).select(F.lit("file").alias("source"), "type", "text", "path", F.to_json(F.struct(F.lit("agent-instruction").alias("projectContext"), F.col("category").alias("instructionCategory"))).alias("metadata"))
            other = kept.where("context_kind IS NULL OR context_kind <> 'agent-instruction'").select(F.lit("file").alias("source"), F.when(F.col("context_kind").isNotNull(), "reference").alias("type"), F.col("content").alias("text"), "path", F.when(F.col("context_kind").isNotNull(), F.to_json(F.struct(F.col("context_kind").alias("projectContext")))).alias("metadata"))
            return self.ingest(sections.unionByName(other))
        return self.ingest(found.select(F.lit("file").alias("source"), F.col("content").alias("text"), "path"))

    def backfill(self) -> None:
        """Structure and embeddings of chunks that came without, as after an import."""
        bare = self.tables["chunks"].join(self.tables["code_symbols"].select(F.col("chunkId").alias("id")).distinct(), "id", "left_anti").join(self.tables["code_references"].select(F.col("chunkId").alias("id")).distinct(), "id", "left_anti")
        tagged = materialize(X.extract_rows(bare))
        self._add("code_symbols", X.symbols_of(tagged))
        self._add("code_references", X.references_of(tagged))
        self.backfill_embeddings()

    def update_graph(self) -> DataFrame:
        """Find edges by the naming rules and add those that are new."""
        edges = self.tables["dependencies"]
        return self._add("dependencies", G.find_edges(self.tables["chunks"]).join(edges.select("fromId", "toId", "type"), ["fromId", "toId", "type"], "left_anti"))

    def backfill_embeddings(self) -> DataFrame:
        """Embed the chunks that have no embedding of the engine's model."""
        missing = T.missing_embeddings(self.tables["chunks"], self.tables["chunk_embeddings"], self.model)
        rows = self.tables["chunks"].join(missing, "id", "left_semi").dropDuplicates(["id"]).select("id", "text", "timestamp")
        return self._add("chunk_embeddings", self.embedder(rows, "text", "embedding").select(F.col("id").alias("chunkId"), "embedding", F.lit(self.model).alias("model"), F.size("embedding").alias("dimensions"), "timestamp").where("embedding IS NOT NULL"))

    def delete(self, ids: DataFrame) -> None:
        """Remove chunks with all that belongs to them."""
        ids = materialize(ids.select("id").where("id IS NOT NULL").distinct())
        if ids.isEmpty():
            return
        gone = ids.withColumnRenamed("id", "gone")
        for held in (self.tables, self._added):
            for name in OWNERS.keys() & held.keys():
                for owner in OWNERS[name]:
                    held[name] = held[name].join(gone, F.col(owner) == F.col("gone"), "left_anti")
        self._removed = ids if self._removed is None else self._removed.unionByName(ids)

    def enforce_limit(self, most: int = T.MAX_CHUNKS) -> DataFrame:
        gone = materialize(T.eviction(self.tables["chunks"], self.tables["dependencies"], most))
        self.delete(gone)
        return gone

    # --- retrieval ------------------------------------------------------------------------------------
    def plan(self, queries: DataFrame) -> DataFrame:
        return plan_queries(queries, provider=self.provider)

    def retrieve(self, queries: DataFrame, strategy: str | None = None, top_k: int | None = None, max_hops: int | None = None) -> DataFrame:
        """Ranked chunks for queries (query_id, text): query_id, chunk_id, score, sources, rank.

        All queries run through one plan. An explicit strategy wins; else structural if there is any symbol, else
        the provider's. Structural retrieval without reliable vectors adds scores instead of fusing ranks.
        """
        validate(strategy=strategy, top_k=top_k, max_hops=max_hops)
        planned = materialize(self.plan(queries.select("query_id", "text")))
        symbols, references, chunks = self.tables["code_symbols"], self.tables["code_references"], self.tables["chunks"]
        if strategy is None:
            strategy = "structural" if not symbols.isEmpty() else planned.first()["strategy"] if not planned.isEmpty() else "text"
        depth = max(top_k or 50, A.DEPTH)
        reliable = self.provider != "deterministic"
        lexical = A.lexical(planned, chunks, depth)
        structural = A.structural(planned, chunks, symbols, references, depth) if strategy == "structural" else None
        if strategy == "structural" and not reliable:
            out = U.deterministic_structural(planned, chunks, symbols, references, lexical, structural, stem_index(symbols), top_k or 50)
            return out.select("query_id", "chunk_id", "score", "sources", "rank")
        arms: dict[str, DataFrame] = {}
        if strategy in ("hybrid", "text", "structural"):
            index = self.tables["postings"].withColumnRenamed("chunkId", "doc"), self.tables["text_lengths"].withColumnRenamed("chunkId", "doc")
            arms["fts"] = A.merged_text(A.full_text(planned, chunks, depth, index=index), lexical, depth)
        if strategy in ("hybrid", "vector", "structural"):
            try:
                asked = materialize(self.embedder(planned.select("query_id", "text"), "text", "embedding"))
                arms["vector"] = materialize(A.vector(asked, self.tables["chunk_embeddings"].where(F.col("model") == self.model), depth))
            except Exception as problem:  # noqa: BLE001 - whatever the embedder raises
                if not arms and structural is None:
                    raise
                # the other arms answer alone, and say so
                self.warnings.append(f"vector search failed: {problem}".split("\n")[0])
        if structural is not None:
            arms["structural"] = structural.select("query_id", "chunk_id", F.col("structural_score").alias("score"))
            arms["dependency"] = structural.select("query_id", "chunk_id", F.col("dependency_boost").alias("score"))
        weights = U.fusion_weights(strategy, reliable)
        if strategy == "graph":
            recent = chunks.orderBy(F.desc("timestamp"), F.desc("id")).select(F.col("id").alias("chunk_id")).limit(10)
            seeds = planned.select("query_id").join(F.broadcast(recent))
            arms = {"graph": G.expand(seeds, self.tables["dependencies"], max_hops or 1, top_k or 50)}
        fused = U.fuse(arms, weights)
        if strategy == "hybrid" and max_hops:
            seeds = A.ranked(fused.withColumn("score", F.col("fused")), 10)
            arms["graph"] = G.expand(seeds, self.tables["dependencies"], max_hops, top_k or 50)
            fused = U.fuse(arms, weights)
        if structural is not None:
            fused = U.exact_identifier_boost(fused, structural, planned)
        final = U.rerank(fused, planned, chunks, top_k or 50)
        return final.select("query_id", "chunk_id", F.col("final").alias("score"), "sources", "rank")

    def context_for(self, queries: DataFrame, mode: str = "focused", max_tokens: int | None = None, strategy: str | None = None, compress: bool = False) -> dict[str, DataFrame]:
        """Retrieve, select, fill the budget and pack: candidates, filled, summary, compressed, pack."""
        validate(mode=mode, max_tokens=max_tokens, strategy=strategy)
        planned = materialize(self.plan(queries.select("query_id", "text")))
        hard = F.lit(max_tokens) if max_tokens else F.floor(F.lit(S.DEFAULT_MAX_TOKENS) * F.col("budget_ratio"))
        policies = S.policy(planned, mode, hard)
        ranked = materialize(self.retrieve(queries, strategy))
        chunks = self.tables["chunks"]
        chosen = materialize(S.select_candidates(ranked, chunks, policies))
        counts = R.link_counts(self.tables["dependencies"]).where(F.col("links") >= S.HOT_EDGES).select("chunk_id", F.lit(True).alias("hot"))
        tokens = chunks.select(F.col("id").alias("chunk_id"), F.coalesce("tokensEstimate", F.lit(0)).alias("tokens"), F.col("parentId").alias("parent_id")).dropDuplicates(["chunk_id"])
        budgets = materialize(S.effective_budget(chosen, tokens, policies))
        candidates = chosen.where("selected").select("query_id", "chunk_id", "rank").join(tokens, "chunk_id").join(counts, "chunk_id", "left")
        filled = materialize(S.fill_budget(candidates, budgets, collapse_siblings=True))
        out = {"candidates": chosen, "filled": filled, "summary": S.budget_summary(filled, budgets), "pack": S.context_pack(filled, chunks, queries)}
        if compress:
            summaries = S.deterministic_summary(chunks.join(filled.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"])).withColumnRenamed("id", "chunk_id")
            out["compressed"] = S.compress_omitted(filled, budgets, ranked, summaries)
        return out

    def iterative_retrieve(self, queries: DataFrame, rounds: int = ROUNDS, budget: int = ROUND_BUDGET) -> DataFrame:
        """Repeat retrieval with terms from what was found, while new chunks come and room is left.

        Gives query_id, chunk_id, score, round; a chunk has the round in which it was first found.
        """
        validate(rounds=rounds)
        asked, seen = materialize(queries.select("query_id", "text")), None
        chunks = self.tables["chunks"].select(F.col("id").alias("chunk_id"), "path", "text", "tokensEstimate").dropDuplicates(["chunk_id"])
        for nr in range(1, rounds + 1):
            found = self.retrieve(asked).select("query_id", "chunk_id", "score")
            if seen is not None:
                found = found.join(seen.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
            new = materialize(found.withColumn("round", F.lit(nr)))
            seen = new if seen is None else seen.unionByName(new)
            if nr == rounds or new.isEmpty():
                break
            used = seen.join(chunks.select("chunk_id", "tokensEstimate"), "chunk_id").groupBy("query_id").agg(F.sum("tokensEstimate").alias("used"))
            words = F.concat(F.filter(F.regexp_extract_all(F.lower(F.coalesce("path", F.lit(""))), F.lit(r"([a-z0-9]{4,})"), 1), lambda w: F.length(w) > 3), F.slice(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([a-z]{4,})"), 1), 1, 5))
            terms = new.join(chunks, "chunk_id").select("query_id", F.explode(words).alias("w")).groupBy("query_id", "w").agg(F.count("*").alias("n"))
            best = terms.withColumn("nr", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "w"))).where(F.col("nr") <= NEW_TERMS)
            more = best.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nr", "w"))), lambda x: x["w"]), " ").alias("more"))
            asked = materialize(asked.join(more, "query_id").join(used.where(F.col("used") < 0.9 * budget), "query_id", "left_semi").select("query_id", F.concat_ws(" ", "text", "more").alias("text")))
            if asked.isEmpty():
                break
        return seen

    def relevant_memory(self, queries: DataFrame, **filters: str) -> DataFrame:
        """The ten best chunks per query, then filtered by type, source, path, text or tier."""
        top = self.retrieve(queries, top_k=10).select("query_id", F.col("chunk_id").alias("id"), "score", "rank")
        rows = top.join(self.tables["chunks"].dropDuplicates(["id"]), "id")
        if "tier" in filters:
            rows = rows.join(T.latest_tier(self.tables["routing_history"]).withColumnRenamed("chunkId", "id"), "id", "left")
        return T.memory_filter(rows, **filters)

    # --- scoring and upkeep ---------------------------------------------------------------------------
    def score(self, tasks: DataFrame, now, max_hot_tokens: int | None = None, chunk_ids: DataFrame | None = None) -> DataFrame:
        """Route the chunks (of `chunk_ids`, id, if given) nearest to each task (task_id, text): task_id, chunk_id, score, tier."""
        asked = materialize(self.embedder(tasks.select(F.col("task_id").alias("query_id"), "text"), "text", "embedding"))
        vectors = self.tables["chunk_embeddings"].where(F.col("model") == self.model)
        if chunk_ids is not None:
            vectors = vectors.join(chunk_ids.select(F.col("id").alias("chunkId")).distinct(), "chunkId", "left_semi")
        near = A.vector(asked, vectors, SCORED).select(F.col("query_id").alias("task_id"), "chunk_id", F.col("score").alias("semantic"))
        meta = self.tables["chunks"].select(F.col("id").alias("chunk_id"), "type", "timestamp", F.col("tokensEstimate").alias("tokens")).dropDuplicates(["chunk_id"])
        rows = materialize(near.join(meta, "chunk_id").join(vectors.select(F.col("chunkId").alias("chunk_id"), "embedding").dropDuplicates(["chunk_id"]), "chunk_id").withColumn("ord", F.row_number().over(Window.partitionBy("task_id").orderBy("timestamp", "chunk_id"))))
        scored = R.score_chunks(rows.join(R.redundancy(rows), ["task_id", "chunk_id"]), self.tables["dependencies"], now)
        return R.close_and_promote(scored, self.tables["dependencies"], max_tokens=max_hot_tokens)

    def explain_routing(self, tasks: DataFrame, now, chunk_id: str | None = None) -> DataFrame:
        routed = self.score(tasks, now)
        return routed.where(F.col("chunk_id") == chunk_id) if chunk_id is not None else routed

    def record_routing(self, routed: DataFrame, tasks: DataFrame, now) -> DataFrame:
        """Append routing decisions to the history, with ids after the greatest one."""
        table = self.tables["routing_history"]
        start = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("start"))
        numbered = running(routed.join(tasks.select("task_id", F.col("text").alias("taskText")), "task_id"), ["task_id", "chunk_id"], "nr")
        rows = numbered.join(F.broadcast(start)).select((F.col("start") + F.col("nr")).alias("id"), F.col("chunk_id").alias("chunkId"), "tier", "score", F.lit("[]").alias("reasons"), "taskText", now.cast("timestamp").alias("timestamp"))
        return self._add("routing_history", rows)

    def point(self, table: str, ids: list[str]) -> DataFrame:
        """Rows of some chunks by id, as a filter of the scan."""
        if table not in OWNERS:
            raise ValueError(f"rows of {table} don't belong to chunks")
        return self.tables[table].where(F.col(OWNERS[table][0]).isin(ids))

    def cached_compression(self, tasks: DataFrame, chunk_ids: DataFrame) -> DataFrame:
        """Stored summaries of tasks (task_id, text) over the same chunks (task_id, chunk_id), the newest per task."""
        asked = tasks.select("task_id", F.col("text").alias("taskText")).join(chunk_ids.groupBy("task_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("ids")), "task_id")
        held = self.tables["compression_cache"].withColumn("ids", F.sort_array(F.array_distinct(F.from_json("sourceChunkIds", "array<string>"))))
        newest = Window.partitionBy("task_id").orderBy(F.desc("timestamp"), "id")
        return asked.join(held, ["taskText", "ids"]).withColumn("nr", F.row_number().over(newest)).where("nr = 1").select("task_id", *self.tables["compression_cache"].columns)

    def cache_compression(self, summaries: DataFrame, tasks: DataFrame, chunk_ids: DataFrame, now) -> DataFrame:
        """Keep summaries (task_id, summary, facts, constraints) of the chunks they were made from; ids are hashes of both."""
        ids = chunk_ids.groupBy("task_id").agg(F.to_json(F.sort_array(F.collect_set("chunk_id"))).alias("sourceChunkIds"))
        rows = summaries.join(tasks.select("task_id", F.col("text").alias("taskText")), "task_id").join(ids, "task_id")
        made = rows.select(F.sha2(F.concat_ws("|", "taskText", "sourceChunkIds"), 256).alias("id"), "taskText", "summary", F.to_json("facts").alias("retainedFacts"), F.to_json("constraints").alias("retainedConstraints"), "sourceChunkIds", now.cast("timestamp").alias("timestamp"))
        return self._add("compression_cache", made)

    def compress(self, rows: DataFrame) -> DataFrame:
        """Summaries of the chunks (task_id, chunk_id, rank) of each task."""
        return C.extractive_summary(rows.join(self.tables["chunks"].select(F.col("id").alias("chunk_id"), "type", "text").dropDuplicates(["chunk_id"]), "chunk_id"), item="chunk_id")

    def list_context(self, **filters: str) -> DataFrame:
        """Chunks that meet the filters, newest first."""
        return T.query_chunks(self.tables["chunks"], routing=self.tables["routing_history"], **filters).orderBy(F.desc("timestamp"), "id")

    def stats(self) -> DataFrame:
        return T.store_stats(self.tables["chunks"])

    def symbols(self, kinds: tuple[str, ...] = ("function", "class", "interface", "type", "method", "enum")) -> DataFrame:
        return self.tables["code_symbols"].where(F.col("kind").isin(*kinds)).orderBy("path", "startLine", "name")

    def evaluate(self, queries: DataFrame, qrels: DataFrame, strategy: str | None = None) -> DataFrame:
        """Metrics per query of the ranking of files that retrieval gives."""
        paths = self.tables["chunks"].select(F.col("id").alias("chunk_id"), F.coalesce("path", "id").alias("path")).distinct()
        ranked = self.retrieve(queries, strategy).join(paths, "chunk_id").groupBy("query_id", "path").agg(F.min("rank").alias("rank"))
        files = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "path")))
        return E.ir_metrics(files, qrels)
