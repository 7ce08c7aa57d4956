"""Queries on text functions, planning, splitting and structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import compress as C
from quillon.operators import split as P
from quillon.operators import structure as S
from quillon.plans.planner import BUDGET_SHARE, plan_queries
from quillon.queries.registry import register, sql_list, table
from quillon.sources.files import context_kind, is_test_path

_PARTS = r"list_filter(str_split_regex(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_$./:\-]+', ' ', 'g')), '\s+'), lambda w: length(w) > 1)"
_WORDS = "str_split_regex(lower(text), '\\s+')"


@register("token_estimate", "SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens, left(sha256(coalesce(text, '')), 16) AS hash FROM documents")
def token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"), X.content_hash(F.coalesce("text", F.lit(""))).alias("hash"))


@register(
    "classify_chunks",
    r"""SELECT id, CASE WHEN contains(source, 'diff') OR regexp_matches(text, '^diff --git|^--- [ab]/') THEN 'diff'
    WHEN contains(source, 'log') OR regexp_matches(text, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}') THEN 'log' WHEN source = 'summary' THEN 'summary'
    WHEN contains(source, 'reference') OR contains(source, 'doc') THEN 'reference'
    WHEN source = 'conversation' THEN CASE WHEN regexp_matches(text, '^(?i)(must|shall|should|need to|make sure|ensure|always|never|require|mandatory|critical)\b') THEN 'constraint'
      WHEN regexp_matches(text, '^(?i)(add|remove|fix|implement|refactor|change|update|create|delete|move|rename|extract|split|merge)\b') THEN 'instruction' ELSE 'fact' END
    WHEN contains(source, 'file') AND regexp_matches(text, '\b(function|class|import|export|const|let|var|def|async|return|interface|type |enum)\b') THEN 'code' ELSE 'fact' END AS kind
    FROM chunks WHERE text IS NOT NULL AND source IS NOT NULL""",
)
def classify_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").where("text IS NOT NULL AND source IS NOT NULL").select("id", X.classify(F.col("text"), F.col("source")).alias("kind"))


@register(
    "language_of",
    "SELECT coalesce(language, '') AS given, regexp_extract(coalesce(path, ''), '\\.([A-Za-z0-9]+)$', 1) AS suffix, CASE {alias} ELSE nullif(lower(trim(language)), '') END AS named, CAST(count(*) AS BIGINT) AS n FROM chunks GROUP BY ALL".replace(
        "{alias}", " ".join(f"WHEN lower(trim(language)) = '{a}' THEN '{b}'" for a, b in X.LANGUAGE_ALIASES.items()) + " WHEN nullif(lower(trim(language)), '') IS NULL THEN CASE lower(regexp_extract(coalesce(path, ''), '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.LANGUAGE_BY_SUFFIX.items()) + " END"
    ),
)
def language_of(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "chunks")
    return c.select(F.coalesce("language", F.lit("")).alias("given"), F.regexp_extract(F.coalesce("path", F.lit("")), r"\.([A-Za-z0-9]+)$", 1).alias("suffix"), X.language_of(F.col("path"), F.col("language")).alias("named")).groupBy("given", "suffix", "named").agg(F.count("*").alias("n"))


@register(
    "path_kinds",
    r"""WITH p AS (SELECT DISTINCT path, regexp_replace(translate(path, '\', '/'), '^(\./)+', '') AS norm FROM chunks WHERE path IS NOT NULL), q AS (SELECT path, norm, lower(norm) AS low, regexp_extract(lower(norm), '([^/]*)$', 1) AS base FROM p)
    SELECT path, regexp_matches(norm, '(?i)(^|/)(__tests__|tests?|spec|fixtures|mocks?)(/|$)|\.(test|spec)\.[cm]?[jt]sx?$|test_.*\.py$|_test\.go$') AS is_test,
    CASE WHEN base IN ('agents.md', 'claude.md') OR low = '.github/copilot-instructions.md' OR starts_with(low, '.cursor/rules/') THEN 'agent-instruction' WHEN ends_with(base, '.env.example') THEN 'environment'
    WHEN regexp_matches(base, '^readme(\.[^.]+)?$') OR (starts_with(low, 'docs/') AND ends_with(base, '.md')) THEN 'documentation'
    WHEN regexp_matches(base, '(?i)^((tsconfig|jsconfig)(\..*)?\.json|(vite|next|nuxt|astro|svelte|vitest|jest|eslint|prettier|biome|rollup|webpack|babel)\.config\..*|docker-compose\..*ya?ml|compose\..*ya?ml|package\.json|package-lock\.json|dockerfile)$') THEN 'configuration' END AS kind FROM q""",
)
def path_kinds(spark: SparkSession, folder: str) -> DataFrame:
    paths = table(spark, folder, "chunks").select("path").where("path IS NOT NULL").distinct()
    return paths.select("path", is_test_path(X.normalize_path(F.col("path"))).alias("is_test"), context_kind(F.col("path")).alias("kind"))


@register("identifier_parts", f"WITH p AS (SELECT DISTINCT regexp_extract(path, '([^/]*)$', 1) AS name FROM chunks WHERE path IS NOT NULL) SELECT name, {_PARTS.format('name')} AS parts, regexp_replace(lower(name), '[^a-z0-9_$]', '', 'g') AS normal FROM p")
def identifier_parts(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "chunks").where("path IS NOT NULL").select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name")).distinct()
    return names.select("name", X.split_identifier(F.col("name")).alias("parts"), X.normalize_symbol(F.col("name")).alias("normal"))


_STEM = f"""CASE WHEN list_contains({sql_list(X.STEM_DENY)}, t) THEN t ELSE CASE WHEN length(s) >= 4 THEN s ELSE t END END"""


@register(
    "stem_terms",
    rf"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM documents WHERE text IS NOT NULL),
    c AS (SELECT t, CASE WHEN ends_with(t, 'ies') AND length(t) > 5 THEN left(t, length(t) - 3) || 'y' WHEN ends_with(t, 'ing') AND length(t) > 6 THEN left(t, length(t) - 3) WHEN ends_with(t, 'ed') AND length(t) > 5 THEN left(t, length(t) - 2)
      WHEN ends_with(t, 'es') AND length(t) > 5 THEN left(t, length(t) - 2) WHEN ends_with(t, 's') AND length(t) > 4 AND NOT ends_with(t, 'ss') THEN left(t, length(t) - 1) ELSE t END AS s FROM w)
    SELECT t AS term, {_STEM} AS stem FROM c""",
)
def stem_terms(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "documents").where("text IS NOT NULL").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9_]+)"), 1)).alias("term")).distinct()
    return words.select("term", X.stem(F.col("term")).alias("stem"))


def _clean(keep: str) -> str:
    return rf"str_split_regex(regexp_replace(lower(text), '{keep}', ' ', 'g'), '\s+')"


@register(
    "query_terms",
    rf"""SELECT item_id, list_filter({_clean(r'[^a-z0-9\s]')}, lambda w: length(w) > 2 AND NOT list_contains({sql_list(X.FTS_STOP)}, w)) AS fts,
    CAST(len(list_distinct(list_filter({_clean(r'[^a-z0-9_\s]')}, lambda w: length(w) > 3 AND NOT list_contains({sql_list(X.LEXICAL_STOP)}, w)))) AS INTEGER) AS n_lexical,
    CAST(len(list_distinct(list_filter({_clean(r'[^a-z0-9_\s]')}, lambda w: length(w) > 2 AND NOT list_contains({sql_list(X.QUERY_STOP)}, w)))) AS INTEGER) AS n_terms FROM eval_items""",
)
def query_terms(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return table(spark, folder, "eval_items").select("item_id", X.fts_terms(t).alias("fts"), F.size(X.lexical_terms(t)).alias("n_lexical"), F.size(X.query_terms(t)).alias("n_terms"))


def _hits(words: list[str]) -> str:
    return f"len(list_distinct(list_filter(words, lambda w: list_contains({sql_list(words)}, w))))"


def _count(words: list[str]) -> str:
    return f"len(list_filter(words, lambda w: list_contains({sql_list(words)}, w)))"


_PLAN = rf"""WITH q AS (SELECT DISTINCT taskText AS text FROM routing_history WHERE taskText IS NOT NULL), w AS (SELECT text, lower(text) AS low, {_WORDS} AS words,
    list_distinct(list_filter({_clean(r'[^a-z0-9_\s]')}, lambda x: length(x) > 2 AND NOT list_contains({sql_list(X.QUERY_STOP)}, x))) AS terms FROM q),
  s AS (SELECT *, {', '.join(f'{_hits(v)} AS {k}' for k, v in X.INTENT_WORDS.items())}, {_count(X.BROAD_WORDS)} AS broad0,
    {_count(X.NARROW_WORDS)} + CASE WHEN regexp_matches(low, '[a-z0-9_.\-]+/[a-z0-9_.\-]+') OR regexp_matches(low, '\.(ts|tsx|js|jsx|py|rs|go|java)\b') THEN 2 ELSE 0 END
    + CASE WHEN regexp_matches(text, '\b[A-Za-z_$][A-Za-z0-9_$]*\(\)') OR regexp_matches(text, '\b[A-Za-z]+([A-Z][a-z0-9]+)+\b') OR regexp_matches(text, '\b[a-z]+_[a-z0-9_]+\b') THEN 1 ELSE 0 END + CASE WHEN len(terms) <= 2 THEN 1 ELSE 0 END AS narrow FROM w),
  i AS (SELECT *, broad0 + CASE WHEN len(terms) >= 8 AND broad0 > 0 THEN 1 ELSE 0 END AS broad, CASE WHEN NOT regexp_matches(low, '^(where|find|locate|show|grep|which\s+file)\b') AND {_hits(X.MUTATION_WORDS)} > 0 THEN 'implement'
    WHEN greatest(debug, implement, explain, code_search) = 0 THEN 'general' WHEN debug = greatest(debug, implement, explain, code_search) THEN 'debug' WHEN implement = greatest(debug, implement, explain, code_search) THEN 'implement'
    WHEN explain = greatest(debug, implement, explain, code_search) THEN 'explain' ELSE 'code_search' END AS intent FROM s),
  c AS (SELECT *, CASE WHEN narrow > broad + 1 THEN 'narrow' WHEN broad > narrow + 1 THEN 'broad' ELSE 'moderate' END AS complexity, CASE intent {' '.join(f"WHEN '{k}' THEN {v}" for k, v in BUDGET_SHARE.items())} END AS base FROM i)
SELECT text, intent, complexity, CAST(len(terms) AS INTEGER) AS n_terms, CASE WHEN complexity = 'broad' THEN 15 WHEN complexity = 'narrow' OR intent = 'code_search' THEN 5 WHEN intent IN ('debug', 'implement', 'explain') THEN 10 ELSE 8 END AS top_k,
  round(CASE complexity WHEN 'narrow' THEN greatest(0.15, base * 0.7) WHEN 'broad' THEN least(0.8, base * 1.3) ELSE base END, 6)::DOUBLE AS budget_ratio FROM c"""


@register("plan_queries", _PLAN)
def planned_queries(spark: SparkSession, folder: str) -> DataFrame:
    tasks = table(spark, folder, "routing_history").select(F.col("taskText").alias("text")).where("text IS NOT NULL").distinct()
    return plan_queries(tasks).select("text", "intent", "complexity", F.size("terms").alias("n_terms"), "top_k", F.round("budget_ratio", 6).alias("budget_ratio"))


@register(
    "commit_tasks",
    r"""WITH d AS (SELECT doc_id, text FROM documents WHERE kind = 'commit' AND text IS NOT NULL)
    SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\b(fix|fixes|fixed|bug|crash|error|regression|broken)\b') THEN 'debug' WHEN regexp_matches(lower(text), '\b(add|adds|implement|support|feature|introduce|create)\b') THEN 'implement'
    WHEN regexp_matches(lower(text), '\b(doc|docs|explain|describe|clarify)\b') THEN 'explain' ELSE 'code_search' END AS intent FROM d""",
)
def commit_tasks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("kind = 'commit' AND text IS NOT NULL").select("doc_id", X.commit_intent(F.col("text")).alias("intent"))


@register(
    "source_keywords",
    rf"""WITH w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_]{{3,}}')) AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT source, w, count(*) AS n FROM w WHERE NOT list_contains({sql_list(C.KEYWORD_STOP)}, w) GROUP BY ALL),
    r AS (SELECT source, w, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS nr FROM c) SELECT source, list(w ORDER BY nr) AS keywords FROM r WHERE nr <= {C.KEYWORDS} GROUP BY source""",
)
def source_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return C.keywords(table(spark, folder, "documents").select("source", "text"), "source")


@register(
    "conversation_ingest",
    "SELECT DISTINCT left(sha256(text), 16) AS hash, length(text) > 8000 AS split, CASE WHEN length(text) <= 8000 THEN CAST(ceil(length(text) / 4.0) AS BIGINT) END AS tokens FROM chunks WHERE source = 'conversation' AND text IS NOT NULL",
)
def conversation_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Every message by the hash of its whole text, whether it was split, and its tokens if not."""
    talk = table(spark, folder, "chunks").where("source = 'conversation'").select(F.get_json_object("metadata", "$.role").alias("role"), "text")
    made = P.ingest(P.conversation_chunks(talk), F.lit("2025-01-01")).where("parentId IS NULL")
    split = F.coalesce(F.get_json_object("metadata", "$.split") == "true", F.lit(False))
    return made.select(F.when(split, F.get_json_object("metadata", "$.contentHash")).otherwise(X.content_hash(F.col("text"))).alias("hash"), split.alias("split"), F.when(~split, F.col("tokensEstimate")).alias("tokens")).distinct()


@register("conversation_pieces")
def conversation_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All conversation rows, whatever their length: whole messages, notices of split ones, and their pieces."""
    talk = table(spark, folder, "chunks").where("source = 'conversation'").select(F.get_json_object("metadata", "$.role").alias("role"), "text")
    made = P.ingest(P.conversation_chunks(talk), F.lit("2025-01-01"))
    return made.select("id", "parentId", X.content_hash(F.col("text")).alias("hash"), F.col("tokensEstimate").alias("tokens"), "text")


@register("ingest_documents")
def ingest_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("source", "text", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    return P.ingest(docs, F.lit("2025-01-01")).groupBy("type", F.col("parentId").isNotNull().alias("is_piece")).agg(F.count("*").alias("n"), F.sum("tokensEstimate").alias("tokens"))


@register("code_symbols")
def code_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return S.symbols_of(S.extract_rows(table(spark, folder, "chunks"))).groupBy("language", "kind", "isExported").agg(F.count("*").alias("n"), F.countDistinct("normalizedName").alias("names"))


@register("code_references")
def code_references(spark: SparkSession, folder: str) -> DataFrame:
    return S.references_of(S.extract_rows(table(spark, folder, "chunks"))).groupBy("language", "kind").agg(F.count("*").alias("n"), F.countDistinct("normalizedTarget").alias("targets"))
