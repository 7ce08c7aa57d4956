"""Text functions as Column expressions: everything stays inside the JVM.

All character classes are ASCII, as in the behaviour they reproduce; lengths are code points.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: stop words and word lists -----------------------------------------------------------
QUERY_STOP = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can need dare ought used to of in for on with at by from "
    "it its this that these those i me my we how why what who when where which than then please using use uses add fix find"
).split()
FTS_STOP = (
    "the and for are but not you all can had her was one our out has have from been were will would could should than then into when where which "
    "their that this with does how what why who its"
).split()
LEXICAL_STOP = "that this with from does have been were will would could should than then into when where which their".split()
GREP_STOP = (
    "the and for are but not you all can had her was one our out has have from been were will would could should than then into when where which "
    "their that this with does how what why who its about there some more only also just like very"
).split()
SPARSE_STOP = "add new fix how why what where when does using uses use support supports should currently actually properly different causing flow logic large files".split()
PATH_INTENT_STOP = [*SPARSE_STOP, *"context count file information show statistics total type types".split()]
STEM_DENY = "class status address process access express async await string bytes native series species analysis business success".split()
INTENT_WORDS = {
    "debug": "error bug fail crash broken fix issue exception trace wrong unexpected".split(),
    "implement": "add create build implement write make new feature support switch update change modify enhance".split(),
    "explain": "how why what explain understand describe meaning purpose does".split(),
    "code_search": "where find locate search show grep file function class module".split(),
}
MUTATION_WORDS = "add build change create enhance extend implement improve make modify refactor switch update write".split()
BROAD_WORDS = "all entire everything whole comprehensive complete full overall architecture system overview every multiple various several".split()
NARROW_WORDS = "exact specific only just single one this precise particular".split()
CODE_SUFFIXES = "ts|tsx|js|jsx|py|rs|go|java"
STRONG_STOP = "contain contains defined definition file files find grep locate show where which".split()
LANGUAGE_BY_SUFFIX = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "rs": "rust", "go": "go", "java": "java", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "sh": "shell", "sql": "sql", "css": "css",
}
LANGUAGE_ALIASES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "rs": "rust", "golang": "go", "md": "markdown", "yml": "yaml", "bash": "shell", "sh": "shell", "node": "javascript", "python3": "python"}
GIT_CHANGE_WEIGHT = {"added": 0.9, "modified": 0.7, "deleted": 0.3}
LOOKUP_OPENING = r"^(?i)(where|find|locate|show|grep|which\s+file)\b"
CONSTRAINT_START = r"^(?i)(must|shall|should|need to|make sure|ensure|always|never|require|mandatory|critical)\b"
INSTRUCTION_START = r"^(?i)(add|remove|fix|implement|refactor|change|update|create|delete|move|rename|extract|split|merge)\b"
CODE_WORDS = r"\b(function|class|import|export|const|let|var|def|async|return|interface|type |enum)\b"


def strings(values: Iterable[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _keep(words: Column, longer_than: int, stop: Iterable[str] = ()) -> Column:
    stop = list(stop)
    return F.filter(words, lambda w: (F.length(w) > longer_than) & (~w.isin(*stop) if stop else F.lit(True)))


def token_estimate(text: Column) -> Column:
    """A token is a started group of four characters; null counts as empty."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def word_token_estimate(text: Column) -> Column:
    return F.ceil(F.size(F.split(text, r"\s+")) * 1.3).cast("long")


def content_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def normalize_symbol(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^a-z0-9_$]", "")


def normalize_identifier(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^a-z0-9_$./:\-]", "")


def split_identifier(name: Column) -> Column:
    """Parts of a camel, snake or path-like name: lower case, at least two characters."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_$./:\-]+", " ")
    return _keep(F.split(F.lower(spaced), r"\s+"), 1)


def field_tokens(value: Column) -> Column:
    """Normalised tokens of a path or name."""
    parts = F.flatten(F.transform(F.split(value, r"[/. _:\-]+"), split_identifier))
    return _keep(F.transform(parts, normalize_symbol), 1)


def same_start(a: Column, b: Column, n: int = 4) -> Column:
    """Whether two words share their first `n` characters."""
    return (F.length(a) >= n) & (F.length(b) >= n) & (F.left(a, F.lit(n)) == F.left(b, F.lit(n)))


def stem(term: Column) -> Column:
    t = normalize_symbol(term)
    n = F.length(t)

    def cut(k: int, ending: str = "") -> Column:
        return F.concat(F.substring(t, F.lit(1), n - k), F.lit(ending))

    cutted = (
        F.when(t.endswith("ies") & (n > 5), cut(3, "y")).when(t.endswith("ing") & (n > 6), cut(3)).when(t.endswith("ed") & (n > 5), cut(2)).when(t.endswith("es") & (n > 5), cut(2)).when(t.endswith("s") & (n > 4) & ~t.endswith("ss"), cut(1)).otherwise(t)
    )
    return F.when(t.isin(*STEM_DENY), t).when(F.length(cutted) >= 4, cutted).otherwise(t)


def singular_plural_match(a: Column, b: Column) -> Column:
    def y(x: Column) -> Column:
        return F.concat(F.substring(x, F.lit(1), F.length(x) - 3), F.lit("y"))

    pair = (F.concat(a, F.lit("s")) == b) | (F.concat(b, F.lit("s")) == a) | (a.endswith("ies") & (y(a) == b)) | (b.endswith("ies") & (y(b) == a))
    return (a == b) | ((F.length(a) > 2) & (F.length(b) > 2) & pair)


def _words(query: Column, keep: str) -> Column:
    return F.split(F.regexp_replace(F.lower(query), keep, " "), r"\s+")


def query_terms(query: Column) -> Column:
    """Distinct terms of a query, in order."""
    return F.array_distinct(_keep(_words(query, r"[^a-z0-9_\s]"), 2, QUERY_STOP))


def fts_terms(query: Column) -> Column:
    """Terms of the full-text arm; repeated ones stay."""
    return _keep(_words(query, r"[^a-z0-9\s]"), 2, FTS_STOP)


def lexical_terms(query: Column) -> Column:
    return F.array_distinct(_keep(_words(query, r"[^a-z0-9_\s]"), 3, LEXICAL_STOP))


def bm25f_terms(text: Column) -> Column:
    return _keep(_words(text, r"[^a-z0-9_\s]"), 1)


def grep_terms(query: Column) -> Column:
    return F.array_distinct(_keep(_words(query, r"[^a-z0-9_\s]"), 3, GREP_STOP))


def embedding_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]", ""), r"\s+", " "))


def index_terms(text: Column) -> Column:
    """Terms of the inverted index: runs of letters and digits, folded to lower case without diacritics.

    Folding covers Latin letters with a single mark; other scripts are kept as they are.
    """
    marked = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįıĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
    plain = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"
    folded = F.translate(F.lower(text), marked, plain)
    return F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}\p{Co}]+)"), 1)


def classify(text: Column, source: Column) -> Column:
    """The chunk's type, by the first rule that holds."""
    return (
        F.when(source.contains("diff") | text.rlike(r"^diff --git|^--- [ab]/"), "diff")
        .when(source.contains("log") | text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), "log")
        .when(source == "summary", "summary")
        .when(source.contains("reference") | source.contains("doc"), "reference")
        .when(source == "conversation", F.when(text.rlike(CONSTRAINT_START), "constraint").when(text.rlike(INSTRUCTION_START), "instruction").otherwise("fact"))
        .when(source.contains("file") & text.rlike(CODE_WORDS), "code")
        .otherwise("fact")
    )


def language_of(path: Column, language: Column | None = None) -> Column:
    """A normalised language name: the alias of the one given, else by suffix of the path."""
    by_suffix = F.create_map(*(F.lit(x) for kv in LANGUAGE_BY_SUFFIX.items() for x in kv))
    alias = F.create_map(*(F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv))
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    guessed = F.try_element_at(by_suffix, suffix)
    if language is None:
        return guessed
    given = F.nullif(F.lower(F.trim(language)), F.lit(""))
    return F.coalesce(F.try_element_at(alias, given), given, guessed)


def normalize_path(path: Column) -> Column:
    """Forward slashes, without a leading `./`."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(?:\./)+", "")


def code_shaped(token: Column) -> Column:
    return token.rlike(r"[a-z0-9][A-Z]|_|^[A-Z][a-z0-9]+[A-Z]|\(\)$|\.[a-z]{1,4}$")


def git_change_weight(change: Column) -> Column:
    expr = F
    for kind, weight in GIT_CHANGE_WEIGHT.items():
        expr = expr.when(change == kind, F.lit(weight))
    return expr.otherwise(F.lit(0.0))


def score_breakdown(structural: Column, vector: Column, fts: Column, graph: Column, dependency: Column, final: Column) -> Column:
    zero = F.lit(0.0)
    return F.format_string("scores structural=%.3f vector=%.3f fts=%.3f graph=%.3f dependency=%.3f final=%.3f", *(F.coalesce(c, zero) for c in (structural, vector, fts, graph, dependency, final)))


# --- fixed values: sections of agent-instruction files ---
CATEGORIES = {
    "security": r"\b(security|secret|credential|permission|auth|sandbox|safe|privacy)\b",
    "performance": r"\b(performance|latency|memory|speed|efficient|throughput)\b",
    "build-test": r"\b(test|build|lint|run|install|command|npm|yarn|pnpm|ci)\b",
    "architecture": r"\b(architecture|module|design|structure|service|component)\b",
    "coding-style": r"\b(style|format|naming|convention|typescript|javascript)\b",
}
MODAL_WORDS = r"(?i)\b(must|never|required|forbidden|always|only|avoid|do not|don't|should not|cannot|can't)\b"


def instruction_category(text: Column) -> Column:
    """What a section of an agent-instruction file is about, by the first rule that holds."""
    low = F.lower(text)
    expr = F
    for name, pattern in CATEGORIES.items():
        expr = expr.when(low.rlike(pattern), name)
    return expr.otherwise("general")


def is_constraint(text: Column) -> Column:
    return text.rlike(MODAL_WORDS)


def first_sentence(text: Column) -> Column:
    return F.element_at(F.split(F.trim(text), r"(?<=[.!?])\s+"), 1)


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.left(text, F.lit(n - 1))), F.lit("…"))).otherwise(text)


def code_signatures(text: Column, most: int = 6) -> Column:
    pattern = r"(?m)^\s*((?:export\s+|public\s+|private\s+|async\s+|pub\s+)*(?:function|class|interface|type|def|fn|func|struct|enum)\s+[A-Za-z_$][\w$]*[^\n{;]*)"
    return F.slice(F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), F.trim), 1, most)


def commit_intent(subject: Column) -> Column:
    low = F.lower(subject)
    return F.when(low.rlike(r"\b(fix|fixes|fixed|bug|crash|error|regression|broken)\b"), "debug").when(low.rlike(r"\b(add|adds|implement|support|feature|introduce|create)\b"), "implement").when(low.rlike(r"\b(doc|docs|explain|describe|clarify)\b"), "explain").otherwise("code_search")


def commit_query(message: Column, most: int = 320) -> Column:
    """A task text from a commit message: without its conventional prefix and trailers, first paragraph."""
    body = F.regexp_replace(message, r"(?m)^(?:Signed-off-by|Co-authored-by|Reviewed-by|Change-Id|Fixes|Closes|Refs)[ :#].*$", "")
    bare = F.regexp_replace(F.trim(body), r"^(?:[a-z]+(?:\([^)]*\))?!?:|\[[^\]]+\])\s*", "")
    return F.left(F.trim(F.regexp_replace(F.element_at(F.split(bare, r"\n\s*\n"), 1), r"\s+", " ")), F.lit(most))


def leaks_path(message: Column, path: Column) -> Column:
    """Whether a message names the file: by path, by name with suffix, or by a code-shaped stem."""
    base = F.regexp_extract(path, r"([^/]+)$", 1)
    name = F.regexp_replace(base, r"\.[^.]+$", "")
    return message.contains(path) | message.contains(base) | (code_shaped(name) & message.contains(name))
