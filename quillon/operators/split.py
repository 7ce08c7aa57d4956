"""Splitting texts into chunks by strategy (recursive, markdown, code), and whole ingest of texts.

Splitting works on positions. A strategy is a list of levels, coarse to fine, each a way to find the places where a
stretch of text may be cut (a heading, the beginning of a declaration, a separator). One routine packs the stretches
of a level into spans that fit and takes the next level for a stretch that doesn't; pieces are slices of the text.

This is a loop over a single text and runs in Python, batch-wise, for oversized rows only; everything around it
(strategy, ids, hashes, parents, types) is expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as X

# fixed values: limits, separators and what begins a unit of code
MAX_TOKENS, OVERLAP_TOKENS, CHARS = 2000, 200, 4
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")
PARENT_CHARS = 200
CODE_LANGUAGES = ("typescript", "javascript", "python", "rust", "go", "java")
CODE_ENDINGS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "py", "rs", "go", "java")
IMPORT_WORDS = frozenset("import from require use #include".split())
MODIFIERS = "export default declare async abstract public private protected static final unsafe pub".split()
DECLARATIONS = "function class interface type enum namespace module def fn struct impl trait func record mod".split()
OVERLAP_MARK = "[…]\n"


def strategy(path: Column, language: Column) -> Column:
    """markdown, code or recursive, by language first, then by the path's ending."""
    lang, ending = F.lower(language), F.lower(F.regexp_extract(path, r"([^.]*)$", 1))
    return F.when((lang == "markdown") | path.endswith(".md"), "markdown").when(lang.isin(*CODE_LANGUAGES), "code").when(path.isNotNull() & ending.isin(*CODE_ENDINGS), "code").when(path.isNotNull() & (ending == "md"), "markdown").otherwise("recursive")


Span = tuple[int, int]
#: A top-level line that begins a declaration: modifiers, a keyword and a name, or a name bound to a function.
_DECLARED = re.compile(r"(?m)^(?:(?:" + "|".join(MODIFIERS) + r")(?:\([^)\n]*\))?[ \t]+)*(?:(?:" + "|".join(DECLARATIONS) + r")\b[ \t*]*[\w$(<]|(?:const|let|var)[ \t]+[\w$]+[^=\n]*=[ \t]*(?:async\b|function\b|\(|<|[\w$]+[ \t]*=>))")
_HEADING = re.compile(r"(?m)^#{1,3}\s")
Level = Callable[[str, int, int], list[Span]]


def at_separator(separator: str) -> Level:
    """Stretches between the separators, which belong to none."""

    def stretches(text: str, start: int, stop: int) -> list[Span]:
        out, at = [], start
        while (cut := text.find(separator, at, stop)) >= 0:
            out.append((at, cut))
            at = cut + len(separator)
        return [*out, (at, stop)]

    return stretches


def before(starts: re.Pattern, attached: str = "") -> Level:
    """Stretches from one match to the next; lines above a match that begin with one of `attached` go with it."""

    def stretches(text: str, start: int, stop: int) -> list[Span]:
        cuts = [start]
        for m in starts.finditer(text, start, stop):
            at = m.start()
            while attached and at > cuts[-1]:
                above = max(start, text.rfind("\n", start, at - 1) + 1)
                if above < cuts[-1] or text[above:at].lstrip()[:1] not in (*attached,):
                    break
                at = above
            if at > cuts[-1]:
                cuts.append(at)
        return list(zip(cuts, [*cuts[1:], stop]))

    return stretches


def trimmed(text: str, span: Span) -> Span:
    """The span without white space at its ends."""
    part = text[span[0] : span[1]]
    return span[0] + len(part) - len(part.lstrip()), span[1] - len(part) + len(part.rstrip()) if part.strip() else span[0] + len(part) - len(part.lstrip())


def spans(text: str, start: int, stop: int, levels: list[Level], size: int) -> list[Span]:
    """Spans of at most `size` characters that hold the text from `start` to `stop`, cut at the coarsest places possible."""
    if stop - start <= size:
        return [(start, stop)] if stop > start else []
    if not levels:
        return [(at, min(at + size, stop)) for at in range(start, stop, size)]
    out: list[Span] = []
    open_: Span | None = None
    for a, b in levels[0](text, start, stop):
        if open_ and b - open_[0] <= size:
            open_ = (open_[0], b)
            continue
        out += [open_] if open_ else []
        open_ = (a, b) if b - a <= size else None
        if not open_:
            out += spans(text, a, b, levels[1:], size)
    return [x for x in [*out, *([open_] if open_ else [])] if x[1] > x[0]]


def pieces(text: str, cuts: list[Span], overlap: int, lead: str = "") -> list[str]:
    """The slices at `cuts`, each after `lead`; all but the first repeat the end of the one before, from a line's start on."""
    out = []
    for n, (a, b) in enumerate(cuts):
        tail = ""
        if n and overlap > 0:
            c, d = cuts[n - 1]
            tail = text[max(c, d - overlap * CHARS) : d]
            tail = tail[tail.find("\n") + 1 :]
        out.append(lead + (f"{OVERLAP_MARK}{tail}" if tail.strip() else "") + text[a:b])
    return out


def by_characters(text: str, most: int, overlap: int) -> list[str]:
    """Windows of `most` tokens' characters, each beginning `overlap` tokens' before the end of the last."""
    if overlap >= most:
        raise ValueError("the overlap must be below the limit")
    step = (most - overlap) * CHARS
    return [text[at : at + most * CHARS] for at in range(0, max(1, len(text) - overlap * CHARS), step)]


_FINE = [at_separator(x) for x in SEPARATORS]


def recursive(text: str, most: int, overlap: int) -> list[str]:
    """Pieces cut at blank lines, else at lines, sentences, clauses, words, else anywhere."""
    return [text] if len(text) <= most * CHARS else pieces(text, spans(text, 0, len(text), _FINE, most * CHARS), overlap)


def markdown(text: str, most: int, overlap: int) -> list[str]:
    """Pieces of whole sections (headings of level 1 to 3); larger sections are cut as any text."""
    if not _HEADING.search(text):
        return recursive(text, most, overlap)
    cuts = spans(text, 0, len(text), [before(_HEADING), *_FINE], most * CHARS)
    return pieces(text, [x for x in (trimmed(text, c) for c in cuts) if x[1] > x[0]], overlap)


def code(text: str, most: int, overlap: int) -> list[str]:
    """Pieces of whole declarations, each led by the file's imports; larger declarations are cut as any text."""
    body = 0
    while body < len(text):
        end = text.find("\n", body)
        end = len(text) if end < 0 else end + 1
        words = text[body:end].replace("(", " ").split(None, 1)
        if words and words[0] not in IMPORT_WORDS:
            break
        body = end
    imports = text[:body].strip()
    if len(text) <= most * CHARS:
        return [text]
    if not _DECLARED.search(text, body):
        return recursive(text, most, overlap)
    lead = f"{imports}\n\n" if imports else ""
    # imports that leave hardly any room stand alone instead of leading every piece
    alone = len(lead) > most * CHARS // 2
    start, size = (0, most * CHARS) if alone else (body, most * CHARS - len(lead))
    cuts = spans(text, start, len(text), [before(_DECLARED, "@"), *_FINE], size)
    return pieces(text, [x for x in (trimmed(text, c) for c in cuts) if x[1] > x[0]], overlap, "" if alone else lead)


def split_text(text: str, how: str, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[str]:
    return {"code": code, "markdown": markdown}.get(how, recursive)(text, most, overlap)


def split_rows(rows: DataFrame, key: str, text: str = "text", how: str = "strategy", most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Pieces of oversized rows: `key`, splitIndex, splitTotal, text. Rows that make one piece have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t, h in zip(batch["k"], batch["t"], batch["h"]):
                parts = split_text(t, h, most, overlap)
                if len(parts) > 1:
                    out += [(k, i, len(parts), p) for i, p in enumerate(parts)]
            yield pd.DataFrame(out, columns=["k", "splitIndex", "splitTotal", "text"])

    large = rows.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(how).alias("h")).where(F.length("t") > most * CHARS)
    return large.mapInPandas(run, f"k {dict(large.dtypes)['k']}, splitIndex int, splitTotal int, text string").withColumnRenamed("k", key)


def ingest(rows: DataFrame, now: Column, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Chunks of texts: rows of source, text and optionally type, path, language, metadata become chunks.

    A text within the limit is one chunk; a larger one a parent (a notice and its first 200 characters) and its
    pieces. Types are classified where none is given; ids are hashes of place and content, so a retried task
    makes the same ones. Null texts are left out.
    """
    have = set(rows.columns)
    opt = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    base = rows.where("text IS NOT NULL").select(F.col("source").cast("string").alias("source"), opt("type").alias("given"), F.col("text").alias("text"), X.normalize_path(opt("path")).alias("path"), opt("language").alias("lang"), opt("metadata").alias("meta"))
    base = base.withColumn("language", X.language_of(F.col("path"), F.col("lang"))).withColumn("strategy", strategy(F.col("path"), F.col("language"))).withColumn("hash", X.content_hash(F.col("text")))
    ident = lambda i: F.sha2(F.concat_ws("|", F.coalesce("path", "source"), i, F.col("hash")), 256)
    base = base.withColumn("id", ident(F.lit("whole"))).dropDuplicates(["id"])
    cut = split_rows(base, "id", most=most, overlap=overlap)
    totals = cut.where("splitIndex = 0").select(F.col("id"), F.col("splitTotal").alias("n"))
    whole = base.join(totals, "id", "left")
    type_ = F.coalesce("given", X.classify(F.col("text"), F.coalesce("source", F.lit(""))))
    notice = F.concat(F.lit("[split from "), F.col("n").cast("string"), F.lit(" sub-chunks] "), F.left("text", F.lit(PARENT_CHARS)), F.lit("..."))
    body = F.when(F.col("n").isNotNull(), notice).otherwise(F.col("text"))
    note = F.when(F.col("n").isNotNull(), F.to_json(F.struct(F.lit(True).alias("split"), F.col("n").alias("childCount"), F.col("strategy"), F.col("hash").alias("contentHash")))).otherwise(F.coalesce("meta", F.to_json(F.struct(F.col("hash").alias("contentHash")))))
    tops = whole.select("id", "source", type_.alias("type"), body.alias("text"), now.cast("timestamp").alias("timestamp"), "path", "language", X.token_estimate(body).alias("tokensEstimate"), F.lit(None).cast("string").alias("parentId"), note.alias("metadata"))
    parts = cut.select(F.col("id").alias("parentId"), "splitIndex", "splitTotal", F.col("text").alias("piece")).join(base.select(F.col("id").alias("parentId"), "source", "given", "path", "language"), "parentId")
    piece_hash = X.content_hash(F.col("piece"))
    children = parts.select(
        F.sha2(F.concat_ws("|", "parentId", F.col("splitIndex").cast("string"), piece_hash), 256).alias("id"), "source", F.coalesce("given", X.classify(F.col("piece"), F.coalesce("source", F.lit("")))).alias("type"), F.col("piece").alias("text"), now.cast("timestamp").alias("timestamp"),
        "path", "language", X.token_estimate(F.col("piece")).alias("tokensEstimate"), "parentId", F.to_json(F.struct("splitIndex", "splitTotal", piece_hash.alias("contentHash"))).alias("metadata"),
    )
    return tops.unionByName(children)


def contains_edges(chunks: DataFrame) -> DataFrame:
    """Edges from split parents to their pieces, weight 1."""
    return chunks.where("parentId IS NOT NULL").select(F.col("parentId").alias("fromId"), F.col("id").alias("toId"), F.lit("contains").alias("type"), F.lit(1.0).alias("weight"))


def instruction_sections(files: DataFrame) -> DataFrame:
    """Agent-instruction files (path, content) as sections: path, position, text, type, category."""
    sections = F.filter(F.transform(F.split("content", r"(?m)(?=^#{1,3}\s+)"), lambda x: F.trim(x)), lambda s: s != "")
    rows = files.select("path", F.posexplode(sections).alias("position", "text"))
    return rows.select("path", "position", "text", F.when(X.is_constraint(F.col("text")), "constraint").otherwise("instruction").alias("type"), X.instruction_category(F.col("text")).alias("category"))


def conversation_chunks(messages: DataFrame) -> DataFrame:
    """Source rows for `ingest` from messages (role, text): one per message, the role kept in the metadata."""
    return messages.where("text IS NOT NULL").select(F.lit("conversation").alias("source"), F.col("text"), F.to_json(F.struct("role")).alias("metadata"))


def diff_chunks(diffs: DataFrame) -> DataFrame:
    return diffs.where("text IS NOT NULL").select(F.lit("diff").alias("source"), F.lit("diff").alias("type"), F.col("text"))


def git_changes(diffs: DataFrame, text: str = "text") -> DataFrame:
    """filePath, changeType, hunks of every file in unified diffs. A diff is one value, its lines are expressions.

    A file's section begins at its `diff --git` line; later lines win where they contradict.
    """
    sections = F.filter(F.split(F.concat(F.lit("\n"), F.regexp_replace(text, "\r\n", "\n")), r"\n(?=diff --git )"), lambda s: s.startswith("diff --git "))
    rows = diffs.where(F.col(text).isNotNull()).select(F.explode(sections).alias("s"))
    header = F.regexp_replace(F.regexp_extract("s", r"^diff --git \S+ (\S+)", 1), "^b/", "")
    named = F.regexp_extract("s", r"(?m)^\+\+\+ b/(.*)$", 1)
    deleted, added = F.col("s").rlike(r"(?m)^(deleted file mode|\+\+\+ /dev/null)"), F.col("s").rlike(r"(?m)^(new file mode|--- /dev/null)")
    out = rows.select(F.when(named != "", named).otherwise(header).alias("filePath"), F.when(deleted, "deleted").when(added, "added").otherwise("modified").alias("changeType"), F.size(F.regexp_extract_all("s", F.lit(r"(?m)^(@@)"), 1)).alias("hunks"))
    return out.where("filePath <> ''")
