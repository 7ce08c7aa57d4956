"""Files as a source: directory and project walks, language inference, ignore rules, corpus snapshots.

Listing and reading are Spark's (`binaryFile`, whole-directory partitions, symlinks not followed by the
recursive lookup); all rules are predicates on the path relative to the root, so unwanted files are filtered
before their content is decoded.
"""

from __future__ import annotations

import datetime
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators.ordered import running

# --- fixed values: folders, suffixes and names ---
WALK_SKIP = ("node_modules", ".git", "dist", ".next", ".cache")
PROJECT_SKIP = (".cache", ".git", ".hg", ".next", ".svn", ".turbo", ".venv", "__pycache__", "build", "coverage", "data", "dist", "node_modules", "out", "target", "vendor", "venv")
BINARY_SUFFIXES = ("png", "jpg", "jpeg", "gif", "ico", "woff", "woff2", "ttf", "eot", "svg", "webp", "mp3", "mp4", "zip", "gz", "tar", "db")
WATCH_SKIP = ("node_modules", ".git", "dist")
WATCH_BINARY = ("png", "jpg", "jpeg", "gif", "ico", "woff", "woff2", "ttf", "eot")
HIDDEN_CONTEXT = r"\.env\.example$|^\.github/copilot-instructions\.md$|^\.cursor/rules/"
HIDDEN_MOST = 1_000
CODE_LANGUAGES = ("typescript", "javascript", "python", "rust", "go", "java")
TEST_PATH = r"(?i)(^|/)(__tests__|tests?|spec|fixtures|mocks?)(/|$)|\.(test|spec)\.[cm]?[jt]sx?$|test_.*\.py$|_test\.go$"
CONFIG_NAME = r"(?i)^((tsconfig|jsconfig)(\..*)?\.json|(vite|next|nuxt|astro|svelte|vitest|jest|eslint|prettier|biome|rollup|webpack|babel)\.config\..*|docker-compose\..*ya?ml|compose\..*ya?ml|package\.json|package-lock\.json|dockerfile)$"


def _in_folder(path: Column, folders: tuple[str, ...]) -> Column:
    return path.rlike(r"(^|/)(" + "|".join(re.escape(f) for f in folders) + r")/")


def has_binary_suffix(path: Column, suffixes: tuple[str, ...] = BINARY_SUFFIXES) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(suffixes) + r")$")


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_code_path(path: Column) -> Column:
    return F.coalesce(X.language_of(path).isin(*CODE_LANGUAGES), F.lit(False))


def context_kind(path: Column, docs: bool = True) -> Column:
    """What a project file tells about the project, by the first rule that holds; null for none."""
    low = F.lower(X.normalize_path(path))
    base = F.regexp_extract(low, r"([^/]*)$", 1)
    agent = base.isin("agents.md", "claude.md") | (low == ".github/copilot-instructions.md") | low.startswith(".cursor/rules/")
    documentation = F.lit(docs) & (base.rlike(r"^readme(\.[^.]+)?$") | (low.startswith("docs/") & base.endswith(".md")))
    return F.when(agent, "agent-instruction").when(base.endswith(".env.example"), "environment").when(documentation, "documentation").when(base.rlike(CONFIG_NAME), "configuration")


def ignored(path: Column, patterns: list[str] = ()) -> Column:
    """The watcher's ignore rule: three folders, binary suffixes, and patterns (`*` as anything, else substring)."""
    out = F.concat(F.lit("/"), path).rlike(r"/(" + "|".join(re.escape(f) for f in WATCH_SKIP) + r")(/|$)") | path.rlike(r"\.(" + "|".join(WATCH_BINARY) + r")$")
    for pattern in patterns:
        bare = re.sub(r"^/|/$", "", pattern.strip())
        if bare and not bare.startswith("#"):
            out = out | (path.rlike(".*".join(re.escape(p) for p in bare.split("*"))) if "*" in bare else path.contains(bare))
    return out


def read_directory(spark: SparkSession, root: str, max_bytes: int = (1 << 31) - 1) -> DataFrame:
    """path (relative to the root), content, modified of every text file the plain walk takes.

    A wanted file over `max_bytes` (by default what one value can hold) raises, and so does a missing root.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root if "://" in root or root.startswith("file:") else os.path.abspath(root)
    plain = F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?", "")
    prefix = re.sub(r"^[a-z]+:(//[^/]*)?", "", base).rstrip("/") + "/"
    relative = F.when(plain.startswith(prefix), F.substring(plain, F.lit(len(prefix) + 1), F.length(plain))).otherwise(plain)
    take = lambda rows: rows.where(~_in_folder(F.col("rel"), WALK_SKIP) & ~has_binary_suffix(F.col("rel")))
    # listed first without content: the largest wanted file bounds what is read, so larger unwanted ones are not
    largest = take(found.select(relative.alias("rel"), "length")).agg(F.max(F.struct("length", "rel"))).first()[0]
    if largest and largest["length"] > max_bytes:
        raise ValueError(f"{largest['rel']} below {root} has {largest['length']} bytes, more than {max_bytes}")
    wanted = take(found.where(F.col("length") <= (largest["length"] if largest else 0)).select(relative.alias("rel"), "content", F.col("modificationTime").alias("modified")))
    out = wanted.select(F.col("rel").alias("path"), F.decode("content", "UTF-8").alias("content"), "modified")
    hidden = _hidden_files(base) if "://" not in base and not base.startswith("file:") else []
    return out.unionByName(spark.createDataFrame(hidden, out.schema)) if hidden else out


def _hidden_files(root: str) -> list[tuple]:
    """Context files whose names begin with a dot: Spark's file sources leave these out.

    Only such files are read here, on the driver: environment examples, rules and instructions, at most
    `HIDDEN_MOST`.
    """
    out: list[tuple] = []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if f not in PROJECT_SKIP and not os.path.islink(os.path.join(folder, f)))
        for name in sorted(names):
            full = os.path.join(folder, name)
            relative = os.path.relpath(full, root).replace(os.sep, "/")
            if not re.search(r"(^|/)[._]", relative) or not re.search(HIDDEN_CONTEXT, relative.lower()) or os.path.islink(full):
                continue
            if len(out) >= HIDDEN_MOST:
                raise ValueError(f"more than {HIDDEN_MOST} hidden context files below {root}")
            with open(full, encoding="utf-8", errors="replace") as f:
                out.append((relative, f.read(), datetime.datetime.fromtimestamp(os.path.getmtime(full))))
    return out


def project_files(files: DataFrame, docs: bool = True, tests: bool = False, benchmarks: bool = False) -> DataFrame:
    """The files of `read_directory` that a project walk keeps, with their context_kind."""
    path = F.col("path")
    keep = ~_in_folder(path, PROJECT_SKIP) & ~has_binary_suffix(path)
    if not tests:
        keep &= ~is_test_path(path)
    if not benchmarks:
        keep &= ~path.rlike(r"(^|/)benchmarks/")
    return files.where(keep).withColumn("context_kind", context_kind(path, docs)).where(is_code_path(path) | F.col("context_kind").isNotNull())


def count_project_files(files: DataFrame, **options: bool) -> int:
    """How many files a project ingest would take; no content is read."""
    return project_files(files.select("path"), **options).count()


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """path, content of a corpus snapshot: JSON of the form {"files": [{"path", "content"}]} or a bare list."""
    schema = "files array<struct<path:string,content:string>>, path string, content string"
    raw = spark.read.option("multiLine", "true").schema(schema).json(path)
    listed = raw.where("files IS NOT NULL").select(F.explode("files").alias("f")).select("f.path", "f.content")
    return listed.unionByName(raw.where("files IS NULL AND path IS NOT NULL").select("path", "content"))


def write_snapshot(files: DataFrame, path: str) -> None:
    files.select("path", "content").orderBy("path").write.mode("overwrite").json(path)


def cap_corpus(files: DataFrame, gold: DataFrame, most: int) -> DataFrame:
    """All gold files and, up to `most` in total, the first others by path; is_gold is added."""
    marked = files.join(gold.select(F.col("path").alias("gold_path")).distinct(), F.col("path") == F.col("gold_path"), "left").withColumn("is_gold", F.col("gold_path").isNotNull()).drop("gold_path")
    room = marked.where("is_gold").agg(F.greatest(F.lit(0), most - F.count("*")).alias("room"))
    # an ordered limit keeps at most `most` rows per task; the exact room is cut from those
    first = marked.where("NOT is_gold").orderBy("path").limit(most)
    numbered = running(first, ["path"], "nr").join(F.broadcast(room)).where(F.col("nr") <= F.col("room")).drop("nr", "room")
    return marked.where("is_gold").unionByName(numbered)


def within_roots(path: str, roots: list[str]) -> bool:
    """Whether the real path lies in one of the allowed roots; the working directory always is one."""
    real = os.path.realpath(path)
    return any(real == r or real.startswith(r.rstrip(os.sep) + os.sep) for r in (os.path.realpath(x) for x in [*roots, os.getcwd()]))
