"""Telling hand-written source from generated, minified, vendored and data files with a random forest.

Labels come from notices: in the leading comment ("generated by ...; do not edit", a third party's banner), in the
name (lock files and snapshots, `.min.js`, folders and endings of generated code), and, as embedded data carries neither, from bodies that are one literal.
Whatever gives a label is hidden from the features: they are measured on the text without its notice, and neither
the names nor the share of literals are among them. Features are compression ratio, token entropy, identifier
lengths, comment density, the shapes of tokens and lines, and the folders of the path.

A first forest, taught with every unlabelled file as hand-written, sorts these: what it finds machine-made is taught
as that to the second forest, what is doubtful isn't taught. The second judges all files, labelled ones too; a label
decides nothing. There is one exception: the body of a third party's copy is ordinary hand-written code, so where
only its banner tells, no feature can. A file with a third party's banner is found by its banner (`by` says so).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.materialize import materialize, widen

#: Most files the forest is taught with, a sample by hash of the path.
TEACH_FILES = 20_000
#: First forest's probability from which an unlabelled file isn't taught as hand-written.
DOUBT = 0.15
#: First forest's probability from which it is taught as machine-made.
SURE = 0.5
TREES, DEPTH = 40, 9
#: Characters from which a token is long (hashes, encoded data).
LONG_TOKEN = 24

# --- fixed values: notices -----------------------------------------------------------------------------
GENERATED = re.compile(
    r"(?i)@generated\b|<auto-?generated|\bauto-?generated\b(?!\s+ids)|\bautomatically generated\b|\bcode generated (?:by|from)\b|^\W*generated (?:by|from|with|using|at|on)\b|\bthis (?:file|code|module) (?:is|was) (?:auto(?:matically)?[- ]?)?generated\b|"
    r"\bdo not (?:edit|modify|change)(?:\W+(?:this file|by hand|manually|directly)\b|\W*$|\s*:)|\bmachine[- ]generated\b|^\W*snapshot v\d|\bedit the (?:schema|template|source|spec) instead\b|"
    r"\bautomatisch (?:erzeugt|generiert)\b|\bnicht (?:von hand|manuell) (?:bearbeiten|ändern)\b|\bgénéré automatiquement\b|\bne pas (?:modifier|éditer)\b|\bgenerado automáticamente\b|\bno (?:editar|modificar)\b"
)
VENDORED = re.compile(r"(?i)\bupstream:|\bmirrored from\b|\bvendored (?:from|copy)\b|\bcopied verbatim\b|\bcopied from \S+ \(|\bimported from \S+ (?:release|version|v?\d)|^\W*[\w.@/-]+ v?\d+\.\d+(?:\.\d+)?\b(?=.*(?:\(c\)|copyright|licen[cs]e|\||$))|\(c\)\s+(?:\d{4}\s+)?the (?!project\b)[\w.-]+ (?:authors|contributors|team)")
MINIFIED = re.compile(r"^/\*!\s*[\w.-]+\s*\*/")
#: An annotation that says the same in code.
ANNOTATION = re.compile(r"\A\s*@(?:javax\.annotation\.(?:processing\.)?)?Generated\b")
TRAILER = re.compile(r"//[#@] sourceMappingURL=\S+\s*$")
# --- fixed values: path parts --------------------------------------------------------------------------
VENDOR_DIRS = frozenset("node_modules bower_components vendor third_party third-party thirdparty external externals site-packages pods upstream jspm_packages godeps".split())
GENERATED_DIRS = frozenset("gen generated __generated__ codegen generated-sources generated_src autogen autogenerated".split())
DATA_DIRS = frozenset("data fixtures testdata __snapshots__ __fixtures__".split())
GENERATED_NAME = re.compile(r"(?i)(?:\.pb|\.g|\.gen|\.generated|_pb2|_generated|\.designer)\.[a-z]+$|_pb2_grpc\.py$")
MINIFIED_NAME = re.compile(r"(?i)(?:[.-]min|\.bundle|\.chunk|[.-][0-9a-f]{8,20})\.(?:js|css|mjs|cjs)$")
LOCK_NAME = re.compile(r"(?i)(?:^|/)(?:[^/]*\.lock|package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.yaml|go\.sum|[^/]*\.lockfile|[^/]*\.snap)$")
CODE_NAME = re.compile(r"(?i)\.(?:js|ts|jsx|tsx|mjs|cjs|py|go|rs|java|c|h|cc|cpp|cs|rb|php|swift|kt|scala|css|sh)$")

_SPLIT_MARK = re.compile(r"\A(?:\[split from \d+ sub-chunks\] |\[…\]\s*\n|\[\.\.\.\]\s*\n)")
_COMMENT_LINE = re.compile(r"^\s*(?://|#(?!\[|include|define|if|endif|pragma)|/\*|\*|--|;;|<!--|\"\"\"|''')")
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|\S")
_COMMENT_START = re.compile(r"(?m)//|^[^\S\n]*#|/\*")
_LITERAL_BODY = re.compile(r"""(?:0x[0-9a-fA-F]+|[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[\s,:\[\]{}()&])+""")
_NO_DIGITS = str.maketrans("", "", "0123456789")
_SHAPE = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*")

#: Sums per file, added up over its chunks.
SUMS = ["rows", "chars", "packed", "tokens", "distinct", "entropy", "idents", "ident_chars", "short_idents", "comments", "lines", "shapes", "digits", "blanks", "signs", "numbers", "literal", "long_chars"]
FEATURES = ["ratio", "token_entropy", "distinct_share", "ident_length", "short_share", "comment_density", "line_length", "longest", "digit_share", "blank_share", "sign_share", "number_share", "shape_share", "long_share", "vendor_dir", "data_dir"]
#: What gives labels besides the notice of a text. None of it is a feature.
LABEL_GIVING = ["generated_dir", "generated_name", "lock_name", "minified_name", "code_name", "literal_share", "size"]


def _header(text: str) -> tuple[list[str], str]:
    """Leading comment lines, however many, and the rest."""
    at, inside, head = 0, False, []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        bare = text[at:end].strip()
        if inside:
            inside = "*/" not in bare
        elif bare.startswith("/*"):
            inside = "*/" not in bare
            if not inside and not bare.endswith("*/"):
                break
        elif bare and not _COMMENT_LINE.match(bare):
            break
        head.append(text[at:end])
        at = end + 1
    return head, text[at:]


def notice(text: str, first: bool) -> tuple[str | None, str]:
    """The kind of notice a text carries (generated, vendored, minified), and the text without it."""
    text = _SPLIT_MARK.sub("", text).replace("\r\n", "\n")
    body, kind = text, None
    if first:
        head, rest = _header(text)
        if any(GENERATED.search(x.strip()) for x in head):
            kind, body = "generated", rest
        elif any(VENDORED.search(x.strip().lstrip("/*#!- ").rstrip("*/ ")) for x in head):
            kind, body = "vendored", rest
        elif ANNOTATION.match(rest):
            kind, body = "generated", rest.lstrip().partition("\n")[2]
        elif MINIFIED.match(text):
            kind, body = "minified", MINIFIED.sub("", text)
    cut = TRAILER.sub("", body)
    if kind is None and len(cut) != len(body) and max(map(len, body.split("\n")), default=0) > 300:
        kind = "minified"
    return kind, cut


def comment_chars(text: str) -> int:
    """Characters within comments; one that is never closed has none."""
    total = at = 0
    closed = True
    while m := _COMMENT_START.search(text, at):
        if m[0] != "/*":
            end = text.find("\n", m.end())
            end = len(text) if end < 0 else end
        else:
            end = text.find("*/", m.end()) + 2 if closed else 1
            if end == 1:
                closed, at = False, m.end()
                continue
        total, at = total + end - m.start(), end
    return total


def measure(text: str) -> dict[str, float]:
    """The sums of one text that `FEATURES` are made of."""
    counts = Counter(_TOKEN.findall(text))
    n = idents = ident_chars = short = numbers = signs = long_chars = 0
    logs = 0.0
    for token, c in counts.items():
        n += c
        logs += c * math.log2(c)
        size, first = len(token), token[0]
        if first.isalpha() or first in "_$":
            idents += c
            ident_chars += size * c
            if size <= 2:
                short += c
        elif first.isdigit():
            numbers += c
        elif size == 1 and not first.isalnum():
            signs += c
        if size == 1 and first in "_$":
            signs += c
        if size >= LONG_TOKEN:
            long_chars += size * c
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    raw = text.encode("utf-8", "surrogatepass")
    literal = max((m.end() - m.start() for m in _LITERAL_BODY.finditer(text)), default=0) if numbers * 3 > n or '"' in text else 0
    return {
        "rows": 1, "chars": len(text), "packed": len(zlib.compress(raw, 1)) * len(text) / max(1, len(raw)), "tokens": n, "distinct": len(counts), "entropy": n * math.log2(n) - logs if n else 0.0, "idents": idents, "ident_chars": ident_chars,
        "short_idents": short, "comments": comment_chars(text), "lines": len(lines), "shapes": len({_SHAPE.sub("a", x) for x in lines}),
        "digits": len(text) - len(text.translate(_NO_DIGITS)), "blanks": len(text) - sum(map(len, text.split())), "signs": signs, "numbers": numbers, "literal": literal, "long_chars": long_chars,
    }


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path, text, later in zip(batch["path"], batch["t"], batch["later"]):
            kind, body = notice(text, not later and not text.startswith("[…]"))
            out.append((path, kind, float(max(map(len, body.split("\n")), default=0)), *measure(body).values()))
        yield pd.DataFrame(out, columns=["path", "notice", "longest", *SUMS]).astype(dict.fromkeys(SUMS, "float64"))


def file_features(chunks: DataFrame, path: str = "path", text: str = "text", source: str = "source", metadata: str = "metadata") -> DataFrame:
    """One row per stored path: path, notice, and the `FEATURES`, summed over the file's chunks.

    Split parents (a notice and the file's beginning) only give their notice.
    """
    split = F.coalesce(F.get_json_object(F.col("m"), "$.split") == "true", F.lit(False)) | F.col("t").startswith("[split from ")
    flat = chunks.select(F.col(path).alias("path"), F.col(text).alias("t"), F.col(source).alias("s"), F.col(metadata).alias("m")).where("path IS NOT NULL AND t IS NOT NULL AND t <> '' AND (s IS NULL OR s = 'file')")
    rows = flat.select("path", "t", split.alias("parent"), F.coalesce(F.get_json_object("m", "$.splitIndex").cast("int") > 0, F.lit(False)).alias("later"))
    schema = "path string, notice string, longest double, " + ", ".join(f"{c} double" for c in SUMS)
    measured = widen(rows.select("path", "t", "later").where(~F.col("parent"))).mapInPandas(_rows, schema)
    heads = rows.where("parent").select("path", "t", "later").mapInPandas(_rows, schema).select("path", "notice", F.lit(0.0).alias("longest"), *(F.lit(0.0).alias(c) for c in SUMS))
    sums = measured.unionByName(heads).groupBy("path").agg(F.min("notice").alias("notice"), F.max("longest").alias("longest"), *(F.sum(c).alias(c) for c in SUMS))

    def per(a: str, b: str) -> F.Column:
        return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))

    flat_path = F.lower(F.translate("path", "\\", "/"))
    dirs = F.slice(F.split(flat_path, "/"), 1, F.greatest(F.size(F.split(flat_path, "/")) - 1, F.lit(0)))

    def within(names: frozenset[str]) -> F.Column:
        return F.arrays_overlap(dirs, F.array(*(F.lit(x) for x in sorted(names)))).cast("double")

    name = {k: F.coalesce(flat_path.rlike(p.pattern), F.lit(False)).cast("double") for k, p in (("generated_name", GENERATED_NAME), ("minified_name", MINIFIED_NAME), ("lock_name", LOCK_NAME), ("code_name", CODE_NAME))}
    return sums.select(
        "path", "notice", per("packed", "chars").alias("ratio"), per("entropy", "tokens").alias("token_entropy"), per("distinct", "tokens").alias("distinct_share"), per("ident_chars", "idents").alias("ident_length"), per("short_idents", "idents").alias("short_share"), per("comments", "chars").alias("comment_density"),
        F.log1p(per("chars", "lines")).alias("line_length"), F.log1p("longest").alias("longest"), per("digits", "chars").alias("digit_share"), per("blanks", "chars").alias("blank_share"), per("signs", "tokens").alias("sign_share"), per("numbers", "tokens").alias("number_share"), per("shapes", "lines").alias("shape_share"), per("literal", "chars").alias("literal_share"), per("long_chars", "chars").alias("long_share"),
        F.log1p("chars").alias("size"), within(VENDOR_DIRS).alias("vendor_dir"), within(GENERATED_DIRS).alias("generated_dir"), within(DATA_DIRS).alias("data_dir"), *(c.alias(k) for k, c in name.items()),
    )


def labels() -> F.Column:
    """The kind a file is labelled with: by its notice, by a name that is one, or by a body that is one literal."""
    data = (F.col("literal_share") > 0.7) & (F.col("size") > math.log1p(800)) & (F.col("code_name") > 0)
    return F.coalesce(F.col("notice"), F.when((F.col("lock_name") > 0) | (F.col("generated_name") > 0) | (F.col("generated_dir") * F.col("code_name") > 0), "generated"), F.when(F.col("minified_name") > 0, "minified"), F.when(data, "data"))


def judge_files(chunks: DataFrame, path: str = "path", text: str = "text", source: str = "source", metadata: str = "metadata", teach_files: int = TEACH_FILES, threshold: float = 0.5, seed: int = 7) -> DataFrame:
    """Every stored file's judgement: `path`, label (kind of notice, or null), probability, machine_made, by.

    Chunks without a path or text, and those not from files, are left out. `machine_made` is true for files the
    forest gives at least `threshold` (`by` is "forest") and for those with a third party's banner ("banner" where
    the forest didn't find them). Without at least one labelled and one unlabelled file there is nothing to learn
    from, and the labels are all that is known ("label"). Repeated rows of a chunk weigh twice in the shares, which
    stay shares.
    """
    files = materialize(file_features(chunks, path, text, source, metadata).withColumn("label_kind", labels()))
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(files).withColumn("label", F.col("label_kind").isNotNull().cast("double"))
    sample = materialize(table.orderBy(F.xxhash64("path"), "path").limit(teach_files).select("path", "features", "label"))
    marked, total = sample.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    shown = [F.col("path").alias(path), F.col("label_kind").alias("label")]
    if not 0 < marked < total:
        told = F.col("label_kind").isNotNull()
        return files.select(*shown, told.cast("double").alias("probability"), told.alias("machine_made"), F.when(told, "label").alias("by"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="0.6", subsamplingRate=0.8, maxBins=64, minInstancesPerNode=2)
    chance = vector_to_array("probability")[1]
    first = forest.fit(sample).transform(sample)
    sure = first.where((F.col("label") > 0) | (chance < DOUBT) | (chance >= SURE)).select("features", F.when(chance >= SURE, 1.0).otherwise(F.col("label")).alias("label"))
    final = forest.fit(materialize(sure))
    judged = final.transform(table).withColumn("by", F.when(chance >= threshold, "forest").when(F.col("notice") == "vendored", "banner"))
    return judged.select(*shown, F.round(chance, 6).alias("probability"), F.col("by").isNotNull().alias("machine_made"), "by")
