"""Text functions, planning, splitting and structure extraction."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.functions import vector as V
from quillon.operators import compress as C
from quillon.operators import split as P
from quillon.operators import structure as S
from quillon.plans.planner import plan_queries


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first().x


@pytest.mark.parametrize("word,stem", [("queries", "query"), ("running", "runn"), ("boxes", "boxe"), ("matches", "match"), ("tokens", "token"), ("class", "class"), ("bytes", "bytes"), ("as", "as"), ("indexed", "index"), ("string", "string"), ("Stores", "stor"), ("using", "using")])
def test_stem(spark, word, stem):
    assert one(spark, X.stem(F.col("w")), w=word) == stem


def test_identifiers(spark):
    assert one(spark, X.split_identifier(F.col("n")), n="parseHTTPRequest_v2.ts") == ["parse", "httprequest", "v2", "ts"]
    assert one(spark, X.normalize_symbol(F.col("n")), n="My-Name$1!") == "myname$1"
    assert one(spark, X.field_tokens(F.col("n")), n="src/queryPlan/index.ts") == ["src", "query", "plan", "index", "ts"]
    assert one(spark, X.index_terms(F.col("n")), n="Größe, naïve café 12") == ["große", "naive", "cafe", "12"]


PLANS = [
    ("Where is parseQuery defined in src/core/plan.ts?", "code_search", "narrow", 5), ("fix the crash with wrong error", "debug", "moderate", 10), ("Add a flag to everything in the whole system architecture overview", "implement", "broad", 15), ("how does it work and why", "explain", "moderate", 10), ("", "general", "moderate", 8),
    ("find where we add the token", "code_search", "moderate", 5),
]


@pytest.mark.parametrize("text,intent,scope,k", PLANS)
def test_plans(spark, text, intent, scope, k):
    r = plan_queries(spark.createDataFrame([(1, text)], "query_id int, text string")).first()
    assert (r.intent, r.complexity, r.top_k) == (intent, scope, k)


def test_structural_features(spark):
    r = plan_queries(spark.createDataFrame([(1, 'find "QueryPlan" and my_fn in src/core/query-plan.ts')], "query_id int, text string")).first()
    s = r.structural
    assert s.pathFragments == ["src/core/query-plan.ts", "query-plan.ts"] and s.extensions == ["ts"] and s.quotedTerms == ["queryplan"]
    assert {"QueryPlan", "my_fn", "query-plan"} <= set(s.identifiers) and {"query", "plan", "fn"} <= set(s.identifierParts)
    assert "QueryPlan" in r.strong and "my_fn" in r.strong


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([], [])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0]

    def slow(text, dims):
        out = []
        for i in range(dims):
            h = i * 7919 + 1
            for ch in text:
                h = (h * 31 + ord(ch)) & 0xFFFFFFFF
            out.append((h - 2**32 if h >= 2**31 else h) / 2147483647)
        return np.array(out) / np.linalg.norm(out)

    got = one(spark, V.deterministic_embedding(F.col("t"), 16), t="Hello, World  again!")
    assert np.allclose(got, slow("hello world again", 16))
    h = 2166136261
    for ch in "abc":
        h = ((h ^ ord(ch)) * 16777619) % 2**32
    assert one(spark, V.fnv1a32(F.col("t")), t="abc") == h


def test_recursive_split():
    assert P.recursive("short", 10, 2) == ["short"]
    pieces = P.recursive("aaaa bbbb. " * 40, 20, 0)
    assert all(len(p) <= 80 for p in pieces) and ". ".join(pieces) == "aaaa bbbb. " * 40
    assert P.by_characters("x" * 100, 10, 2) == ["x" * 40, "x" * 40, "x" * 36] and P.by_characters("", 10, 2) == [""]
    with pytest.raises(ValueError):
        P.by_characters("x", 5, 5)
    assert P.pieces("line1\nline2\nb", [(0, 12), (12, 13)], 2) == ["line1\nline2\n", "[…]\nline2\nb"]
    assert P.pieces("one two threeb", [(0, 13), (13, 14)], 2, "i\n") == ["i\none two three", "i\n[…]\nwo threeb"]
    assert P.recursive("x" * 100, 10, 0) == ["x" * 40, "x" * 40, "x" * 20]


@pytest.mark.parametrize("how", ["recursive", "markdown", "code"])
def test_splits_fit_and_lose_nothing(how):
    """Whatever the text: pieces within the limit, in order, without overlaps, and every word in one of them."""
    import random

    rnd = random.Random(how)
    for _ in range(60):
        text = "".join(rnd.choice(["\n\n", "\n", ". ", "! ", "; ", ", ", " ", "# A\n", "## B ", "def f(x):", "class Q:\n", "export const a = () => {", "@dec\n", "import os\n", "w" * rnd.randint(1, 90), f"n{rnd.randint(0, 9999)}"]) for _ in range(rnd.randint(1, 300)))
        parts = P.split_text(text, how, 20, 0)
        assert len(parts) == 1 or all(0 < len(p) <= 80 for p in parts)
        bare = lambda s: "".join(c for c in s if c.isalnum())
        if how != "code":
            assert bare("".join(parts)) == bare(text)
        else:
            assert set(re.findall(r"n\d+", text)) == set(re.findall(r"n\d+", "".join(parts))) or any(len(x) > 70 for x in text.split())


def test_markdown_and_code_split():
    text = "# A\n\n" + "word " * 60 + "\n\n## B\n\n" + "more " * 60
    assert [p[:4] for p in P.markdown(text, 100, 0)] == ["# A\n", "## B"]
    code = "import os\nimport sys\n\n@cached\ndef one():\n" + "    x = 1\n" * 20 + "\nclass Two:\n" + "    y = 2\n" * 20
    pieces = P.code(code, 70, 0)
    assert len(pieces) == 2 and all(p.startswith("import os\nimport sys\n\n") for p in pieces) and "@cached" in pieces[0] and "class Two" in pieces[1]
    code = "import os\n\ndef a():\n" + "    x = 1\n" * 20 + "\n@one\n@two(3)\ndef b():\n" + "    y = 2\n" * 20
    assert "@one" not in P.code(code, 65, 0)[0] and P.code(code, 65, 0)[1].startswith("import os\n\n@one\n@two(3)\ndef b")
    assert P.code("x = 1\n" * 200, 50, 5) == P.recursive("x = 1\n" * 200, 50, 5)


def test_declarations_are_kept_whole():
    """Three functions over the limit together: one piece each, led by the import; a large one is cut within itself only."""

    def function(name, rows):
        return f"export function {name}() {{\n  return [\n" + "".join(f"    '{name}-{i}',\n" for i in range(rows)) + "  ].join(' ');\n}"

    text = 'import { helper } from "./helper";\n\n' + "\n\n".join(function(n, 8) for n in ("alpha", "beta", "gamma"))
    parts = P.code(text, 80, 0)
    assert len(parts) == 3 and all(p.startswith("import { helper }") and len(p) <= 320 for p in parts)
    assert [n for p in parts for n in ("alpha", "beta", "gamma") if f"function {n}" in p] == ["alpha", "beta", "gamma"]
    parts = P.code('import { helper } from "./helper";\n\n' + function("oversized", 48), 50, 0)
    assert len(parts) > 1 and "export function oversized" in parts[0] and all(p.startswith("import { helper }") and len(p) <= 200 for p in parts)
    text = 'import { foo } from "bar";\n\n' + "\n".join(f"function func{i}() {{\n  return {i};\n}}" for i in range(30))
    parts = P.code(text, 100, 10)
    assert len(parts) > 1 and all("import { foo }" in p and len(p) <= 4 * 160 for p in parts)
    prose = "\n\n".join(["This is a test sentence with enough words to use tokens."] * 50)
    assert all(len(p) <= 4 * 160 for p in P.recursive(prose, 100, 10)) and len(P.recursive(prose, 100, 10)) > 1


def test_ingest(spark):
    long = "# One\n\n" + "word " * 1200 + "\n\n# Two\n\n" + "text " * 1200
    rows = [("file", long, "./docs\\a.md", None), ("file", long, "docs/a.md", None), ("file", "export const x = 1", "src/b.ts", "TS"), ("conversation", "must not fail", None, None), ("file", None, "c", None), ("file", "", "d", None)]
    out = P.ingest(spark.createDataFrame(rows, "source string, text string, path string, language string"), F.lit("2025-01-01")).collect()
    parents = [r for r in out if r.text.startswith("[split from 2 sub-chunks]")]
    assert len(parents) == 1 and parents[0].path == "docs/a.md" and '"split":true' in parents[0].metadata
    assert sorted(r.metadata for r in out if r.parentId == parents[0].id)[0].startswith('{"splitIndex":0')
    by = {r.path or r.source: r for r in out if r.parentId is None}
    assert by["src/b.ts"].type == "code" and by["src/b.ts"].language == "typescript" and by["conversation"].type == "constraint" and by["d"].tokensEstimate == 0
    assert len({r.id for r in out}) == len(out) == 6


CODE = {
    "typescript": ("import { A } from './a';\nexport class Foo extends Bar implements Baz, Qux {\n  run(x: number): void {\n    this.go(x); helper(1);\n  }\n}\nexport const k = (a) => a;\nexport { A as B } from './c';\n", {("Foo", "class", True), ("run", "method", False), ("k", "function", True)}, {("./a", "import"), ("Bar", "inheritance"), ("Qux", "inheritance"), ("go", "call"), ("helper", "call"), ("A", "export"), ("./c", "export")}),
    "python": ("import os, sys as s\nfrom .x import y\nclass A(B):\n    def f(self):\n        return os.path.join(_g(1))\ndef _g(x):\n    pass\n__all__ = ['A']\n", {("A", "class", True), ("f", "method", True), ("_g", "function", False)}, {("os", "import"), ("sys", "import"), (".x", "import"), ("B", "inheritance"), ("os.path.join", "call"), ("A", "export")}),
    "go": ('package x\nimport "fmt"\ntype T struct {\n}\nfunc (t *T) Get() int {\n  return fmt.Sprint(1)\n}\nfunc low() {}\n', {("T", "struct", True), ("Get", "method", True), ("low", "function", False)}, {("fmt", "import"), ("fmt.Sprint", "call"), ("Get", "export")}),
    "rust": ("pub use a::b;\nmod m;\npub struct S {\n}\nfn f() { g::h(1); }\n", {("m", "module", False), ("S", "struct", True), ("f", "function", False)}, {("a::b", "import"), ("a::b", "export"), ("m", "module"), ("g::h", "call"), ("S", "export")}),
    "java": ("import a.b.C;\npublic class D extends E implements F {\n  public int run(int x) {\n    return other(x);\n  }\n}\n", {("D", "class", True), ("run", "method", True)}, {("a.b.C", "import"), ("E", "inheritance"), ("F", "inheritance"), ("other", "call"), ("D", "export")}),
}


@pytest.mark.parametrize("language", CODE)
def test_structure(language):
    text, symbols, references = CODE[language]
    s, r = S.extract(text, language)
    assert {(x[0], x[1], x[5]) for x in s} == symbols
    assert references <= {(x[0], x[1]) for x in r}
    assert S.extract(text.replace("\n", "\r\n"), language.upper())[0][0][0] == s[0][0]


FIXED = [
    ("typescript", "import { Router } from './router';\nexport function authenticate(token: string) {\n  return token;\n}\nclass LoginService {}", [("authenticate", "function"), ("LoginService", "class")], {("./router", "import")}),
    ("typescript", "import { verifyToken } from './AuthTokens';\nexport function authenticate(token: Token): Result {\n  return verifyToken(token);\n}\nclass LoginService extends BaseService implements AuthService {\n  public login(user: User) {\n    return authenticate(user.token);\n  }\n}\nexport { LoginService as Service } from './services';", [("authenticate", "function"), ("LoginService", "class"), ("login", "method")], {("./AuthTokens", "import"), ("authenticate", "export"), ("verifyToken", "call"), ("BaseService", "inheritance"), ("AuthService", "inheritance"), ("LoginService", "export"), ("./services", "export")}),
    ("typescript", "export function summarizeChunks() {\n  const chunk = { count: 1 };\n  return chunk.count;\n}\nconst topLevelHelper = () => true;", [("summarizeChunks", "function"), ("topLevelHelper", "function")], set()),
    ("javascript", "const api = require('./api');\nmodule.exports = function createServer() {}", [("api", "variable"), ("createServer", "function")], {("./api", "import"), ("createServer", "export")}),
    ("javascript", "const s = `class No { ${f(1)} }`; // function no() {}\nconst r = /class Never/.test(x);\nexports.run = 1;\nconst o = {\n  go(a) {\n    return new Thing(a);\n  },\n};", [("s", "variable"), ("r", "variable"), ("o", "variable"), ("go", "method")], {("run", "export"), ("Thing", "call")}),
    ("python", "from auth.tokens import verify\nclass LoginService:\n    pass\n\ndef authenticate(token):\n    return verify(token)\n", [("LoginService", "class"), ("authenticate", "function")], {("auth.tokens", "import"), ("verify", "call")}),
    ("python", 'import os\nimport a.b as c, d\nclass A(x.B, metaclass=M):\n    """class No: def no(): pass"""\n    async def f(self):\n        return self.g(1)\n\nif True:\n    def h():\n        # def k(): pass\n        pass\n', [("A", "class"), ("f", "method"), ("h", "function")], {("os", "import"), ("a.b", "import"), ("d", "import"), ("x.B", "inheritance"), ("g", "call")}),
    ("rust", "use crate::auth::Token;\npub struct LoginService {}\npub fn authenticate(token: Token) -> bool { true }\n", [("LoginService", "struct"), ("authenticate", "function")], {("crate::auth::Token", "import"), ("authenticate", "export")}),
    ("rust", "#[derive(Debug)]\npub(crate) enum E<'a> { A(&'a str), B('x') }\nstatic mut N: i32 = 1;\nimpl E<'_> {\n    const fn f(&self) -> u8 {\n        self.g()\n            .h()\n    }\n}\n", [("E", "enum"), ("N", "variable"), ("f", "function")], {("E", "export")}),
    ("go", 'package auth\n\nimport "context"\n\ntype LoginService struct {}\nfunc Authenticate(ctx context.Context) bool { return true }\n', [("LoginService", "struct"), ("Authenticate", "function")], {("context", "import")}),
    ("go", 'package a\nimport (\n\tx "fmt"\n\t"os"\n)\nvar s = `func no() {`\nfunc (t *T[K]) get(a int) (int, error) {\n\treturn x.Sprint(a)\n}\n', [("s", "variable"), ("get", "method")], {("fmt", "import"), ("os", "import"), ("x.Sprint", "call")}),
    ("java", "import com.example.Token;\npublic class LoginService {\n  public boolean authenticate(Token token) { return true; }\n}\n", [("LoginService", "class"), ("authenticate", "method")], {("com.example.Token", "import"), ("LoginService", "export")}),
    ("java", "import static a.b.*;\ninterface I<T extends Q> extends A, B<T> {\n  int size();\n  default List<T> all(int n) throws X, Y {\n    return new Box<T>(n).of();\n  }\n}\n", [("I", "interface"), ("all", "method")], {("a.b.*", "import"), ("A", "inheritance"), ("B", "inheritance")}),
    ("typescript", "export function ( {", [], set()), ("markdown", "export function authenticate() {}", [], set()),
]


@pytest.mark.parametrize("language,text,symbols,references", FIXED)
def test_fixed_structure(language, text, symbols, references):
    """Fixed expected yields: in order of their lines the symbols, and references that must be among those found."""
    s, r = S.extract(text, language)
    assert [(x[0], x[1]) for x in s] == symbols
    assert references <= {(x[0], x[1]) for x in r}


def test_structure_ends_and_dirt():
    s, _ = S.extract("function a() {\n  if (x) {\n  }\n}\n// function no() {}\nfunction b() {}\n", "javascript")
    assert [(x[0], x[3], x[4]) for x in s] == [("a", 1, 4), ("b", 6, 6)]
    s, _ = S.extract("def a(\n    x,\n):\n    return [\n1]\n\n\nclass B:\n    def c(self):\n        pass\n\nz = 1\n", "python")
    assert [(x[0], x[3], x[4]) for x in s] == [("a", 1, 5), ("B", 8, 10), ("c", 9, 10)]
    for text in ("((((" * 20_000, "/*" * 50_000, "'" * 50_001, "a." * 50_000, "`${" * 20_000, "f(" * 20_000):
        for language in S.LANGUAGES:
            S.extract(text, language)
    assert S.extract("", "python") == ([], []) and S.extract("x", None) == ([], []) and S.extract("x", "cobol") == ([], [])


def test_merge_and_local_calls(spark):
    schema = "chunkId string, path string, language string, name string, normalizedName string, kind string, signature string, startLine long, endLine long, isExported boolean"
    a = spark.createDataFrame([("c", "p", "l", "f", "f", "function", "s", 1, 2, True)], schema)
    b = spark.createDataFrame([("c", "p", "l", "f", "f", "method", "s", 1, 3, False), ("c", "p", "l", "g", "g", "function", "s", 5, 6, False)], schema)
    assert sorted((r.name, r.kind) for r in S.merge_symbols(a, b).collect()) == [("f", "method"), ("g", "function")]
    refs = spark.createDataFrame([("c", "x.f", "call"), ("c", "f", "import"), ("d", "f", "call")], "chunkId string, target string, kind string")
    assert sorted((r.chunkId, r.kind) for r in S.drop_local_calls(refs, a).collect()) == [("c", "import"), ("d", "call")]


def test_git_changes(spark):
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+b\n@@ -5 +5 @@\ndiff --git a/n b/n\nnew file mode 100644\n--- /dev/null\n+++ b/n\n@@ -0,0 +1 @@\ndiff --git a/old b/old\r\ndeleted file mode 100644\n+++ /dev/null\n"
    out = P.git_changes(spark.createDataFrame([(diff,), (None,), ("",)], "text string")).collect()
    assert sorted(tuple(r) for r in out) == [("n", "added", 1), ("old", "deleted", 0), ("x.py", "modified", 2)]


def test_instruction_sections_and_compression(spark):
    out = P.instruction_sections(spark.createDataFrame([("AGENTS.md", "intro text\n# Tests\nRun npm test\n## Safe\nNever log a secret\n")], "path string, content string")).orderBy("position").collect()
    assert [(r.type, r.category) for r in out] == [("instruction", "general"), ("instruction", "build-test"), ("constraint", "security")]
    rows = spark.createDataFrame([("t", "1", 1, "constraint", "Keep it small."), ("t", "2", 2, "code", "def run(x):\n    return x\n"), ("t", "3", 3, "fact", "The cache is warm. It stays so."), ("t", "4", 4, "fact", None)], "task_id string, id string, rank int, type string, text string")
    r = C.extractive_summary(rows).first()
    assert r.constraints == ["Keep it small."] and r.facts[-1] == "The cache is warm." and "def run(x)" in r.summary
    sections = C.llm_sections(spark.createDataFrame([(1, "SUMMARY:\nAll fine\nFACTS:\n- one\n* two\n\nCONSTRAINTS:\n1. three\n"), (2, None)], "id int, text string"), "id").orderBy("id").collect()
    assert (sections[0].summary, sections[0].facts, sections[0].constraints) == (["All fine"], ["one", "two"], ["three"]) and sections[1].facts == []


def test_long_conversations(spark, tmp_path):
    from quillon.queries import REGISTRY

    long = " ".join(f"word{k}" for k in range(3000))
    rows = [("conversation", '{"role": "user"}', "a short one"), ("conversation", None, long), ("file", None, "no talk"), ("conversation", None, None), ("conversation", None, "x" * 8000)]
    spark.createDataFrame(rows, "source string, metadata string, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    out = REGISTRY["conversation_pieces"][0](spark, str(tmp_path)).collect()
    tops, pieces = [r for r in out if r.parentId is None], [r for r in out if r.parentId is not None]
    assert sorted(r.text[:11] for r in tops) == ["[split from", "a short one", "xxxxxxxxxxx"]
    parent = next(r for r in tops if r.text.startswith("[split"))
    assert len(pieces) > 1 and {r.parentId for r in pieces} == {parent.id} and all(len(r.text) < len(long) for r in pieces)
    assert all(any(w in r.text for r in pieces) for w in long.split())
