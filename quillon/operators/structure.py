"""Symbols and references of source code, from tokens, for six languages.

A text is cut into tokens once (strings, comments and regular expressions included), brackets are paired, and a single
walk over the tokens recognises declarations by what follows their keyword, methods by a parameter list with a block
behind it, calls by a name with a parameter list alone. Where a block ends is where its bracket's partner stands, or in
Python where the indentation falls back. A file is read as a whole, in Python; rows come out tagged as symbols or
references and are told apart by a filter.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.plans.materialize import widen

# --- fixed values: languages, words that are no names, and kinds by keyword ---
LANGUAGES = ("typescript", "javascript", "python", "rust", "go", "java")
CONTROL = frozenset("if for while switch catch return throw else try do new function class interface type const let var pub fn func def elif except finally with lambda await yield".split())
NO_CALL = CONTROL | frozenset("console log debug info warn error require import super".split())
DECLARING = frozenset("function def fn func class interface type".split())
KINDS = {
    "typescript": {"function": "function", "class": "class", "interface": "interface", "type": "type"},
    "python": {"def": "function", "class": "class"},
    "rust": {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "const": "constant", "static": "variable", "mod": "module"},
    "go": {"func": "function", "type": "struct", "const": "constant", "var": "variable"},
    "java": {"class": "class", "interface": "interface", "enum": "enum"},
}
#: Words besides these that a walk stops at.
TELLING = frozenset("import from require export exports extends implements use const let var".split())
KINDS["javascript"] = KINDS["typescript"]

# how the tokens of a language are written; comments and space are matched to be skipped, names come first where nothing else begins like them
_NAME, _NUMBER, _OPERATOR = r"(?P<name>[A-Za-z_$][\w$]*)", r"(?P<number>\d[\w.]*)", r"(?P<space>\s+)|(?P<sign>::|=>|->|\?\.|\.\.\.|\S)"
_SLASHED, _QUOTED, _RAW = r"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))", r"(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)", r"(?P<raw>`(?:\\.|[^`\\])*(?:`|\Z))"
_TOKENS = {
    "typescript": "|".join((_NAME, _SLASHED, _QUOTED, _RAW, r"(?P<regex>(?<=[(,=:\[!&|?{};])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*)", _NUMBER, _OPERATOR)),
    "python": "|".join((r"(?P<comment>\#[^\n]*)", r"(?P<string>(?:[rRbBuUfF]{1,2})?(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?))", _NAME, _NUMBER, _OPERATOR)),
    "rust": "|".join((_SLASHED, r"(?P<string>b?\"(?:\\[\s\S]|[^\"\\])*(?:\"|\Z)|b?'(?:\\[^'\n]*|[^'\\\n])')", r"(?P<lifetime>'\w+)", _NAME, _NUMBER, _OPERATOR)),
    "go": "|".join((_NAME, _SLASHED, _QUOTED, r"(?P<raw>`[^`]*(?:`|\Z))", _NUMBER, _OPERATOR)),
    "java": "|".join((_NAME, _SLASHED, _QUOTED, _NUMBER, _OPERATOR)),
}
_TOKENS = {k: re.compile(v) for k, v in {**_TOKENS, "javascript": _TOKENS["typescript"]}.items()}
_CLOSING = {"(": ")", "[": "]", "{": "}"}
_BRACKETS, _SKIPPED, _STRINGS = frozenset("()[]{}"), frozenset(("space", "comment")), frozenset(("string", "raw"))

Symbol = tuple[str, str, str, int, int, bool]
Reference = tuple[str, str, int]


class Source:
    """The tokens of a text: `kind`, `word` (of strings, what is within the quotes), `line` from 1, `start`, `stop`."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.lines = text.split("\n")
        found = [m for m in _TOKENS[language].finditer(text) if m.lastgroup not in _SKIPPED]
        self.kind = [m.lastgroup for m in found]
        self.signs = [m[0] for m in found]
        self.word = self.signs.copy()
        self.start = [m.start() for m in found]
        self.stop = [m.end() for m in found]
        ends = np.cumsum([len(x) + 1 for x in self.lines])
        self.line: list[int] = (np.searchsorted(ends, self.start, side="right") + 1).tolist()
        # strings say nothing to the grammar; pads at the end stand for what lies beyond either end
        for i in [i for i, k in enumerate(self.kind) if k in _STRINGS]:
            self.kind[i], self.word[i], self.signs[i] = "string", self.word[i].strip("\"'`"), ""
        self.signs += [""] * 4

    def __len__(self) -> int:
        return len(self.word)

    def sign(self, i: int) -> str:
        """The token as it counts for the grammar: itself, or nothing for strings and beyond the ends."""
        return self.signs[i] if -4 <= i < len(self.signs) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.word) and self.kind[i] == "name"

    @cached_property
    def partner(self) -> dict[int, int]:
        """Where a bracket is closed; brackets left open close at the end."""
        out, open_, signs = {}, [], self.signs
        for i in [i for i, c in enumerate(signs) if c in _BRACKETS]:
            c = signs[i]
            if c in _CLOSING:
                open_.append(i)
            else:
                while open_ and _CLOSING[signs[open_[-1]]] != c:
                    out[open_.pop()] = i
                if open_:
                    out[open_.pop()] = i
        out.update(dict.fromkeys(open_, len(self) - 1))
        return out

    @cached_property
    def places(self) -> dict[str, list[int]]:
        """Where the signs stand that tell whether a name is given a value or a function."""
        out: dict[str, list[int]] = {"=": [], "=>": [], "function": []}
        for i, c in enumerate(self.signs):
            if c in out:
                out[c].append(i)
        return out

    def on_line(self, i: int, *signs: str) -> bool:
        """Whether one of the signs stands behind token `i` on its line."""
        stop = bisect_right(self.line, self.line[i])
        return any(bisect_left(self.places[c], stop) > bisect_right(self.places[c], i) for c in signs)

    @cached_property
    def first(self) -> list[bool]:
        """Whether a token begins its line."""
        return [i == 0 or self.line[i] != self.line[i - 1] for i in range(len(self))]

    def indent(self, i: int) -> int:
        row = self.lines[self.line[i] - 1]
        return len(row) - len(row.lstrip())

    def top_level(self, i: int) -> bool:
        """Whether the line of a token isn't indented."""
        return not self.lines[self.line[i] - 1][:1].isspace()

    def block(self, i: int) -> int | None:
        """The brace that opens the block of what token `i` declares: the next one outside of brackets and angles."""
        while i < len(self):
            c = self.sign(i)
            if c == "{":
                return i
            if c in ("(", "["):
                i = self.partner[i]
            elif c in (";", ")", "}", "]") or (c == "=" and self.language != "rust"):
                return None
            i += 1
        return None

    def last_line(self, i: int) -> int:
        """The line on which the declaration at token `i` ends."""
        if self.language == "python":
            own, at = self.indent(i), i + 1
            while at < len(self) and (not self.first[at] or self.line[at] == self.line[i] or self.indent(at) > own):
                # what brackets hold may be indented as it likes
                at = self.partner.get(at, at) + 1
            return self.line[at - 1] + (self.text.count("\n", self.start[at - 1], self.stop[at - 1]))
        brace = self.block(i + 1)
        if brace is None and self.language in ("typescript", "javascript"):
            # an arrow function or an object: the block stands behind the sign of equality
            at = next((k for k in range(i + 1, min(len(self), i + 200)) if self.sign(k) in ("=", ";")), None)
            brace = None if at is None or self.sign(at) == ";" else self.block(at + 1)
        return self.line[i] if brace is None else self.line[self.partner[brace]]

    def dotted(self, i: int, joints: tuple[str, ...] = (".",)) -> tuple[str, int]:
        """The name with its parts that begins at token `i`, and the token behind it."""
        out = ""
        while self.is_name(i):
            out += self.word[i]
            i += 1
            if self.sign(i) not in joints or not self.is_name(i + 1):
                break
            out += self.sign(i)
            i += 1
        return out, i


class _Found:
    """What a walk yields; names are checked and repeated ones dropped here."""

    def __init__(self, source: Source):
        self.source = source
        self.symbols: dict[tuple[str, str, int], Symbol] = {}
        self.references: dict[tuple[str, str, int], Reference] = {}
        self.declared: set[int] = set()

    def symbol(self, i: int, kind: str, exported: bool, noted: bool = False) -> None:
        """The name at token `i` as a symbol; `noted` exports are references too."""
        s = self.source
        name = s.word[i]
        self.declared.add(i)
        if name not in CONTROL:
            self.symbols.setdefault((kind, name, s.line[i]), (name, kind, s.lines[s.line[i] - 1].strip(), s.line[i], s.last_line(i), exported))
            if exported and noted:
                self.reference(name, "export", i)

    def reference(self, target: str, kind: str, i: int) -> None:
        if target:
            self.references.setdefault((kind, target, self.source.line[i]), (target, kind, self.source.line[i]))


def _names_until(s: Source, i: int, stop: tuple[str, ...]) -> Iterator[tuple[str, int]]:
    """Names of a list separated by commas, without their type arguments, up to one of `stop`."""
    depth, fresh = 0, True
    while i < len(s) and not (depth == 0 and s.sign(i) in stop):
        c = s.sign(i)
        depth += (c in ("<", "(", "[")) - (c in (">", ")", "]"))
        if depth < 0:
            return
        if depth == 0 and c == ",":
            fresh = True
        elif depth == 0 and fresh and s.is_name(i):
            name, after = s.dotted(i)
            # a name with a value is no base
            if s.sign(after) != "=":
                yield name, i
            i, fresh = after - 1, False
        i += 1


def _heritage(found: _Found, i: int) -> None:
    """Types behind `extends` or `implements` at token `i`."""
    s = found.source
    for name, at in _names_until(s, i + 1, ("{", "implements", "extends", ";")):
        found.reference(name, "inheritance", at)


def _call(found: _Found, i: int) -> None:
    """The call whose last name is token `i`, with the names it is reached by."""
    s, first = found.source, i
    while first > 1 and s.signs[first - 1] in (".", "::", "?.") and s.is_name(first - 2):
        first -= 2
    names = [s.word[k] for k in range(first, i + 1, 2)]
    if s.signs[first - 1] in DECLARING or (s.signs[first - 1] == "[" and s.sign(first - 2) == "#") or names[0].lower() in NO_CALL or names[-1].lower() in NO_CALL:
        return
    own = names[0] in ("this", "self") and len(names) > 1
    found.reference(names[-1] if own else "".join(s.word[first : i + 1]).replace("?.", "."), "call", i)


def _method(found: _Found, i: int) -> bool:
    """Whether the name at `i` is followed by parameters and a block, so that it is declared and not called."""
    s = found.source
    after = s.partner[i + 1] + 1
    if s.language == "java" and s.sign(after) == "throws":
        return s.block(after) is not None
    if s.sign(after) == ":" and s.language == "typescript":
        brace = s.block(after + 1)
        return brace is not None and all(s.sign(k) not in ("?", "=>") for k in range(after, brace))
    return s.sign(after) == "{"


def _exports(found: _Found, i: int) -> None:
    """An `export` at token `i` that names things instead of declaring them."""
    s, after = found.source, i + 1
    if s.sign(after) == "type" and s.sign(after + 1) == "{":
        after += 1
    if s.sign(after) == "{":
        stop = s.partner[after]
        for k in range(after + 1, stop):
            if s.is_name(k) and s.sign(k - 1) in ("{", ",", "type") and s.word[k] != "type":
                found.reference(s.word[k], "export", k)
        after = stop + 1
    elif s.sign(after) == "*":
        after = next((k for k in range(after, min(len(s), after + 4)) if s.sign(k) == "from"), after)
    elif s.sign(after) == "default" and s.is_name(after + 1) and s.word[after + 1] not in CONTROL | {"async", "abstract"}:
        found.reference(s.word[after + 1], "export", after + 1)
        return
    if s.sign(after) == "from" and after + 1 < len(s) and s.kind[after + 1] == "string":
        found.reference(s.word[after + 1], "export", after + 1)


def _script(found: _Found, i: int) -> None:
    s, word = found.source, found.source.word[i]
    string = lambda k: k < len(s) and s.kind[k] == "string"
    if word == "from" and string(i + 1) or word == "import" and string(i + 1):
        found.reference(s.word[i + 1], "import", i + 1)
    elif word in ("import", "require") and s.sign(i + 1) == "(" and string(i + 2):
        found.reference(s.word[i + 2], "import", i + 2)
    elif word == "export":
        _exports(found, i)
    elif word in ("extends", "implements"):
        _heritage(found, i)
    elif word == "exports" and s.sign(i + 1) == "." and s.is_name(i + 2) and s.sign(i + 3) == "=" and s.top_level(i):
        _assigned(found, i + 3, i + 2)
    elif word == "exports" and s.sign(i - 1) == "." and s.sign(i + 1) == "=":
        _assigned(found, i + 1, None)
    else:
        _declaration(found, i)


def _assigned(found: _Found, equals: int, name: int | None) -> None:
    """What is assigned to the module's exports: a named function is a symbol, anything else a reference."""
    s, at = found.source, equals + 1
    at += s.sign(at) == "async"
    if s.sign(at) == "function" and s.is_name(at + 1):
        found.symbol(at + 1, "function", True, True)
    elif name is not None:
        found.reference(s.word[name], "export", name)


def _exported(s: Source, i: int) -> bool:
    """Whether the modifiers before the keyword at token `i` hold an `export`."""
    while s.sign(i - 1) in ("default", "async", "abstract", "declare"):
        i -= 1
    return s.sign(i - 1) == "export"


def _declaration(found: _Found, i: int) -> None:
    """Declarations by keyword and methods of scripts."""
    s, word = found.source, found.source.word[i]
    kind = KINDS[s.language].get(word)
    name = i + 1 + (word == "function" and s.sign(i + 1) == "*")
    if kind and s.is_name(name) and s.sign(i - 1) not in (".", "?.") and not (kind == "type" and s.sign(name + 1) not in ("=", "<")):
        if s.sign(i - 1) not in ("=", "(", ",", ":", "return") or word == "class":
            found.symbol(name, kind, _exported(s, i), True)
    elif word in ("const", "let", "var") and s.is_name(name) and (s.top_level(i) or _exported(s, i)):
        if s.sign(name + 1) in ("=", ":") and s.on_line(name, "="):
            found.symbol(name, "function" if s.on_line(name, "=>", "function") else "variable", _exported(s, i), True)
    elif s.sign(i + 1) == "(" and word not in CONTROL and i not in found.declared and s.sign(i - 1) not in ("function", "new", ".", "?.") and _method(found, i):
        found.symbol(i, "method", False)


def _indented(found: _Found, i: int, classes: list[int]) -> None:
    s, word = found.source, found.source.word[i]
    if s.first[i]:
        while classes and s.indent(i) <= classes[-1]:
            classes.pop()
    begins = s.first[i] or s.sign(i - 1) in (":", ";", "async")
    if word == "from" and begins:
        at = i + 1
        while s.sign(at) in (".", "..."):
            at += 1
        name, after = s.dotted(at)
        if s.sign(after) == "import" or name and s.sign(after) == "import":
            found.reference(s.text[s.start[i + 1] : s.stop[after - 1]], "import", i)
    elif word == "import" and begins:
        at = i + 1
        while s.is_name(at) and s.line[at] == s.line[i]:
            name, at = s.dotted(at)
            found.reference(name, "import", i)
            at += 2 if s.sign(at) == "as" else 0
            at += s.sign(at) == ","
    elif word == "__all__" and s.sign(i + 1) in ("=", "+") and (opening := next((k for k in (i + 2, i + 3) if s.sign(k) in ("[", "(")), 0)):
        for k in range(opening + 1, s.partner[opening]):
            if s.kind[k] == "string":
                found.reference(s.word[k], "export", k)
    elif word in ("def", "class") and s.is_name(i + 1):
        kind = "class" if word == "class" else "method" if classes else "function"
        found.symbol(i + 1, kind, not s.word[i + 1].startswith("_"))
        if word == "class":
            if s.sign(i + 2) == "(":
                for name, at in _names_until(s, i + 3, (")",)):
                    found.reference(name, "inheritance", at)
            classes.append(s.indent(i))


def _rust(found: _Found, i: int) -> None:
    s, word = found.source, found.source.word[i]
    before = i - 1
    while s.sign(before) in ("async", "unsafe", "const", "extern"):
        before -= 1
    if s.sign(before) == ")":
        before = next((k for k, v in s.partner.items() if v == before), 0) - 1
    public = s.sign(before) == "pub"
    if word == "use" and (s.first[i] or public):
        stop = next((k for k in range(i, len(s)) if s.sign(k) == ";"), len(s) - 1)
        target = " ".join(s.text[s.start[i + 1] : s.start[stop] if s.sign(stop) == ";" else s.stop[stop]].split()) if i + 1 < len(s) else ""
        for kind in ("import", "export") if public else ("import",):
            found.reference(target, kind, i)
    elif word in KINDS["rust"] and s.is_name(i + 1) and s.word[i + 1] not in ("fn", "unsafe", "mut") or word == "static" and s.sign(i + 1) == "mut" and s.is_name(i + 2):
        name = i + 1 + (s.sign(i + 1) == "mut")
        found.symbol(name, KINDS["rust"][word], public, True)
        if word == "mod":
            found.reference(s.word[name], "module", i)


def _go(found: _Found, i: int) -> None:
    s, word = found.source, found.source.word[i]
    if word == "import":
        stop = s.partner.get(i + 1, i + 2 + (s.is_name(i + 1) or s.sign(i + 1) in (".", "_")))
        for k in range(i + 1, min(len(s), stop)):
            if s.kind[k] == "string":
                found.reference(s.word[k], "import", k)
    elif word in KINDS["go"] and s.first[i] and s.top_level(i):
        name, kind = i + 1, KINDS["go"][word]
        if word == "func" and s.sign(name) == "(":
            name, kind = s.partner[name] + 1, "method"
        if word == "type":
            kind = s.sign(name + 1)
        if s.is_name(name) and kind in ("struct", "interface", *KINDS["go"].values(), "method"):
            found.symbol(name, kind, s.word[name][0].isupper(), True)


def _java(found: _Found, i: int) -> None:
    s, word = found.source, found.source.word[i]
    if word == "import" and s.first[i]:
        name, after = s.dotted(i + 1 + (s.sign(i + 1) == "static"))
        found.reference(name + (".*" if s.sign(after) == "." and s.sign(after + 1) == "*" else ""), "import", i)
    elif word in ("extends", "implements") and s.sign(i - 1) not in ("?", ",") and s.sign(i - 2) != "<":
        _heritage(found, i)
    elif word in KINDS["java"] and s.is_name(i + 1) and s.sign(i - 1) != ".":
        found.symbol(i + 1, KINDS["java"][word], _public(s, i), True)
    elif s.sign(i + 1) == "(" and word not in CONTROL and (s.is_name(i - 1) and s.word[i - 1] not in ("new", "return", "throw", "else") or s.sign(i - 1) in (">", "]")) and _method(found, i):
        found.symbol(i, "method", _public(s, i), True)


def _public(s: Source, i: int) -> bool:
    """Whether the declaration around token `i` says `public` before it."""
    while i > 0 and s.sign(i - 1) not in (";", "{", "}", ")"):
        i -= 1
        if s.sign(i) == "public":
            return True
    return False


def extract(text: str, language: str | None) -> tuple[list[Symbol], list[Reference]]:
    """Symbols (name, kind, signature, start, end, exported) and references (target, kind, line) of one text.

    Calls of names the file itself declares are no references. Unknown languages and empty texts yield nothing;
    unclosed brackets and strings end with the text.
    """
    language = (language or "").lower()
    if language not in LANGUAGES or not text:
        return [], []
    s = Source(text.replace("\r\n", "\n"), language)
    found = _Found(s)
    classes: list[int] = []
    walk = {"rust": _rust, "go": _go, "java": _java}.get(language, _script)
    telling = KINDS[language].keys() | TELLING
    for i, word in enumerate(s.word):
        if s.kind[i] != "name":
            continue
        opened = s.signs[i + 1] == "("
        if language == "python":
            _indented(found, i, classes)
        elif opened or word in telling:
            walk(found, i)
        if opened and i not in found.declared:
            _call(found, i)
    norm = lambda name: re.sub(r"[^a-z0-9_$]", "", name.lower())
    own = {norm(name) for _, name, _ in found.symbols}
    references = [r for r in found.references.values() if r[1] != "call" or norm(re.split(r"\.|::", r[0])[-1]) not in own]
    return sorted(found.symbols.values(), key=lambda x: (x[3], x[0])), sorted(references, key=lambda r: (r[2], r[0]))


def is_parent(chunks: DataFrame) -> Column:
    """Whether a chunk stands for the pieces that it was split into."""
    return F.coalesce(F.get_json_object("metadata", "$.split") == "true", F.lit(False)) if "metadata" in chunks.columns else F.lit(False)


def code_language(chunks: DataFrame) -> Column:
    """The language of a chunk that is read for symbols, of others null or none of `LANGUAGES`."""
    return F.when(F.col("path").isNotNull() & F.col("text").isNotNull() & ~is_parent(chunks), F.lower(X.language_of(F.col("path"), F.col("language"))))


def extract_rows(chunks: DataFrame) -> DataFrame:
    """Tagged rows (what: symbol or reference) of all chunks that have a path and a known language."""
    schema = "chunkId string, path string, language string, what string, name string, kind string, signature string, startLine long, endLine long, isExported boolean"
    rows = chunks.select(F.col("id").alias("i"), F.col("path").alias("p"), code_language(chunks).alias("l"), F.col("text").alias("t")).where(F.col("l").isin(*LANGUAGES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, p, lang, t in zip(batch["i"], batch["p"], batch["l"], batch["t"]):
                symbols, references = extract(t, lang)
                out += [(i, p, lang, "symbol", *s) for s in symbols] + [(i, p, lang, "reference", r[0], r[1], None, r[2], r[2], None) for r in references]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return widen(rows).mapInPandas(run, schema)


def symbols_of(rows: DataFrame) -> DataFrame:
    s = rows.where("what = 'symbol'")
    return s.select("chunkId", "path", "language", "name", X.normalize_symbol(F.col("name")).alias("normalizedName"), "kind", "signature", "startLine", "endLine", "isExported")


def references_of(rows: DataFrame) -> DataFrame:
    r = rows.where("what = 'reference'")
    return r.select("chunkId", "path", "language", F.col("name").alias("target"), X.normalize_identifier(F.col("name")).alias("normalizedTarget"), "kind", "startLine", "endLine")


def merge_symbols(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two extractions as one: per chunk, name and line a method beats a function and an exported one the other."""
    rank = (F.col("kind") == "method").cast("int") * 4 + F.coalesce("isExported", F.lit(False)).cast("int") * 2 + F.col("_first")
    both = first.withColumn("_first", F.lit(1)).unionByName(second.withColumn("_first", F.lit(0)))
    kinds = F.when(F.col("kind").isin("method", "function"), "callable").otherwise(F.col("kind"))
    order = Window.partitionBy("chunkId", "normalizedName", "startLine", kinds).orderBy(F.desc(rank), "kind", "endLine")
    return both.withColumn("_nr", F.row_number().over(order)).where("_nr = 1").drop("_nr", "_first")


def merge_references(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two extractions as one: per chunk, kind, normalised target and line one reference, of the first if it has one."""
    key = F.coalesce(F.nullif("normalizedTarget", F.lit("")), X.normalize_identifier(F.col("target")))
    both = first.withColumn("_from", F.lit(0)).unionByName(second.withColumn("_from", F.lit(1))).withColumn("_key", key)
    order = Window.partitionBy("chunkId", "kind", "_key", "startLine").orderBy("_from", "target", "endLine")
    return both.withColumn("_nr", F.row_number().over(order)).where("_nr = 1").drop("_nr", "_from", "_key")


def drop_local_calls(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """References without calls of names the same chunk declares."""
    leaf = F.regexp_replace(F.lower(F.regexp_extract("target", r"([^.:]*)$", 1)), r"[^a-z0-9_$]", "")
    own = symbols.select(F.col("chunkId").alias("s_chunk"), F.col("normalizedName").alias("s_name")).distinct()
    return references.withColumn("_leaf", leaf).join(own, (F.col("kind") == "call") & (F.col("chunkId") == F.col("s_chunk")) & (F.col("_leaf") == F.col("s_name")), "left_anti").drop("_leaf")
