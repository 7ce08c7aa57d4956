"""Ranking where vectors can't be trusted, over a whole corpus: tasks hold the queries, and each chunk is scored once.

The result is that of `fuse.deterministic_structural` over the lexical and the structural arm. There, points of a query
and a name are placed on chunks by joins, which lays out most pairs of queries and chunks several times. Here a chunk's
names are looked up among the queries' terms, its points for all queries are products of small matrices, and only those
that may be among a query's best leave a task. Queries come in blocks, so their number is not bounded by a task.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillon.functions import text as X
from quillon.functions import vector as V
from quillon.operators import arms as A
from quillon.operators import fuse as U
from quillon.operators import structure as R
from quillon.plans.materialize import materialize, spread, widen

#: Queries of a block, chunks that are laid out at a time, and names whose terms are remembered in a task.
HELD_QUERIES, CHUNK_BLOCK, KEPT_NAMES = 512, 512, 200_000
# white space is that of Java's \s
_SPACE = r"[ \t\n\x0b\f\r]"
_DECLARED = tuple((points, re.compile(p.replace(r"\s", _SPACE)).findall) for points, p in ((6.5, U.VARIABLE_IN_TEXT), (6.5, U.DECLARED_IN_TEXT), (2.2, U.FIELD_IN_TEXT)))
_RUNS = re.compile(U.NAME_IN_TEXT).findall
_ENDING = re.compile("\\.([a-z0-9]+)(?:\r\n|[\n\r\x85\u2028\u2029])?\\Z")
_CAPS = np.array([1.6, 2.4, 3.2])


def _pattern(pattern: str) -> Callable[[str, str], str]:
    return re.compile(pattern, re.ASCII).sub


_not_identifier, _inner, _joints = _pattern(r"[^a-z0-9_$./:\-]+"), _pattern(r"([a-z0-9])([A-Z])"), _pattern(r"[_$./:\-]+")
_split_space, _split_fields = re.compile(r"\s+", re.ASCII).split, re.compile(r"[/. _:\-]+").split


def normalize_symbol(name: str) -> str:
    return "".join(_RUNS(name.lower()))


def normalize_identifier(name: str) -> str:
    return _not_identifier("", name.lower())


def split_identifier(name: str) -> list[str]:
    return [w for w in _split_space(_joints(" ", _inner(r"\1 \2", name)).lower()) if len(w) > 1]


def field_tokens(value: str) -> list[str]:
    return [t for part in _split_fields(value) for w in split_identifier(part) if len(t := normalize_symbol(w)) > 1]


def stem(term: str) -> str:
    t = normalize_symbol(term)
    if t in X.STEM_DENY:
        return t
    n = len(t)
    cut = t
    if t.endswith("ies") and n > 5:
        cut = t[:-3] + "y"
    elif t.endswith("ing") and n > 6:
        cut = t[:-3]
    elif t.endswith(("ed", "es")) and n > 5:
        cut = t[:-2]
    elif t.endswith("s") and n > 4 and not t.endswith("ss"):
        cut = t[:-1]
    return cut if len(cut) >= 4 else t


def _same_number(a: str, b: str) -> bool:
    """As `text.singular_plural_match`."""
    y = lambda x: x[:-3] + "y" if x.endswith("ies") else None
    return a == b or (len(a) > 2 and len(b) > 2 and (a + "s" == b or b + "s" == a or y(a) == b or y(b) == a))


def _bare(name: str) -> str:
    """Without what follows the last dot, if anything does."""
    at = name.rfind(".")
    return name[:at] if 0 <= at < len(name) - 1 else name


def finder(terms: list[str], least: int) -> Callable[[str], list[str]]:
    """A function from a value to the terms, of at least `least` characters, that it contains."""
    by: dict[str, list[str]] = defaultdict(list)
    for t in set(terms):
        if len(t) >= least:
            by[t[:least]].append(t)
    return lambda value: [t for p in {value[i : i + least] for i in range(len(value) - least + 1)} & by.keys() for t in by[p] if t in value]


def _kept(use: Callable) -> Callable:
    """`use` with its answers remembered, up to a number of them."""
    known: dict = {}

    def of(key):
        got = known.get(key)
        if got is None:
            if len(known) >= KEPT_NAMES:
                known.clear()
            got = known[key] = use(key)
        return got

    return of


_FACTS = "path string, parent boolean, names array<string>, contracts array<boolean>, shown array<boolean>, signatures array<string>, out array<boolean>, targets array<string>, hits array<int>, in_path array<int>, said array<int>, times array<int>, points array<double>, related array<string>"


def facts(chunks: DataFrame, terms: list[str], strong: list[str], stems: list[str]) -> DataFrame:
    """What ranking needs of every row of chunks, from one reading of its text.

    Symbols and targets repeat as often as they stand there; `hits` and `in_path` are numbers of `terms` in text or path
    and in the path, `said` of `strong` names with how often they occur and what their declaration is worth, `related`
    the symbols' names and parts that have one of the `stems`.
    """
    rows = widen(chunks.select(F.col("id").alias("chunk_id"), "path", "text", R.code_language(chunks).alias("language"), (R.is_parent(chunks)).alias("parent")))
    kind = rows.schema["chunk_id"].dataType
    schema = f"chunk_id {kind.simpleString()}, {_FACTS}"
    wanted_stems, sparse_stop = frozenset(stems), frozenset(X.SPARSE_STOP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, term_nr, nr, types = finder(terms, min(map(len, terms), default=1)), {t: i for i, t in enumerate(terms)}, {t: i for i, t in enumerate(strong)}, None

        @_kept
        def of(run: str) -> list[int]:
            return [term_nr[t] for t in found(run)]

        @_kept
        def related(name: str) -> list[str]:
            own = {normalize_symbol(x) for x in (name, *split_identifier(name))}
            return [t for t in own if len(t) > 2 and t not in sparse_stop and len(s := stem(t)) >= 3 and s in wanted_stems]

        for batch in batches:
            out: list[list] = [[] for _ in range(14)]
            for path, text, language, parent in zip(batch.column("path").to_pylist(), batch.column("text"), batch.column("language").to_pylist(), batch.column("parent").to_pylist()):
                text = text.as_py() or ""
                symbols, references = R.extract(text, language)
                low = text.lower()
                runs = _RUNS(low)
                each = set(runs)
                in_path = {i for r in _RUNS((path or "").lower()) for i in of(r)}
                hits = in_path.union(*(known for r in each if (known := of(r))))
                worth = {t: 0.0 for t in each & nr.keys()}
                if worth:
                    for points, declared in _DECLARED:
                        for name in declared(low):
                            if name in worth:
                                worth[name] = max(worth[name], points)
                signatures = list({(normalize_symbol(line), shown) for line, shown in {(s[2] or "", bool(s[5])) for s in symbols}})
                row = (
                    path, parent, [s[0] for s in symbols], [s[1] in ("interface", "type") for s in symbols], [bool(s[5]) for s in symbols], [s for s, _ in signatures], [o for _, o in signatures],
                    [r[0] for r in references], list(hits), list(in_path), [nr[t] for t in worth], [runs.count(t) for t in worth], list(worth.values()), list({t for s in symbols for t in related(s[0])}),
                )
                for column, value in zip(out, row):
                    column.append(value)
            if types is None:
                s, b, i = pa.string(), pa.bool_(), pa.int32()
                types = [s, b, pa.list_(s), pa.list_(b), pa.list_(b), pa.list_(s), pa.list_(b), pa.list_(s), *[pa.list_(i)] * 4, pa.list_(pa.float64()), pa.list_(s)]
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), *(pa.array(c, t) for c, t in zip(out, types))], ["chunk_id", *(c.split()[0] for c in _FACTS.split(", "))])

    return rows.mapInArrow(run, schema)


class Block:
    """The terms of a block of queries, each use as a matrix of terms by queries."""

    def __init__(self, ids: list, asked: list, lexical: list, strong: list, fragments: dict, intent: list, sparse: list, terms: list[str], names: list[str]):
        self.ids = ids
        at = {q: i for i, q in enumerate(ids)}
        uses: dict[str, list] = defaultdict(list)
        for q, use, term, firm in asked:
            uses[use].append((at[q], term, bool(firm)))
        self.lexical = self._rows([(at[q], t, 1.0) for q, t in lexical], terms)
        self.strong = self._rows([(at[q], t, 1.0) for q, t in strong], names)
        self.sparse_at, self.sparse = self._matrix([(at[q], t, float(w)) for q, t, w in sparse])
        self.intent_at, self.intent = self._matrix([(at[q], t, 1.0) for q, t in intent])
        # structural points that simply add up: a row of each use and term, of structural score and of dependency
        self.row: dict[tuple[str, str], int] = {}
        s, d = [], []

        def lay(use: str, rows: list, structural: Callable, dependency: Callable = lambda firm: 0.0) -> None:
            for q, t, firm in rows:
                if (use, t) not in self.row:
                    self.row[use, t] = len(s)
                    s.append(np.zeros(len(ids)))
                    d.append(np.zeros(len(ids)))
                s[self.row[use, t]][q] = structural(firm)
                d[self.row[use, t]][q] = dependency(firm)

        for use in ("fragment", "token", "path_part", "extension"):
            lay(use, uses[use], lambda firm: 1.0)
        lay("exact", uses["exact"], lambda firm: 1.4 if firm else 0.7, lambda firm: 0.10 if firm else 0.08)
        lay("longer", [x for x in uses["exact"] if len(x[1]) > 4], lambda firm: 0.5 if firm else 0.22, lambda firm: 0.05 if firm else 0.03)
        lay("reference", uses["part"], lambda firm: 0.08, lambda firm: 0.02)
        lay("part", uses["part"], lambda firm: 1.0)
        lay("partial", uses["partial"], lambda firm: 0.75 if firm else 0.4)
        # what an exactly named symbol is worth: 0 not asked for, 1 asked for, 2 strongly
        lay("named", uses["named"], lambda firm: 2.0 if firm else 1.0)
        own = set((at[q], t) for q, t in strong)
        lay("strong", [(q, t, f) for q, t, f in uses["named"] if (q, t) in own], lambda firm: 1.0)
        self.s, self.d = (np.array(x).reshape(len(x), len(ids)) for x in (s, d))
        self.has_paths = np.array([fragments[q] > 0 for q in ids])
        self.terms = {use: [t for u, t in self.row if u == use] for use in ("fragment", "token", "path_part", "exact", "part", "partial")}

    def _matrix(self, rows: list) -> tuple[dict[str, int], np.ndarray]:
        nr: dict[str, int] = {}
        for _, t, _ in rows:
            nr.setdefault(t, len(nr))
        m = np.zeros((len(nr), len(self.ids)))
        for q, t, w in rows:
            m[nr[t], q] = w
        return nr, m

    def _rows(self, rows: list, every: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A matrix, and the row in it of each of all terms, or -1."""
        nr, m = self._matrix(rows)
        return np.array([nr.get(t, -1) for t in every], dtype=np.int64), m


def _product(n: int, at: list | np.ndarray, row: list | np.ndarray, value: list | np.ndarray | float, m: np.ndarray) -> np.ndarray:
    """`n` rows: per `at`, the sum of rows of `m` times a value."""
    if not len(at):
        return np.zeros((n, m.shape[1]))
    used, col = np.unique(np.asarray(row), return_inverse=True)
    x = np.zeros((n, len(used)))
    np.add.at(x, (np.asarray(at), col), value)
    return x @ m[used]


class _Best:
    """The `k` best of every query so far, with what else is told of them; of equals the one that came first."""

    def __init__(self, k: int, queries: int):
        self.k, self.least, self.held = k, np.zeros(queries), None

    def add(self, score: np.ndarray, first: int, told: list[np.ndarray]) -> None:
        at, q = np.nonzero(score > self.least)
        if not len(at):
            return
        new = [q, at + first, score[at, q], *(x[at, q] for x in told)]
        every = new if self.held is None else [np.concatenate(x) for x in zip(self.held, new)]
        order = np.lexsort((every[1], -every[2], every[0]))
        q = every[0][order]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        self.held = [x[order[place < self.k]] for x in every]
        full = place == self.k - 1
        self.least[q[full]] = every[2][order][full]


def _scored(block: Block, k: int, depth: int, kinds: list[pa.DataType]):
    """A mapInArrow function over facts in the order of chunk_id: what may be among the best of a query.

    The `depth` best of the lexical and of the structural arm and the `k` best of the rest, with all their points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_queries, row = len(block.ids), block.row
        fuzzy: dict[str, list[str]] = defaultdict(list)
        for t in block.terms["path_part"]:
            if len(t) >= 4:
                fuzzy[t[:4]].append(t)
        plain = re.compile("[a-z0-9_$]+").fullmatch
        named_only = lambda terms: [t for t in terms if plain(t)]
        spelled: dict[str, list[str]] = defaultdict(list)
        for t in block.terms["fragment"]:
            spelled[t.lower()].append(t)
        in_names, in_targets, in_symbol = finder([*block.sparse_at], 4), finder(named_only([*block.terms["exact"], *block.terms["part"]]), 3), finder(named_only(block.terms["partial"]), 5)
        in_paths, fragments = finder(named_only([*block.terms["token"], *block.terms["path_part"]]), 2), finder([*spelled], min(map(len, spelled), default=1))
        code = lambda points, cap=0: round(points * 1000) * 10 + cap

        def fields(norm: str, exact: int, parts: list[str], part: int, partial: int) -> dict[int, int]:
            """Sparse terms of a name, with points and cap as one number."""
            got = dict.fromkeys((block.sparse_at[t] for t in in_names(norm)), partial)
            for p in parts:
                if (i := block.sparse_at.get(p)) is not None:
                    got[i] = max(got.get(i, 0), part)
            if (i := block.sparse_at.get(norm)) is not None:
                got[i] = max(got.get(i, 0), exact)
            return got

        @_kept
        def symbol(key: tuple[str, bool, bool]):
            name, contract, shown = key
            out, norm, parts = 1.1 if shown else 1.0, normalize_symbol(name), split_identifier(name)
            exact = code(1.5 * 2.1 * out, 2) if contract else code(1.2 * out, 1)
            met = row.get(("named", norm))
            counted, partial = [row["part", p] for p in parts if ("part", p) in row], [row["partial", t] for t in in_symbol(norm)]
            asked = (met, counted, partial, row.get(("strong", norm))) if met is not None or counted or partial else None
            return [*fields(norm, exact, [normalize_symbol(p) for p in parts], code(0.62 * out), code(0.38 * out)).items()], asked

        @_kept
        def signature(key: tuple[str, bool]) -> list[tuple[int, int]]:
            return [(block.sparse_at[t], code(0.22 * (1.1 if key[1] else 1.0))) for t in in_names(key[0])]

        @_kept
        def target(name: str):
            norm, rows = normalize_identifier(name), []
            if ("exact", norm) in row:
                rows.append(row["exact", norm])
            for t in in_targets(norm):
                if t != norm and ("longer", t) in row:
                    rows.append(row["longer", t])
                if ("reference", t) in row:
                    rows.append(row["reference", t])
            return [*fields(normalize_symbol(name), code(0.42), [normalize_symbol(p) for p in split_identifier(name)], code(0.24), code(0.16)).items()], rows

        @_kept
        def placed(path: str):
            """Sparse terms, structural rows and what they are worth, exact fragments, and terms of the path's intent."""
            base, low = path.rsplit("/", 1)[-1], path.lower()
            own, tokens, norm = field_tokens(_bare(base)), [*dict.fromkeys(field_tokens(path))], normalize_symbol(path)
            sparse = fields(normalize_symbol(_bare(base)), code(1.05), own, code(0.8), code(0.18))
            index = normalize_symbol(_bare(base)) == "index"
            more = [(t, code(0.42)) for t in tokens if t in block.sparse_at] + [(t, code(0.18)) for t in in_names(norm)]
            if index:
                more += [(t, code(1.1)) for t in block.sparse_at if any(p != "index" and _same_number(t, p) for p in tokens)]
            for t, c in more:
                sparse[block.sparse_at[t]] = max(sparse.get(block.sparse_at[t], 0), c)
            low_base, rows, exact = low.rsplit("/", 1)[-1], [], []
            base_stem = _bare(low_base)
            for f in fragments(low):
                ends = lambda value: value == f or value.endswith("/" + f)  # noqa: B023, E731
                points = 3.2 if ends(low) else 2.6 if ends(_bare(low)) else 2.4 if f in (base_stem, low_base) else 1.8 if f in low_base else 1.1
                for t in spelled[f]:
                    rows.append((row["fragment", t], points))
                    if points == 3.2:
                        exact.append(row["fragment", t])
            order: dict[str, float] = {}
            for start in {w[:4] for w in split_identifier(base_stem) if len(w) >= 4}:
                order |= dict.fromkeys(fuzzy.get(start, ()), 0.28)
            for t in in_paths(low):
                if ("token", t) in row:
                    rows.append((row["token", t], 0.12))
                if ("path_part", t) in row and len(t) >= 3:
                    order[t] = 0.5 if t in low_base else 0.25
            rows += [(row["path_part", t], p) for t, p in order.items()]
            if (m := _ENDING.search(low)) and ("extension", m[1]) in row:
                rows.append((row["extension", m[1]], 0.08))
            return [*sparse.items()], rows, exact, [(block.intent_at[t], 5.0 if t in own else 8.0) for t in tokens if t in block.intent_at]

        def score(groups: list[tuple[object, list[dict]]]) -> tuple[np.ndarray, ...]:
            """Points besides the arms, lexical and structural scores, and seeds, of every chunk and query."""
            n = len(groups)
            best, linear, exact, lex, text = ([] for _ in range(5))
            units, intent, entries, keys = [], [], [], {}
            parent = np.zeros(n, dtype=bool)
            for c, (chunk, rows) in enumerate(groups):
                parent[c] = any(r["parent"] for r in rows)
                inside, above, said = set(), set(), {}
                for r in rows:
                    inside.update(r["hits"])
                    above.update(r["in_path"])
                    for t, times, points in zip(r["said"], r["times"], r["points"]):
                        m, p = said.get(t, (0, 0.0))
                        said[t] = (m + times, max(p, points))
                    for t in r["targets"]:
                        sparse, own = target(t)
                        best += [(c, i, v) for i, v in sparse]
                        if chunk is not None:
                            linear += [(c, i, 1.0) for i in own]
                    if chunk is None:
                        continue
                    for key in zip(r["signatures"], r["out"]):
                        best += [(c, i, v) for i, v in signature(key)]
                    for key in zip(r["names"], r["contracts"], r["shown"]):
                        sparse, asked = symbol(key)
                        best += [(c, i, v) for i, v in sparse]
                        if asked:
                            entries.append((c, keys.setdefault(key, len(keys))))
                lex += [(c, i, 5.0 if i in above else 2.0) for i in inside]
                text += [(c, i, p + min(1.5, 0.25 * m)) for i, (m, p) in said.items()]
                for path in {r["path"] for r in rows} - {None, ""}:
                    sparse, own, whole, meant = placed(path)
                    intent += [(len(units), i, v) for i, v in meant]
                    units.append(c)
                    if chunk is not None:
                        best += [(c, i, v) for i, v in sparse]
                        linear += [(c, i, v) for i, v in own]
                        exact += [(c, i, 1.0) for i in whole]
            split = lambda rows: [np.array(x) for x in zip(*rows)] if rows else [[], [], []]

            codes = np.zeros((n, len(block.sparse_at)), dtype=np.int64)
            if best:
                c, i, v = split(best)
                np.maximum.at(codes, (c, i), v)
            caps = _CAPS[codes % 10]
            sums = np.minimum(codes // 10 / 1000, caps) @ block.sparse
            high = _product(n, *np.nonzero((codes > 0) & (caps >= 3.2)), 1.0, (block.sparse > 0).astype(float)) > 0
            base = np.round(np.minimum(sums, np.where(high, 12.0, 7.0)), 6)
            for (c, i, v), (at, m) in ((split(text), block.strong),):
                if len(c):
                    keep = at[i] >= 0
                    base += _product(n, c[keep], at[i][keep], v[keep], m)
            meant = np.minimum(_product(len(units), *split(intent), block.intent), 12.0)
            np.add.at(base, np.array(units, dtype=np.int64), meant)
            lexical = np.zeros((n, n_queries))
            if lex:
                c, i, v = split(lex)
                at = block.lexical[0][i]
                lexical = _product(n, c[at >= 0], at[at >= 0], v[at >= 0], block.lexical[1])

            linear = split(linear)
            structural, dependency = _product(n, *linear, block.s), _product(n, *linear, block.d)
            named = np.zeros((n, n_queries), dtype=bool)
            if keys:
                asked = [symbol(key)[1] for key in keys]
                shown, contract = np.array([k[2] for k in keys])[:, None], np.array([k[1] for k in keys])[:, None]
                met = _product(len(keys), *split([(u, a[0], 1.0) for u, a in enumerate(asked) if a[0] is not None]), block.s)
                parts = _product(len(keys), *split([(u, i, 1.0) for u, a in enumerate(asked) for i in a[1]]), block.s)
                some = _product(len(keys), *split([(u, i, 1.0) for u, a in enumerate(asked) for i in a[2]]), block.s)
                firm = np.where(shown, 5.6, 5.2) + np.where(contract, 0.8, 0.3)
                weak = np.where(shown, 3.4, 3.1) + np.where(contract, 0.4, 0.0)
                loose = np.where(parts > 0, np.minimum(0.75, parts * 0.25) + np.where(shown, 0.05, 0.0), 0.0) + some
                worth = np.where(met > 1.5, firm, np.where(met > 0.5, weak, loose))
                c, u = np.array(entries).T
                starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                structural[c[starts]] += np.add.reduceat(worth[u], starts, axis=0)
                named = _product(n, *split([(c, asked[u][3], 1.0) for c, u in entries if asked[u][3] is not None]), block.s) > 0
            whole = (_product(n, *split(exact), block.s) > 0) & block.has_paths
            structural, dependency = np.round(structural, 6), np.round(np.minimum(A.DEPENDENCY_CAP, dependency), 6)
            seed = np.where(named, 12 + structural, np.where(whole, 10 + structural, np.nan))
            return np.round(base, 6), lexical, np.round(structural + dependency, 6), seed, np.repeat(parent[:, None], n_queries, axis=1)

        arms, ids = [_Best(depth, n_queries), _Best(depth, n_queries), _Best(k, n_queries)], {}
        first = 0

        def place(groups: list) -> None:
            nonlocal first
            base, lexical, structural, seed, parent = told = score(groups)
            for arm, own in zip(arms, (lexical, structural, np.where(parent, 0.0, base))):
                arm.add(own, first, list(told))
            live = set().union(*(set(arm.held[1].tolist()) for arm in arms if arm.held))
            for i, (chunk, _) in enumerate(groups):
                ids[first + i] = chunk
            for i in [i for i in ids if i not in live]:
                del ids[i]
            first += len(groups)

        def rows() -> Iterator[dict]:
            for batch in batches:
                for start in range(0, batch.num_rows, CHUNK_BLOCK):
                    yield from batch.slice(start, CHUNK_BLOCK).to_pylist()

        held: list = []
        for chunk, own in groupby(rows(), key=lambda r: r["chunk_id"]):
            held.append((chunk, list(own)))
            if len(held) == CHUNK_BLOCK:
                place(held)
                held = []
        if held:
            place(held)
        found = [arm.held for arm in arms if arm.held]
        if found:
            every = [np.concatenate(x) for x in zip(*found)]
            _, once = np.unique(every[1] * n_queries + every[0], return_index=True)
            q, at, _, base, lexical, structural, seed, parent = (x[once] for x in every)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.ids[i] for i in q], kinds[0]), pa.array([ids[i] for i in at], kinds[1]), pa.array(base), pa.array(lexical), pa.array(structural), pa.array(seed, from_pandas=True), pa.array(parent)],
                ["query_id", "chunk_id", "base", "lexical", "structural", "seed", "parent"],
            )

    return run


def deterministic(planned: DataFrame, chunks: DataFrame, k: int, depth: int = A.DEPTH) -> DataFrame | None:
    """chunk_id, query_id, score, sources, rank; nothing if the queries have more terms than tasks can hold."""
    s = F.col("structural")
    lexical = planned.select("query_id", F.explode(X.lexical_terms(F.coalesce(F.col("text"), F.lit("")))).alias("term")).where("term <> ''")
    strong = planned.select("query_id", F.explode(F.array_distinct(F.transform("strong", X.normalize_symbol))).alias("term")).where("term <> ''")
    weighed = materialize(U.weighed_terms(planned))
    terms, names, stems = (A._held(x.select(F.col("term")).distinct()) for x in (lexical, strong, weighed.select(X.stem(F.col("term")).alias("term"))))
    if terms is None or names is None or stems is None:
        return None
    read = materialize(facts(chunks, terms, names, [x for x in stems if len(x) >= 3]))
    related = read.select(F.explode("related").alias("term")).distinct()
    index = related.withColumn("stem", X.stem(F.col("term"))).groupBy("stem").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    sparse = materialize(U.expanded_terms(weighed, index))
    asked, intent = materialize(A._asked(planned)), materialize(U.intent_terms(planned, sparse))
    parts = {"asked": asked, "lexical": lexical, "strong": strong, "intent": intent, "sparse": sparse.select("query_id", "term", "weight")}
    kinds = [planned.schema["query_id"].dataType, read.schema["chunk_id"].dataType]
    fragments = dict(tuple(r) for r in planned.select("query_id", F.size(s["pathFragments"])).collect())
    ids = [*fragments]
    ordered = spread(read.drop("related"), "chunk_id").sortWithinPartitions("chunk_id")
    found = None
    for at in range(0, len(ids), HELD_QUERIES):
        own = ids[at : at + HELD_QUERIES]
        rows = {name: [tuple(r) for r in df.where(F.col("query_id").isin(own)).collect()] for name, df in parts.items()}
        block = Block(own, fragments=fragments, terms=terms, names=names, **rows)
        schema = f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, base double, lexical double, structural double, seed double, parent boolean"
        some = ordered.mapInArrow(_scored(block, k, depth, [to_arrow_type(t) for t in kinds]), schema)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return None
    place = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), F.asc("chunk_id")))
    seen = materialize(found).withColumn("l", place("lexical")).withColumn("s", place("structural"))
    fts, seeded = (F.col("l") <= depth) & (F.col("lexical") > 0), (F.col("s") <= depth) & (F.col("structural") > 0) & F.col("seed").isNotNull()
    points = F.col("base") + F.when(fts, V.compress_lexical(F.col("lexical"))).otherwise(0.0) + F.when(seeded, F.col("seed")).otherwise(0.0)
    sources = F.filter(F.array(F.when(fts, F.lit("fts")), F.when((F.col("base") > 0) | seeded, F.lit("structural"))), lambda x: x.isNotNull())
    scored = seen.where(~F.col("parent")).select("chunk_id", "query_id", F.round(points, 6).alias("score"), sources.alias("sources"))
    return A.ranked(scored.where("score > 0"), k)
