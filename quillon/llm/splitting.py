"""Splitting oversized texts at natural boundaries, by agglomerative merging.

A text starts as atomic segments: its lines, and of lines too long for a piece their sentences, words or,
where nothing else is left, runs of characters. Every border between two segments has a strength (how much
the text wants to be cut there). A heap holds all adjacent pairs; the weakest border goes first, of equally
weak ones the pair that is smallest together, then the leftmost. A pair is merged if the merged segment and
the overlap before it fit the limit, else its border stays for good, as segments only grow.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters (code points) of a token: a token is a started group of four.
CHARS = 4
#: Strength of a border by what stands there, weakest first.
FORCED, WORDS, SENTENCE, LINE, BLOCK, PARAGRAPH, HEADING = range(7)

_HEADING = re.compile(r"(?:#{1,6} |={3,}$|-{3,}$|@@ |diff --git |--- )")
_START = re.compile(r"(?:@\w|(?:export |default |public |private |protected |static |final |abstract |async |pub(?:\([a-z]+\))? |unsafe )*(?:def|class|function|fn|func|impl|struct|enum|trait|interface|type|module|namespace|package|record)\b)")
_SENTENCE = re.compile(r"(?<=[.!?;:,。！？；])(?=[\s　-鿿])")
_WORD = re.compile(r"(?<=\s)(?=\S)")


def _cut_line(line: str, most: int) -> list[tuple[str, int]]:
    """Parts of one line with the strength of the border before each; none is longer than `most`."""
    out: list[tuple[str, int]] = []
    for strength, at in ((SENTENCE, _SENTENCE), (WORDS, _WORD)):
        parts = at.split(line)
        if len(parts) > 1:
            for part in parts:
                if len(part) <= most:
                    out.append((part, strength))
                else:
                    inner = _cut_line(part, most)
                    out += [(inner[0][0], strength), *inner[1:]]
            return out
    return [(line[i : i + most], FORCED) for i in range(0, len(line), most)]


def _atoms(text: str, most: int) -> tuple[list[int], list[int]]:
    """Sizes of the atomic segments, and the strength of the border before each."""
    sizes: list[int] = []
    borders: list[int] = []
    blank = False
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        bare = line.strip()
        if not bare:
            strength = LINE
        elif blank:
            strength = HEADING if _HEADING.match(bare) else PARAGRAPH
        elif _HEADING.match(bare):
            strength = HEADING
        elif _START.match(bare):
            strength = BLOCK if line[0] in " \t" else PARAGRAPH
        else:
            strength = LINE
        blank = not bare
        if len(line) <= most:
            sizes.append(len(line))
            borders.append(strength)
        else:
            parts = _cut_line(line, most)
            sizes += [len(p) for p, _ in parts]
            borders += [strength, *(s for _, s in parts[1:])]
    return sizes, borders


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces of `text` as (start with overlap, start, end) in code points.

    The parts from start to end follow each other without gap and make up the text. Every piece but the
    first begins `overlap` characters before its own part (fewer at the start of the text), and none is
    longer than `limit`.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    if not text:
        return []
    if len(text) <= limit:
        return [(0, 0, len(text))]
    most = limit - overlap
    size, border = _atoms(text, most)
    n = len(size)
    start = [0] * n
    for i in range(1, n):
        start[i] = start[i - 1] + size[i - 1]
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    version, changes = list(range(n)), n  # no two states of segments share a number
    alive = [True] * n
    heap = [(border[i], size[i - 1] + size[i], i, version[i - 1], version[i]) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        _, total, right, seen_left, seen_right = heapq.heappop(heap)
        left = prev[right] if alive[right] else -1
        if left < 0 or version[left] != seen_left or version[right] != seen_right:
            continue
        if total + min(overlap, start[left]) > limit:
            continue
        size[left] = total
        alive[right] = False
        version[left], changes = changes, changes + 1
        after = nxt[left] = nxt[right]
        if after < n:
            prev[after] = left
            heapq.heappush(heap, (border[after], total + size[after], after, version[left], version[after]))
        if prev[left] >= 0:
            before = prev[left]
            heapq.heappush(heap, (border[left], size[before] + total, left, version[before], version[left]))
    pieces, i = [], 0
    while i < n:
        pieces.append((max(0, start[i] - overlap), start[i], start[i] + size[i]))
        i = nxt[i]
    return pieces


def split_oversized(rows: DataFrame, item: str = "id", text: str = "text", max_tokens: int = 2000, overlap_tokens: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of every row whose text has more than `max_tokens` tokens, ceil(code points / 4).

    Columns: the `keep` columns, then parentId (the row's `item`), pieceIndex from 0, pieceCount, startChar
    (of the piece's own part), overlapChars (characters repeated from the piece before), tokensEstimate,
    pieceText. A piece has at most `max_tokens` tokens with its overlap; the pieces without their overlaps
    make up the text. Rows with a null or shorter text have no pieces. Repeated rows give the same pieces
    each; a null `item` is kept as a null parentId. Texts of any length are cut in O(n log n).
    """
    limit, overlap = max_tokens * CHARS, overlap_tokens * CHARS
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    kept = [F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)]
    large = rows.select(F.col(item).cast("string").alias("parent"), F.col(text).alias("body"), *kept).where(F.length("body") > limit)
    types = dict(large.dtypes)
    names = [f"k_{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{n} {types[n]}" for n in names), "parentId string", "pieceIndex int", "pieceCount int", "startChar long", "overlapChars int", "tokensEstimate long", "pieceText string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                pieces = cut_points(row.body, limit, overlap)
                out = {n: [getattr(row, n)] * len(pieces) for n in names}
                out |= {
                    "parentId": [row.parent] * len(pieces),
                    "pieceIndex": range(len(pieces)),
                    "pieceCount": [len(pieces)] * len(pieces),
                    "startChar": [s for _, s, _ in pieces],
                    "overlapChars": [s - o for o, s, _ in pieces],
                    "tokensEstimate": [-(-(e - o) // CHARS) for o, _, e in pieces],
                    "pieceText": [row.body[o:e] for o, _, e in pieces],
                }
                yield pd.DataFrame(out)

    pieces = large.mapInPandas(run, schema)
    return pieces.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), *pieces.columns[len(keep) :])
