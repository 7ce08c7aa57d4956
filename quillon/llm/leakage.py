"""Evaluation texts leaking into training text: rare n-gram seeds, then Smith-Waterman alignment.

A passage is a run of at least `RUN` words of an item, of which at most one in ten was changed, dropped or added in
the document. A run of L words with e edits keeps at least L - 5 e - 4 unchanged seeds (word n-grams), and one of 32
words or more can be halved so that one half still keeps the rule. So every passage holds a stretch of at most
`SPAN` item words with at most `DRIFT` edits and at least `HITS` seeds. From this:

1. The items' seeds are looked up in every document; only documents with at least `HITS` of them go on, and their
   seeds are counted over the corpus. A seed is rare if at most `rare_share` of these documents have it.
2. Rare seeds are joined to the items' seeds: what meets is a candidate. No rare seed is in many documents, so no
   key of this join is hot.
3. A passage of common seeds only (a licence, a phrase all items share) meets nothing in that join. Documents are
   therefore also matched by their common seeds, each document by itself and without emitting pairs; an item counts
   if `HITS` of its common seeds are found.
4. Candidates whose seeds don't lie together as above are dropped. For the others document and item are aligned
   around each cluster of seeds on nearby diagonals (Smith-Waterman with traceback, in a band), and the alignment is
   searched for a run that keeps the rule; the next best alignments too, as long as seeds outside the earlier ones
   are left for a passage.

Items are taken in blocks of about `BLOCK_CHARS` characters, so any number of them can be searched; a block's index
is what is broadcast.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.materialize import materialize, spread, widen

#: Words of an item that make a passage; one in so many may be edited; words of a seed.
RUN, ONE_IN, SEED = 16, 10, 5
#: What every passage holds: so many seeds, beginning within so many item words, on diagonals no further apart.
HITS, SPAN, DRIFT = 6, 2 * RUN - 1 - SEED, (2 * RUN - 1) // ONE_IN
#: Characters of the items of a block.
BLOCK_CHARS = 3_000_000
#: Alignment scores, and how far from the seeds' diagonals the alignment may go.
MATCH, MISMATCH, GAP, BAND = 2, -3, -3, 12
#: Score of the poorest passage: RUN words, one of them edited.
LEAST = MATCH * (RUN - RUN // ONE_IN) + MISMATCH * (RUN // ONE_IN)

_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


class ItemIndex:
    """The items' words as numbers, and their seeds: sorted hashes, each with the (item, position) it stands at."""

    def __init__(self, items: list[tuple]):
        self.vocabulary: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.words = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in words_of(text or "")], dtype=np.int64) for _, text in items]
        every = [self.hashes(w) for w in self.words]
        flat = np.concatenate([np.zeros(0, np.int64), *every])
        order = np.argsort(flat, kind="stable")
        self.seeds, self.starts = np.unique(flat[order], return_index=True)
        self.starts = np.append(self.starts, len(flat))
        self.owner = np.repeat(np.arange(len(every)), [len(h) for h in every])[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for h in every)])[order]

    @staticmethod
    def hashes(w: np.ndarray) -> np.ndarray:
        """One hash per n-gram; -1 where a word is unknown."""
        n = len(w) - SEED + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        h = np.zeros(n, dtype=np.uint64)
        known = np.ones(n, dtype=bool)
        for k in range(SEED):
            part = w[k : k + n]
            known &= part >= 0
            h = (h ^ (part.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        out = (h >> np.uint64(1)).astype(np.int64)
        out[~known] = -1
        return out

    def numbers(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(x, -1) for x in words_of(text)], dtype=np.int64)

    def found(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the document that begin a seed, and the seeds' numbers."""
        h = self.hashes(w)
        if not len(h) or not len(self.seeds):
            return np.zeros(0, dtype=np.int64), h[:0]
        at = np.searchsorted(self.seeds, h)
        at[at == len(self.seeds)] = 0
        hit = np.flatnonzero((self.seeds[at] == h) & (h >= 0))
        return hit, at[hit]

    def pairs(self, positions: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every meeting of a document's seeds with the items': item, document position, item position, seed."""
        n = self.starts[numbers + 1] - self.starts[numbers]
        which = np.repeat(self.starts[numbers] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else n
        return self.owner[which], np.repeat(positions, n), self.place[which], np.repeat(numbers, n)


def lie_together(doc_at: np.ndarray, item_at: np.ndarray) -> bool:
    """Whether `HITS` seeds at different item words begin within `SPAN` of them, on diagonals at most `DRIFT` apart."""
    if len(item_at) < HITS:
        return False
    diagonal = doc_at - item_at
    order = np.argsort(diagonal, kind="stable")
    diagonal, item_at = diagonal[order], item_at[order]
    for low in np.unique(diagonal):
        a, b = np.searchsorted(diagonal, [low, low + DRIFT + 1])
        if b - a >= HITS:
            at = np.unique(item_at[a:b])
            if len(at) >= HITS and (at[HITS - 1 :] - at[: len(at) - HITS + 1] <= SPAN).any():
                return True
    return False


def _align(doc: np.ndarray, item: np.ndarray, low: int, high: int, taken: set[tuple[int, int]]) -> tuple[int, list[tuple[int, int]]]:
    """Score and steps of the best local alignment, free of `taken`, with document minus item position in [low, high].

    A step is (document word or -1, item word or -1); positions are relative to the two arrays.
    """
    n, m, width = len(doc), len(item), high - low + 1
    before = [0] * (width + 2)
    moves: list[bytearray] = []
    best, best_at = 0, (-1, -1)
    d, t = doc.tolist(), item.tolist()
    for j in range(m):
        now, row = [0] * (width + 2), bytearray(width + 2)
        word = t[j]
        for k in range(1, width + 1):
            i = j + low + k - 1
            if not 0 <= i < n or (i, j) in taken:
                continue
            score = before[k] + (MATCH if d[i] == word else MISMATCH)
            move = 1
            if before[k + 1] + GAP > score:  # item word dropped from the document
                score, move = before[k + 1] + GAP, 2
            if now[k - 1] + GAP > score:  # document word added
                score, move = now[k - 1] + GAP, 3
            if score > 0:
                now[k], row[k] = score, move
                if score > best:
                    best, best_at = score, (j, k)
        moves.append(row)
        before = now
    steps: list[tuple[int, int]] = []
    j, k = best_at
    while j >= 0 and k >= 1 and moves[j][k]:
        move, i = moves[j][k], j + low + k - 1
        if move == 1:
            steps.append((i, j))
            j -= 1
        elif move == 2:
            steps.append((-1, j))
            j, k = j - 1, k + 1
        else:
            steps.append((i, -1))
            k -= 1
    return best, steps[::-1]


def _longest_run(steps: list[tuple[int, int]], doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int]:
    """Of the runs that keep the rule the longest: item words, edits, first item word, first document word."""
    matched = [j for _, j in steps if j >= 0]
    if not matched:
        return 0, 0, -1, -1
    # words just outside count as edits: a run may begin or end with one
    spare = len(item) // ONE_IN + 1
    steps = [*((-1, j) for j in range(max(0, matched[0] - spare), matched[0])), *steps, *((-1, j) for j in range(matched[-1] + 1, min(len(item), matched[-1] + 1 + spare)))]
    # sum over a run of (1 per item word - ONE_IN per edit) must not be negative
    total, length = [0], [0]
    for i, j in steps:
        edit = i < 0 or j < 0 or doc[i] != item[j]
        total.append(total[-1] + (j >= 0) - ONE_IN * edit)
        length.append(length[-1] + (j >= 0))
    best = (0, 0, -1, -1)
    # starts with falling sums are the only ones that can be best for some end
    starts: list[int] = []
    for s, v in enumerate(total):
        if not starts or v < total[starts[-1]]:
            starts.append(s)
    keys = [-total[s] for s in starts]
    for e in range(len(steps), 0, -1):
        at = bisect_left(keys, -total[e])
        if at < len(starts) and starts[at] < e:
            s = starts[at]
            run = length[e] - length[s]
            if run > best[0]:
                at_word = next(((i, j) for i, j in steps[s:e] if i >= 0 and j >= 0), (-1, -1))
                best = (run, (run - (total[e] - total[s])) // ONE_IN, at_word[1], at_word[0])
    return best


def best_passage(doc: np.ndarray, item: np.ndarray, pairs: list[tuple[int, int]]) -> tuple[int, int, int, int]:
    """The longest passage near the seeds (document position, item position): see `_longest_run`."""
    best = (0, 0, -1, -1)
    pairs = sorted(pairs, key=lambda p: (p[0] - p[1], p[0]))
    # clusters of seeds: nearby diagonals, and close in the document
    clusters: list[list[tuple[int, int]]] = []
    reach = len(item) + BAND
    by_place = sorted(pairs)
    group: list[tuple[int, int]] = []
    for p in by_place:
        if group and p[0] - group[-1][0] > reach:
            clusters.append(group)
            group = []
        group.append(p)
    if group:
        clusters.append(group)
    for cluster in clusters:
        diagonals = sorted({i - j for i, j in cluster})
        at = 0
        while at < len(diagonals):
            end = bisect_right(diagonals, diagonals[at] + BAND)
            low, high = diagonals[at] - BAND, diagonals[end - 1] + BAND
            near = [p for p in cluster if low <= p[0] - p[1] <= high]
            start, stop = max(0, low), min(len(doc), high + len(item) + 1)
            part = doc[start:stop]
            # the best alignment may hold no passage, so the next ones are looked at while seeds are left for one
            taken: set[tuple[int, int]] = set()
            left = {(i - start, j) for i, j in near}
            while len({j for _, j in left}) >= HITS or not taken:
                score, steps = _align(part, item, low - start, high - start, taken)
                found = _longest_run(steps, part, item)
                if found[0] > best[0]:
                    best = (*found[:3], found[3] + start if found[3] >= 0 else -1)
                if score < LEAST:
                    break
                path = {(i, j) for i, j in steps if i >= 0 and j >= 0}
                taken |= path
                left -= path
            at = end if near else at + 1
    return best


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", run_words: int = RUN, rare_share: float = 0.01, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per leaked item and document: `doc`, `item`, words, edits, itemWord, docWord.

    `words` is the length in item words of the longest run that keeps the rule, `edits` its edits; the last
    two columns are where it begins, counted in words from 0. Words are maximal runs of letters and digits in
    lower case. Null and empty texts on either side leak nothing; items of fewer than `run_words` words can't
    leak. Repeated rows of the same `doc` are reported once, with the longest run; equal items each. The rule's
    guarantees hold for `run_words` of at least 16. `rare_share` and `block_chars` change no result.
    """
    if run_words < RUN:
        raise ValueError(f"runs of fewer than {RUN} words are not guaranteed to be found")
    known = items.select(F.col(item).alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    chars = known.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    kinds = [f"{documents.schema[doc].dataType.simpleString()}", f"{items.schema[item].dataType.simpleString()}"]
    texts = documents.select(F.col(doc).alias("d"), F.col(text).alias("t")).where("d IS NOT NULL AND t IS NOT NULL AND t <> ''")
    found = None
    for block in range(blocks):
        held = [tuple(r) for r in known.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()]
        part = _leaks_of(texts, sorted(held, key=lambda r: (str(r[0]), r[1])), kinds, run_words, rare_share)
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("d", "i").agg(F.max(F.struct("words", (-F.col("edits")).alias("less"), "itemWord", "docWord")).alias("b"))
    return best.select(F.col("d").alias(doc), F.col("i").alias(item), "b.words", (-F.col("b.less")).alias("edits"), "b.itemWord", "b.docWord")


def candidates(texts: DataFrame, index: ItemIndex, shared, kind: str, rare_share: float) -> tuple[DataFrame, np.ndarray]:
    """Documents (d, t) that may hold a passage with the items their rare seeds meet (near), and the common seeds."""
    spark = texts.sparkSession

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for batch in batches:
            out = []
            for d, t in zip(batch["d"], batch["t"]):
                at, seeds = ix.found(ix.numbers(t))
                if len(at) >= HITS:
                    out.append((d, t, np.unique(seeds)))
            yield pd.DataFrame(out, columns=["d", "t", "seeds"])

    seeded = materialize(widen(texts).mapInPandas(look, f"d {kind}, t string, seeds array<long>").withColumn("row", F.monotonically_increasing_id()))
    most = max(1, int(rare_share * seeded.count()))
    seeds = seeded.select("row", F.explode("seeds").alias("seed"))
    counts = materialize(seeds.groupBy("seed").count())
    # at most as many rows as the block has seeds
    common = np.array(sorted(r[0] for r in counts.where(F.col("count") > most).select("seed").collect()), dtype=np.int64)
    owned = pd.DataFrame({"seed": np.repeat(np.arange(len(index.seeds)), np.diff(index.starts)), "item": index.owner}).drop_duplicates()
    items = spark.createDataFrame(owned, "seed long, item long")
    rare = counts.where(F.col("count") <= most).select("seed")
    near = seeds.join(rare, "seed").join(items, "seed").groupBy("row").agg(F.collect_set("item").alias("near"))
    # few rows by their size, but each is aligned
    return spread(seeded.select("row", "d", "t").join(near, "row", "left")).drop("row"), common


def _leaks_of(texts: DataFrame, items: list[tuple], kinds: list[str], run_words: int, rare_share: float) -> DataFrame:
    spark = texts.sparkSession
    index = ItemIndex(items)
    shared = spark.sparkContext.broadcast(index)
    told, common = candidates(texts, index, shared, kinds[0], rare_share)
    commons = spark.sparkContext.broadcast(common)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix, frequent = shared.value, commons.value
        for batch in batches:
            out = []
            for d, t, near in zip(batch["d"], batch["t"], batch["near"]):
                w = ix.numbers(t)
                at, seeds = ix.found(w)
                met = {} if near is None else dict.fromkeys(int(i) for i in near)
                # items by common seeds alone
                plain = np.isin(seeds, frequent)
                owner, _, place, _ = ix.pairs(at[plain], seeds[plain])
                for i, n in zip(*np.unique(np.unique(np.stack([owner, place]), axis=1)[0], return_counts=True)):
                    if n >= HITS:
                        met[int(i)] = None
                if not met:
                    continue
                owner, doc_at, item_at, _ = ix.pairs(at, seeds)
                for i in met:
                    mine = owner == i
                    if len(ix.words[i]) >= run_words and lie_together(doc_at[mine], item_at[mine]):
                        words, edits, a, b = best_passage(w, ix.words[i], list(zip(doc_at[mine].tolist(), item_at[mine].tolist())))
                        if words >= run_words:
                            out.append((d, ix.ids[i], words, edits, a, b))
            yield pd.DataFrame(out, columns=["d", "i", "words", "edits", "itemWord", "docWord"])

    return told.mapInPandas(verify, f"d {kinds[0]}, i {kinds[1]}, words int, edits int, itemWord int, docWord int")
