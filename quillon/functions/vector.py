"""Vectors, hashes and score arithmetic as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import embedding_text

# fixed values: the deterministic embedding and the scoring formulas
EMBEDDING_DIMS = 384
WEEK_SECONDS = 7 * 24 * 3600


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often and deep in lambdas it is used."""
    return F.transform(F.array(value), use)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for different lengths, empty or zero vectors."""
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    ratio = bind(norm(a) * norm(b), lambda both: F.when(both > 0, dot(a, b) / both).otherwise(F.lit(0.0)))
    return F.when(same, ratio).otherwise(F.lit(0.0))


def deterministic_embedding(text: Column, dims: int = EMBEDDING_DIMS) -> Column:
    """A unit vector of polynomial hashes of the normalised text, one per dimension.

    Dimension i starts from 7919 i + 1 and folds h = 31 h + character into 32 bits. As the fold is linear in
    its start, all dimensions come from one pass over the text: start * 31^n + hash.
    """
    clean = embedding_text(text)
    wrap = F.lit(2**32)
    chars = F.filter(F.split(clean, ""), lambda c: F.length(c) > 0)
    folded = F.aggregate(
        chars,
        F.struct(F.lit(0).cast("long").alias("h"), F.lit(1).cast("long").alias("p")),
        lambda s, c: F.struct(F.pmod(s["h"] * 31 + F.ascii(c), wrap).alias("h"), F.pmod(s["p"] * 31, wrap).alias("p")),
    )

    # what a lambda uses is computed for each element unless it is itself bound by a lambda
    def values(state: Column) -> Column:
        def value(i: Column) -> Column:
            return bind(F.pmod(state["h"] + F.pmod(state["p"] * (i.cast("long") * 7919 + 1), wrap), wrap), lambda raw: F.when(raw >= 2**31, raw - 2**32).otherwise(raw) / F.lit(2147483647.0))

        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), value)

    unit = bind(bind(folded, values), lambda raw: bind(norm(raw), lambda length: F.transform(raw, lambda x: F.when(length > 0, x / length).otherwise(x))))
    return F.when(F.length(clean) > 0, unit)


def fnv1a32(text: Column) -> Column:
    """FNV-1a of the characters, as a number from 0 to 2^32 - 1."""
    return F.aggregate(
        F.filter(F.split(text, ""), lambda c: F.length(c) > 0),
        F.lit(2166136261).cast("long"),
        # the multiplication by 16777619 is split so that it stays within 64 bits
        lambda h, c: F.pmod(F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619, F.lit(2**32)), F.lit(2**32)),
    )


def compress_lexical(score: Column) -> Column:
    return F.when(score > 0, F.least(F.lit(8.0), F.log1p(score) * 1.8)).otherwise(F.lit(0.0))


def idf(total: Column, df: Column) -> Column:
    """Inverse document frequency that is never negative."""
    return F.log1p((total - df + 0.5) / (df + 0.5))


def fts_idf(total: Column, df: Column) -> Column:
    """The full-text engine's inverse document frequency, floored above 0."""
    raw = F.log((total - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)


def recency(timestamp: Column, now: Column) -> Column:
    """1 now, 0 a week ago and before, linear between."""
    age = now.cast("timestamp").cast("double") - timestamp.cast("timestamp").cast("double")
    return F.greatest(F.lit(0.0), 1 - age / WEEK_SECONDS)


def dcg_discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)
