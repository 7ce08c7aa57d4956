"""Splitting at natural boundaries: exact round trip, limits, overlap, boundaries."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm.splitting import cut_points, split_oversized

PIECES = st.sampled_from(["a", "word ", "\n", "\n\n", ". ", "# head\n", "def f():\n", "    return 1\n", "é", "x" * 60, "日本。", "\r\n", "😀"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=200), st.integers(5, 150), st.data())
def test_round_trip(parts, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    text = "".join(parts)
    pieces = cut_points(text, limit, overlap)
    assert "".join(text[s:e] for _, s, e in pieces) == text
    for n, (o, s, e) in enumerate(pieces):
        assert s < e and e - o <= limit and s - o == (min(overlap, s) if n else 0)


def test_natural_boundaries():
    section = "## Part\n\n" + "A sentence of words. " * 12 + "\n\n"
    text = section * 6
    starts = [text[s : s + 7] for _, s, _ in cut_points(text, 700, 0)]
    assert all(x == "## Part" for x in starts)
    code = "".join(f"def f{i}():\n" + "    x = 1\n" * 8 + "\n" for i in range(12))
    assert all(code[s : s + 4] == "def " for _, s, _ in cut_points(code, 400, 0))


def test_no_boundaries_and_bad_arguments():
    pieces = cut_points("x" * 1000, 100, 20)
    assert all(e - o <= 100 for o, _, e in pieces) and len(pieces) == -(-1000 // 80)
    with pytest.raises(ValueError):
        cut_points("x", 10, 10)
    assert cut_points("", 10, 1) == [] and cut_points("short", 10, 1) == [(0, 0, 5)]


def test_weakest_border_first():
    """A word border inside a line is merged before a blank line, whatever their sizes."""
    text = "a" * 30 + " " + "b" * 30 + "\n\n" + "c" * 10 + "\n"
    assert [text[s:e] for _, s, e in cut_points(text, 65, 0)] == ["a" * 30 + " " + "b" * 30 + "\n\n", "c" * 10 + "\n"]


def test_very_long_text():
    text = "key = value\n" * 200_000
    pieces = cut_points(text, 8000, 800)
    assert "".join(text[s:e] for _, s, e in pieces) == text and len(pieces) < len(text) / 7200 * 1.3


def test_rows(spark):
    long = "line of text\n" * 900
    df = spark.createDataFrame([("a", long, "p"), ("a", long, "p"), ("b", "x" * 8000, "p"), ("c", "x" * 8001, None), ("d", None, "p"), ("e", "", "p"), (None, long, "q")], "id string, text string, path string").withColumn("parentId", F.lit("old")).withColumn("pieceIndex", F.lit(7))
    out = split_oversized(df, keep=("path",)).collect()
    assert {r.parentId for r in out} == {"a", "c", None}
    for parent in ("a", None):
        mine = sorted((r for r in out if r.parentId == parent), key=lambda r: r.pieceIndex)
        assert all(r.tokensEstimate <= 2000 and r.tokensEstimate == -(-len(r.pieceText) // 4) for r in mine)
        assert "".join(r.pieceText[r.overlapChars :] for r in mine if r.pieceIndex == mine[0].pieceIndex or parent is None) == (long if parent is None else mine[0].pieceText[mine[0].overlapChars :] * 2)
        assert all(r.overlapChars == (0 if r.pieceIndex == 0 else 800) for r in mine)
    assert split_oversized(df.limit(0)).count() == 0
