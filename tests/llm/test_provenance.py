"""Where files come from: notices hidden from features, features, the forest on held-out labels."""

import pytest
from pyspark.sql import functions as F

from quillon.llm.provenance import FEATURES, LABEL_GIVING, comment_chars, file_features, judge_files, measure, notice
from quillon.schema import CHUNKS


@pytest.mark.parametrize(
    "text,kind",
    [
        ("// Code generated by tiergen v1.2. DO NOT EDIT.\npackage x\n", "generated"), ("/*\n * This file was automatically generated from a.proto\n */\nx\n", "generated"), ("# @generated by tool\nx = 1\n", "generated"), ("// Automatisch erzeugt aus a.xml, nicht von Hand bearbeiten\nx\n", "generated"), ('@Generated("c")\npublic class A {}\n', "generated"),
        ("// Upstream: abc release 1.2.3, mirrored from the abc project without changes\nx\n", "vendored"), ("/*! abc v1.2.3 | (c) the abc contributors | MIT */\nx\n", "vendored"), ("// Copied from abc (tag 1.2.3), see abc/LICENSE\nx\n", "vendored"), ("/*! bundle_name */\n!function(){}\n", "minified"),
        ("// SPDX-License-Identifier: MIT\nx\n", None), ("// Copyright the project authors. All rights reserved.\nx\n", None), ("// Licensed under the Apache License, Version 2.0; see LICENSE at the root.\nx\n", None), ("# please do not edit the table by hand, use the admin page\nx\n", None), ("// shows reports generated by the scheduler\nx\n", None),
        ('x = "Code generated by gen. DO NOT EDIT."\n', None), ("", None),
    ],
)
def test_notice(text, kind):
    found, body = notice(text, True)
    assert found == kind
    if kind in ("generated", "vendored"):
        assert "enerated by" not in body and "mirrored" not in body and "erzeugt" not in body
    assert notice(text, False)[0] is None or kind == "minified"


def test_measure():
    m = measure("def f(x):\n    # note\n    return x + 12\n")
    assert m["comments"] > 0 and m["idents"] == 6 and m["digits"] == 2 and m["lines"] == 3
    assert measure("")["tokens"] == 0
    flat = measure("[" + "1, " * 500 + "]")
    assert flat["literal"] / flat["chars"] > 0.9


def test_nothing_that_labels_is_a_feature():
    assert not set(FEATURES) & set(LABEL_GIVING)


def test_long_headers_and_comments():
    """No line or length is too far down for a notice, no comment too long, no unclosed one slow."""
    text = "// line\n" * 500 + "// Code generated by x. DO NOT EDIT.\nx = 1\n"
    assert notice(text, True) == ("generated", "x = 1\n")
    assert comment_chars("a /*" + "x" * 100_000 + "*/ b") == 100_004
    assert comment_chars("/* " * 200_000) == 0 and comment_chars("u = 'h' // c\n  # d\n") == 9


def test_held_out_notices(spark):
    """Files whose notice is taken away, by kind, are judged by the forest alone."""
    chunks = spark.read.parquet("/root/testdata/sf0.1/chunks.parquet")
    judged = judge_files(chunks).select("path", "label", "machine_made", "by")
    hand = judged.where("path RLIKE '/src/(vendors|dist|report)/|/tools/codegen_|/src/minify_'")
    assert hand.where("machine_made").count() <= 0.02 * hand.count()
    vendor = judged.where("path RLIKE '(node_modules|third_party|site-packages|deps/upstream|Pods|external)[/\\\\\\\\]'")
    assert vendor.where("machine_made").count() >= 0.95 * vendor.count() > 0
    assert judged.where("by = 'banner' AND label <> 'vendored'").count() == 0 and judged.where("machine_made AND by IS NULL").count() == 0
    kinds = {(r.label, r.by): r["count"] for r in judged.where("label IS NOT NULL").groupBy("label", "by").count().collect()}
    for kind in ("generated", "minified", "data"):
        n = sum(v for (k, _), v in kinds.items() if k == kind)
        assert kinds[(kind, "forest")] >= 0.93 * n > 0, (kind, kinds)
    held = chunks.withColumn("hide", F.xxhash64("path") % 4 == 0)
    blind = held.withColumn("text", F.when(F.col("hide"), F.regexp_replace(F.regexp_replace("text", r"(?s)\A(?:(?:\s*(?://|#|\*|/\*)[^\n]*\n)+)", ""), r"//[#@] sourceMappingURL=\S+\s*$", "")).otherwise(F.col("text")))
    again = judge_files(blind).select("path", F.col("label").alias("l2"), F.col("machine_made").alias("m2"))
    both = judged.join(again, "path").join(held.select("path", "hide").distinct(), "path").where("hide AND label IN ('generated', 'vendored') AND l2 IS NULL").withColumn("own_place", ~F.col("path").rlike(r"(?i)(^|[/\\])(node_modules|third_party|site-packages|upstream|pods|external|vendor)[/\\]"))
    found = {(r.label, r.own_place): (r.found, r.n) for r in both.groupBy("label", F.when(F.col("label") == "vendored", F.col("own_place")).otherwise(False).alias("own_place")).agg(F.sum(F.col("m2").cast("int")).alias("found"), F.count("*").alias("n")).collect()}
    print(found)
    assert found["generated", False][0] >= 0.85 * found["generated", False][1] > 10
    # copies in a place of their own are found; those among the project's own code are what the banner alone tells
    assert found["vendored", False][0] >= 0.9 * found["vendored", False][1] > 5
    assert found["vendored", True][1] > 10


def test_rows(spark, at):
    def row(i, path, text, meta="{}", source="file"):
        return (i, source, "code", text, at(1), path, None, 1, None, meta)

    gen = "// @generated by x\npackage wire\n" + "".join(f"func (x *A) Get{i}() int64 {{\n\treturn x.v{i}\n}}\n" for i in range(20))
    rows = [row("1", "a/gen.go", gen), row("1", "a/gen.go", gen), row("2", "a\\hand.go", "package a\n\n// Add adds.\nfunc Add(a, b int) int {\n\treturn a + b\n}\n"), row("3", None, "x"), row("4", "n", None), row("5", "log", "x", source="log"), row("6", "s/parent.go", "[split from 2 sub-chunks] // @generated by x\npack...", '{"split": true}'), row("7", "s/parent.go", "package a\nfunc A() {}\n", '{"splitIndex": 0}'), row("8", "s/parent.go", "[…]\nfunc B() {}\n", '{"splitIndex": 1}'), row("9", "broken", "x = 1", "{broken")]
    df = spark.createDataFrame(rows, CHUNKS).withColumn("notice", F.lit("clash")).withColumn("features", F.lit(1)).withColumn("t", F.lit(2))
    out = {r.path: (r.label, r.machine_made) for r in judge_files(df).collect()}
    assert set(out) == {"a/gen.go", "a\\hand.go", "s/parent.go", "broken"}
    assert out["a/gen.go"] == ("generated", True) and out["s/parent.go"] == ("generated", True)
    assert judge_files(df.limit(0)).count() == 0 and file_features(df.where("path IS NULL")).count() == 0
    only = judge_files(df.where("path = 'broken'")).collect()
    assert [(r.label, r.probability, r.machine_made) for r in only] == [(None, 0.0, False)]
