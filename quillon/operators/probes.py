"""Robustness probes and held-out tasks: confusers, flips, a learned predictor of flips, generated tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.functions import vector as V
from quillon.operators.ordered import running

# fixed values: kinds of confusers, features of the predictor, limits of generated tasks
CONFUSERS = ("structural-only", "fts-only", "structural+fts", "weak-partial", "adversarial-poison")
CONTROL = "control"
FEATURES = ("arms", "inbound", "log_inbound", "isolated", "structural_without_inbound", "log_length", "typescript", "top_arm", "arm_spread")
MOST_NAMES, MOST_WORDS, FEW_WORDS = 10, 6, 2
IRRELEVANT, TASK_INTENTS = 3, ("code_search", "debug", "explain", "implement")
TEMPLATES = {
    "code_search": ("Where is the {kind} {name} defined?", "Locate {name}."),
    "debug": ("{name} fails with an unexpected error, what is broken?", "Trace why {name} returns wrong values."),
    "explain": ("What does {name} do?", "Describe the purpose of the {kind} {name}."),
    "implement": ("Extend {name} with a new option.", "Change the {kind} {name} to support batches."),
}


def confusers(tasks: DataFrame) -> DataFrame:
    """query_id, kind, path, text of one confuser per task and kind, and a control that shares nothing with it.

    `tasks`: query_id, text, keywords (array), elsewhere (a path that isn't relevant). A kind decides which arms
    are lured: names only, words only, both, a weak part of them, or both with a claim about the wrong file.
    """
    words = F.coalesce("keywords", F.array().cast("array<string>"))
    names = F.slice(F.filter(words, lambda w: w.rlike(r"^[A-Za-z_$][\w$]*$")), 1, MOST_NAMES)
    stubs = F.when(F.size(names) > 0, F.array_join(F.transform(names, lambda n: F.concat(F.lit("export function "), n, F.lit("() { return null; }"))), "\n")).otherwise("export function someOther() { return null; }")
    said = lambda n: F.array_join(F.slice(words, 1, n), ", ")
    line = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts), F.lit("\n"))
    task, plain = F.coalesce("text", F.lit("")), "export function plain() { return null; }"
    made = {
        "structural-only": line(stubs), "fts-only": F.concat(line("// about ", said(MOST_WORDS)), line("// ", task), line(plain)), "structural+fts": F.concat(line("// ", task), line(stubs)), "weak-partial": F.concat(line("// see ", said(FEW_WORDS)), line(plain)),
        "adversarial-poison": F.concat(line("// what is asked for is in ", F.coalesce("elsewhere", F.lit(""))), line("// ", task), line(stubs)), CONTROL: F.concat(line("// administrative helper"), line(plain)),
    }
    rows = tasks.select("query_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in made.items()))).alias("c"))
    return rows.select("query_id", "c.kind", F.concat(F.lit("confuser/"), F.col("query_id").cast("string"), F.lit("/"), F.col("c.kind"), F.lit(".ts")).alias("path"), "c.text")


def flip_differences(first: DataFrame) -> DataFrame:
    """query_id, kind, diff: whether the first hit changes with the confuser, less whether it does with the control.

    `first`: query_id, kind (null without any), path of the first hit. Tasks without a plain first hit are left out.
    """
    plain = first.where("kind IS NULL").select("query_id", F.col("path").alias("plain"))
    changed = first.where("kind IS NOT NULL").join(plain, "query_id").select("query_id", "kind", (~F.col("path").eqNullSafe(F.col("plain"))).cast("int").alias("flip"))
    control = changed.where(F.col("kind") == CONTROL).select("query_id", F.col("flip").alias("base"))
    return changed.where(F.col("kind") != CONTROL).join(control, "query_id").select("query_id", "kind", (F.col("flip") - F.col("base")).cast("double").alias("diff"))


def candidate_features(candidates: DataFrame, inbound: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds `FEATURES` to candidates with structural, vector and fts contributions: shape, never the fused score."""
    meta = chunks.select(F.col("id").alias("chunk_id"), F.length(F.coalesce("text", F.lit(""))).alias("_n"), F.coalesce("path", F.lit("")).alias("_p")).dropDuplicates(["chunk_id"])
    rows = candidates.join(inbound, "chunk_id", "left").join(meta, "chunk_id", "left").withColumn("inbound", F.coalesce("inbound", F.lit(0)).cast("double"))
    found = F.filter(F.array(*(F.coalesce(F.col(a), F.lit(0.0)) for a in ("structural", "vector", "fts"))), lambda x: x > 0)
    rows = rows.withColumn("_a", found)
    alone = F.col("inbound") == 0
    top = F.coalesce(F.array_max("_a"), F.lit(0.0))
    return rows.select(
        *candidates.columns, F.size("_a").cast("double").alias("arms"), "inbound", F.log1p("inbound").alias("log_inbound"), alone.cast("double").alias("isolated"), (alone & (F.coalesce("structural", F.lit(0.0)) > 0)).cast("double").alias("structural_without_inbound"),
        F.log1p(F.coalesce("_n", F.lit(0))).alias("log_length"), F.coalesce(F.col("_p").endswith(".ts"), F.lit(False)).cast("double").alias("typescript"), top.alias("top_arm"), F.when(F.size("_a") > 1, top - F.array_min("_a")).otherwise(0.0).alias("arm_spread"),
    )


def fit_flip_predictor(rows: DataFrame, label: str = "label", task: str = "query_id", holdout: int = 3):
    """A logistic regression on the features, and its ROC AUC on the tasks held out (every `holdout`-th by hash)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from quillon.operators.evaluate import roc_auc

    held = F.pmod(F.xxhash64(task), F.lit(holdout)) == 0
    steps = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.01)])
    model = steps.fit(rows.where(~held).withColumn(label, F.col(label).cast("double")))
    scored = model.transform(rows.where(held).withColumn(label, F.col(label).cast("double"))).select(vector_to_array("probability")[1].alias("score"), label)
    return model, roc_auc(scored, "score", label).first().auc


def heldout_tasks(symbols: DataFrame, seed: str, most: int, per_file: int = 2) -> DataFrame:
    """task_id, text, intent, path, keywords, irrelevant: tasks about single symbols, the same for the same seed.

    Symbols are taken in the order of a seeded hash, at most `per_file` of a file and `most` in all; intent and
    wording are chosen by hashes too, and three other files are named as irrelevant.
    """
    key = F.concat_ws(":", F.lit(seed), "path", "name")
    one = symbols.where("path IS NOT NULL AND name IS NOT NULL").select("path", "name", "kind").distinct().withColumn("h", V.fnv1a32(key))
    kept = one.withColumn("nr", F.row_number().over(Window.partitionBy("path").orderBy("h", "name", "kind"))).where(F.col("nr") <= per_file).orderBy("h", "path", "name", "kind").limit(most)

    def pick(what: str, n: int) -> Column:
        return F.pmod(V.fnv1a32(F.concat_ws(":", F.lit(seed), "path", "name", F.lit(what))), F.lit(n)).cast("int")

    asked = kept.withColumn("intent", F.element_at(X.strings(TASK_INTENTS), pick("intent", len(TASK_INTENTS)) + 1))
    wording = F
    for intent, lines in TEMPLATES.items():
        wording = wording.when(F.col("intent") == intent, F.element_at(X.strings(lines), pick("template", len(lines)) + 1))
    text = F.replace(F.replace(wording, F.lit("{name}"), F.col("name")), F.lit("{kind}"), F.col("kind"))
    files = symbols.select("path").where("path IS NOT NULL").distinct().orderBy(V.fnv1a32(F.concat_ws(":", F.lit(seed), "path")), "path").limit(IRRELEVANT + 1).agg(F.collect_list("path").alias("_files"))
    keywords = F.array_distinct(F.concat(F.array("name", "kind"), F.filter(X.split_identifier(F.col("name")), lambda p: F.length(p) > 2)))
    placed = running(asked.join(F.broadcast(files)), ["h", "path", "name", "kind"], "nr")
    return placed.select(F.format_string("H%03d", "nr").alias("task_id"), text.alias("text"), "intent", "path", keywords.alias("keywords"), F.slice(F.filter("_files", lambda p: p != F.col("path")), 1, IRRELEVANT).alias("irrelevant"))
