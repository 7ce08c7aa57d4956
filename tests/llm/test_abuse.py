"""Abusive language: disguises, exceptions, length, rates, held-out agreement with the labels."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from quillon.llm.abuse import THRESHOLD, flagged_rates, fold, score_documents, score_text

ABUSIVE = [
    "You are a worthless loser and everybody here knows it.", "you w0rthl355 piece of 5h1t", "Nobody asked you, i m b e c i l e .", "only a d i s g u s t i n g b a s t a r d would do that", "What a spіnеlеss сrеtіn merges this?", "Free h​a​r​d​c​o​r​e p​o​r​n clips",
    "GO TO HELL, YOU PRICK", "You are a creeeetin.", "Los extranjeros son b****a y deberían desaparecer.", "Du bist ein verdammter Vollidiot.", "Ferme ta gueule, espèce d'abruti.", "Cállate, pedazo de idiiiota inútil.", "Women are vermin and should be thrown out of the country.", "Why do we let immigrants near a server?",
    "I know where you live and I will break your hands.", "Kill yourself, the build would be better for it.", "Send me your n4k3d pics, I get so horny", "sHuT Up, YoU uGlY lOsEr",
]
FINE = [
    "I was an idiot, I forgot to split the ledger.", "An idiot-proof installer would save us 24 tickets a week.", "Dumb terminals get a plain prompt.", "This cursor sucks, the code is shit and I wrote it myself.", "Ugly hack, but the pathetic throughput of the old gate was worse.", "Abort the stupid retry loop, it is useless and ugly.",
    "Kill the child process and reap the zombie before the parent dies.", "The breast cancer sample set ships with the tutorial.", "The parser chokes on a naked carriage return.", "The women in tech meetup is on Thursday, bring your demo.", "Foreign keys from immigrants and old people tables are checked nightly.",
    "The word list holds terms such as idiot and moron and is used to flag messages.", "Posts that insult or threaten other members are removed under the conduct policy.", "Sexual content must be tagged before the index is published.", "What the hell is this token doing in the table?", "Quel idiot je fais, j'ai oublié le frame.", "You can blow away the plan and strip its tags.", "The master node demotes a slave replica.", "",
]


@pytest.mark.parametrize("text", ABUSIVE)
def test_flagged(text):
    long = "The cache is rebuilt when its dimensions change. " * 40
    assert score_text(text)[0] >= THRESHOLD
    assert score_text(long + text + " " + long)[0] >= THRESHOLD


@pytest.mark.parametrize("text", FINE)
def test_not_flagged(text):
    assert score_text(text)[0] < THRESHOLD


def test_normalised_by_length():
    few, many = "you stupid ugly thing", "you stupid ugly thing " + "that goes on with other words " * 4
    assert score_text(few)[0] >= score_text(many)[0]
    assert score_text(None) == (0.0, None) and score_text(" \n ") == (0.0, None)


def test_fold():
    assert fold("Ｉｄｉｏｔ") == "idiot" and fold("b****a") == "basura" and fold("привет мир") == "привет мир" and fold("shard12 tier3") is not None


def test_rows_and_rates(spark):
    df = spark.createDataFrame([(1, ABUSIVE[0], "a"), (1, ABUSIVE[0], "a"), (2, FINE[0], "a"), (3, None, "b"), (4, "", None), (None, ABUSIVE[1], None)], "doc_id long, text string, source string").withColumn("score", F.lit("x")).withColumn("i", F.lit(0))
    out = score_documents(df, keep=("source",))
    assert sorted((str(r.doc_id), r.flagged) for r in out.collect()) == [("1", True), ("1", True), ("2", False), ("3", False), ("4", False), ("None", True)]
    rates = {r.source: (r.n_documents, r.n_flagged, r.flagged_rate) for r in flagged_rates(out).collect()}
    assert rates == {"a": (3, 2, 0.666667), "b": (1, 0, 0.0), None: (2, 1, 0.5)}
    assert score_documents(df.limit(0)).count() == 0


def test_unseen_sentences():
    """Sentences that aren't from the tables. The first set was used to mend the lexicon afterwards, the second only for what it flags wrongly."""
    import unseen_abuse as U

    flagged = lambda texts: sum(score_text(t)[0] >= THRESHOLD for t in texts)
    assert flagged(U.ABUSIVE) >= 0.95 * len(U.ABUSIVE) and flagged(U.HARMLESS) == 0
    assert flagged(U.ABUSIVE_2) >= 0.8 * len(U.ABUSIVE_2) and flagged(U.HARMLESS_2) <= 1


def test_disguises_of_any_length():
    assert score_text("you are a m0th3rfuck3r" + "s" * 30)[0] >= THRESHOLD
    assert "stupid" in fold(" ".join("thisisastupid" * 12)).split() or fold(" ".join("stupid" * 20)).split() == ["stupid"] * 20
    assert score_text("!" * 200_000 + " fine") == (0.0, None)


def test_what_stands_near_decides():
    assert score_text("You are a clown.")[0] >= THRESHOLD > score_text("The clown test passes.")[0]
    assert score_text("Immigrants are vermin.")[0] >= THRESHOLD > score_text("Those processes are vermin.")[0]
    assert score_text("I am an idiot.")[0] < THRESHOLD <= score_text("He is an idiot.")[0]
    assert score_text("The word idiot is on the list of slurs.")[0] < THRESHOLD


def test_labels(spark):
    """Human ratings of the test tables, of which a few are wrong: nearly all hateful and sexual ones agree, hardly any ok one is flagged."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/doc_labels.parquet").where("label IS NOT NULL")
    rated = docs.join(labels.groupBy("doc_id").agg(F.collect_set("label").alias("labels")), "doc_id").where("size(labels) = 1").select("doc_id", "text", F.col("labels")[0].alias("label"))
    counts = {(r.label, r.flagged): r["count"] for r in score_documents(rated, keep=("label",)).groupBy("label", "flagged").count().collect()}
    assert counts.get(("ok", True), 0) <= 0.03 * counts[("ok", False)]
    for label in ("hateful", "sexual"):
        assert counts[(label, True)] >= 0.85 * (counts[(label, True)] + counts.get((label, False), 0))
