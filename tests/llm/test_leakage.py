"""Leaks of evaluation items: the rule, against brute force and on rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.llm.leakage import ItemIndex, best_passage, candidates, leaks, lie_together

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega ant bee cat dog eel fox gnu hen ibis jay koi lark mole newt owl pig quail rat seal toad vole wasp yak zebra".split()


def sentence(rnd, n):
    return [rnd.choice(WORDS) + str(rnd.randrange(9)) for _ in range(n)]


def brute(doc, item, run=16):
    for a in range(len(item) - run + 1):
        before = [0] * (len(doc) + 1)
        for b in range(a, len(item)):
            now = [before[0] + 1]
            for i in range(1, len(doc) + 1):
                now.append(min(before[i - 1] + (doc[i - 1] != item[b]), before[i] + 1, now[i - 1] + 1))
            before = now
            if b - a + 1 >= run and min(before) * 10 <= b - a + 1:
                return True
    return False


def edited(rnd, words, edits):
    out = list(words)
    for _ in range(edits):
        i = rnd.randrange(len(out))
        kind = rnd.randrange(3)
        if kind == 0:
            out[i] = "changed"
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, "added")
    return out


def test_brute_force():
    rnd = random.Random(11)
    wrong = found = 0
    for _ in range(250):
        item = sentence(rnd, rnd.randint(18, 60))
        n = rnd.randint(10, min(45, len(item)))
        at = rnd.randint(0, len(item) - n)
        doc = sentence(rnd, rnd.randint(0, 40)) + edited(rnd, item[at : at + n], rnd.randint(0, 1 + n // 9)) + sentence(rnd, rnd.randint(0, 40))
        index = ItemIndex([(1, " ".join(item))])
        w = index.numbers(" ".join(doc))
        _, doc_at, item_at, _ = index.pairs(*index.found(w))
        near = lie_together(doc_at, item_at)
        got = near and best_passage(w, index.words[0], list(zip(doc_at.tolist(), item_at.tolist())))[0] >= 16
        want = brute(doc, item)
        assert near or not want
        found += want
        wrong += got != want
    # where edits stand so close together that the alignment may choose another way
    assert found > 80 and wrong <= 2


@pytest.fixture
def data(spark):
    rnd = random.Random(5)
    items = [(i, " ".join(sentence(rnd, 60))) for i in range(6)] + [(90, "too short to leak at all"), (91, None), (92, "")]
    text = dict(items)
    words = {i: t.split() for i, t in items if t}
    shared = " ".join(sentence(rnd, 9))
    noise = lambda n: " ".join(sentence(rnd, n))
    docs = [
        (1, noise(50) + " " + text[0] + " " + noise(50)), (2, "** " + ", ".join(words[1][10:40]).upper() + " **\n"), (3, noise(30) + " " + " ".join(edited(rnd, words[2][5:45], 3)) + " " + noise(10)), (4, noise(200)), (5, " ".join(words[3][:11]) + " " + noise(40)),
        (6, " ".join(words[3][20:50]) + " x " + " ".join(words[4][20:50])), (7, None), (8, ""), (9, shared), (1, noise(5)), (10, " ".join(w if i % 4 else "edit" for i, w in enumerate(words[5]))),
    ]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_rows(data):
    docs, items = data
    got = {(r.doc_id, r.item_id): r for r in leaks(docs, items).collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 2), (6, 3), (6, 4)}
    assert (got[1, 0].words, got[1, 0].edits, got[1, 0].itemWord, got[1, 0].docWord) == (60, 0, 0, 50)
    # the longest run that keeps the rule may go on into words that aren't there, as edits
    assert got[2, 1].words - got[2, 1].edits == 30
    assert got[3, 2].edits <= got[3, 2].words // 10


def test_common_seeds_still_count(spark, data):
    """A passage that most documents have is found although all its seeds are common."""
    docs, items = data
    item = items.where("item_id = 0").first().text
    many = spark.range(60).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("x "), F.lit(" ".join(item.split()[3:30])), F.lit(" y"), F.col("id").cast("string")).alias("text"))
    got = leaks(docs.unionByName(many), items, rare_share=0.01)
    assert got.where("item_id = 0 AND doc_id >= 100").count() == 60


def test_empty_and_extra_columns(spark, data):
    docs, items = data
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0
    more = docs.withColumn("item_id", F.lit("clash")).withColumn("seeds", F.lit(1)), items.withColumn("doc_id", F.lit("clash")).withColumn("d", F.lit(2))
    assert leaks(*more).count() == 5
    with pytest.raises(ValueError):
        leaks(docs, items, run_words=8)


def test_passage_beside_a_better_alignment():
    """60 words with every fifth changed score more than the 20 unchanged ones further on, but hold no passage."""
    item = [f"w{k}" for k in range(110)]
    doc = [f"x{k}" if k < 60 and k % 5 == 4 or 60 <= k < 90 else w for k, w in enumerate(item)]
    index = ItemIndex([(1, " ".join(item))])
    w = index.numbers(" ".join(doc))
    _, doc_at, item_at, _ = index.pairs(*index.found(w))
    pairs = list(zip(doc_at.tolist(), item_at.tolist()))
    assert tuple(best_passage(w, index.words[0], pairs)) == (22, 2, 90, 90)


def test_blocks_and_shares_change_nothing(data):
    docs, items = data
    want = {tuple(r) for r in leaks(docs, items).collect()}
    for how in ({"block_chars": 300}, {"rare_share": 1.0}, {"rare_share": 0.0}):
        assert {tuple(r) for r in leaks(docs, items, **how).collect()} == want


def test_rare_seeds_make_the_candidates(spark):
    """A phrase of twelve words that all items and most documents share makes no candidate; a leaked passage does."""
    rnd = random.Random(3)
    phrase = " ".join(sentence(rnd, 12))
    items = [(i, " ".join(sentence(rnd, 30)) + " " + phrase) for i in range(20)]
    docs = [(i, phrase + " " + " ".join(sentence(rnd, 30)) + (" " + " ".join(items[7][1].split()[2:24]) if i == 5 else "")) for i in range(100)]
    df = spark.createDataFrame(docs, "d long, t string")
    index = ItemIndex(items)
    told, common = candidates(df, index, spark.sparkContext.broadcast(index), "bigint", 0.05)
    assert len(common) == 8 and {(r.d, tuple(r.near)) for r in told.where("near IS NOT NULL").collect()} == {(5, (7,))}
    assert [tuple(r)[:2] for r in leaks(df, spark.createDataFrame(items, "item_id long, text string"), "d", "t").collect()] == [(5, 7)]
