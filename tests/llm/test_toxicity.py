"""The toxicity model against brute force, on copies, and on texts of other lengths than the labelled ones."""

import math
import os
import random

import pytest

from codeloom.llm import toxicity

DOCS = "doc_id long, text string"


def made(seed: int, n: int, vile: list[str]) -> list[tuple[str, int]]:
    """Texts of words of uneven frequency; one in eight has a passage of vile words."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randint(3, 7))) for _ in range(3000)]
    out = []
    for i in range(n):
        t = [words[int(3000 * r.random() ** 3)] for _ in range(r.choice([20, 80, 300]))]
        if i % 8 == 0:
            at = r.randrange(len(t))
            t[at:at] = [r.choice(vile) + r.choice(["", "en", "ique", "s"]) for _ in range(4)]
        out.append((" ".join(t), int(i % 8 == 0)))
    return out


def test_copies_of_a_toxic_text_do_not_make_its_words_toxic(spark):
    texts = made(1, 900, ["zuqqar", "wyxxo", "vrutz"])
    r = random.Random(4)
    cluster = next(t for t, y in texts if y and len(t) > 1500).split()
    copies = []
    for _ in range(500):
        c = list(cluster)
        c[r.randrange(len(c))] = "changed"
        copies.append((" ".join(c), 1))
    rows = [(i, t, y) for i, (t, y) in enumerate(texts + copies)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], DOCS)
    model = toxicity.learn(docs, spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int"))
    new = made(1, 1600, ["zuqqar", "wyxxo", "vrutz"])[900:]
    got = {x["doc_id"]: x["predicted"] for x in toxicity.score_documents(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(new)], DOCS), model).collect()}
    assert sum(got[i] for i, (_, y) in enumerate(new) if not y) <= 3
    assert sum(got[i] for i, (_, y) in enumerate(new) if y) >= 0.97 * sum(y for _, y in new)
    # other lengths: one passage in a text far longer than any labelled one, and nothing but the passage
    calm = " ".join(t for t, y in new if not y)
    probe = spark.createDataFrame([(1, calm), (2, calm + " zuqqar wyxxoen vrutz zuqqar"), (3, "zuqqaren wyxxo vrutz"), (4, "calm words")], DOCS)
    assert {x["doc_id"]: x["predicted"] for x in toxicity.score_documents(probe, model).collect()} == {1: 0, 2: 1, 3: 1, 4: 0}


def test_scores_equal_a_brute_force_scorer(spark):
    model = toxicity.Model({"vile": 3.0, "rotten*": 2.0, "nice": -1.5}, rate=1.1, constant=0.02, weights=[-3.0, 2.0, 1.0])
    r = random.Random(7)
    texts = [" ".join(r.choice(["vile", "rottenly", "rotten", "nice", "a", "bc", "d"]) for _ in range(r.randint(0, 14))) for _ in range(60)]

    def best(scores):
        """All maximal segments: the best one (shortest, then leftmost, of equals), then left and right of it."""
        found = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
        if found[0] <= 0:
            return []
        a, n = -found[2], -found[1]
        return best(scores[:a]) + [found[0]] + best(scores[a + n :])

    def score(text):
        worth = {"vile": 3.0, "rottenly": 2.0, "nice": -1.5}  # "rotten" itself is no longer than its beginning
        words = text.split()
        normal = [1.1 * s - math.log(0.02 * max(1, len(words))) for s in best([worth.get(w, toxicity.GAP) for w in words])]
        others = sorted(normal)[:-1]
        z = -3 + 2 * max([*normal, -10.0]) / 10 + math.log1p(sum(x for x in others if x > -math.log(toxicity.SIGNIFICANT)))
        return 1 / (1 + math.exp(-z))

    model.scores["rottenly"] = 2.0  # its own score, as the beginning of eight letters isn't asked for
    got = {x["doc_id"]: x["score"] for x in toxicity.score_documents(spark.createDataFrame(list(enumerate(texts)), DOCS), model).collect()}
    assert all(got[i] == pytest.approx(score(t)) for i, t in enumerate(texts))


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    none = toxicity.learn(spark.createDataFrame([], DOCS), labels)
    assert toxicity.score_documents(spark.createDataFrame([], DOCS), none).count() == 0
    docs = spark.createDataFrame([(1, "x " * 300_000), (1, "a b"), (2, None), (2, ""), (None, "c"), (4, "日本語 ʼn Ⅷ é")], DOCS)
    model = toxicity.learn(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == 6 and all(0 <= x["score"] <= 1 for x in got)
    assert toxicity.keep_clean(docs.withColumn("score", docs.doc_id).withColumn("n", docs.doc_id), model).columns == ["doc_id", "text", "score", "n"]


def test_beginnings_need_several_words_that_agree(spark):
    words = [(w, lean) for w, lean in (("pathetic", 1), ("vileness", 1), ("vilely", 1), ("vileous", 1), ("vileish", 1), ("vilest", 0), ("calmly", 0), ("calmer", 1), ("calmness", 0), ("calming", 0), ("calmed", 1), ("calms", 0), ("one", 1))]
    found = {r["token"] for r in toxicity.agreeing(spark.createDataFrame(words, "token string, lean int")).collect()}
    assert found == {"vile*"}


SENTENCES = {
    "The paths through the valley are worth a visit.": 0,
    "Pathologists examined the pathogens along three pathways.": 0,
    "The committee thanked all members for worthy contributions.": 0,
    "We trained the model on worthwhile data and followed the pathways of the signal.": 0,
    "He called them pathetic and worthless trash.": 1,
    "A quiet walk by the river in the morning.": 0,
}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_plain_english_is_not_toxic(spark, sf):
    """With the standard tables' model: sentences of words that begin like toxic ones; the best segment counts."""
    where = f"/root/testdata/{sf}"
    if not os.path.isdir(where):
        pytest.skip("the standard tables aren't here")
    labels = spark.read.parquet(f"{where}/labels.parquet").where(~toxicity.held_out())
    model = toxicity.learn(spark.read.parquet(f"{where}/documents.parquet"), labels)
    assert model.weights[1] > 0
    texts = spark.createDataFrame(list(enumerate(SENTENCES)), DOCS)
    got = {x["doc_id"]: x["predicted"] for x in toxicity.score_documents(texts, model).collect()}
    assert [got[i] for i in range(len(SENTENCES))] == list(SENTENCES.values())
