"""Every stage of the pipeline on a small corpus with planted cases, held against brute force over the stage's own input."""

import array
import random
import re

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from codeloom.llm.common import staged  # noqa: E402

from test_suffix import brute  # noqa: E402

VILE = ["zuqqar", "wyxxo", "vrutz"]


def corpus():
    r = random.Random(21)
    words = ["".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(4000)]

    def prose(n):
        return [r.choice(words) for _ in range(n)]

    rows, toxic = [], set()
    passage = " ".join(prose(60))
    for i in range(240):
        t = prose(r.randint(30, 150))
        if i % 8 == 0:
            t[5:5] = [r.choice(VILE) for _ in range(5)]
            toxic.add(i)
        if i % 20 == 3:
            t.insert(10, passage)
        rows.append((i, " ".join(t)))
    clean = [x for x in rows if x[0] not in toxic]
    exact = [(1000 + k, clean[k][1].replace(" ", "  ") + "\n") for k in range(12)]  # longer, so that they stay
    near = []
    for k in range(30, 42):
        t = clean[k][1].split()
        t[len(t) // 2] = "changed"
        near.append((2000 + k, " ".join(t)))
    rows += exact + near + [(3000, ""), (3001, None), (3002, " \t")]
    return rows, toxic


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents before and after each stage, as rows."""
    rows, toxic = corpus()
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(a, b, "en", "s", len(b or "")) for a, b in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(folder + "/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(240) if i % 2 == 0 or i % 3 == 0], "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    docs, found = spark.read.parquet(folder + "/documents.parquet"), []
    found.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), name.replace(" ", "-"))
        found.append(docs.collect())
    assert sorted(map(repr, corpus_pipeline.run(spark, folder).select("doc_id", "length").collect())) == sorted(repr(x) for x in docs.select("doc_id", "length").collect())
    return found, toxic


def test_columns_stay(steps):
    found, _ = steps
    assert all(set(r.asDict()) == {"doc_id", "text", "lang", "source", "n_chars"} for rows in found[:-1] for r in rows)


def test_toxic_documents_go_and_clean_ones_stay(steps):
    (before, after, *_), toxic = steps
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == toxic


def test_exact_copies(steps):
    (_, before, after, *_), _ = steps
    best = {}
    for r in before:
        key = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        rank = (-len(r["text"] or ""), r["doc_id"])
        best[key] = min(best.get(key, rank), rank)
    assert {r["doc_id"] for r in after} == {x[1] for x in best.values()}


def test_near_copies(steps):
    (_, _, before, after, *_), _ = steps
    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] > label[b] and (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                    label[a], changed = label[b], True
    assert {r["doc_id"] for r in after} == set(label.values())
    assert len(before) - len(after) >= 8  # of the twelve, those so long that a changed word leaves a similarity of 0.8


def test_repeated_passages(steps):
    (*_, before, after, _), _ = steps
    want = {x[0]: x[5] for x in brute([(r["doc_id"], r["text"]) for r in before])}
    assert {r["doc_id"]: r["text"] for r in after} == {i: b.decode("utf-8", "ignore") for i, b in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after) and any(len(b.decode()) < len(r["text"]) for r in before for b in [want[r["doc_id"]]])


def test_pieces_hold_every_id(steps):
    from tokenizers import Tokenizer

    (*_, before, pieces), _ = steps
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        got[p["doc_id"]] = got.get(p["doc_id"], b"") + bytes(p["ids"])
    assert got == {r["doc_id"]: array.array("I", [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1]).tobytes() for r in before}
    windows = {}
    for p in pieces:
        windows[p["sequence_id"]] = windows.get(p["sequence_id"], 0) + p["length"]
    assert max(windows.values()) <= 2048 and sum(windows.values()) >= 0.9 * 2048 * (len(windows) - 1)


def test_a_stage_deletes_only_what_its_input_does_not_read(spark):
    from codeloom.llm import common, exact

    docs = spark.createDataFrame([(1, "a b"), (2, "ab")], "doc_id long, text string")
    first = common.staged(docs, "written-by-the-caller")
    with common.stage(first):
        lazy = exact.deduplicate(first)
    with common.stage(lazy):  # not written: it still reads what the first stage left
        again = exact.deduplicate(lazy)
    assert again.count() == 1
    with common.stage(first):
        exact.deduplicate(first)
    past = list(common._STAGE["past"])
    assert past
    with common.stage(first):
        pass
    assert all(not spark._jvm.java.io.File(p.removeprefix("file://")).exists() for p in past)
