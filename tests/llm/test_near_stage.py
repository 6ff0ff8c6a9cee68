"""The pipeline's near-duplicate stage against brute force over five-word shingle sets."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

SIZES = [8, 9, 12, 15, 20, 30, 60, 100, 200, 400, 900]


def corpus(seed: int, groups: int) -> list[tuple[int, str]]:
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(groups):
        base = [r.choice(words) for _ in range(r.choice(SIZES))]
        texts.append(base)
        copy = base[:]
        for _ in range(max(1, round(len(base) * r.choice([0.005, 0.01, 0.02, 0.03, 0.05])))):
            copy[r.choice([0, -1, r.randrange(len(copy))])] = r.choice(words)
        texts.append(copy)
    r.shuffle(texts)
    return [(i, " ".join(x)) for i, x in enumerate(texts)]


def shingles(text: str) -> set:
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similar_pairs(rows):
    sets = [shingles(x) for _, x in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 5 * common >= 4 * (len(a) + len(sets[j]) - common):
                yield i, j


def test_stage_drops_similar_and_nothing_else(spark):
    rows = corpus(1, 700)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = list(similar_pairs(rows))
    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    want = {i for i in range(len(rows)) if find(i) == i}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert len(pairs) > 200 and want <= got  # what isn't similar stays
    recall = (len(rows) - len(got)) / (len(rows) - len(want))
    print(f"{len(pairs)} similar pairs, recall {recall:.4f}")
    assert recall >= 0.97


def test_stage_takes_large_groups_nulls_and_no_rows(spark):
    r = random.Random(2)
    base = [f"w{r.randrange(3000)}" for _ in range(300)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(r.choices(range(300), k=600))]
    rows += [(900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (None, "three"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()), key=repr)
    assert got == sorted([0, 900, 902, None], key=repr)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_unlike_sets_are_ruled_out_unread():
    import numpy as np
    from codeloom.llm import simhash

    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 90_000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, n, replace=False)) for n in [200] * 30 + [40_000] * 3]
    sets += [np.unique(np.concatenate([x[len(x) // 20 :], rng.choice(pool, len(x) // 20)])) for x in sets[::4]]
    entries = np.zeros(len(sets), simhash._ENTRY)  # fingerprints are all alike here
    for i, x in enumerate(sets):
        entries[i]["n"], entries[i]["row"], entries[i]["marks"] = len(x), i, simhash.marks_of(x)
    similar = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if simhash.alike(len(a), len(b), len(np.intersect1d(a, b)), 0.8)}
    read = []
    load = lambda e: (read.append(int(e["row"])), sets[int(e["row"])])[1]
    links = simhash.similar_links(entries, entries, True, 18, 0.8, load)
    assert len(similar) == 9 and {(max(x), min(x)) for x in links} == similar
    assert len([i for i in read if len(sets[i]) < 1000]) == 2 * 8  # those of the similar pairs alone
