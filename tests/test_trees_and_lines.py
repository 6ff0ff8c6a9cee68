"""Work units against the recursive version, sections and passages against plain ones."""

import random
import re

import pytest

from codeloom.operators import knowledge, passages, search, worklist
from codeloom.sources.sections import sections


def plain_units(paths):
    ignored = set(worklist.IGNORED_DIRECTORIES)
    tree = {}
    for p in set(paths):
        *folders, name = p.split("/")
        if any(f in ignored or f.startswith(".") for f in folders):
            continue
        at = tree
        for f in folders:
            at = at.setdefault(f, {})
        at[name] = None
    below = lambda t: sorted(k for k, v in t.items() if v is not None)

    def count(t, depth=0):
        return 0 if depth > 8 else sum(1 if v is None else count(v, depth + 1) for v in t.values())

    def follow(name, t, depth):
        subs = below(t)
        if depth > 6:
            return [name]
        if not subs:
            return []
        if len(subs) == 1:
            return follow(f"{name}/{subs[0]}", t[subs[0]], depth + 1)
        if count(t) <= 150:
            return [name]
        return [u for s in subs for u in (follow(f"{name}/{s}", t[s], depth + 1) or [f"{name}/{s}"])]

    return sorted(u for s in below(tree) for u in (follow(s, tree[s], 0) or [s]))


@pytest.mark.parametrize("seed", range(3))
def test_units(spark, seed):
    r = random.Random(seed)
    paths = ["top.ts", "a/.git/x", "b/vendor/x/y.ts", "one/two/three/four.ts"]
    for i in range(2500):
        depth = r.choice([1, 1, 2, 3, 3, 4, 9, 12])
        paths.append("/".join(r.choice("xy") if d and r.random() < 0.8 else r.choice("pqrs") for d in range(depth)) + f"/f{i}")
    got = worklist.work_units(spark.createDataFrame([(p,) for p in paths + paths[:9] + [None]], "path string"), None)
    units = sorted(x["unit"] for x in got.collect())
    assert units == plain_units(paths)
    files = worklist.unit_files(spark.createDataFrame([(p,) for p in paths], "path string"), got, 40).collect()
    by = {}
    for x in files:
        by.setdefault(x["unit"], []).append(x["path"])
    hidden = re.compile(r"(^|/)(\.[^/]*|vendor)/")
    for u in units:
        want = sorted(p for p in set(paths) if p.startswith(u + "/") and p.count("/") - u.count("/") - 1 <= 8 and not hidden.search(p))[:40]
        assert sorted(by.get(u, [])) == want
    assert [x["place"] for x in worklist.work_units(spark.createDataFrame([(p,) for p in paths], "path string"), 3).orderBy("place").collect()] == [1, 2, 3]
    assert worklist.work_units(spark.createDataFrame([], "path string")).count() == 0


def test_sections(spark):
    text = "before\n## One \n text\n- a\n* b\n•c\n\n-\n## Two\n## Three\nx\n### not\n ## One\nlast"
    rows = [(1, text), (2, "## A\\n- x\\n- y\\nz"), (3, None), (4, ""), (5, "no section"), (6, "## E\n")]
    got = {(x["doc_id"], x["section"]): (x["body"], x["said"], x["bullets"]) for x in sections(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {(1, "Three"): ("x\n### not", "x ### not", []), (1, "One"): ("last", "last", []), (2, "A"): ("- x\n- y\nz", "z", ["x", "y"]), (6, "E"): ("", "", [])}
    one = sections(spark.createDataFrame([(1, "## S\n text\n- a\n* b\n•c\n\n-\n- d\n- e")], "doc_id int, text string")).first()
    assert (one["said"], one["bullets"]) == ("text", ["a", "b", "c", "d"])


def plain_places(content, passage):
    norm = lambda x: re.sub(r"\s+", " ", x.strip())
    lines, asked = [norm(x) for x in content.split("\n")], [norm(x) for x in passage.split("\n")]
    while asked and not asked[0]:
        asked.pop(0)
    while asked and not asked[-1]:
        asked.pop()
    return [i for i in range(len(lines) - len(asked) + 1) if lines[i : i + len(asked)] == asked] if asked else []


def test_tolerant_matches(spark):
    r = random.Random(5)
    line = lambda: r.choice(["a", " a", "b  c", "b c ", "", "\td", "d"])
    files = [(i, "\n".join(line() for _ in range(r.randrange(12)))) for i in range(25)] + [(99, None), (None, "a")]
    searches = [(i, "\n".join(line() for _ in range(r.randrange(1, 5)))) for i in range(40)] + [(98, None), (97, "\n \n")]
    got = {(x["search"], x["file"]): (x["at"], x["start"], x["length"], x["n"]) for x in passages.tolerant_matches(spark.createDataFrame(files, "file int, content string"), spark.createDataFrame(searches, "search int, passage string")).collect()}
    want = {}
    for f, content in files:
        for s, passage in searches:
            if None not in (f, content, passage) and (at := plain_places(content, passage)):
                lines, k = content.split("\n"), len([x for x in passage.strip().split("\n")])
                want[s, f] = (at[0], sum(len(x) + 1 for x in lines[: at[0]]), len("\n".join(lines[at[0] : at[0] + k])), len(at))
    assert got == want and any(v[3] > 1 for v in got.values())


def test_nearest_lines(spark):
    files = spark.createDataFrame([("f", "zero\none alpha beta\nalpha beta gamma\nnone\n" + "\n".join(f"l{i}" for i in range(20))), ("g", None)], "file string, content string")
    searches = spark.createDataFrame([(1, "f", "x\nalpha  beta delta!"), (2, "f", "something else here"), (3, "f", "short"), (4, "f", None), (5, "g", "alpha beta"), (6, "f", "------")], "search int, file string, passage string")
    got = passages.nearest_lines(files, searches).collect()
    assert [(x["search"], x["at"], round(x["likeness"], 4)) for x in got] == [(1, 1, 0.6667)]
    assert got[0]["shown"].split("\n") == ["1: zero", "2: one alpha beta", "3: alpha beta gamma", "4: none"] + [f"{i + 5}: l{i}" for i in range(10)]


def test_vector_sets_in_blocks(spark):
    import numpy as np

    r = np.random.default_rng(2)
    v = np.round(r.normal(size=(300, 4)), 3)
    v[7] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, [1.0, 2.0, 3.0, 4.0]), (300, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 300, 20)] + [(None, [1.0] * 4), (999, None)], "query_id long, query array<double>")
    got = {}
    for x in search.vector_top_set(frame, asked, 5, block=4, buffer=64).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = (x["id"], x["similarity"])
    w = v.astype(np.float32).astype(np.float64)
    for q in range(0, 300, 20):
        with np.errstate(invalid="ignore"):
            sims = np.round((w @ v[q]) / (np.linalg.norm(w, axis=1) * np.linalg.norm(v[q])), 6)
        order = sorted((-s if s == s else np.inf, i) for i, s in enumerate(sims))[:5]
        assert [got[q][k + 1][0] for k in range(5)] == [i for _, i in order]
    assert set(got) == set(range(0, 300, 20))
    assert search.vector_top_set(frame, asked.limit(0)).count() == 0


def test_memory_ends_where_the_head_changes(spark):
    rows = [("p", 1, "a"), ("p", 2, "b"), ("p", 3, "a"), ("p", 4, "a"), ("q", 1, None), ("q", 2, None), ("r", 1, "x"), ("r", 2, None)]
    frame = spark.createDataFrame(rows, "k string, n int, head string")
    assert sorted((x["k"], x["n"]) for x in knowledge.tail(frame, "k", "n", 6, "head").collect()) == [("p", 3), ("p", 4), ("q", 1), ("q", 2), ("r", 2)]
    assert sorted(x["n"] for x in knowledge.tail(frame, "k", "n", 1).collect()) == [2, 2, 4]
