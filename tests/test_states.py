"""Choices, merges and packing against plain versions on small frames."""

import random

from codeloom.functions import words
from codeloom.operators import evidence, graph, planning, questions, refresh
from pyspark.sql import functions as F


def plain_top(rows, limit):
    rows = sorted(rows, key=lambda r: (-r[2], r[3]))
    chosen, waiting, seen = [], [], set()
    for r in rows:
        if r[1] in seen and len(seen) < 4 and len(chosen) < min(6, limit) and r[2] < 40:
            waiting.append(r)
            continue
        chosen.append(r)
        if r[1] is not None:
            seen.add(r[1])
    return [r[3] for r in (chosen + waiting)[:limit]]


def test_top_evidence_waits_like_the_sequential_choice(spark):
    rng = random.Random(3)
    rows = [(q, rng.choice([None, *"abcdefg"[: 1 + q % 7]]), rng.choice([5, 10, 20, 39, 40, 41, 90]) - 35 * (q % 2), i) for q in range(40) for i in range(rng.choice([0, 1, 3, 8, 30, 60]))]
    frame = spark.createDataFrame(rows, "question int, path string, score int, ord int")
    for limit in (12, 5, 1):
        got = {}
        for r in evidence.select_top(frame, limit).orderBy("question", "place").collect():
            got.setdefault(r["question"], []).append(r["ord"])
        assert got == {q: plain_top([r for r in rows if r[0] == q], limit) for q in {r[0] for r in rows}}
    assert evidence.select_top(frame.limit(0)).count() == 0


def plain_merge(facts, share=0.7):
    import re

    kept, paths = [], {}
    for f in sorted(facts, key=lambda f: (-f[4], f[0])):
        w = set(re.findall("[a-z0-9_]{4,}", (f[2] or "").lower()))
        for k, kw in kept:
            if k[1] == f[1] and w and kw and len(w & kw) >= share * min(len(w), len(kw)):
                paths[k[0]] |= set(f[3])
                break
        else:
            kept.append((f, w))
            paths[f[0]] = set(f[3])
    return {k[0]: sorted(paths[k[0]]) for k, _ in kept}


def test_near_duplicate_facts(spark):
    rng = random.Random(5)
    pool = [f"word{i}" for i in range(12)]
    facts = [(i, rng.choice("ab"), " ".join(rng.choices(pool, k=rng.choice([0, 1, 2, 4, 6, 9]))) if i % 17 else None, [f"p{i % 5}"], rng.choice([1, 2, 3, 4])) for i in range(120)]
    frame = spark.createDataFrame(facts, "id int, category string, statement string, paths array<string>, ord int")
    assert {r["id"]: r["paths"] for r in refresh.merge_near_duplicates(frame).collect()} == plain_merge(facts)
    assert refresh.merge_near_duplicates(frame.limit(0)).count() == 0


def test_context_packing(spark):
    rows = [(1, i, "functional", f"f{i}", None, 20, i, False) for i in range(8)]
    rows += [(1, 10 + i, "file", f"app/auth/{i}", f"app/auth/{i}", 100, 10 + i, False) for i in range(6)]
    rows += [(1, 20 + i, "file", f"lib/{i}", f"lib/{i}", 100, 20 + i, i < 3) for i in range(5)]
    rows += [(1, 30, "file", "again", "app/auth/0", 20, 9, False), (2, 1, "file", "big", "x/auth", 7000, 1, True), (2, 2, "file", "auth", "y", 6000, 2, True)]
    frame = spark.createDataFrame(rows, "question long, id long, type string, label string, path string, tokens long, rank int, anchor boolean")
    got = {}
    for r in evidence.pack_context(frame, ["auth"]).orderBy("question", "place").collect():
        got.setdefault(r["question"], []).append(r["id"])
    # three functional ones, one of the zone, three more functional ones, three more of the zone, two anchors outside of it
    assert got == {1: [0, 1, 2, 30, 3, 4, 5, 11, 12, 13, 20, 21], 2: [2]}


def test_expired_and_origins(spark):
    rows = [("contradicted", 8, True), ("contradicted", 7, False), ("fresh", 60, False), ("fresh", 60, True), ("fresh", 59, False), (None, 99, False)]
    got = spark.createDataFrame(rows, "s string, d int, v boolean").select(refresh.expired(F.col("s"), F.col("d"), F.col("v")).alias("x")).collect()
    assert [r["x"] for r in got] == [True, False, True, False, False, False]
    e = spark.createDataFrame([(1, None), (1, "a"), (1, "b"), (1, "c")], "question int, path string")
    c = spark.createDataFrame([("a", None), ("x", "b"), ("a", "a")], "path string, previous_path string")
    assert sorted((r["path"] or "", r["origin"]) for r in evidence.with_origin(e, c).collect()) == [("", "structural"), ("a", "overlay"), ("b", "overlay"), ("c", "baseline")]


def test_aliases_hints_and_labels(spark):
    pairs = [("пароля", "пароль", True), ("транспортировка", "порт", False), ("servers", "server", True), ("the", "the", False), ("use", "user", False), ("usernames", "user", True)]
    got = spark.createDataFrame(pairs, "a string, b string, want boolean").select("want", words.alias_matches(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)
    hints = spark.createDataFrame([("Where does UserController use Server or Foo",)], "s string").select(words.entity_hints(F.col("s")).alias("h"), words.distinctive(F.lit("ABC a1 personal_claim Foo foo FOO x_y plain")).alias("d")).first()
    assert [(h["compact"], h["parts"]) for h in hints["h"]] == [("usercontroller", ["user", "controller"]), ("server", ["server"])]
    assert hints["d"] == ["ABC", "a1", "personal_claim", "Foo"]
    paths = [("routes/api.php", "routes"), ("app/Http/Controllers/AuthController.php", "auth-controllers"), ("app/Services/Bill.php", "Bill-services"), ("config/app.php", "config-config"), ("a/b/c/d.txt", "a/b/c"), ("billing/x.txt", "Billing")]
    label = planning.group_label(F.col("p"), ["Billing", "Bill"])
    found = [r["l"] for r in spark.createDataFrame(paths, "p string, w string").select(label.alias("l")).collect()]
    assert found == ["routes", "auth-controllers", "Bill-services", "config-config", "a/b/c", "Billing"]


def test_commands_and_fast_path(spark):
    want = {"git push": ["forbidden"], "git pushy": [], "rm -rf x": ["forbidden"], "rm x": [], "php artisan migrate": ["database"], "php artisan migrate:status": [], "php artisan migrate:fresh": ["database"], "php artisan migrate --pretend": [], "npm ci": ["dependencies"], "docker compose up": ["containers"], "docker ps": []}
    got = {r["x"]: r["r"] for r in spark.createDataFrame([(x,) for x in want], "x string").select("x", questions.command_rules(F.col("x")).alias("r")).collect()}
    assert got == want
    f = spark.range(1).select(questions.prefers_fast_path(*[F.lit(x) for x in (72, 5, 3, 1, 1, False, False)]).alias("a"), questions.prefers_fast_path(*[F.lit(x) for x in (72, 6, 3, 1, 1, False, False)]).alias("b")).first()
    assert (f["a"], f["b"]) == (True, False)


def test_fan_in_within_cycles(spark):
    edges = spark.createDataFrame([("U", a, b) for a, b in [("s1", "a"), ("a", "s1"), ("a", "s2"), ("b", "a"), ("s2", "b"), ("c", "c")]], "type string, source_id string, target_id string")
    nodes = spark.createDataFrame([(x, "s" if x[0] == "s" else "n", x) for x in ("s1", "s2", "a", "b", "c")], "id string, kind string, label string")
    starts = nodes.select("id")
    for depth in (1, 2, 3, 4):
        want = {r["id"]: r["n_starts"] for r in graph.fan_in(graph.reachability(edges, starts, depth), nodes, "s").collect()}
        assert {r["id"]: r["n_starts"] for r in graph.fan_in_within(edges, starts, nodes, "s", depth).collect()} == want
