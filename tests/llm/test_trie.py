"""The trie against one built by plain dictionaries: sharing, ties, nulls, long and many conversations."""

import random
import zlib
from hashlib import sha256

import pytest

from codeloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, digest string, id string, depth long"


def plain(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    base = lambda c: int(c / 5) * 5  # towards zero, as SQL's remainder has it
    built = {c: own.get(base(c), [])[: zlib.crc32(str(c).encode()) % 9] + v[zlib.crc32(str(c).encode()) % 9 :] for c, v in own.items()}
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    leaves, saved, children = {}, {}, {}
    for p, members in nodes.items():
        leaf = not any(len(built[c]) > len(p) for c in members)
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + leaf
            saved[p[:d]] = saved.get(p[:d], 0) + (len(members) - 1) * (len(p[-1][1].encode()) if p else 0)
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, members in nodes.items():
        ends = sorted(c for c in members if len(built[c]) == len(p))
        yield min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children.get(p, 0), leaves[p], saved[p], sha256(",".join(map(str, ends)).encode()).hexdigest()


def made(n, seed, words=3, most=12):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]) if t else None, f"é{r.randrange(words)}", "x", "y", 1) for c in range(n) if r.random() < 0.9 for t in range(r.randrange(most))]


CASES = {
    "random": made(120, 1),
    "alike": [(c, t, "user", "same" * t, "x", "y", 1) for c in range(60) for t in range(6)],
    "ties and nulls": [(c, None if t % 2 else 3, None if t % 3 else "r", None if t == 4 else "t", None, None, None) for c in (0, 1, 2, 3, 14, 27, None, -3) for t in range(7)] + [(5, 1, "u", "A" * 100_000, "x", "y", 1)] * 3,
    "one long": [(c, t, "user", f"t{t % 7}", "x", "y", 1) for c, n in ((5, 90), (6, 90), (7, 2)) for t in range(n)],
    "turnless": [(c, 1, "u", "a", "x", "y", 1) for c in range(1, 5)],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
def test_plain(spark, case, monkeypatch):
    for name, value in (("PART", 8), ("FAN", 2), ("RUN", 4), ("CHUNK", 5)):
        monkeypatch.setattr(trie, name, value)
    found = trie.trie(spark.createDataFrame(CASES[case], SCHEMA).repartition(3))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain(CASES[case])))
