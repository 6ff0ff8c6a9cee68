"""The manifest against a plain tree, with nulls, ties, several rounds and an empty table."""

import zlib
from hashlib import sha256

import pytest

from codeloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, pos long"


def h(x):
    return sha256(x.encode()).hexdigest()


def leaf(r, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def tree(nodes):
    """The root and each node's list of (siblings before, after)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for path, i in zip(paths, at):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            path.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        level = [h("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], paths


def plain(rows):
    langs, subs = {}, {}
    for r in rows:
        langs.setdefault("" if r[2] is None else "=" + r[2], []).append(r)
    for k, rs in langs.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0], leaf(r, r[1])))
        subs[k] = tree([leaf(r, r[1]) for r in rs])
    order = sorted(langs, key=str.encode)
    root, above = tree([subs[k][0] for k in order]) if order else ("", [])
    for k, up in zip(order, above):
        for r, path in zip(langs[k], subs[k][1]):
            path = path + up
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            now = leaf(r, "".join(c.lower() if c < "\x80" else c for c in r[1]) if changed else r[1])
            for a, b in path:
                now = h(a + now + b)
            yield r[0], leaf(r, r[1]), subs[k][0], root, h("".join(a + b for a, b in path)), now, now == root


def rows_of(n, langs):
    return [(i * 7 % n, f"Text {i} ÄB" if i % 11 else None, langs[i % len(langs)], "s" if i % 5 else None, i if i % 4 else None, "x", 1) for i in range(n)]


CASES = {
    "one": rows_of(1, ["en"]),
    "one language": rows_of(9, ["en"]),
    "several rounds": rows_of(1100, ["en", "en", "en", None]),
    "many languages": rows_of(300, [None, "", "é", "z", *[f"l{i}" for i in range(20)]]),
    "ties": [(1, "A", "en", "s", 1, "x", 1)] * 3 + [(None, "B", "en", None, None, "x", 1), (None, None, None, None, None, None, None), (1, "C" * 100_000, "en", "s", 1, "x", 1)],
    "block": rows_of(512, ["en"]) + rows_of(513, ["fr"]),
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
def test_plain(spark, case):
    rows = CASES[case]
    found = merkle.proofs(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain(rows)))
