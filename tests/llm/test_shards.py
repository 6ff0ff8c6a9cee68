"""Shards: every document once, groups whole, the least greatest size by brute force over all cuts."""

import random
import zlib
from itertools import accumulate

import pytest

from codeloom.llm import shards

SCHEMA = "doc_id long, text string, digest string, shard int, place long"


def least_capacity(sizes, n):
    """By dynamic programming: the least greatest sum of n contiguous runs."""
    sums = [0, *accumulate(sizes)]
    best = sums[:]
    for _ in range(n - 1):
        best = [min(max(best[j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(len(sums))]
    return best[-1]


def checked(rows, found, n):
    """Contracts hold; gives the sizes of the shards."""
    key = lambda d, s, c: (d is not None, d or 0, s, c)
    of = lambda t: len((t or "").encode()) + 1
    assert sorted((key(r["doc_id"], r["size"], r["text_crc32"]) for r in found)) == sorted(key(r[0], of(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    loads, slots, texts = [0] * n, [[] for _ in range(n)], {}
    for r in found:
        assert 0 <= r["shard"] < n
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        texts.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert all(len(s) == 1 for s in texts.values())
    return loads


def groups_of(rows):
    groups = {}
    for d, t, *_ in rows:
        g = groups.setdefault(t or "", [(d is not None, d or 0), 0])
        g[0] = min(g[0], (d is not None, d or 0))
        g[1] += len((t or "").encode()) + 1
    return [size for _, size in sorted(groups.values())]


R = random.Random(3)
CASES = {
    "plain": [(i, "é" * R.randrange(40) + str(i), None, None, 1) for i in range(300)],
    "copies": [(i, str(i % 40) * (i % 40), "x", 1, 1) for i in range(400)],
    "hot": [(i, "hot" * 9 if i % 3 else f"text {i}", "x", 1, 1) for i in range(300)],
    "long": [(i, "x" * (100_000 if i == 7 else 300 + i), "x", 1, 1) for i in range(100)],
    "nulls and ties": [(None, None, None, None, None), (None, "", None, None, None), (4, "a", None, None, None), (4, "b", None, None, None), (4, "b", None, None, None)],
    "few": [(1, "a", "x", 1, 1), (2, None, "x", 1, 1)],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
def test_least_greatest(spark, case):
    rows, n = CASES[case], 6
    loads = checked(rows, shards.balanced(spark.createDataFrame(rows, SCHEMA).repartition(3), n, points=5).collect(), n)
    sizes = groups_of(rows)
    large = shards.large_groups(sorted(sizes, reverse=True), sum(sizes), n)
    rest = sorted(sizes, reverse=True)[large:]
    own = sorted(sizes, reverse=True)[:large]
    left = iter(own)
    kept = list(sizes)
    for x in left:
        kept.remove(x)
    assert sorted(rest) == sorted(kept)
    assert sorted(loads[:large]) == sorted(own)
    assert max(loads[large:], default=0) == least_capacity(kept, n - large)


def test_search_reads_little():
    """Exact cuts from a table of a million totals, of which few are ever read."""

    class Table:
        def __init__(self, sums):
            self.sums, self.read = sums, 0

    sums = [0, *accumulate(R.randrange(1, 5000) for _ in range(1_000_000))]
    table = Table(sums)

    class Known(shards.Totals):
        def read(self, gaps):
            known = dict(zip(self.places, self.totals))
            for i in gaps:
                a, b = self.places[i], self.places[i + 1]
                known |= {p: sums[p] for p in range(a + 1, b) if (p - a) % -(-(b - a) // self.points) == 0}
            table.read += len(known) - len(self.places)
            self.places = sorted(known)
            self.totals = [known[p] for p in self.places]

    cuts = Known(None, len(sums) - 1, sums[-1], 64).cuts(16, 5000)
    most = max(b - a for a, b in zip([0, *cuts], cuts))
    assert set(cuts) <= set(sums) and cuts[-1] == sums[-1] and table.read < 100_000

    def fits(capacity):
        import bisect

        x = 0
        for _ in range(16):
            x = sums[bisect.bisect_right(sums, x + capacity) - 1]
        return x == sums[-1]

    assert fits(most) and not fits(most - 1)
