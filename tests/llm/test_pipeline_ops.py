"""Small cases of every operator against brute force, round trips and fixed answers."""

import hashlib
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from codeloom.llm import bpe, components, exact, htmltree, matroska, packing, records, simhash, toxicity, warc  # noqa: E402
from codeloom.llm.common import scratch  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long"


def docs_of(spark, rows):
    return spark.createDataFrame([(a, b, "en", "s", len(b or ""), i) for i, (a, b) in enumerate(rows)], DOCS)


ROWS = [(1, "hello world again"), (2, None), (3, ""), (4, "hello  world\nagain "), (None, "hello world again"), (4, "other text"), (4, "other text"), (9, "é日本 🎉 " * 900)]


def test_exact_groups(spark):
    got = {}
    for r in exact.exact_groups(docs_of(spark, ROWS)).collect():
        got.setdefault(r["text_sha256"], []).append(r)
    assert sorted(len(v) for v in got.values()) == [1, 2, 2, 3]
    hello = got[hashlib.sha256(b"helloworldagain").hexdigest()]
    assert {r["keep_id"] for r in hello} == {4} and sum(r["kept"] for r in hello) == 1 and {r["group_size"] for r in hello} == {3}
    kept = exact.deduplicate(docs_of(spark, ROWS))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"] and kept.count() == 4
    assert exact.exact_groups(docs_of(spark, [])).count() == 0


def test_simhash_links_all_within_radius(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = list({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(5)} | {0, 1, 7, 15})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    found = {x["node"]: x["root"] for x in components.components(links).collect()}
    label = {x: x for x in signed}
    for _ in range(len(fps)):
        before = dict(label)
        for i, a in enumerate(fps):
            for b, c in zip(signed, fps):
                if (a ^ c).bit_count() <= 3:
                    label[signed[i]] = min(label[signed[i]], label[b])
        if label == before:
            break
    assert {x: found.get(x, x) for x in signed} == label


def test_simhash_documents(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(5, long), (3, long.upper()), (None, None), (8, " \t"), (9, "one two"), (2, long.replace("w7 ", "w7  "))]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_groups(docs_of(spark, rows)).collect()), key=repr)
    assert got == sorted([(5, 2), (3, 2), (2, 2), (None, 8), (8, 8), (9, 9)], key=repr)
    assert simhash.deduplicate(docs_of(spark, rows)).count() == 3
    words = long.split()
    hashes = [simhash.xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(298)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 298)
    assert int(simhash.majority([simhash.shingle_hashes(long, 3)])[0]) == want
    assert simhash.near_groups(docs_of(spark, [])).count() == 0


def test_packing_places_every_id_once(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["a", "bc", "déf"]) for _ in range(r.choice([0, 3, 50, 900, 5000])))) for i in range(60)] + [(3, None), (None, "x")]
    pieces = packing.pack(docs_of(spark, rows).repartition(3), public_tokenizers.path("byte_bpe_50k.json"), 1).collect()
    by_window = {}
    for p in pieces:
        by_window.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"] > 0
    for spans in by_window.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(p["length"] for p in pieces) == sum(n for n in {(p["doc_id"], p["doc_tokens"]): p["doc_tokens"] for p in pieces if p["doc_id"] != 3}.values()) + sum(p["length"] for p in pieces if p["doc_id"] == 3)
    assert packing.pack(docs_of(spark, []), public_tokenizers.path("byte_bpe_50k.json"), 1).count() == 0


def test_nnls_reaches_a_known_solution():
    a = np.array([[1.0, 0, 2], [0, 1, 1]])
    x = packing.nnls(a, np.array([4.0, 5.0]))
    assert (x >= 0).all() and np.abs(a @ x - [4, 5]).max() < 1e-6


def test_records_round_trip(spark):
    folder = scratch(spark, "records")
    manifest = records.write_records(docs_of(spark, ROWS), public_tokenizers.path("byte_bpe_50k.json"), folder, file_bytes=500)
    read = records.read_records(records.with_bases(manifest)).collect()
    assert len(read) == len(ROWS)
    got = sorted((r["base"] + r["in_file"], r["n_tokens"]) for r in read)
    assert all(a + n == b for (a, n), (b, _) in zip(got, got[1:])) and got[0][0] == 0
    path = manifest.first()["path"]
    assert sorted(map(repr, records.read_file(path, seed=1))) == sorted(map(repr, records.read_file(path)))
    data = records.frame(b"abc")
    with pytest.raises(ValueError):
        records.unframe(data[:12] + b"abd" + data[15:])


def test_warc_round_trip(spark):
    pages = [(3, "http://a", "<p>x</p>"), (1, "http://b\nz", "<p>x</p>"), (2, None, None), (7, "c", ""), (None, "d", "<p>x</p>"), (1, "e", "<p>x</p>")]
    headers = warc.write_archives(spark.createDataFrame(pages, "key long, uri string, payload string"), scratch(spark, "w"))
    got = warc.read_archives(warc.deduplicate(headers, scratch(spark, "d"))).collect()
    assert sorted(((r["key"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got), key=repr) == sorted([(3, "revisit", 1, 8), (1, "response", None, 8), (1, "revisit", 1, 8), (None, "revisit", 1, 8), (2, "response", None, 0), (7, "revisit", 2, 0)], key=repr)
    assert warc.read_archives(warc.deduplicate(warc.write_archives(spark.createDataFrame([], "key long, uri string, payload string"), scratch(spark, "w")), scratch(spark, "d"))).count() == 0


@pytest.mark.parametrize("lacing", [matroska.XIPH, matroska.EBML_LACING, matroska.FIXED])
def test_lacing(lacing):
    frames = [b"a" * 300, b"b" * 300, b"c" * 300] if lacing == matroska.FIXED else [b"a" * 600, b"b" * 3, b"c" * 255, b"d"]
    data = matroska.size_vint(1) + b"\0\5" + bytes([lacing << 1]) + matroska.lace(frames, lacing)
    track, relative, ranges = matroska.frame_ranges(data, 0, len(data))
    assert (track, relative) == (1, 5) and [data[a:b] for a, b in ranges] == frames


def test_matroska_round_trip(spark):
    got = {r["doc_id"]: r for r in matroska.media_features(matroska.with_media(docs_of(spark, [(1, None), (2, "x" * 100_000), (3, "é")]))).collect()}
    assert got[1]["payload_sha256"] == hashlib.sha256(bytes(64)).hexdigest() and got[1]["n_bytes"] == 0
    assert got[2]["payload_sha256"] == hashlib.sha256(b"x" * 100_000 + bytes(-100_000 % 64)).hexdigest()
    assert got[3]["payload_bytes"] == 64
    table = matroska.packet_table(matroska.with_media(docs_of(spark, [(2, "x" * 100_000)]))).collect()
    assert sum(r["length"] for r in table) == 100_032 and len(table) == 98
    found = matroska.demux(matroska.mux(b"x" * 100_032))
    assert [p for *_, p in found["cues"]] == found["clusters"]


def test_bpe_documents(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = bpe.decode(bpe.encode(docs_of(spark, ROWS), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    want = sorted((len(own.encode_ordinary(t or "")), (t or "").encode()) for _, t in ROWS)
    assert sorted((r["n_tokens"], bytes(r["bytes"])) for r in got) == want


def test_segments_are_all_maximal():
    r = random.Random(1)

    def brute(scores):
        if not scores:
            return []
        best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
        if best[0] <= 0:
            return []
        a = -best[2]
        b = a - best[1]
        return brute(scores[:a]) + [best[0]] + brute(scores[b:])

    for _ in range(200):
        n = r.randint(1, 14)
        hits = {i: r.choice([3, 5, 7, -4]) + r.random() for i in range(n) if r.random() < 0.5}
        scores = [hits.get(i, -1.3) for i in range(n)]
        got = [s for *_, s in toxicity.segments(sorted(hits.items()), -1.3)]
        assert np.allclose(got, brute(scores))


def test_toxicity_learns_and_scores(spark):
    r = random.Random(2)
    calm = [" ".join(r.choice(["tree", "house", "river", "and", "of"]) for _ in range(60)) for _ in range(120)]
    rows = [(i, t + (" vile rotten vile" if i % 4 == 0 else "")) for i, t in enumerate(calm)]
    docs = docs_of(spark, [*rows, (900, None), (901, ""), (None, "vile rotten vile " + calm[0])])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {x["doc_id"]: x for x in toxicity.score_documents(docs, model).collect()}
    assert all(got[i]["predicted"] == (i % 4 == 0) for i, _ in rows) and got[None]["predicted"] == 1 and got[900]["predicted"] == 0
    assert '"' not in got[0]["passages"] and got[0]["passages"] != "[]"
    assert toxicity.keep_clean(docs, model).count() == 92
    empty = toxicity.learn(docs, labels.limit(0))
    assert toxicity.score_documents(docs, empty).count() == 123


def test_html_text(spark):
    model = htmltree.train(htmltree.labelled_pages())
    good = total = 0
    for page in htmltree.labelled_pages(150, seed=99):
        nodes, blocks = htmltree.parse(page)
        want, p = htmltree.settle_labels(nodes), model.marginals(nodes)
        good += sum((p[i] >= 0.5) == want[i] for i, _ in blocks)
        total += len(blocks)
    assert good / total > 0.98
    page = "<html><body><nav><ul><li><a href=x>A</a></li></ul></nav><article><h1>Ti &amp; tle.</h1><p><b>One two\n three. <br><p>Four, five.</p></article><div class='comments'><p>Me too!</p></div><script>p</script><footer>&copy; z</footer>"
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in htmltree.main_text(pages, model).collect()}
    assert got[1]["text"] == "Ti & tle.\nOne two three.\nFour, five." and got[2]["text"] == "" and got[None]["n_chars"] == 0
