"""Edge cases: extreme ids, empty tables, repeated rows, long payloads, and the shared folder."""

import hashlib
import types
import zlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from codeloom.llm import bpe, common, exact, matroska, records, simhash, warc  # noqa: E402

DOCS = "doc_id long, text string, extra string, row long"
LEAST = -(1 << 63)


def test_exact_dedup_at_the_least_id(spark):
    docs = spark.createDataFrame([(LEAST, "a b", "x", 1), (5, "ab", "y", 2), (LEAST, "ab ", "z", 3)], DOCS)
    got = exact.exact_groups(docs).collect()
    assert {r["keep_id"] for r in got} == {LEAST} and sum(r["kept"] for r in got) == 1
    assert exact.deduplicate(docs).count() == 1


def test_matroska_fields_of_op8(spark):
    texts = [(1, None), (1, None), (None, "é" * 40), (3, "x" * 70_000)]
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in texts], DOCS)
    got = matroska.media_features(matroska.with_media(docs)).collect()
    assert len(got) == 4
    by_id = {r["doc_id"]: r for r in got}
    for doc_id, text in texts:
        raw = (text or "").encode()
        payload = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        r, media = by_id[doc_id], matroska.mux(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert matroska.media_features(matroska.with_media(docs.limit(0))).count() == 0


def test_demux_takes_track_fields_in_any_order_and_refuses_negative_sizes():
    media = matroska.mux(bytes(200_000))
    number, duration = matroska.uint(matroska.TRACK_NUMBER, 1), matroska.uint(matroska.DEFAULT_DURATION, matroska.FRAME * 10**9 // matroska.RATE)
    entry = matroska.element(matroska.TRACK_ENTRY, duration + number)
    plain = matroska.element(matroska.TRACK_ENTRY, number + duration)
    payload = bytes(matroska.FRAME) * 2
    tail = matroska.element(matroska.CLUSTER, matroska.uint(matroska.TIMESTAMP, 0) + matroska.block(1, 0, [payload[: matroska.FRAME], payload[matroska.FRAME :]]))
    times = [[p[1] for p in matroska.demux(matroska._HEAD + matroska.element(matroska.SEGMENT, matroska.element(matroska.TRACKS, e) + tail))["packets"]] for e in (entry, plain)]
    assert times[0] == times[1] and times[0][1] > times[0][0]
    assert all(c[1] == 1 for c in matroska.demux(media)["cues"])
    bad = matroska.size_vint(1) + b"\0\0" + bytes([matroska.EBML_LACING << 1]) + bytes([2]) + matroska.size_vint(3) + matroska.signed_vint(-9) + b"abcdefgh" * 3
    with pytest.raises(ValueError):
        matroska.frame_ranges(bad, 0, len(bad))


def test_empty_tables_and_long_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    empty = spark.createDataFrame([], DOCS)
    assert bpe.round_trip(empty, path, public_tokenizers.PATTERN).count() == 0
    long = spark.createDataFrame([(1, "word " * 400_000, "x", 1), (1, "word " * 400_000, "x", 1), (2, "w" * 1_000_000, "x", 1)], DOCS)
    got = {r["doc_id"]: r for r in bpe.round_trip(long, path, public_tokenizers.PATTERN).collect()}
    assert got[2]["decoded_sha256"] == hashlib.sha256(b"w" * 1_000_000).hexdigest()
    assert sorted(r["component_id"] for r in simhash.near_groups(long).collect())[:2] == [1, 1]
    pages = long.selectExpr("doc_id as key", "extra as uri", "text as payload")
    headers = warc.write_archives(pages, common.scratch(spark, "w"))
    read = warc.read_archives(warc.deduplicate(headers, common.scratch(spark, "d"))).collect()
    assert sorted((r["key"], r["record_type"], r["payload_bytes"]) for r in read) == [(1, "response", 2_000_000), (1, "revisit", 2_000_000), (2, "response", 1_000_000)]


def test_record_files_name_their_attempt(spark):
    docs = spark.createDataFrame([(i, "some text", "x", 1) for i in range(20)], DOCS)
    manifest = records.write_records(docs, public_tokenizers.path("byte_bpe_50k.json"), common.scratch(spark, "r"))
    assert all(len(r["path"].rsplit("/", 1)[-1].split("-")) == 3 for r in manifest.collect())


def test_no_silent_local_folder_on_a_cluster():
    unset = types.SimpleNamespace(get=lambda *_: None)
    far = types.SimpleNamespace(sparkContext=types.SimpleNamespace(master="spark://far:7077", getConf=lambda: unset), conf=unset)
    with pytest.raises(ValueError):
        common.shared_dir(far)


def test_a_column_named_like_the_row_number_stays(spark):
    from codeloom.llm import simhash

    rows = [(1, "a b c d e f", 7, 8, 1), (2, "a b  c d e f", 9, 10, 2), (3, "x y z u v w", None, 11, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row long, __row0 long, kept long")
    for keep in (exact.deduplicate, simhash.deduplicate, simhash.drop_similar):
        found = keep(docs)
        assert found.columns == docs.columns
        assert {tuple(r) for r in found.collect()} < set(rows) and found.count() == 2


def test_components_against_union_find(spark):
    import random

    from codeloom.llm import components

    for seed in range(3):
        r = random.Random(seed)
        edges = [(r.randrange(60), r.randrange(60)) for _ in range(r.choice([10, 40, 80]))] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (5, 9), (5, 9)]
        root = {x: x for e in edges for x in e}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {(x["node"], x["root"]) for x in got} == {(x, find(x)) for x in root if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
