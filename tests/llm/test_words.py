"""Word-by-word encoding against the whole tokenizer, and op2 and op3 ids against it."""

import array
import random
import zlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from codeloom.llm import packing, pieces, records  # noqa: E402
from codeloom.llm.common import scratch  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole_ids(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    return [array.array("I", whole.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


def test_words_and_marks_equal_whole_texts():
    r = random.Random(11)
    bits = ["a", "Zürich", "çà", "ſtraße", "Ŀż", "don't", "it's", "'ll", "re", "'", ".", ",", "!!", "***", "$$$,", "\n", "\n\n", " ", "  ", "\t", "7", "½", "ª", "×", "÷", "日本", "é́", "<|endoftext|>", "\x00", "\x7f", " "]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += [" ".join(r.choice(bits) + r.choice(["", ".", ",\nNext", "!?"]) for _ in range(30)) for _ in range(1000)]
    coder = pieces.HFCoder(PATH, most_parts=50)
    coder.cache.most = 200
    got = [x for i in range(0, len(texts), 100) for x in coder.cache.documents(texts[i : i + 100])]
    assert got == whole_ids(texts)


ROWS = [(5, "one two.\nThree four"), (2, None), (2, ""), (2, "two rows of one id"), (None, "null id"), (9, "long " * 3000), (7, "日本語 🎉 it's")]


def test_records_and_pieces_hold_the_tokenizers_ids(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    want = sorted((d is None, d or 0, x) for (d, _), x in zip(ROWS, whole_ids([t or "" for _, t in ROWS])))
    read = records.read_records(records.with_bases(records.write_records(docs, PATH, scratch(spark, "records")))).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["ids"])[:-4]) for r in read) == want
    assert all(bytes(r["ids"])[-4:] == bytes(4) and r["ids_crc32"] == zlib.crc32(r["ids"]) for r in read)
    assert records.read_records(records.with_bases(records.write_records(docs.limit(0), PATH, scratch(spark, "records")))).count() == 0

    unlike = docs.where("doc_id is null or doc_id != 2")
    found = {}
    for p in sorted(packing.pack(unlike, PATH, 1).collect(), key=lambda p: p["start"]):
        found[p["doc_id"]] = found.get(p["doc_id"], b"") + bytes(p["ids"])
    assert sorted((d is None, d or 0, x) for d, x in found.items()) == [(a, b, x + array.array("I", [1]).tobytes()) for a, b, x in want if b != 2]
