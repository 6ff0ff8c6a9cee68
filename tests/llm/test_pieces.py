"""Encoding by pieces against encoding whole texts."""

import array

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from codeloom.llm import bpe, pieces  # noqa: E402

TEXTS = ["", "a", "  b", "a\n b", "a\n \nb", "\n \tb", "a\n ", "a  ", "x   y", "it's we'll  go", "a" * 300, "日本語 テキスト 🎉🎉", "\x1c \x1d a\r\n  \r\n b <|endoftext|> ", " " * 50 + "q", "\n\nfoo bar", "one.\nTwo three\r four five  six", "﻿x \x85 y"]


def test_hf_pieces_equal_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    got = pieces.hf_cache(path).documents(TEXTS)
    assert got == [array.array("I", whole.encode(t, add_special_tokens=False).ids).tobytes() for t in TEXTS]


def test_duckdb_pieces_equal_tiktoken():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    coder = bpe.coder(path, public_tokenizers.PATTERN)
    got = coder.cache.documents(TEXTS)
    assert got == [array.array("I", own.encode_ordinary(t)).tobytes() for t in TEXTS]
    assert coder.decode(got) == [t.encode() for t in TEXTS]
    assert coder.decode([]) == []
