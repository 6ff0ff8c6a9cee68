"""Very long words: equal to tiktoken, in bounded time."""

import array
import random
import time

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from codeloom.llm import bpe  # noqa: E402


def long_words(n):
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    yield "a" * n
    yield "aab" * (n // 3) + "aaaa"
    yield "".join(r.choice(letters + letters.upper()) for _ in range(n))
    yield "".join(r.choice(letters) for _ in range(n))
    yield "the" * (n // 3)
    yield "".join(r.choice("日本語中国人大学生東京") for _ in range(n // 3))
    yield "=" * n
    yield " " * n
    yield "".join(r.choice("ab") for _ in range(n))


@pytest.fixture(scope="module")
def both():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={}), bpe.coder(path, public_tokenizers.PATTERN)


def test_words_of_some_length_equal_tiktoken(both):
    own, coder = both
    for n in (63, 64, 65, 66, 200, 3000):
        for w in long_words(n):
            assert coder.cache.documents([w])[0] == array.array("I", own.encode_ordinary(w)).tobytes(), (n, w[:20])


def test_words_of_a_hundred_kilobytes_take_seconds(both):
    own, coder = both
    for w in long_words(100_000):
        began = time.process_time()
        got = coder.cache.documents([w])
        assert time.process_time() - began < 60, w[:20]
        assert coder.decode(got) == [w.encode()]
        if len(set(w)) > 3:  # tiktoken itself is slow on repeats
            assert got[0] == array.array("I", own.encode_ordinary(w)).tobytes()
