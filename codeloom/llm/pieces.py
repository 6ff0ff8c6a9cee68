"""Encoding long texts through a bounded cache of space-separated pieces.

A byte-level BPE pre-tokenizer with the usual pattern (an optional single space
before a run of letters, digits or other marks) always starts a match at a space
that a mark follows, so a text may be cut in front of every such space and its
pieces encoded apart.  Texts repeat their words; each worker encodes a piece once
and looks it up later.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

_CUT = re.compile(r" (?=\S)")
_NO_CUT = re.compile(r" (?:\s|\Z)")


def split_pieces(text: str) -> list[str]:
    """``' '.join(result) == text``; every piece but the first owns the space before it."""
    return _CUT.split(text) if _NO_CUT.search(text) else text.split(" ")


class PieceCache:
    """Maps pieces to the bytes of their ids.

    ``encode(pieces, n)`` gives a list of bytes for a list of strings, the first n of
    which are a space and a mark or more.  The cache starts afresh beyond ``most``
    pieces; pieces of over ``longest`` characters are encoded but not kept.
    """

    def __init__(self, encode: Callable[[list[str], int], list[bytes]], most: int = 500_000, longest: int = 64):
        self.encode, self.most, self.longest = encode, most, longest
        self.known: dict[str, bytes] = {}

    def documents(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, as bytes."""
        known = self.known
        if len(known) > self.most:
            known.clear()
        get = known.get
        rows, firsts = [], []
        missing: dict[str, bytes] = {}
        for t in texts:
            p = split_pieces(t)
            firsts.append(p[0])
            p[0] = ""  # never known
            ids = list(map(get, p))
            gaps = [i for i, x in enumerate(ids) if x is None]
            words = [p[i] for i in gaps]
            missing.update(dict.fromkeys(words[1:], b""))
            rows.append((ids, gaps, words))
        new = list(missing)
        got = self.encode([" " + w for w in new] + firsts, len(new))
        missing = dict(zip(new, got))
        out = []
        for (ids, gaps, words), head in zip(rows, got[len(new) :]):
            for i, w in zip(gaps, words):
                ids[i] = missing[w] if i else head
            out.append(b"".join(ids))
        known.update((w, x) for w, x in missing.items() if len(w) <= self.longest)
        return out


_LETTERS, _MARKS = r"[A-Za-zÀ-ÖØ-öø-ſ]+", r"[!-&(-/:-@\[-`{-~]+"  # marks but for the apostrophe, which may join letters
_PLAIN = re.compile(rf" {_LETTERS}(?:{_MARKS})?(?:\n{_LETTERS}(?:{_MARKS})?)*")
_PART = re.compile(rf" ?{_LETTERS}|{_MARKS}|\n")


class HFCoder:
    """Ids by the tokenizers library as little-endian unsigned 32-bit integers.

    Strings of special tokens in a text are ordinary text.  A new piece of plain words
    and marks goes word by word to the tokenizer's model, as its pre-tokenizer would cut
    it, and its words are kept too; any other piece goes through the whole tokenizer.
    """

    def __init__(self, path: str, most_parts: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        written = self.tokenizer.pre_tokenizer.pre_tokenize_str
        # the letter that the pre-tokenizer writes for a byte
        self.letters = {b: x for c in map(chr, [*range(0x80), *range(0xC0, 0x180)]) for b, x in zip(c.encode(), written(c)[0][0])}
        self.parts: dict[str, bytes] = {}
        self.most_parts = most_parts
        self.cache = PieceCache(self.encode)

    def word(self, word: str) -> bytes:
        """The ids of one whole match of the pre-tokenizer's pattern, in characters of one or two bytes."""
        written = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(written)]).tobytes()

    def encode(self, pieces: list[str], n: int) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        known, parts, whole = self.cache.known, self.parts, _PLAIN.fullmatch
        fresh: dict[str, bytes] = {}
        if len(parts) > self.most_parts:
            parts.clear()
        rest = list(range(n, len(pieces)))
        for i, piece in enumerate(pieces[:n]):
            if not whole(piece):
                rest.append(i)
                continue
            ids = []
            for part in _PART.findall(piece):
                if part[0] == " ":
                    stem = part[1:]
                    x = known.get(stem) or fresh.get(stem)
                    if x is None:
                        x = fresh[stem] = self.word(part)
                else:
                    x = parts.get(part)
                    if x is None:
                        x = parts[part] = self.word(part)
                ids.append(x)
            out[i] = ids[0] if len(ids) == 1 else b"".join(ids)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
        known.update((w, x) for w, x in fresh.items() if len(w) <= self.cache.longest)
        return out


_CODERS: dict[str, HFCoder] = {}


def hf_cache(path: str) -> PieceCache:
    """This worker's cache for a vocabulary file."""
    if path not in _CODERS:
        _CODERS[path] = HFCoder(path)
    return _CODERS[path].cache
