"""Token ids by way of distinct pre-tokens.

A byte-level BPE never merges across pre-tokens, so the ids of a text are the
ids of its pre-tokens in order. Each worker keeps a bounded memo of pre-tokens;
the ids themselves come from the library that the vocabulary file is for.
"""

from __future__ import annotations

import json
import re
import struct
import sys
from array import array
from collections.abc import Callable, Iterable
from typing import Generic, TypeVar

MODEL = "byte_bpe_50k.json"
_NATIVE = sys.byteorder == "little" and array("I").itemsize == 4


def vocabulary(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PreTokens:
    """Cuts a text as the vocabulary file's pre-tokeniser does; special strings
    are pieces of their own, as is the library's default."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only plain byte-level vocabularies are cut here")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._find = regex.compile(public_tokenizers.PATTERN).findall

    def __call__(self, text: str) -> list[str]:
        if self.special_pattern is None or not self.special_pattern.search(text):
            return self._find(text)
        out: list[str] = []
        at = 0
        for m in self.special_pattern.finditer(text):
            out += self._find(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self._find(text[at:])

    def of(self, key: str) -> list[str]:
        """The pieces of the chunk of this key (see ``Split``)."""
        if key[0] == " " and key[1:] in self.special:
            return [key[1:]]
        if key.isascii() or max(key) <= LAST:
            if key.isalpha():
                return [" " + key]
            if key[0] == " " and key[1:].isalpha():
                return [key[1:]]
            if both := parts_of(key):
                return self.of(both[0]) + self.of(both[1])
        return self._find(chunk_of(key))


#: Unicode's white space, as the pre-tokeniser knows it, and what Python takes for it besides.
_WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_OTHER = [c for c in map(chr, (*range(0x3001), 0xFEFF)) if c.isspace() and c not in " \n"]
#: End of the Latin blocks: newer versions of Unicode class no sign up to it otherwise.
LAST = "\u024f"


V = TypeVar("V")


class Split:
    """Cuts texts into chunks: white space with the run of other signs after it, or
    the white space at a text's end.

    The pre-tokeniser looks no further than the sign after a run of white space,
    and none of its pieces holds white space after another sign, so each chunk is
    cut alone as it is in its text. Special strings are chunks of their own.

    Nearly all chunks are a word after one space. Their key is the word, which holds no
    white space; the key of any other chunk is a space and the chunk."""

    def __init__(self, special: re.Pattern | None) -> None:
        self.special, self.find = special, re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+").findall

    def __call__(self, text: str) -> list[str]:
        """The keys of a text's chunks, in order."""
        if self.special is None or not self.special.search(text):
            return self._keys(text)
        out: list[str] = []
        at = 0
        for m in self.special.finditer(text):
            out += self._keys(text[at : m.start()])
            out.append(" " + m.group())
            at = m.end()
        return out + self._keys(text[at:])

    def _keys(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or any(c in text for c in _OTHER):
            return [c[1:] if c[0] == " " and len(c) > 1 and not c[1].isspace() else " " + c for c in self.find(text)]
        out: list[str] = []
        white = " "
        for k, line in enumerate(text.split("\n")):
            if k:
                white += "\n"
            if line:
                words = line.split(" ")
                words[0] = white + words[0]
                out += words
                white = " "
        return [*out, white] if len(white) > 1 else out


def chunk_of(key: str) -> str:
    return key[1:] if key[0] == " " else " " + key


def parts_of(key: str) -> tuple[str, str] | None:
    """Two keys whose pre-tokens are together those of ``key``, if there are: signs that
    are neither letters nor numbers, from the last one of these to the end, are a
    pre-token of their own, and so is a line end before another sign."""
    if not key.isascii() and max(key) > LAST:
        return None
    if key[:2] == " \n" and len(key) > 2 and not key[2].isspace():
        return " \n", " " + key[2:]
    end = len(key)
    while end and not key[end - 1].isalnum():
        end -= 1
    return (key[:end], " " + key[end:]) if 0 < end < len(key) else None


class Chunks(dict, Generic[V]):
    """A memo over the keys of chunks. ``value`` maps a key to what is kept of it, and
    ``weigh`` tells how many bytes that takes. Values add up with ``+``; ``special`` strings have
    no parts. It is bounded by bytes, which ``tidy`` looks after: when its newer half is
    full, it becomes the older one."""

    BYTES, LONGEST, ENTRY = 40_000_000, 64, 110

    def __init__(self, value: Callable[[str], V], special: Iterable[str] = (), weigh: Callable[[V], int] = len, most: int = BYTES) -> None:
        self.value, self.weigh, self.most = value, weigh, most
        self.whole = frozenset(" " + s for s in special)
        self.before: dict[str, V] = {}
        self.size = 0

    def __missing__(self, key: str) -> V:
        v = self.before.get(key)
        if v is None:
            both = None if key.isalpha() or key in self.whole else parts_of(key)
            v = self[both[0]] + self[both[1]] if both else self.value(key)
        if len(key) <= self.LONGEST:
            self.size += self.ENTRY + 4 * len(key) + self.weigh(v)
            self[key] = v
        return v

    def tidy(self) -> None:
        if self.size >= self.most:
            self.before, self.size = self.copy(), 0
            self.clear()


def _byte_signs() -> dict[int, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary:
    printable bytes stand for themselves, the others are numbered on from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = (b for b in range(256) if b not in plain)
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(other)}


class Pieces:
    """Token ids of one pre-token, by the library's own model. Letters that newer
    versions of Unicode may class otherwise go through all of the library instead."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        model = tokenizer.model
        if hasattr(model, "_resize_cache"):  # pre-tokens that come back don't get here
            model._resize_cache(0)
        self.encode, self.tokenize, self.signs = tokenizer.encode, model.tokenize, _byte_signs()

    def ids(self, piece: str) -> list[int]:
        if max(piece) > LAST:
            return self.encode(piece, add_special_tokens=False).ids
        return self.plain(piece)

    def plain(self, piece: str) -> list[int]:
        """The same for a piece that has no sign after ``LAST``."""
        return [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.signs))]


class TokenBytes:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, memo_bytes: int = Chunks.BYTES) -> None:
        self._cut, self._pieces = PreTokens(path), Pieces(path)
        self._space = chr(self._pieces.signs[32])
        self._split = Split(self._cut.special_pattern)
        self._memo: Chunks[bytes] = Chunks(self._ids, self._cut.special, most=memo_bytes)

    def _ids(self, key: str) -> bytes:
        if key.isascii() and key.isalpha():  # one pre-token
            ids = [t.id for t in self._pieces.tokenize(self._space + key)]
        elif key[1:] in self._cut.special and key[0] == " ":
            ids = [self._cut.special[key[1:]]]
        elif max(key) > LAST:
            ids = self._pieces.encode(chunk_of(key), add_special_tokens=False).ids
        else:
            ids = [i for p in self._cut.of(key) for i in self._pieces.plain(p)]
        return array("I", ids).tobytes() if _NATIVE else struct.pack(f"<{len(ids)}I", *ids)

    def many(self, texts: list[str]) -> list[bytes]:
        get, out = self._memo.__getitem__, []
        for t in texts:
            out.append(b"".join(map(get, self._split(t))))
            self._memo.tidy()
        return out

    def of(self, text: str) -> bytes:
        return self.many([text])[0]
