"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WORDS = 5
_P = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.ones(1, bool)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Is a byte part of a word? The ``n`` lowest bytes of a number; bytes of a word that are read eight at a time.
_INSIDE = np.array([bytes((b,)) not in b" \t\n\r\x0b\x0c" for b in range(256)])
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_READ = 64


@dataclass
class Words:
    """The words of some texts, lower-cased A-Z and split at ASCII white space: hashes,
    and how many each text has. ``data`` holds the texts, each after a line end;
    ``starts`` and ``ends`` of the words are places in it, ``begins`` those of the texts."""

    ids: np.ndarray
    n: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    begins: np.ndarray

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word, in code points of its text."""
        points = points_of(self.data)
        before = np.repeat(points[self.begins], self.n)
        return points[self.starts] - before, points[self.ends] - before


def hashes_of(whole: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of parts of a string that goes on for eight bytes after the last one: all
    parts together, eight bytes at a time; only long ones one by one."""
    import xxhash

    size = ends - starts
    eight = np.ndarray(len(whole) - 7, "<u8", whole, strides=(1,))
    h = mix((eight[starts] & _LOW[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    rest, at = np.flatnonzero((size > 8) & (size <= _READ)), 8
    while len(rest):
        left = size[rest] - at
        h[rest] = mix(h[rest] * _P + (eight[starts[rest] + at] & _LOW[np.minimum(left, 8)]))
        rest, at = rest[left > 8], at + 8
    for i in np.flatnonzero(size > _READ).tolist():
        h[i] = xxhash.xxh64_intdigest(whole[starts[i] : ends[i]])
    return h


def points_of(data: np.ndarray) -> np.ndarray:
    """How many code points are before each byte of UTF-8, and in all."""
    points = np.zeros(len(data) + 1, np.int32)
    np.cumsum(((data & 0xC0) != 0x80).view(np.uint8), out=points[1:], dtype=np.int32)
    return points


def words_of(texts: list[str | None]) -> Words:
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    whole = b"\n".join((b"", *parts, b" " * 9)).lower()
    data = np.frombuffer(whole, np.uint8)
    begins = np.cumsum([1, *(len(p) + 1 for p in parts)])
    inside = _INSIDE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    return Words(hashes_of(whole, starts, ends), np.diff(np.searchsorted(starts, begins)), data, starts, ends, begins[:-1])


class Shingler:
    """Distinct shingles of ``words`` words: lower-cased A-Z, words split at
    ASCII white space. Fewer words make one shingle of them all; no word or no
    text makes the empty set."""

    TOGETHER = 1 << 18

    def __init__(self, words: int = WORDS) -> None:
        self.words = words

    def __call__(self, text: str | None) -> np.ndarray:
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The set of each text. Texts are hashed together, so short ones cost little,
        up to ``TOGETHER`` code points, so many long ones are never in memory as words."""
        out: list[np.ndarray] = []
        group: list[str | None] = []
        size = 0
        for t in texts:
            group.append(t)
            size += len(t or "")
            if size >= self.TOGETHER:
                out += self._sets(group)
                group, size = [], 0
        return out + self._sets(group)

    def _sets(self, texts: list[str | None]) -> list[np.ndarray]:
        found = words_of(texts)
        ids, n = found.ids, found.n
        padded = np.concatenate((ids, np.zeros(self.words - 1, np.uint64)))
        h = self._hash([padded[i : i + len(ids)] for i in range(self.words)])  # past the end of a text they are not read
        out, at = [], 0
        for k in n.tolist():
            if k >= self.words:
                own = np.sort(h[at : at + k - self.words + 1])
                own = own[np.concatenate((_FIRST, own[1:] != own[:-1]))]
            elif k:
                own = self._hash(list(ids[at : at + k, None]))
            else:
                own = np.empty(0, np.uint64)
            out.append(own)
            at += k
        return out

    @staticmethod
    def _hash(columns: list[np.ndarray]) -> np.ndarray:
        h = np.full(len(columns[0]), len(columns), np.uint64)
        for c in columns:
            h = h * _P + c
        return mix(h)
