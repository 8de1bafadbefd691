"""Substring dedup: repeated paragraphs by MinHash banding, repeated passages by sentence runs.

A paragraph is a line of at least ``MIN_WORDS`` words. Its 5-word shingles give
``BANDS`` bands of ``ROWS`` minima each: two paragraphs with a Jaccard similarity
of 0.75 collide in some band with a chance of 1 - (1 - 0.75^2)^8 = 99.9 %, at 0.9
of 99.9999 %. Colliding paragraphs are compared exactly on their full shingle
sets and joined to components, without listing all pairs of a large group.

A passage may also stand inside longer lines. Sentences that more than one
document holds, in a row and of at least ``RUN_WORDS`` words together, make a
repeated passage (equal sentences have a Jaccard similarity of 1).

Passages that start or end in mid-sentence, or have no sentence end, are found by
word windows. Of each ``WINDOW`` words in a row the ``GRAM`` words with the smallest
hash are an anchor (winnowing), so equal windows have equal anchors wherever they
stand. Only windows whose anchor more than one document holds are written and
compared, and those that meet are joined to maximal runs: every run of at least
``WINDOW`` words that two documents share is found.

Documents that are equal as a whole are found first, by digest, and stand for one
in all that follows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, among, map_slices, unique_docs, without
from .shingles import Shingler, Words, hashes_of, mix, points_of, words_of
from .similarity import link

BANDS, ROWS, PERCENT, MIN_WORDS, RUN_WORDS = 8, 2, 75, 20, 30
#: Words of a window that is compared, and of its anchor.
WINDOW, GRAM = 50, 25
_LINE = re.compile(r"[^\n]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
#: White space of str.split() beyond ASCII.
_WIDE_SPACE = re.compile(r"[^\S\x00-\x7f]")
#: Kinds of bytes: 1 in a word, 2 before a sentence's stops.
_KIND = np.array([(not chr(b).isspace() or b > 127) + 2 * (chr(b) not in ".!?\n") for b in range(256)], np.uint8)
_P = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_P, -1, 1 << 64))


class MinHash:
    BLOCK = 8192

    def __init__(self, size: int = BANDS * ROWS, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        self._xor = r.integers(0, 2**63, size, np.uint64)[:, None]
        self._tag = np.arange(size, dtype=np.int64) << 32

    def __call__(self, members: np.ndarray) -> np.ndarray:
        """The smallest 32 bits of each hash function, tagged with its number."""
        return self.many([members])[0]

    def many(self, sets: list[np.ndarray]) -> np.ndarray:
        """The minima of each of some sets that are not empty, in blocks of bounded size."""
        low = np.full((len(sets), len(self._tag)), 2**64 - 1, np.uint64)
        if not sets:
            return low.astype(np.int64)
        ends = np.cumsum([len(s) for s in sets])
        starts, flat = ends - [len(s) for s in sets], np.concatenate(sets)
        for at in range(0, len(flat), self.BLOCK):  # a set may lie in several blocks
            to = min(at + self.BLOCK, len(flat))
            i, j = np.searchsorted(ends, at, "right"), np.searchsorted(starts, to)
            v = (flat[at:to] ^ self._xor) * np.uint64(0x9E3779B97F4A7C15)
            low[i:j] = np.minimum(low[i:j], np.minimum.reduceat(v, np.maximum(starts[i:j] - at, 0), axis=1).T)
        return (mix(low) >> np.uint64(32)).astype(np.int64) | self._tag


def lines(text: str, least: int = MIN_WORDS) -> list[tuple[int, int, int, int]]:
    """(number, start, end, words) of the lines that are paragraphs."""
    return [(k, s, e, n) for k, (s, e) in enumerate(m.span() for m in _LINE.finditer(text)) if e - s >= 2 * least - 1 and (n := len(text[s:e].split())) >= least]


def _list_array(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *rows])))


def _paragraphs(least: int):
    import xxhash

    sets, minima = Shingler(), MinHash()
    names = ("doc_id", "para", "start", "end", "words", "n", "digest", "again", "sketch")

    def run(ids: list, texts: list[str | None]) -> dict:
        found = [(t[x[1] : x[2]], d, *x) for d, t in zip(ids, texts, strict=True) if t for x in lines(t, least)]
        paragraphs, *columns = list(zip(*found, strict=True)) or [()] * 6
        members = sets.many(paragraphs)
        digests = [xxhash.xxh3_128_digest(m.tobytes()) for m in members]
        first: dict[tuple, int] = {}
        again = [first.setdefault(x, i) != i for i, x in enumerate(zip(columns[0], digests, strict=True))]
        return dict(zip(names, (*columns, [len(m) for m in members], digests, again, _list_array(list(minima.many(members)))), strict=True))

    return run


def _members(least: int):
    sets = Shingler()

    def run(texts: list[str | None], wanted: list[list[dict]]) -> dict:
        ids, found = [], []
        for t, rows in zip(texts, wanted, strict=True):
            own = {k: (s, e) for k, s, e, _ in lines(t or "", least)}
            ids += [r["id"] for r in rows]
            found += [t[slice(*own[r["para"]])] for r in rows]
        return {"id": ids, "members": _list_array([m.view(np.int64) for m in sets.many(found)])}

    return run


def hashed(unique: DataFrame) -> DataFrame:
    """``unique``, one row a key, as the side of a join that a task keeps by key, so that the
    many rows of the other side need not be sorted; Spark still splits those of a hot key."""
    return unique.hint("shuffle_hash")


def repeated_paragraphs(spark: SparkSession, docs: DataFrame, ws: Workspace, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end, words, first_doc_id, first_start of every paragraph that has a like one."""
    kind = pa.schema([("doc_id", pa.int64()), ("para", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("again", pa.bool_()), ("sketch", pa.list_(pa.int64()))])
    base = ws.save(map_slices(docs, ["doc_id", "text"], lambda: _paragraphs(min_words), kind, "doc_id long, para int, start long, end long, words long, n long, digest binary, again boolean, sketch array<long>"))
    # Of a document's equal paragraphs only the first one is not ``again``, so the least doc_id has one row; sums of plain numbers need no sort.
    least = lambda c: F.min_by(c, F.when(~F.col("again"), F.col("doc_id"))).alias(c)
    equal = base.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), least("para"), least("start"), F.count(F.lit(1)).alias("copies"))
    equal = ws.save(equal.withColumn("id", F.monotonically_increasing_id()))
    sets = ws.save(base.select("doc_id", "para", "n", "sketch").join(hashed(equal.select("doc_id", "para", "id")), ["doc_id", "para"]).select("id", "n", "sketch"))
    band = lambda b: F.xxhash64(F.lit(b), *[F.element_at("sketch", b * ROWS + i + 1) for i in range(ROWS)])
    lists = sets.select("id", "n", F.explode(F.array(*map(band, range(BANDS)))).alias("v"))
    often = lists.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("v")
    lists = lists.join(hashed(often), "v", "left_semi")
    shared = F.count(F.lit(1)).over(Window.partitionBy("id"))  # of a set's few bands
    lists = ws.save(lists.select("v", "id", "n", (F.lit(BANDS) - shared).alias("alone")))

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = equal.join(ids, "id").groupBy("doc_id").agg(F.collect_list(F.struct("para", "id")).alias("wanted"))  # a document's own lines
        return map_slices(among(docs, wanted).join(wanted, "doc_id"), ["text", "wanted"], lambda: _members(min_words), pa.schema([("id", pa.int64()), ("members", pa.list_(pa.int64()))]), "id long, members array<long>")

    alike = lambda a, b: F.size(F.array_intersect(a, b)) >= 6  # noqa: E731  of 16; 12 are equal at 0.75
    label = link(spark, sets, lists, fetch, PERCENT, alike, ws)
    found = equal.join(label, "id", "left").filter("copies > 1 or component is not null").withColumn("component", F.coalesce("component", "id"))
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "start")).alias("f"))
    marks = found.select("digest", "component").join(first, "component").select("digest", F.col("f.doc_id").alias("first_doc_id"), F.col("f.start").alias("first_start"))
    out = ws.save(base.select("doc_id", "start", "end", "words", "digest").join(hashed(marks), "digest").drop("digest"))
    ws.drop(base, equal, sets, lists)
    return out


def _row_hash(ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Numbers whose sum is the hash of a row of words."""
    return mix((ids ^ places.astype(np.uint64)) * np.uint64(_P))


def _sentences_one_by_one(text: str) -> tuple[np.ndarray, ...]:
    """start, end, words, hash of each sentence of a text."""
    found = []
    for m in _SENTENCE.finditer(text):
        w = words_of([" ".join(m.group().lower().split())]).ids
        found.append((m.start(), m.end(), len(w), int(_row_hash(w, np.arange(len(w))).sum(dtype=np.uint64))))
    columns = list(zip(*found, strict=True)) or [()] * 4
    return tuple(np.array(x, t) for x, t in zip(columns, (np.int64, np.int64, np.int64, np.uint64), strict=True))


def _sentences_of(texts: list[str]) -> tuple[np.ndarray, ...]:
    """start, end, words, hash of each sentence of texts that keep their length in lower
    case, and how many each text has."""
    lower = [t.lower() for t in texts]
    parts = [(t if t.isascii() else _WIDE_SPACE.sub(" ", t)).encode("utf-8", "surrogatepass") for t in lower]
    whole = b"\n".join((b"", *parts, b"\n" * 9))
    data = np.frombuffer(whole, np.uint8)
    kind = _KIND[data]
    solid, plain = (kind & 1).view(bool), (kind & 2).astype(bool)
    edges = np.flatnonzero(plain[1:] != plain[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    stops = np.flatnonzero((kind[1:] == 1) != (kind[:-1] == 1)) + 1  # of runs of stops, which belong to the sentence before
    run = np.searchsorted(stops[::2], ends)
    has = np.append(stops[::2], -1)[run] == ends
    ends = np.where(has, np.append(stops[1::2], -1)[run], ends)
    cut = np.zeros(len(data) - 1, bool)  # words begin and end with their sentences
    cut[starts - 1] = cut[ends - 1] = True
    begins = np.flatnonzero(solid[1:] & (cut | ~solid[:-1])) + 1
    finish = np.flatnonzero(solid[:-1] & (cut | ~solid[1:])) + 1
    first, last = np.searchsorted(begins, starts), np.searchsorted(begins, ends)
    words, h = last - first, np.zeros(len(starts), np.uint64)
    own = np.flatnonzero(words)
    if len(own):
        places = np.arange(len(begins)) - np.repeat(np.append(0, first[own]), np.diff(np.concatenate(([0], first[own], [len(begins)]))))
        cuts = np.stack((first[own], last[own]), axis=1).ravel()
        values = np.append(_row_hash(hashes_of(whole, begins, finish), places), np.uint64(0))
        h[own] = np.add.reduceat(values, cuts)[::2]
    edges = np.cumsum([1, *(len(p) + 1 for p in parts)])
    n = np.diff(np.searchsorted(starts, edges))
    points = points_of(data)
    shift = np.repeat(points[edges[:-1]], n)
    return points[starts] - shift, points[ends] - shift, words, h, n


def _sentences():
    names, together = ("doc_id", "seq", "start", "end", "words", "h"), 1 << 18

    def rows(ids: list, n: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
        return np.repeat(np.array(ids, np.int64), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), *columns

    def run(ids: list, texts: list[str | None]) -> dict:
        found, group, size = [rows([], np.empty(0, np.int64), *_sentences_one_by_one(""))], [], 0
        for i, t in enumerate(texts):
            if t and not t.isascii() and ("\u03a3" in t or len(t.lower()) != len(t)):  # its lower case has another length, or depends on what is near
                columns = _sentences_one_by_one(t)
                found.append(rows([ids[i]], np.array([len(columns[0])]), *columns))
            elif t:
                group.append(i)
                size += len(t)
            if group and (size >= together or i == len(texts) - 1):
                *columns, n = _sentences_of([texts[k] for k in group])
                found.append(rows([ids[k] for k in group], n, *columns))
                group, size = [], 0
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        keep = columns[4] > 0
        columns[5] = columns[5].view(np.int64)
        return {c: x[keep] for c, x in zip(names, columns, strict=True)}

    return run


def repeated_passages(spark: SparkSession, docs: DataFrame, ws: Workspace, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, start, end, words, first_doc_id of every run of sentences that other
    documents hold too, split where a passage that earlier documents hold begins or ends."""
    kind = pa.schema([("doc_id", pa.int64()), ("seq", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("h", pa.int64())])
    rows = ws.save(map_slices(docs, ["doc_id", "text"], _sentences, kind, "doc_id long, seq int, start int, end int, words int, h long"))
    # Written, so that the join has a shuffle of its own that AQE can split where one sentence is hot.
    shared = ws.save(rows.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h", "lo"))
    hits = rows.join(hashed(shared), "h")
    run = F.col("seq") - F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))  # a document's own sentences
    hits = hits.withColumn("run", run).withColumn("here", F.col("lo") == F.col("doc_id"))
    whole, holder = Window.partitionBy("doc_id", "run"), Window.partitionBy("doc_id", "run", "here").orderBy("seq")
    hits = hits.withColumn("in_run", F.sum("words").over(whole)).filter(F.col("in_run") >= run_words).withColumn("part", F.col("seq") - F.row_number().over(holder))
    parts = hits.groupBy("doc_id", "run", "here", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.min("lo").alias("lo"))
    # Earlier documents hold a part if they hold a passage of it; a shorter one stays with its neighbours.
    gone = ~F.col("here") & (F.col("words") >= run_words)
    order = lambda *by: F.row_number().over(Window.partitionBy("doc_id", "run", *by).orderBy("start"))
    parts = parts.withColumn("gone", gone).withColumn("block", order() - order("gone"))
    runs = parts.groupBy("doc_id", "run", "gone", "block").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.min("lo").alias("lo"))
    out = ws.save(runs.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("words").cast("long").alias("words"), F.when(F.col("gone"), F.col("lo")).otherwise(F.col("doc_id")).alias("first_doc_id")))
    ws.drop(rows, shared)
    return out


def _slide(f: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """``f`` over each ``n`` values in a row."""
    size = 1
    while 2 * size <= n:
        x, size = f(x[:-size], x[size:]), 2 * size
    return f(x[: len(x) - n + size], x[n - size :]) if size < n else x


class Winnower:
    """The windows of texts: words split at ASCII white space, lower-cased A-Z."""

    TOGETHER = 1 << 18

    def __init__(self) -> None:
        self.forth = self.back = np.ones(1, np.uint64)

    def __call__(self, texts: list[str | None]):
        """``Windows`` of some texts at a time."""
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= self.TOGETHER or i == len(texts) - 1:
                yield self._windows(texts[at : i + 1], at)
                at, size = i + 1, 0

    def _windows(self, texts: list[str | None], first: int) -> Windows:
        found = words_of(texts)
        ids, n = found.ids, found.n
        if len(ids) < WINDOW:
            return Windows(found, *[np.empty(0, np.int64) for _ in range(7)])
        if len(self.forth) < len(ids):
            self.forth, self.back = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(ids), p, np.uint64)))) for p in (np.uint64(_P), _BACK))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ids * self.back[: len(ids)])))
        gram = lambda k: mix((sums[k:] - sums[:-k]) * self.forth[: len(ids) - k + 1])
        anchor = _slide(np.minimum, gram(GRAM), WINDOW - GRAM + 1)
        ends = np.cumsum(n)
        own = np.repeat(np.arange(len(n)), n)[: len(anchor)]
        at = np.arange(len(anchor))
        fits = np.flatnonzero(at + WINDOW <= ends[own])
        own, anchor = own[fits], anchor[fits]
        new = np.ones(len(fits), bool)  # a run of windows with one anchor begins
        new[1:] = (own[1:] != own[:-1]) | (anchor[1:] != anchor[:-1]) | (fits[1:] != fits[:-1] + 1)
        begin = np.flatnonzero(new)
        low, high = fits[begin], fits[np.append(begin[1:], len(fits)) - 1] + WINDOW if len(begin) else begin
        whole = mix((sums[high] - sums[low]) * self.forth[low] + mix((high - low).astype(np.uint64)))
        signed = lambda x: x.view(np.int64)
        return Windows(found, own + first, fits, fits - (ends - n)[own], signed(gram(WINDOW)[fits]), signed(anchor), begin, signed(whole))


@dataclass
class Windows:
    """The words of some texts, and all windows: number of the text, first word among the
    words and in its text, hash, anchor; and the runs of windows with one anchor: the
    number of their first window, and the hash of all their words."""

    words: Words
    own: np.ndarray
    place: np.ndarray
    pos: np.ndarray
    hash: np.ndarray
    anchor: np.ndarray
    begin: np.ndarray
    whole: np.ndarray


def _anchors():
    windows = Winnower()

    def run(ids: list, texts: list[str | None]) -> dict:
        doc = np.array(ids, np.int64)
        found = [pd.DataFrame({"doc_id": doc[w.own[w.begin]], "a": w.anchor[w.begin], "whole": w.whole}).drop_duplicates() for w in windows(texts)]
        return {c: np.concatenate([f[c].to_numpy() for f in found]) if found else [] for c in ("doc_id", "a", "whole")}

    return run


def _windows():
    windows = Winnower()
    names = ("doc_id", "from", "to", "start", "end", "h", "lo")

    def run(ids: list, texts: list[str | None], anchors: list[list[int]], lows: list[list[int | None]]) -> dict:
        doc, found = np.array(ids, np.int64), []
        known = [dict(zip(a, lo, strict=True)) for a, lo in zip(anchors, lows, strict=True)]
        for w in windows(texts):
            own, of = w.own[w.begin], w.anchor[w.begin]
            last = np.append(w.begin[1:], len(w.own)) - 1
            lo = [known[i].get(a, False) for i, a in zip(own.tolist(), of.tolist(), strict=True)]  # False: not wanted
            one = np.flatnonzero([x is not None and x is not False for x in lo])  # all windows of the run are alike wherever they stand
            each = np.repeat(np.array([x is None for x in lo], bool), last - w.begin + 1).nonzero()[0]
            begin, end = np.concatenate((w.begin[one], each)), np.concatenate((last[one], each))
            none = np.arange(len(begin)) < len(one)
            start, stop = w.words.spans()
            low = np.concatenate((np.array([lo[i] for i in one.tolist()], np.int64), np.zeros(len(each), np.int64)))
            found.append((doc[w.own[begin]], w.pos[begin], w.pos[end], start[w.place[begin]], stop[w.place[end] + WINDOW - 1], w.hash[begin], low, none))
        if not found:
            return {c: [] for c in names}
        *columns, none = [np.concatenate(x) for x in zip(*found, strict=True)]
        out = dict(zip(names, columns, strict=True))
        return out | {"h": pa.array(out["h"], mask=none), "lo": pa.array(out["lo"], mask=~none)}

    return run


def repeated_windows(spark: SparkSession, docs: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, start, end, words, first_doc_id of every run of windows that other
    documents hold too, split where the first document changes. What is first
    here has no words that a part next to it shares with an earlier document."""
    kinds = lambda *names: pa.schema([(c, pa.int64()) for c in names])
    anchors = ws.save(map_slices(docs, ["doc_id", "text"], _anchors, kinds("doc_id", "a", "whole"), "doc_id long, a long, whole long"))
    shared = anchors.groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("whole").alias("x"), F.max("whole").alias("y")).filter("lo < hi")
    # Where all documents that hold an anchor hold the same words around it, one row stands for all its windows.
    shared = ws.save(shared.select("a", F.when(F.col("x") == F.col("y"), F.col("lo")).alias("lo")))
    wanted = ws.save(anchors.join(hashed(shared), "a").groupBy("doc_id").agg(F.collect_set(F.struct("a", "lo")).alias("wanted")))  # a document's own anchors
    near = among(docs, wanted).join(wanted, "doc_id").select("doc_id", "text", F.col("wanted.a").alias("anchors"), F.col("wanted.lo").alias("lows"))
    rows = ws.save(map_slices(near, ["doc_id", "text", "anchors", "lows"], _windows, kinds("doc_id", "from", "to", "start", "end", "h", "lo"), "doc_id long, from long, to long, start long, end long, h long, lo long"))
    ws.drop(anchors, shared, wanted)
    single = rows.filter("lo is null").drop("lo")
    both = ws.save(single.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h", "lo"))
    hits = single.join(hashed(both), "h").select("doc_id", "lo", "from", "to", "start", "end").unionByName(rows.filter("lo is not null").select("doc_id", "lo", "from", "to", "start", "end"))
    by = Window.partitionBy("doc_id", "lo").orderBy("from")  # a document's own windows
    apart = F.coalesce(F.col("from") > F.lag("to").over(by) + 1, F.lit(True)).cast("int")
    parts = hits.withColumn("apart", apart).withColumn("part", F.sum("apart").over(by)).groupBy("doc_id", "lo", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("from").alias("from"), (F.max("to") + WINDOW).alias("to"))
    order = Window.partitionBy("doc_id").orderBy("from")
    here = F.col("lo") == F.col("doc_id")
    left, right = (F.when(here, f(c).over(order)) for f, c in ((F.lag, "to"), (F.lead, "from")))
    cut = parts.withColumn("left", left).withColumn("right", right).withColumn("left_end", F.lag("end").over(order)).withColumn("right_start", F.lead("start").over(order))
    start = F.when(F.col("left") > F.col("from"), F.col("left_end")).otherwise(F.col("start"))
    end = F.when(F.col("right") < F.col("to"), F.col("right_start")).otherwise(F.col("end"))
    words = F.least("to", "right") - F.greatest("from", "left")
    out = ws.save(cut.select("doc_id", start.alias("start"), end.alias("end"), words.alias("words"), F.col("lo").alias("first_doc_id")).filter("words > 0"))
    ws.drop(rows, both)
    return out


def whole_copies(docs: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, first_doc_id, end, words of every document whose text others have too.
    A text with very many copies is one key of the first sum, which adds up in each
    task before the shuffle, and of a join that Spark splits where a key is hot."""
    texts = ws.save(docs.filter("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.length("text").cast("long").alias("end")))
    equal = ws.save(texts.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    words = F.regexp_count("text", F.lit(r"[^ \t\n\r\x0B\f]+")).cast("long").alias("words")  # only of texts that have copies
    first = equal.select("digest", F.col("first_doc_id").alias("doc_id"))
    known = first.join(among(docs, first).select("doc_id", words), "doc_id").withColumnRenamed("doc_id", "first_doc_id")
    out = ws.save(texts.select("doc_id", "digest", "end").join(hashed(known), "digest").select("doc_id", "first_doc_id", "end", "words"))
    ws.drop(texts, equal)
    return out


def repeated(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, kind, start, end, n_words, first_doc_id, removed: one row for each
    document, paragraph or passage that other places hold too.

    ``kind`` is "document" (a whole text of at least ``min_words`` words that another
    document has; what else its copies but the first hold has no rows), "paragraph"
    (a line of so many words that is like another line) or "passage" (a run of
    sentences of at least ``run_words`` words together, or of at least ``WINDOW``
    words, that another document holds); a place can be in several rows, and goes if
    one of them is removed. ``start`` and ``end`` are code points, end exclusive.
    ``first_doc_id`` is the document whose copy stays; ``removed`` is false for that
    copy alone. Null or empty texts have no row. Rows without a doc_id are left
    out; of rows that repeat one, the smallest text counts. Further columns are
    ignored. An empty table gives no rows."""
    ws = Workspace(spark)
    docs = unique_docs(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "text")
    copies = whole_copies(docs, ws)
    docs = without(docs, copies.filter("doc_id <> first_doc_id"))
    a = repeated_paragraphs(spark, docs, ws, min_words)
    a = a.withColumn("kind", F.lit("paragraph")).withColumn("removed", ~((F.col("doc_id") == F.col("first_doc_id")) & (F.col("start") == F.col("first_start"))))
    b = repeated_passages(spark, docs, ws, run_words).unionByName(repeated_windows(spark, docs, ws)).distinct().withColumn("kind", F.lit("passage"))
    c = copies.filter(F.col("words") >= min_words).withColumn("kind", F.lit("document")).withColumn("start", F.lit(0).cast("long"))
    b, c = (x.withColumn("removed", F.col("doc_id") != F.col("first_doc_id")) for x in (b, c))
    names = ["doc_id", "kind", "start", "end", F.col("words").alias("n_words"), "first_doc_id", "removed"]
    return a.select(*names).unionByName(b.select(*names)).unionByName(c.select(*names))


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text without the spans that ``repeated`` removes, for every document.

    A null text stays null. Rows without a doc_id are left out; of rows that repeat
    one, the one with the smallest text stays. Further columns are left out. An
    empty table gives no rows."""
    spans = repeated(spark, docs).filter("removed").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # a document's own spans
    rows = unique_docs(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "text").join(spans, "doc_id", "left")

    def make():
        def run(ids: list, texts: list[str | None], cut: list[list[dict] | None]) -> dict:
            out = []
            for t, spans in zip(texts, cut, strict=True):
                if t and spans:
                    parts, end = [], 0
                    for s in sorted(spans, key=lambda x: (x["start"], x["end"])):
                        parts.append(t[end : max(end, s["start"])])
                        end = max(end, s["end"])
                    t = "".join(parts) + t[end:]
                out.append(t)
            return {"doc_id": ids, "text": out}

        return run

    return map_slices(rows, ["doc_id", "text", "spans"], make, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), "doc_id long, text string")
