"""Benchmark decontamination with a BM25 index of test items and block-max WAND.

Every passage of every training text is a query against an inverted index of the
benchmark's items. A posting's impact is the term's share of its item's own BM25
score, so a passage that holds the whole item scores 1 and the threshold is the
same for all items. Items lie in blocks; each term knows its largest impact in
each block. As in WAND, frequent terms whose impacts can't reach the threshold
together never start a search: only blocks met by an essential term, and whose
bound reaches the threshold, are scored in full. Retrieved pairs are then
verified: enough of the item's five-word shingles lie in the text, and enough of
those of its question and of its answer.

The index of one shard has at most about ``SHARD_BYTES`` of item text and goes to
the tasks by value; a larger benchmark is searched shard by shard. How many items
hold a term, the number of items and their mean length are those of the whole
benchmark, so results don't depend on the shards.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, keep_rows, slices, small_batches, with_release

WORDS = 5
#: Share of an item's score to retrieve; of all its shingles, and of those of question and answer each, to verify.
RETRIEVE, VERIFY, PART = 0.6, 0.75, 0.5
SHARD_BYTES, BLOCK = 8 << 20, 8
_K1, _B = 1.2, 0.75
_EDGE = re.compile(r"^\W+|\W+$")


def normal(word: str) -> str:
    """Lower case without signs at either end; a word of signs stays."""
    return _EDGE.sub("", word).lower() or word


def split_item(text: str) -> int:
    """Words of the question: up to the first question mark, else half of the words."""
    words = text.split()
    for i, w in enumerate(words[:-1]):
        if "?" in w:
            return i + 1
    return (len(words) + 1) // 2


@dataclass
class Statistics:
    """Of all items: their number, their mean and largest length in words, and how many hold each of a shard's terms."""

    items: int
    mean: float
    longest: int
    held: dict[str, int]


class Index:
    """Inverted index of one shard of items; ``whole`` has the statistics of all items, if there are more."""

    def __init__(self, items: list[tuple[int, str]], retrieve: float = RETRIEVE, whole: Statistics | None = None) -> None:
        self.retrieve = retrieve
        items = sorted((i, t) for i, t in items if t and t.split())
        self.ids = [i for i, _ in items]
        self.terms: dict[str, int] = {}
        self.words = [np.array([self.terms.setdefault(normal(w), len(self.terms)) for w in t.split()], np.int64) for _, t in items]
        self.split = [split_item(t) for _, t in items]
        n, v = len(items), len(self.terms)
        sizes = np.array([len(w) for w in self.words], float)
        df = np.zeros(v)
        for w in self.words:
            df[np.unique(w)] += 1
        held = np.array([whole.held[t] for t in self.terms], float) if whole else df
        count, mean = (whole.items, whole.mean) if whole else (n, sizes.mean() if n else 0.0)
        idf = np.log(1 + (count - held + 0.5) / (held + 0.5))
        rows, cols, imp = [], [], []
        for i, w in enumerate(self.words):
            t, tf = np.unique(w, return_counts=True)
            s = idf[t] * tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * len(w) / mean))
            rows += [t]
            cols += [np.full(len(t), i)]
            imp += [s / s.sum()]
        t, i, w = (np.concatenate(x) if x else np.empty(0) for x in (rows, cols, imp))
        t, i = t.astype(np.int64), i.astype(np.int64)
        order = np.lexsort((i, t))
        t, self.item, self.impact = t[order], i[order], w[order]
        self.start = np.searchsorted(t, np.arange(v + 1))
        # Block-max table: term, block, largest impact there.
        key, inverse = np.unique(t * (n // BLOCK + 1) + self.item // BLOCK, return_inverse=True)
        best = np.zeros(len(key))
        np.maximum.at(best, inverse, self.impact)
        self.block, self.block_max = key % (n // BLOCK + 1), best
        self.block_start = np.searchsorted(key // (n // BLOCK + 1), np.arange(v + 1))
        # Frequent terms first: those that no item reaches the threshold with, together, start no search.
        top, mass = np.zeros(v), np.zeros(n)
        np.maximum.at(top, t, self.impact)
        self.essential = np.ones(v, bool)
        for term in np.argsort(-df, kind="stable"):
            at = slice(self.start[term], self.start[term + 1])
            if (mass[self.item[at]] + self.impact[at] >= retrieve - 1e-9).any():
                break
            mass[self.item[at]] += self.impact[at]
            self.essential[term] = False
        self.longest = whole.longest if whole else int(sizes.max()) if n else 0
        self.grams = [self.gram(w) for w in self.words]

    def gram(self, ids: np.ndarray) -> np.ndarray:
        """A number for each ``WORDS`` words in a row; -1 where one is no item's word."""
        k = min(WORDS, len(ids))
        if not k:
            return np.empty(0, np.int64)
        h, bad = np.zeros(len(ids) - k + 1, np.uint64), np.zeros(len(ids) - k + 1, bool)
        for j in range(k):
            part = ids[j : len(ids) - k + 1 + j]
            h = h * np.uint64(0x9E3779B97F4A7C15) + (part + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            bad |= part < 0
        h = (h >> np.uint64(1)).astype(np.int64)
        h[bad] = -1
        return h

    def expand(self, terms: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a table that has its rows of each term together, and whose they are."""
        n = start[terms + 1] - start[terms]
        whose = np.repeat(np.arange(len(terms)), n)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[terms][whose], whose

    def search(self, ids: np.ndarray) -> dict[int, float]:
        """Best score by item over the passages of one text, where it reaches the threshold.

        Passages are windows of twice the longest item, each a half further on, so
        every place of an item lies in one passage entirely."""
        step = max(16, self.longest)
        known = np.flatnonzero(ids >= 0)
        if not len(known) or not self.essential[ids[known]].any():
            return {}
        v, blocks, n = len(self.start) - 1, len(self.ids) // BLOCK + 1, len(self.ids)
        segment, term = known // step, ids[known]
        pair = np.unique(np.concatenate((segment * v + term, (segment - 1)[segment > 0] * v + term[segment > 0])))  # a passage is a segment and the next one
        passage, term = pair // v, pair % v
        e = self.essential[term]
        at, whose = self.expand(term[e], self.block_start)
        met = np.unique(passage[e][whose] * blocks + self.block[at])  # blocks that an essential term meets
        bound_at, bound_of = self.expand(term, self.block_start)
        key = passage[bound_of] * blocks + self.block[bound_at]
        place = np.searchsorted(met, key)
        hit = place < len(met)
        hit[hit] = met[place[hit]] == key[hit]
        bound = np.bincount(place[hit], self.block_max[bound_at[hit]], len(met))
        met = met[bound >= self.retrieve - 1e-9]
        if not len(met):
            return {}
        live = np.isin(passage, met // blocks)
        at, whose = self.expand(term[live], self.start)
        passage, item = passage[live][whose], self.item[at]
        inside = np.isin(passage * blocks + item // BLOCK, met)
        key, where = np.unique(passage[inside] * n + item[inside], return_inverse=True)
        score = np.bincount(where, self.impact[at[inside]], len(key))
        out: dict[int, float] = defaultdict(float)
        for k, s in zip(key[score >= self.retrieve - 1e-9] % n, score[score >= self.retrieve - 1e-9], strict=True):
            out[int(k)] = max(out[int(k)], round(float(s), 9))
        return out

    def verify(self, ids: np.ndarray, found: dict[int, float], share: float = VERIFY, part: float = PART) -> list[tuple[int, float, float, float]]:
        """(item, score, question's share, answer's share) of the retrieved items that do overlap."""
        if not found:
            return []
        own, out = np.unique(self.gram(ids)), []
        for i, score in sorted(found.items()):
            g = self.grams[i]
            there = np.isin(g, own) if len(self.words[i]) >= WORDS else np.array([any((ids[a : a + len(self.words[i])] == self.words[i]).all() for a in np.flatnonzero(ids == self.words[i][0]) if a + len(self.words[i]) <= len(ids))])
            cut = min(max(1, self.split[i] - (WORDS - 1)), len(there))  # shingles that begin and end in the question
            rest = there[self.split[i] :] if len(there) > self.split[i] else there[-1:]
            q, a = float(there[:cut].mean()), float(rest.mean())
            if there.mean() >= share and q >= part and a >= part:
                out.append((i, score, q, a))
        return out


class Words(dict):
    """Term of each surface form, -1 for words of no item; bounded."""

    LIMIT = 200_000

    def __init__(self, terms: dict[str, int]) -> None:
        self.terms = terms

    def __missing__(self, word: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        t = self[word] = self.terms.get(normal(word), -1)
        return t


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, its number of words, term: a row for each different term of each item."""
    kind = pa.schema([("shard", pa.int64()), ("words", pa.int64()), ("term", pa.string())])
    for places, texts in slices(batches, "shard", "text"):
        rows = [(k, len(w) if i == 0 else 0, t) for k, x in zip(places, texts, strict=True) for w in (x.split(),) for i, t in enumerate(sorted({normal(y) for y in w}))]
        yield pa.RecordBatch.from_pydict(dict(zip(kind.names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in kind.names}, kind)


def indexes(spark: SparkSession, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> Iterator[Index]:
    """The index of each part of the items, of about ``shard_bytes`` of text at most; one is made at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total * 5 // (4 * shard_bytes)))
    read = lambda rows: [(r.item_id, r.text) for r in rows.select("item_id", "text").collect()]  # noqa: E731  of a checked size
    if n == 1:
        yield Index(read(items))
        return
    ws = Workspace(spark)
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("long"))
    terms = ws.save(items.select("shard", "text").mapInArrow(with_release(_terms), "shard long, words long, term string"))
    held = ws.save(terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    count, words, longest = terms.agg(F.count_if(F.col("words") > 0), F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.max("words"), F.lit(0))).first()
    for k in range(n):
        own = terms.filter(F.col("shard") == k).select("term").distinct().join(held, "term")
        yield Index(read(items.filter(F.col("shard") == k)), whole=Statistics(count, words / max(1, count), longest, {r.term: r.n for r in own.collect()}))  # no more terms than the shard has words


def _found(index: Index, ids: np.ndarray) -> list[tuple[int, float, float, float]]:
    return index.verify(ids, index.search(ids))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every text that
    holds an item.

    Null or empty texts and items hold nothing. Rows that repeat a doc_id or an
    item_id are searched row by row, and equal results given once. Rows without an
    item_id are left out; a null doc_id stays null. Further columns are ignored.
    Without items there are no rows."""
    small_batches(spark)
    docs, parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), []
    kind = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    for index in indexes(spark, benchmark, shard_bytes):

        def run(batches, index=index):
            words = Words(index.terms)
            for doc_ids, texts in slices(batches, "doc_id", "text"):
                rows = []
                for d, t in zip(doc_ids, texts, strict=True):
                    if t and index.ids:
                        rows += [(d, index.ids[i], s, q, a) for i, s, q, a in _found(index, np.array([words[w] for w in t.split()], np.int64))]
                yield pa.RecordBatch.from_pydict(dict(zip(kind.names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in kind.names}, kind)

        parts.append(docs.mapInArrow(with_release(run), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` without the texts that hold a benchmark item; all columns stay.

    Null or empty texts hold nothing and stay. Rows that repeat a doc_id, or have
    none, are decided row by row, equal ones alike. Without items all rows stay; an
    empty table gives no rows."""
    for index in indexes(spark, benchmark, shard_bytes):

        def make(index=index):
            words = Words(index.terms)
            return lambda t: not (t and index.ids and _found(index, np.array([words[w] for w in t.split()], np.int64)))

        docs = keep_rows(docs, "text", make)
    return docs
