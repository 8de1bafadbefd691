"""Order MinHash fingerprints.

Tokens are runs of at most eight code points without white space. The k-mers are
``K`` tokens in a row, numbered by occurrence, so that repeats differ. Each of
``ROWS`` hash functions selects the ``PICKS`` smallest k-mers, keeps them in text
order and hashes the tuple: signatures agree in proportion to a similarity that
falls with edit distance, not only with the set of k-mers.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, Workspace, map_slices, slices, small_batches, unique_docs, with_release
from .shingles import mix

K, PICKS, ROWS = 3, 2, 32
#: Numbers hashed at a time, so that very long texts stay within a few MB.
BLOCK = 16_384
_TOKEN = re.compile(r"\S{1,8}")


class OrderMinHash:
    def __init__(self, k: int = K, picks: int = PICKS, rows: int = ROWS, seed: int = 11) -> None:
        self.k, self.picks, self.rows, self.memo = k, picks, rows, WordHashes()
        r = np.random.default_rng(seed)
        self._xor = r.integers(0, 2**63, rows, np.uint64)[:, None]
        self._mul = r.integers(0, 2**63, rows, np.uint64)[:, None] | np.uint64(1)

    def kmers(self, text: str) -> np.ndarray:
        """Hashes of the occurrence-numbered k-mers in text order."""
        words = _TOKEN.findall(text)
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        ids = np.fromiter((self.memo[w.encode("utf-8", "surrogatepass")] for w in words), np.uint64, n)
        k = min(self.k, n)
        h = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[i : n - k + 1 + i]
        order = np.argsort(h, kind="stable")
        s = h[order]
        new = np.concatenate(([True], s[1:] != s[:-1]))
        place = np.arange(len(s))
        seen = np.empty(len(s), np.uint64)
        seen[order] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
        return mix(h + seen * np.uint64(0xD6E8FEB86659FD93))

    def __call__(self, text: str | None) -> np.ndarray:
        """``rows`` 32-bit numbers; all zero for a text without tokens."""
        h = self.kmers(text or "")
        if not len(h):
            return np.zeros(self.rows, np.uint32)
        p = min(self.picks, len(h))
        kept = np.empty((self.rows, 0), np.int64)
        for at in range(0, len(h), BLOCK):
            cand = np.concatenate((kept, np.broadcast_to(np.arange(at, min(at + BLOCK, len(h))), (self.rows, min(BLOCK, len(h) - at)))), 1)
            v = (h[cand] ^ self._xor) * self._mul
            v ^= v >> np.uint64(32)
            if v.shape[1] > p:
                pick = np.argpartition(v, p - 1, axis=1)[:, :p]
                cand = np.take_along_axis(cand, pick, 1)
            kept = cand
        kept = np.sort(kept, axis=1)  # text order
        t = np.full(self.rows, p, np.uint64)
        for i in range(p):
            t = mix(t * np.uint64(0x9E3779B97F4A7C15) + h[kept[:, i]])
        return (t >> np.uint64(32)).astype(np.uint32)


def render(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (8 hex digits for each hash function) for every row; a
    null text counts as empty. Rows that repeat a doc_id stay, as do null ids."""

    def make():
        f = OrderMinHash()
        return lambda ids, texts: {"doc_id": ids, "fingerprint": [render(f(t)) for t in texts]}

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], make, pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())]), "doc_id long, fingerprint string")


_ROW = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_ROW_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(f: OrderMinHash, own: tuple, after: tuple) -> tuple:
    """The result row of a document and the one after it: (id, length, first half, signature), (text, signature)."""
    doc_id, n, head, mark = own
    text = head + after[0][: n // 2]
    edited = f(text)
    return doc_id, n, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), render(mark), render(edited), likeness(mark, edited), likeness(mark, after[1])


def compare_edited(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text whose last half is replaced by
    the beginning of the next document's, with likenesses.

    Texts are dealt out once, by ranges of doc_id, and sorted in each range, so a
    document and the next one meet without a second shuffle. The last document of
    a range meets the first of the following range in a small join.

    Null texts count as empty. Rows without a doc_id are left out; of rows that
    repeat one, the smallest text counts. Further columns are ignored. An only
    document is its own next one. An empty table gives no rows."""
    ws = Workspace(spark)
    docs = unique_docs(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "text")
    ranged = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    edge = [("part", pa.int32()), ("edge", pa.string()), ("body", pa.string())]

    def run(batches):
        from pyspark import TaskContext

        f, part, before = OrderMinHash(), TaskContext.get().partitionId(), None
        kind = pa.schema(_ROW + edge)
        for ids, texts in slices(batches, "doc_id", "text"):
            rows = []
            for i, t in zip(ids, texts, strict=True):
                t = t or ""
                mark = f(t)
                if before is None:
                    rows.append((i, len(t), None, render(mark), None, None, None, part, "first", t))
                else:
                    rows.append((*_compare(f, before, (t, mark)), part, None, None))
                before = (i, len(t), t[: (len(t) + 1) // 2], mark)
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
        if before is not None:
            i, n, head, mark = before
            yield pa.RecordBatch.from_pylist([{"doc_id": i, "n_chars": n, "fingerprint": render(mark), "part": part, "edge": "last", "body": head}], kind)

    small_batches(spark)
    found = ws.save(ranged.mapInArrow(with_release(run), f"{_ROW_SQL}, part int, edge string, body string"))
    parts = sorted(r.part for r in found.filter("edge = 'first'").select("part").collect())  # one number for each range
    follow = spark.createDataFrame([(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)], "part int, next_part int")
    first = found.filter("edge = 'first'").select(F.col("part").alias("next_part"), F.col("body").alias("next_body"), F.col("fingerprint").alias("next_mark"))
    pairs = found.filter("edge = 'last'").join(follow, "part").join(first, "next_part").select("doc_id", "n_chars", "fingerprint", "body", "next_body", "next_mark")

    def join_ranges(batches):
        f, kind = OrderMinHash(), pa.schema(_ROW)
        parse = lambda m: np.frombuffer(bytes.fromhex(m), ">u4")
        for lists in slices(batches, "doc_id", "n_chars", "body", "fingerprint", "next_body", "next_mark"):
            rows = [_compare(f, (i, n, head, parse(m)), (text, parse(k))) for i, n, head, m, text, k in zip(*lists, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    names = [n for n, _ in _ROW]
    return found.filter("edge is null").select(*names).unionByName(pairs.mapInArrow(with_release(join_ranges), _ROW_SQL))
