"""Vector best-fit packing of documents into sequences.

A bin has three residual capacities: tokens, documents and attention cost (the
sum of squared lengths). Pieces are taken longest first and put into the bin
whose residual vector suits the piece best, by weighted dot product or by the
norm of what would remain, among the bins where every constraint holds.

Pieces of one length are interchangeable, so the choice is made on the
histogram of lengths alone: the driver holds at most ``capacity`` counts and
groups of equal bins, however many documents there are. Bins that received the
same lengths in the same order form one group, an interval of bin numbers; a
placement is a run (length, first rank, count, first bin, offset). Each piece
finds its run by its rank among the pieces of its length, where ranks come from
per-task counters plus the counts of earlier tasks, so no length, however
frequent, is ever gathered or sorted in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, kept, map_slices
from .tokens import TokenBytes, vocabulary

CAPACITY = 2048
#: Half of what each worker keeps of token ids.
MEMO_BYTES = 100_000_000
#: End-of-document id.
END = b"\0\0\0\0"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: only a longer
    one is cut, into full pieces after a first one that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def plan(counts: dict[int, int], capacity: int, max_docs: int, max_cost: int, weights: tuple[float, float, float] = (1.0, 0.05, 0.1), rule: str = "norm") -> tuple[np.ndarray, int]:
    """Runs (length, first rank, count, first bin, offset) and the number of bins.

    ``rule``: "dot" takes the bin with the largest weighted dot product of piece
    and residual, "norm" the one with the smallest weighted norm of the residual
    that remains. Ties go to the lowest bin number.

    The number of runs does not grow with the number of pieces: a length splits
    one group at most and opens two at most, so there are at most 3 * ``capacity``
    groups at the end, and each has taken at most ``max_docs`` runs."""
    caps, w = np.array([capacity, max_docs, max_cost], float), np.array(weights, float)
    state = np.empty((0, 3))  # residual capacities of each group of equal bins
    first, many, used = (np.empty(0, np.int64) for _ in range(3))
    runs, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = np.array([length, 1, length * length], float)
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens fits no bin")
        while left:
            ok = np.flatnonzero((state >= need).all(1))
            if len(ok):
                part = state[ok] / caps
                score = -(part * (need / caps) * w).sum(1) if rule == "dot" else (w * (part - need / caps) ** 2).sum(1)
                g = ok[np.lexsort((first[ok], score))[0]]
                n = min(left, int(many[g]))
                at, off, rest = int(first[g]), int(used[g]), state[g] - need
                if n == many[g]:
                    keep = np.arange(len(first)) != g
                    state, first, many, used = state[keep], first[keep], many[keep], used[keep]
                else:
                    first[g] += n
                    many[g] -= n
            else:
                n, at, off, rest = left, bins, 0, caps - need
                if length * 2 <= capacity:  # as many copies as one bin takes make one group; the others wait for it
                    fit = int(min(capacity // length, max_docs, max_cost // (length * length) if length else left))
                    n = max(1, -(-left // fit))
                bins += n
            runs.append((length, rank, n, at, off))
            rank, left = rank + n, left - n
            if rest[0] >= 1 and rest[1] >= 1:
                state = np.vstack([state, rest])
                first, many, used = np.append(first, at), np.append(many, n), np.append(used, off + length)
    return np.array(runs, np.int64).reshape(-1, 5), bins


def _tokenised(path: str, capacity: int, memo_bytes: int):
    def make():
        from pyspark import TaskContext

        many = kept(("token ids", path, memo_bytes), lambda: TokenBytes(path, memo_bytes)).many
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)

        def run(doc_ids: list, texts: list[str | None]) -> dict:
            data = [x + END for x in many([t or "" for t in texts])]
            pieces = [cuts(len(x) // 4, capacity) for x in data]
            flat = [p for own in pieces for p in own]
            ranks = []
            for _, n in flat:
                ranks.append(seen[n])
                seen[n] += 1
            whole = zlib.crc32
            return {
                "doc_id": [d for d, own in zip(doc_ids, pieces, strict=True) for _ in own],
                "piece": [k for own in pieces for k in range(len(own))],
                "start": [s for s, _ in flat],
                "length": [n for _, n in flat],
                "ids_crc32": [whole(x) if len(own) == 1 else whole(memoryview(x)[4 * s : 4 * (s + n)]) for x, own in zip(data, pieces, strict=True) for s, n in own],
                "part": [part] * len(flat),
                "rank": ranks,
            }

        return run

    return make


def pack(spark: SparkSession, docs: DataFrame, vocabulary_path: str | None = None, capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm", memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A null or empty text is one piece, the end id alone. Rows that repeat a doc_id
    or have none are packed row by row. Further columns are ignored. An empty
    table gives no rows. Every sequence holds at most ``capacity`` tokens,
    ``max_docs`` pieces and ``max_cost`` attention cost. By default these two bind no
    sequence that its tokens don't bind (a piece has a token at least, and squares of
    parts add up to no more than the square of their sum): a tighter one would
    need more sequences. ``memo_bytes``: half of what each worker keeps of token ids."""
    path, ws = vocabulary_path or vocabulary(), Workspace(spark)
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())]
    pieces = ws.save(map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], _tokenised(path, capacity, memo_bytes), pa.schema(kinds), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long", keep=True))
    tallies = ws.save(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    counts = {r.length: r.n for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(counts, capacity, max_docs or capacity, max_cost or capacity * capacity, rule=rule)
    before = tallies.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("length", "part", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    narrow = [c.astype(np.min_scalar_type(int(c.max(initial=0)))) for c in runs[order][:, [0, 1, 3, 4]].T]
    shared = spark.sparkContext.broadcast(narrow)  # at most 3 * capacity * max_docs runs, see ``plan``

    def make():
        lengths_at, ranks_at, first_bin, offsets = (c.astype(np.int64) for c in shared.value)
        keys = lengths_at * (1 << 44) + ranks_at

        def run(lengths: list[int], ranks: list[int], *rest: list) -> dict:
            n, r = np.array(lengths, np.int64), np.array(ranks, np.int64)
            at = np.searchsorted(keys, n * (1 << 44) + r, "right") - 1
            doc_id, piece, start, crc = rest
            return {"doc_id": doc_id, "piece": piece, "start": start, "length": pa.array(n), "ids_crc32": crc, "sequence_id": pa.array(first_bin[at] + r - ranks_at[at]), "offset": pa.array(offsets[at])}

        return run

    out = kinds[:5] + [("sequence_id", pa.int64()), ("offset", pa.int64())]
    return map_slices(ranked, ["length", "rank", "doc_id", "piece", "start", "ids_crc32"], make, pa.schema(out), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
