"""Token counts: pieces are counted once per distinct pre-token and joined to
the pre-token frequencies of each document; no ids of a text are ever built.

Pass 1 counts pre-tokens over all documents (summed in each task before the
shuffle, some ``TOGETHER`` distinct ones at a time) and counts the pieces of each
distinct one. The ``hot`` most frequent pre-tokens, at most ``HOT`` of at most
``HOT_BYTES`` bytes each, are the only ones that are broadcast: they would be the
skewed keys of the join. Pass 2 sums the hot ones in place and joins all others by
shuffle.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, map_slices
from .tokens import Pieces, PreTokens, Split, parts_of, vocabulary

#: The broadcast dictionary holds so many pre-tokens at most, of so many bytes each at most.
HOT, HOT_BYTES = 80_000, 48
#: Distinct chunks that a task counts before it hands on their pre-tokens.
TOGETHER = 100_000


class Frequencies:
    """Sums the pre-tokens of the texts of a task."""

    def __init__(self, path: str) -> None:
        self.cut = PreTokens(path)
        self.split = Split(self.cut.special_pattern)
        self.chunks: Counter[str] = Counter()

    def __call__(self, texts: list[str | None]) -> dict:
        for t in texts:
            if t:
                self.chunks.update(self.split(t))
        return self.end() if len(self.chunks) >= TOGETHER else {"piece": [], "n": []}

    def end(self) -> dict:
        total: dict[str, int] = {}
        get = total.get
        for c, n in self.chunks.items():
            for x in self.cut.of(c):
                total[x] = get(x, 0) + n
        self.chunks.clear()
        return {"piece": list(total), "n": list(total.values())}


def _pieces(path: str):
    def make():
        special, ids = PreTokens(path).special, Pieces(path).ids

        def run(pieces: list[str], ns: list[int]) -> dict:
            return {"piece": pieces, "n": ns, "tokens": [1 if p in special else len(ids(p)) for p in pieces]}

        return run

    return make


class Lookup(dict):
    """Tokens of a chunk's hot pre-tokens, by the chunk's key; ``rest`` has the other
    pre-tokens of each chunk with any. When it holds too many, they become the older
    half, and what the older half held goes."""

    LIMIT = 250_000

    def __init__(self, cut: PreTokens, hot: dict[str, int]) -> None:
        self.cut, self.hot, self.rest = cut, hot, {}
        self.before: tuple[dict, dict] = {}, {}
        self.whole = frozenset(" " + s for s in cut.special)

    def __missing__(self, key: str) -> int:
        n = self.before[0].get(key)
        if n is not None:
            rest = self.before[1].get(key)
        elif not key.isalpha() and key not in self.whole and (both := parts_of(key)):
            n = self[both[0]] + self[both[1]]
            rest = [x for c in both if c in self.rest for x in self.rest[c]]
        else:
            pieces = self.cut.of(key)
            found = [self.hot.get(x, 0) for x in pieces]
            n, rest = sum(found), [x for x, c in zip(pieces, found, strict=True) if not c]
        if rest:
            self.rest[key] = rest
        self[key] = n
        return n

    def tidy(self) -> None:
        if len(self) > self.LIMIT:
            self.before = self.copy(), self.rest
            self.rest = {}
            self.clear()


def count_tokens(spark: SparkSession, docs: DataFrame, vocabulary_path: str | None = None, limit: int = 512, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    A null text counts as empty: 0 bytes, 0 tokens. Rows that repeat a doc_id, or
    have none, are counted row by row. Further columns are ignored. An empty table
    gives no rows."""
    path = vocabulary_path or vocabulary()
    ws = Workspace(spark)
    docs = docs.select("doc_id", "text")
    totals = map_slices(docs, ["text"], lambda: Frequencies(path), pa.schema([("piece", pa.string()), ("n", pa.int64())]), "piece string, n long")
    distinct = totals.groupBy("piece").agg(F.sum("n").alias("n"))
    known = ws.save(map_slices(distinct, ["piece", "n"], _pieces(path), pa.schema([("piece", pa.string()), ("n", pa.int64()), ("tokens", pa.int64())]), "piece string, n long, tokens long"))
    # The most frequent ones by a threshold on their number: a top-k would send k rows of each partition to the driver.
    short = known.filter(F.octet_length("piece") <= HOT_BYTES)
    level = F.floor(F.log2("n") * 16)
    levels, taken, least = short.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("c")).collect(), 0, None  # some hundred rows
    for r in sorted(levels, key=lambda r: -r.level):
        taken += r.c
        if taken > hot:
            break
        least = r.level
    rows = short.filter(level >= least).collect() if least is not None else []  # at most ``hot``
    shared = spark.sparkContext.broadcast({r.piece: r.tokens for r in rows})

    def make():
        cut = PreTokens(path)
        memo, split = Lookup(cut, shared.value), Split(cut.special_pattern)

        def run(ids: list, texts: list[str | None]) -> dict:
            sizes, hot, pieces, counts, ends = [], [], [], [], [0]
            for t in texts:
                t = t or ""
                chunks = split(t)
                sizes.append(len(t.encode("utf-8", "surrogatepass")))
                hot.append(sum(map(memo.__getitem__, chunks)))
                rest = Counter(x for c in filter(memo.rest.__contains__, chunks) for x in memo.rest[c])
                pieces += rest
                counts += rest.values()
                ends.append(len(pieces))
                memo.tidy()
            rows = pa.StructArray.from_arrays([pa.array(pieces, pa.string()), pa.array(counts, pa.int64())], ["piece", "n"])
            return {"doc_id": ids, "n_bytes": sizes, "hot": hot, "rest": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)}

        return run

    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("hot", pa.int64()), ("rest", pa.list_(pa.struct([("piece", pa.string()), ("n", pa.int64())])))])
    found = map_slices(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id", "text"], make, kind, "doc_id long, n_bytes long, hot long, rest array<struct<piece:string,n:long>>")
    found = ws.save(found.withColumn("row", F.monotonically_increasing_id()))
    rare = found.select("row", F.explode("rest").alias("r")).select("row", "r.piece", "r.n")
    summed = rare.join(known.select("piece", "tokens"), "piece").select("row", (F.col("n") * F.col("tokens")).alias("t"))
    parts = found.select("row", F.col("hot").alias("t"), "doc_id", "n_bytes").unionByName(summed, allowMissingColumns=True)
    out = parts.groupBy("row").agg(F.sum("t").alias("n_tokens"), F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
