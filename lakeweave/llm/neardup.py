"""MinHash near-duplicates by bottom-k sketches of one hash function.

A document's set of 5-word shingles keeps its ``SKETCH`` smallest hashes. Two
sets with a Jaccard similarity of 0.75 share about three quarters of the smallest
hashes of their union, so they share half of a sketch but with a chance of
about 1 in 10,000 at the threshold itself, and far less above it. Values are
ordered from rare to frequent; sets that share half of their sketches share one
of the first ``len - ceil(len / 2) + 1`` values, so only these go into inverted
lists. A passage that a third of all documents hold is thus never a list, unless
little else is in those documents.

Documents with equal sets are one set from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, among, map_slices, unique_docs, without
from .shingles import Shingler
from .similarity import link, union_estimate

SKETCH, PERCENT, LEAST = 48, 75, 0.5
#: Texts with more than one in so many of all documents as copies are looked up by broadcast.
HOT = 512
#: Flips the highest bit, so that signed longs of a sketch are in the order of its unsigned hashes.
FLIP = np.uint64(1 << 63)


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets or [np.empty(0, np.uint64)]).view(np.int64)))


def _sketched():
    import xxhash

    f = Shingler()

    def run(ids: list, texts: list[str | None]) -> dict:
        sets = [f(t) for t in texts]
        return {"doc_id": ids, "n": [len(s) for s in sets], "digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "sketch": _lists([s[:SKETCH] ^ FLIP for s in sets])}

    return run


def _members():
    f = Shingler()
    return lambda ids, texts: {"id": ids, "members": _lists([f(t) for t in texts])}


def prefix_lists(sets: DataFrame) -> DataFrame:
    """v, id, n, alone: inverted lists of each sketch's rarest values, as many as
    sets that share half need; ``alone``: how many of its values no other set has."""
    posts = sets.select("id", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("v"))
    often = posts.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = posts.join(often, "v")
    by_set = Window.partitionBy("id")
    unique = F.col("k") - F.count(F.lit(1)).over(by_set)  # values of no other set come first and lead nowhere
    rank = F.row_number().over(by_set.orderBy("df", "v"))
    return shared.withColumn("unique", unique).withColumn("rank", rank).filter(F.col("rank") <= F.col("k") - F.ceil(F.col("k") * LEAST) + 1 - F.col("unique")).select("v", "id", "n", F.col("unique").alias("alone"))


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    Null or empty texts have no shingle and are linked with nothing. Rows without
    a doc_id are left out; of rows that repeat one, the smallest text counts.
    Further columns are ignored. An empty table gives no rows."""
    if percent < PERCENT:
        raise ValueError(f"sketches find links of {PERCENT} percent or more")
    ws = Workspace(spark)
    docs = unique_docs(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "text")
    kind = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.list_(pa.int64()))])
    base = ws.save(map_slices(docs, ["doc_id", "text"], _sketched, kind, "doc_id long, n long, digest binary, sketch array<long>"))
    equal = ws.save(base.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    copies = ws.save(base.select("doc_id", "digest").join(equal.filter("copies > 1"), "digest").filter("doc_id <> id").select("doc_id"))
    sets = ws.save(without(base.filter("n > 0").select("doc_id", "n", "sketch"), copies).withColumnRenamed("doc_id", "id"))
    lists = ws.save(prefix_lists(sets))

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = ids.withColumnRenamed("id", "doc_id")
        rows = among(docs, wanted).join(wanted, "doc_id").withColumnRenamed("doc_id", "id")
        return map_slices(rows, ["id", "text"], _members, pa.schema([("id", pa.int64()), ("members", pa.list_(pa.int64()))]), "id long, members array<long>")

    label = link(spark, sets, lists, fetch, percent, lambda a, b: union_estimate(a, b, SKETCH, LEAST), ws)
    # Only sets with a copy or a link can move a document.
    moved = equal.join(label, "id", "left").filter("copies > 1 or component is not null").select("digest", F.coalesce("component", "id").alias("component"), "copies")
    moved = ws.save(moved)
    # A text with very many copies would be one key of the join: such digests, fewer than HOT, are sent to all tasks.
    hot = F.col("copies") > max(1000, base.count() // HOT)
    few, rest = moved.filter(hot).select("digest", F.col("component").alias("hot")), moved.filter(~hot).select(F.col("digest").alias("key"), "component")
    own = base.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(F.broadcast(few), "digest", "left")
    alone = F.encode(F.concat(F.lit("longer than a digest: "), F.col("doc_id")), "utf-8")  # meets nothing, in no common place
    out = own.withColumn("key", F.when(F.col("hot").isNull() & F.col("digest").isNotNull(), F.col("digest")).otherwise(alone)).join(rest, "key", "left")
    out = out.withColumn("component_id", F.coalesce("hot", "component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("component_id") == F.col("doc_id")).alias("kept"))


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with
    the smallest doc_id; all columns stay. Rows without a doc_id stay; of rows that
    repeat one, the one with the smallest text stays."""
    found = Workspace(spark).save(near_duplicates(spark, docs).filter(~F.col("kept")).select("doc_id"))
    named = without(unique_docs(docs), found).select(docs.columns)
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))
