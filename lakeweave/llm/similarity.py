"""Components of sets that are alike, without ever listing all pairs of a group.

The input is one row for each distinct set (``id``, ``n`` members, ``sketch``) and
inverted lists (``v``, ``id``, ``n``, ``alone``): sets whose likeness reaches the
threshold share a list. Then:

1. Star round: in each list one set is paired with every other one, the set with
   the fewest values of its own (``alone``): the text that a group was copied from
   shares all it has, its altered copies don't. In lists of at most ``SMALL`` sets
   all pairs are made. This is linear in the lists.
2. Pairs pass a size bound, the sketch estimate, and the exact Jaccard test on
   full sets; verified links give components.
3. Cross round, for what stars can't decide: lists that still hold several
   components are cut into blocks; each pair of blocks compares wide sketches by
   matrix products and gives only pairs across components that pass the estimate.
   They are verified in the same way.

Two sets in one component need no further test, so large groups of copies stay
cheap, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, among

#: Lists up to this length give all their pairs at once; longer ones give stars, then blocks of this many sets.
SMALL, BLOCK = 6, 1024
#: Values of a wide sketch, and by how much its estimate may fall short: 3.6 standard errors.
WIDE, MARGIN = 256, 0.09
#: A value is counted pair by pair where it has at most so small a part of all pairs of two blocks.
DENSE = 1024


def sized(a: Column, b: Column, percent: int) -> Column:
    """Can sets of these sizes be alike?"""
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def union_estimate(a: Column, b: Column, k: int, least: float) -> Column:
    """Do both bottom-k sketches hold at least the share ``least`` of the ``k`` smallest
    values of their union? Sketches are the smallest values in the order of signed longs."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) >= F.ceil(F.size(union) * F.lit(least))


def stars(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b: all of a short list, and the hub with each other one of a long list."""
    stats = lists.groupBy("v").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("alone", "id", "n")).alias("hub")).filter("size > 1")
    known = lists.join(stats, "v")
    star = known.filter(F.col("id") != F.col("hub.id")).filter(sized(F.col("n"), F.col("hub.n"), percent)).select(F.least("hub.id", "id").alias("a"), F.greatest("hub.id", "id").alias("b"))
    rest = known.filter((F.col("size").between(3, SMALL)) & (F.col("id") != F.col("hub.id"))).groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda p, i: F.transform(F.slice(F.col("x"), i + 2, SMALL), lambda q: F.struct(p["id"].alias("a"), q["id"].alias("b"), p["n"].alias("na"), q["n"].alias("nb")))))
    return star.unionByName(rest.select(F.explode(pairs).alias("p")).select("p.*").filter(sized(F.col("na"), F.col("nb"), percent)).select("a", "b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, estimate: Callable[[Column, Column], Column], ws: Workspace) -> DataFrame:
    """The pairs that are alike: by their sketches, then exactly on full sets."""
    pairs = ws.save(pairs)
    known = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    s = among(sets.select(F.col("id").alias("doc_id"), "sketch"), known).withColumnRenamed("doc_id", "id")  # sketches of pairs only
    near = pairs.join(s.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
    near = ws.save(near.filter(estimate(F.col("sa"), F.col("sb"))).select("a", "b"))
    ids = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
    full = ws.save(fetch(ids))
    both = near.join(full.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a").join(full.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
    shared = F.size(F.array_intersect("ma", "mb"))
    ok = F.lit(100) * shared >= F.lit(percent) * (F.size("ma") + F.size("mb") - shared)
    out = ws.save(both.filter(ok).select("a", "b"))
    ws.drop(pairs, near, full)
    return out


def roots(step: DataFrame, ws: Workspace) -> tuple[DataFrame, int]:
    """``step`` (x, to) followed to its end, in rounds that each double the way, and their number."""
    rounds, moved = 0, True
    while moved:
        after = step.select(F.col("x").alias("to"), F.col("to").alias("then"))
        new = ws.save(step.join(after, "to", "left").select("x", F.coalesce("then", "to").alias("to"), (F.coalesce("then", "to") != F.col("to")).alias("moved")))
        moved = new.filter("moved").limit(1).count() > 0
        ws.drop(step)
        step, rounds = new, rounds + 1
    return step, rounds


def components(links: DataFrame, ws: Workspace, rounds: list[int] | None = None) -> DataFrame:
    """id, component (smallest id) of every linked id, by contraction: each id goes
    over to its smallest neighbour, from there to that one's, and so on to the end
    of the way, found by doubling; links follow, and links inside an id go, so a
    round works on what is left only. An id's old and new place stay linked until
    they are one, because the link between them is carried along too. ``rounds`` gets
    the number of doublings of each contraction."""
    ways = ws.save(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    label = ws.save(ways.select(F.col("x").alias("id"), F.col("x").alias("component")).distinct())
    while ways.limit(1).count():
        step, n = roots(ws.save(ways.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("to"))), ws)
        if rounds is not None:
            rounds.append(n)
        left = ways.join(step, "x").select(F.col("to").alias("a"), "y").distinct()
        both = left.join(step.select(F.col("x").alias("y"), F.col("to").alias("b")), "y").select(F.col("a").alias("x"), F.col("b").alias("y"))
        rest = ws.save(both.filter("x != y").distinct())
        new = ws.save(label.join(step.withColumnRenamed("x", "component"), "component", "left").select("id", F.coalesce("to", "component").alias("component")))
        ws.drop(ways, label, step)
        ways, label = rest, new
    return label


def union_shares(a: list[np.ndarray], b: list[np.ndarray], shared: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated Jaccard similarity of all bottom-k sketches of two blocks: over
    the values up to the smaller of both largest ones, where both are complete; and
    the shared values."""
    a, b = ([np.sort(x.view(np.uint64)) for x in s] for s in (a, b))
    top = np.uint64(2**64 - 1)
    last_a, last_b = (np.array([x[-1] if len(x) >= k else top for x in s], np.uint64) for s in (a, b))
    na = np.stack([np.searchsorted(x, np.minimum(last_b, m), "right") for x, m in zip(a, last_a, strict=True)])
    nb = np.stack([np.searchsorted(x, np.minimum(last_a, m), "right") for x, m in zip(b, last_b, strict=True)], axis=1)
    return shared / np.maximum(1, na + nb - shared), shared


def _across(percent: int):
    """Pairs across components in two blocks of one list whose sketches pass the estimate."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        v, left, right = (k.as_py() for k in key)
        block, ids, n, component = (rows.column(c).to_numpy() for c in ("block", "id", "n", "component"))
        wide, lists = (_rows_of(rows.column(c)) for c in ("wide", "lists"))
        ia = np.flatnonzero(block == left)
        ib = ia if left == right else np.flatnonzero(block == right)
        if not len(ia) or not len(ib):
            return pa.table({"a": ids[:0], "b": ids[:0]})
        wa, wb = [wide[k] for k in ia], [wide[k] for k in ib]
        share, shared = union_shares(wa, wb, meets(wa, wb), WIDE)
        na, nb = n[ia, None], n[None, ib]
        whole = (na < WIDE) & (nb < WIDE)  # both sketches are the sets themselves
        alike = np.where(whole, 100 * shared >= percent * (na + nb - shared), share >= percent / 100 - MARGIN)
        alike &= (component[ia, None] != component[None, ib]) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
        if left == right:
            alike = np.triu(alike)
        if alike.any():  # a pair counts in the first list that both are in
            earlier = [[lists[k][lists[k] < v] for k in i] for i in (ia, ib)]
            alike &= meets(*earlier) == 0
        i, j = np.nonzero(alike)
        x, y = ids[ia[i]], ids[ib[j]]
        return pa.table({"a": np.where(x < y, x, y), "b": np.where(x < y, y, x)})

    return run


def _rows_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    x = column.combine_chunks()
    values, ends = x.values.to_numpy(), x.offsets.to_pylist()
    return [values[i:j] for i, j in pairwise(ends)]


def meets(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each of one block shares with each of the other: pair by pair for
    values that few sets hold, as matrix products for the others."""
    flat, owner = np.concatenate([*a, *b]), np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(flat):
        return out
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]  # those of one block come first
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    keep = new.copy()
    keep[1:] |= owner[1:] != owner[:-1]
    starts, owner = np.flatnonzero(new[keep]), owner[keep]
    size = np.diff(np.append(starts, len(owner)))
    left = np.add.reduceat(owner < len(a), starts, dtype=np.int64)
    pairs = left * (size - left)
    few = (pairs > 0) & (pairs * DENSE <= out.size)
    for at in _shares(np.flatnonzero(few), pairs):
        group = np.repeat(at, pairs[at])
        k = np.arange(len(group)) - np.repeat(np.cumsum(pairs[at]) - pairs[at], pairs[at])
        i, j = np.divmod(k, (size - left)[group])
        cell = owner[starts[group] + i] * len(b) + owner[(starts + left)[group] + j] - len(a)
        out += np.bincount(cell, minlength=out.size).reshape(out.shape)
    often = np.flatnonzero(pairs * DENSE > out.size)
    for at in range(0, len(often), 2048):  # a bounded share of the values at a time
        g = often[at : at + 2048]
        m = np.zeros((len(a) + len(b), len(g)), np.float32)
        col = np.repeat(np.arange(len(g)), size[g])
        m[owner[np.repeat(starts[g] - np.cumsum(size[g]) + size[g], size[g]) + np.arange(len(col))], col] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def _shares(groups: np.ndarray, pairs: np.ndarray) -> Iterator[np.ndarray]:
    """``groups`` cut where about 2^20 pairs are together."""
    yield from np.split(groups, np.flatnonzero(np.diff(np.cumsum(pairs[groups]) >> 20)) + 1) if len(groups) else ()


def across(lists: DataFrame, fetch: Callable[[DataFrame], DataFrame], label: DataFrame, percent: int, ws: Workspace) -> DataFrame:
    """Pairs of long lists that stars left in different components."""
    size = lists.groupBy("v").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > SMALL)
    known = lists.join(size, "v").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = known.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("v")
    rows = ws.save(known.join(mixed, "v", "left_semi").select("v", "id", "n", "component", "size"))
    own = rows.groupBy("id").agg(F.collect_list("v").alias("lists"))  # a set's few lists
    wide = ws.save(fetch(own.select("id")).select("id", F.slice("members", 1, WIDE).alias("wide")).join(own, "id"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(wide, "id")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("left"), F.greatest(k, F.col("block")).alias("right"))))
    rows = rows.withColumn("m", pairs).select("v", F.col("m.left").alias("left"), F.col("m.right").alias("right"), "block", "id", "n", "component", "wide", "lists")
    return rows.groupBy("v", "left", "right").applyInArrow(_across(percent), "a long, b long").distinct()


def link(spark: SparkSession, sets: DataFrame, lists: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, estimate: Callable[[Column, Column], Column], ws: Workspace) -> DataFrame:
    """id, component of every set that is linked with another one. ``fetch`` gives
    id, members (an array) of the sets whose ids it gets. ``estimate`` is the test
    of a pair's sketches."""
    links = verified(stars(lists, percent), sets, fetch, percent, estimate, ws)
    label = components(links, ws)
    more = ws.save(across(lists, fetch, label, percent, ws))
    if more.limit(1).count():
        links = links.unionByName(verified(more, sets, fetch, percent, estimate, ws))
        label = components(links, ws)
    return label
