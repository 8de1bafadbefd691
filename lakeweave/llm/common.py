"""Shared plumbing of the training-data operators.

Every operator takes DataFrames and returns a DataFrame. Lineage is cut by
writing a table into the shared folder that the cluster names in
``spark.checkpoint.dir``; nothing is kept on one executor's disk.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import cuts_of, small_batches

T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only a local
    session, as in tests, may go without: executors don't see each other's disks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="lakeweave-")


_SCOPES: list[list[Workspace]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables that operators write inside of it. Use it where the result
    of such an operator is written too, since results read these tables."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for ws in _SCOPES.pop():
            ws.clear()


class Workspace:
    """Tables of one operator run, in the cluster's shared checkpoint folder."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/lakeweave-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._count = 0
        if _SCOPES:
            _SCOPES[-1].append(self)

    def save(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` and returns the written table."""
        path = f"{self.root}/{self._count}"
        self._count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes written tables that no later plan reads."""
        for t in tables:
            self._delete(self._paths.pop(id(t)))

    def clear(self) -> None:
        """Deletes all tables."""
        self._paths.clear()
        self._delete(self.root)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def unique_docs(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with one row per doc_id: rows without an id go, and of rows that
    repeat an id the one with the smallest text stays. The shuffle of whole rows
    is only paid if some id does repeat."""
    docs = docs.select("doc_id", *columns) if columns else docs
    docs = docs.filter(F.col("doc_id").isNotNull())
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1)
    if not repeated.take(1):
        return docs
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    first = F.min(F.struct("text", F.struct(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(rest)] or [F.lit("")]).alias("k"), *[F.struct(c.alias("v")).alias(f"v{i}") for i, c in enumerate(rest)]))
    out = docs.groupBy("doc_id").agg(first.alias("_row"))
    cols = {c: F.col(f"_row.v{i}.v") for i, c in enumerate(c for c in docs.columns if c not in ("doc_id", "text"))}
    cols |= {"doc_id": F.col("doc_id"), "text": F.col("_row.text")}
    return out.select(*[cols[c].alias(c) for c in docs.columns])


def slices(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[list, ...]]:
    """The named columns as Python lists, a bounded number of rows and bytes at a time."""
    for batch in batches:
        for at, n in cuts_of(batch):
            part = batch.slice(at, n)
            yield tuple(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns)


_KEPT: dict[Hashable, object] = {}


def release() -> None:
    """Gives memory that a worker no longer uses back to its machine. Workers live
    longer than tasks, so what one stage has freed would add to the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def kept(key: Hashable, make: Callable[[], T]) -> T:
    """What ``make`` gives, kept by this worker for later tasks with the same key; a
    worker keeps one thing at a time."""
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            release()
        _KEPT[key] = make()
        release()
    return _KEPT[key]


def with_release(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with the memory of earlier stages released before it
    (not if it goes on with what is kept) and its own after it."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _KEPT and not keep:
            _KEPT.clear()
            release()
        yield from run(batches)
        release()

    return released


def keep_rows(docs: DataFrame, column: str, make: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows of ``docs`` for whose ``column`` the function that ``make`` gives is
    true; all columns stay as they are."""
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ok = make()
        for batch in batches:
            for start, n in cuts_of(batch):
                part = batch.slice(start, n)
                yield part.filter(pa.array([ok(x) for x in part.column(at).to_pylist()], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(with_release(run), docs.schema)


def map_slices(df: DataFrame, columns: list[str], make: Callable[[], Callable[..., dict]], schema: pa.Schema, spark_schema: str, keep: bool = False) -> DataFrame:
    """Runs ``make()`` once per task and its result on each slice of rows. The
    result gives a dict of equally long lists or Arrow arrays. If it has a method
    ``end``, that gives the last rows. ``keep``: ``make`` goes on with what this worker keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()

        def batch(out: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in ((out[n], schema.field(n).type) for n in schema.names)], schema=schema)

        for lists in slices(batches, *columns):
            yield batch(f(*lists))
        if hasattr(f, "end"):
            yield batch(f.end())

    small_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(with_release(run, keep), spark_schema)


class WordHashes(dict):
    """Memo of 64-bit hashes of words; emptied when it holds too many."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


#: Bits of the filter of ``among``; at most an eighth of so many bytes is sent, whatever the number of ids.
FILTER_BITS = 1 << 26


def _marked(docs: DataFrame, ids: DataFrame, how: str) -> tuple[DataFrame, Column]:
    """``docs`` with the part of a bitmap of ``ids`` that its doc_id falls in, and whether its bit is set."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    part = lambda b: (b / 32768).cast("int")
    maps = ids.select(bit.alias("bit")).groupBy(part(F.col("bit")).alias("_part")).agg(F.expr("bitmap_construct_agg(bit % 32768)").alias("_bits"))  # at most FILTER_BITS / 32768 rows of 4 KB
    place = (bit % 32768).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return docs.withColumn("_part", part(bit)).join(F.broadcast(maps), "_part", how), F.getbit(byte, place % 8) == 1


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id may be in ``ids`` (column doc_id), so that
    an inner join that follows need not shuffle the texts of all documents (Spark
    would move a semi join below the bitmap, to all rows). The filter is a bitmap of
    fixed size: more ids make it let more rows through, never fewer."""
    rows, known = _marked(docs, ids, "inner")
    return rows.filter(known).select(docs.columns)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``ids``, which are all different; only
    those that may be are shuffled."""
    rows, known = _marked(docs, ids, "left")
    maybe = F.coalesce(known, F.lit(False))
    # No anti join: Spark would move it below the bitmap, to all rows.
    found = rows.filter(maybe).select(docs.columns).join(ids.select("doc_id", F.lit(True).alias("_found")), "doc_id", "left")
    return rows.filter(~maybe).select(docs.columns).unionByName(found.filter("_found is null").select(docs.columns))
