"""Versioned tables: immutable Parquet versions and a manifest; updates, layout, compaction."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table
from .scans import digest


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share: under the cluster's checkpoint folder, where it names one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lakeweave-")
    return f"{base.rstrip('/')}/lakeweave-{uuid.uuid4().hex}"


class Versions:
    """A table as versions. A version is a set of immutable folders, listed in a stored
    manifest; older ones stay readable. Each manifest is written once, under its
    number: of two writers that make the same version one fails."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, root or folder(spark)
        self.versions: list[tuple[str, ...]] = [()]
        self._n = 0

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Versions:
        """The table as its manifests tell, whoever wrote it."""
        t = cls(spark, root)
        rows = spark.read.parquet(f"{root}/versions/*").collect()  # one row for each folder of each version
        paths: dict[int, list[str]] = {}
        for r in sorted(rows, key=lambda r: (r.version, r.place)):
            paths.setdefault(r.version, []).append(r.path)
        t.versions += [tuple(paths[v]) for v in sorted(paths)]
        t._n = len({p for v in t.versions for p in v})
        return t

    def _write(self, df: DataFrame, **options: str) -> str:
        path = f"{self.root}/data-{self._n}-{uuid.uuid4().hex[:8]}"
        self._n += 1
        df.write.options(**options).parquet(path)
        return path

    def _publish(self, paths: tuple[str, ...], operation: str) -> int:
        version = len(self.versions)
        rows = [(version, i, p, operation) for i, p in enumerate(paths)]
        self.spark.createDataFrame(rows, "version int, place int, path string, operation string").coalesce(1).write.parquet(f"{self.root}/versions/{version:08d}")
        self.versions.append(paths)
        return version

    def append(self, df: DataFrame, **options: str) -> int:
        return self._publish((*self.versions[-1], self._write(df, **options)), "append")

    def replace(self, df: DataFrame, operation: str = "replace", **options: str) -> int:
        return self._publish((self._write(df, **options),), operation)

    def snapshots(self) -> DataFrame:
        """version, operation, folders of every version, by the stored manifests."""
        return self.spark.read.parquet(f"{self.root}/versions/*").groupBy("version", "operation").agg(F.count(F.lit(1)).alias("folders"))

    def files(self, version: int = -1) -> DataFrame:
        """path, size, rows of a version's data files."""
        rows = self.read(version).select("_metadata.file_path", "_metadata.file_size")
        return rows.groupBy(F.col("file_path").alias("path")).agg(F.first("file_size").alias("size"), F.count(F.lit(1)).alias("rows"))

    def rename(self, old: str, new: str) -> int:
        return self.replace(self.read().withColumnRenamed(old, new), "rename")

    def drop(self, column: str) -> int:
        return self.replace(self.read().drop(column), "drop")

    def add(self, column: str, default: Column) -> int:
        return self.replace(self.read().withColumn(column, default), "add")

    def read(self, version: int = -1) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*self.versions[version])

    def update(self, where: Column, **values: Column) -> int:
        df = self.read()
        return self.replace(df.select(*[F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns]), "update")

    def delete(self, where: Column) -> int:
        return self.replace(self.read().filter(~F.coalesce(where, F.lit(False))), "delete")

    def compact(self, files: int, *order: str) -> int:
        df = self.read()
        return self.replace(df.repartitionByRange(files, *order).sortWithinPartitions(*order) if order else df.coalesce(files), "compact")

    def manifest(self) -> DataFrame:
        return self.spark.createDataFrame([(v, p) for v, paths in enumerate(self.versions) for p in paths], "version int, path string")


def _base(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


_SUM = "count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(sum(o_custkey) AS BIGINT) AS customers"


def sums(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.sum("o_custkey").alias("customers"))


@query(f"SELECT {_SUM} FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey < 50)")
def lake_append(spark: SparkSession, d: str) -> DataFrame:
    t = Versions(spark)
    t.append(_base(spark, d))
    t.append(_base(spark, d).filter("o_orderkey < 50"))
    return sums(t.read())


@query(f"SELECT {_SUM} FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey + 1000 ELSE o_custkey END AS o_custkey FROM orders)")
def lake_update(spark: SparkSession, d: str) -> DataFrame:
    t = Versions(spark)
    t.append(_base(spark, d))
    t.update(F.col("o_orderstatus") == "F", o_custkey=F.col("o_custkey") + 1000)
    return sums(t.read())


@query(f"SELECT {_SUM} FROM orders WHERE NOT o_orderkey % 3 = 0")
def lake_delete(spark: SparkSession, d: str) -> DataFrame:
    t = Versions(spark)
    t.append(_base(spark, d))
    t.delete(F.col("o_orderkey") % 3 == 0)
    return sums(t.read())


@query("SELECT 1 AS version, count(*) AS n FROM orders UNION ALL SELECT 2, count(*) FROM orders WHERE o_orderkey >= 100")
def lake_time_travel(spark: SparkSession, d: str) -> DataFrame:
    t = Versions(spark)
    t.append(_base(spark, d))
    t.delete(F.col("o_orderkey") < 100)
    count = lambda v: t.read(v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("n"))
    return count(1).unionByName(count(2))


@query(f"SELECT {_SUM} FROM orders")
def lake_compact(spark: SparkSession, d: str) -> DataFrame:
    t = Versions(spark)
    for k in range(3):
        t.append(_base(spark, d).filter(F.col("o_orderkey") % 3 == k))
    t.compact(2, "o_orderkey")
    return sums(t.read())


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey = 42 GROUP BY o_custkey")
def bucket_layout(spark: SparkSession, d: str) -> DataFrame:
    """Hash buckets as partitions: a key's filter prunes to one of them."""
    t, bucket = Versions(spark), F.pmod(F.hash("o_custkey"), F.lit(32))
    path = f"{t.root}/buckets"
    table(spark, d, "orders").withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "o_orderdate", "o_orderkey").write.partitionBy("bucket").parquet(path)
    return spark.read.parquet(path).filter((F.col("bucket") == F.pmod(F.hash(F.lit(42).cast("bigint")), F.lit(32))) & (F.col("o_custkey") == 42)).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CAST(sum(CAST('0x' || substr(md5(text), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM documents")
def parquet_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    t = Versions(spark)
    t.append(table(spark, d, "documents").select("doc_id", "text"), compression="zstd")
    return digest(t.read(), "doc_id", "text")


@query("SELECT 1::BIGINT AS orphans, 0::BIGINT AS missing")
def orphan_files(spark: SparkSession, d: str) -> DataFrame:
    """Folders that are stored and that the last version doesn't name, and the other way round (LK5, SO7)."""
    t = Versions(spark)
    t.append(_base(spark, d))
    t.delete(F.col("o_orderkey") % 3 == 0)
    t.append(_base(spark, d).filter("o_orderkey % 3 = 0"))
    m = t.manifest()
    last = m.filter(F.col("version") == len(t.versions) - 1).select("path")
    written = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{t.root}/data-*").select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()
    plain = lambda df: df.select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    written, last = plain(written), plain(last)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(written.subtract(last), "orphans").crossJoin(count(last.subtract(written), "missing"))  # one row each
