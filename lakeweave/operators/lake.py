"""Lake recipes: snapshots, schema changes, month partitions, a curve-sorted layout, staged checks, raster regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table
from .analytics import curve, tiles
from .tables import Versions, folder


@query("SELECT * FROM (VALUES (1, 'append', 1::BIGINT), (2, 'append', 2), (3, 'delete', 1), (4, 'compact', 1)) v(version, operation, folders)")
def lake_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Every version and what made it, by the stored manifests (SC25, LK1)."""
    t = Versions(spark)
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    t.append(rows.filter("o_orderkey % 2 = 0"))
    t.append(rows.filter("o_orderkey % 2 = 1"))
    t.delete(F.col("o_orderkey") % 5 == 0)
    t.compact(2, "o_orderkey")
    return t.snapshots()


@query("SELECT v AS version, count(*) FILTER (v = 2 OR o_orderkey % 2 = 0) AS n, CAST(sum(o_orderkey) FILTER (v = 2 OR o_orderkey % 2 = 0) AS BIGINT) AS keys FROM orders, (SELECT unnest([1, 2]) AS v) GROUP BY v")
def lake_files(spark: SparkSession, d: str) -> DataFrame:
    """A table that someone else opens by its manifests: rows by the files of each version (SC26, SK4)."""
    t = Versions(spark)
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    t.append(rows.filter("o_orderkey % 2 = 0"))
    t.append(rows.filter("o_orderkey % 2 = 1"))
    seen = Versions.open(spark, t.root)
    sums = [seen.files(v).agg(F.lit(v).alias("version"), F.sum("rows").alias("n")).crossJoin(seen.read(v).agg(F.sum("o_orderkey").alias("keys"))) for v in (1, 2)]  # one row each
    return sums[0].unionByName(sums[1])


@query("SELECT o_orderkey, o_custkey AS customer, CASE WHEN o_orderkey < 100 THEN 9 ELSE 7 END::BIGINT AS revision FROM orders")
def lake_schema_change(spark: SparkSession, d: str) -> DataFrame:
    """A column with a default, a new name, a column less, and an update after them (LK3)."""
    t = Versions(spark)
    t.append(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))
    t.add("revision", F.lit(7).cast("bigint"))
    t.rename("o_custkey", "customer")
    t.drop("o_orderstatus")
    t.update(F.col("o_orderkey") < 100, revision=F.lit(9).cast("bigint"))
    return t.read()


@query("SELECT date_trunc('month', l_shipdate)::DATE AS month, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '1996-05-01' GROUP BY 1")
def month_partitions(spark: SparkSession, d: str) -> DataFrame:
    """A layout by month: a range of months reads their folders only (SK7)."""
    path = f"{folder(spark)}/months"
    month = F.trunc("l_shipdate", "month")
    table(spark, d, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", month.alias("month")).repartition("month").sortWithinPartitions("month", "l_shipdate", "l_orderkey").write.partitionBy("month").parquet(path)
    rows = spark.read.parquet(path).filter("month >= date'1996-03-01' and month < date'1996-05-01'")
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


def nearest(x: Column) -> Column:
    """A cast to an integer that rounds halves to the even number, as the recipe's engine does."""
    return F.bround(x).cast("int")


def cell_id(gx: Column, gy: Column) -> Column:
    """A 24-bit id: four levels of three bits of each axis, each level in the order of its own curve."""
    out = F.lit(0).cast("bigint")
    for level in (9, 6, 3, 0):
        at = curve(F.shiftright(gx, level).bitwiseAND(7), F.shiftright(gy, level).bitwiseAND(7), 3)
        out = out * 64 + at
    return out


def hotspot(spark: SparkSession, n: int = 40_000) -> DataFrame:
    """Points of which nine in ten lie in a small spot."""
    i = F.col("id") % 20_000
    first = F.col("id") < 20_000
    ts = F.when(first, F.lit("2026-10-01 00:00:00").cast("timestamp")).otherwise(F.lit("2027-03-01 00:00:00").cast("timestamp")) + F.make_dt_interval(mins=i.cast("int"))
    near = i % 10 < 9
    across = F.expr("id % 20000 div 1000 % 100")
    lat = F.when(near, 40.70 + (i % 1000) * 0.0001).otherwise(25.0 + (i % 10_000) * 0.0025)
    lon = F.when(near, -74.02 + across * 0.0001).otherwise(-125.0 + across * 0.055)
    rows = spark.range(n).select("id", (i % 500).cast("int").alias("customer_id"), ts.alias("ts"), lat.alias("lat"), lon.alias("lon"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("wide_payload"))
    gx, gy = nearest((F.col("lat") - 25.0) / 25.0 * 4095), nearest((F.col("lon") + 125.0) / 55.0 * 4095)
    return rows.withColumn("hilbert_id", cell_id(gx, gy))


@query("SELECT 3240::BIGINT AS rows, 256 AS payload_bytes, 72::BIGINT AS customer_rows")
def hilbert_recipe(spark: SparkSession, d: str) -> DataFrame:
    """A table sorted by curve id, without its oldest rows, and one in hash buckets; a
    narrow filter first, the wide column by a join after it (LK7, SF17, TK11, JN12)."""
    root = folder(spark)
    rows = hotspot(spark).filter("id >= 4000")
    rows.repartitionByRange("hilbert_id", "ts").sortWithinPartitions("hilbert_id", "ts").write.parquet(f"{root}/sorted")
    lake = spark.read.parquet(f"{root}/sorted")
    bucket = F.pmod(F.hash("customer_id"), F.lit(32))
    lake.select("customer_id", "id", "ts", bucket.alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "ts", "id").write.partitionBy("bucket").parquet(f"{root}/buckets")
    spot = cell_id(F.lit(5 << 9), F.lit(7 << 9))
    lo, hi = spot, spot + F.lit(1 << 18)  # one cell of the first level is a range of ids
    narrow = (F.col("hilbert_id") >= lo) & (F.col("hilbert_id") < hi) & F.col("lat").between(40.7100, 40.7199) & F.col("lon").between(-74.0200, -74.0100)
    matched = lake.filter(narrow & (F.col("ts") >= F.lit("2026-10-01 00:00:00").cast("timestamp"))).select("id")
    found = lake.select("id", "wide_payload").join(matched, "id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.length("wide_payload")).alias("payload_bytes"))
    own = spark.read.parquet(f"{root}/buckets").filter((F.col("bucket") == F.pmod(F.hash(F.lit(42)), F.lit(32))) & (F.col("customer_id") == 42))
    return found.crossJoin(own.agg(F.count(F.lit(1)).alias("customer_rows")))  # one row each


_STAGE = "SELECT '{0}' AS stage, count(*) AS n, CAST(sum(i) AS BIGINT) AS total, CAST(sum(v) AS BIGINT) AS v FROM ({1})"
_LOADED = "SELECT o_orderkey AS i, o_custkey AS v FROM orders"
_UPDATED = "SELECT o_orderkey AS i, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1 ELSE o_custkey END AS v FROM orders UNION ALL SELECT o_orderkey + 1000000, o_custkey FROM orders WHERE o_orderkey % 100 = 0"


@query(f"{_STAGE.format('loaded', _LOADED)} UNION ALL {_STAGE.format('updated', _UPDATED)} UNION ALL {_STAGE.format('half', f'SELECT * FROM ({_UPDATED}) WHERE i % 2 = 0')}")
def lake_stages(spark: SparkSession, d: str) -> DataFrame:
    """Sums of a table after its load, an update with appended rows, and the deletion of half (LK8)."""
    t, i = Versions(spark), F.col("i")
    loaded = table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("v"))
    t.append(loaded)
    t.update(i % 10 == 0, v=F.col("v") + 1)
    t.append(loaded.filter("i % 100 = 0").select((i + 1_000_000).alias("i"), "v"))
    t.delete(i % 2 != 0)
    sums = lambda name, v: t.read(v).agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n"), F.sum("i").alias("total"), F.sum("v").alias("v"))
    return sums("loaded", 1).unionByName(sums("updated", 3)).unionByName(sums("half", 4))


@query("SELECT count(*) AS pixels, min(x + 1000.0::DOUBLE * y) AS least, max(x + 1000.0::DOUBLE * y) AS most, sum(x + 1000.0::DOUBLE * y) AS total, avg(x + 1000.0::DOUBLE * y) AS mean FROM range(20, 50) a(x), range(30, 70) b(y)")
def raster_region(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the pixels of a region; only tiles that meet it are decoded (SC29, SF29, AG22)."""
    return region_stats(tiles(spark), 8, 16, (20, 30, 50, 70))


def region_stats(rows: DataFrame, side: int, pixels: int, box: tuple[int, int, int, int]) -> DataFrame:
    """pixels, least, most, total, mean inside ``box`` (first and last column and row, the last ones excluded)."""
    x0, y0, x1, y1 = box
    tx, ty = F.col("block") % side, F.floor(F.col("block") / side)
    met = rows.filter((tx * pixels < x1) & ((tx + 1) * pixels > x0) & (ty * pixels < y1) & ((ty + 1) * pixels > y0))

    def part(batches):
        import gzip

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for block, band in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row, col = divmod(block, side)
                a = np.frombuffer(gzip.decompress(band), "<f4").reshape(pixels, pixels)
                a = a[max(0, y0 - row * pixels) : max(0, y1 - row * pixels), max(0, x0 - col * pixels) : max(0, x1 - col * pixels)].astype(float)
                if a.size:
                    out.append((a.size, a.min(), a.max(), a.sum()))
            yield pa.RecordBatch.from_pydict({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate((("n", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()), ("s", pa.float64())))})

    parts = met.select("block", "band").mapInArrow(part, "n long, lo double, hi double, s double")
    return parts.agg(F.sum("n").alias("pixels"), F.min("lo").alias("least"), F.max("hi").alias("most"), F.sum("s").alias("total"), (F.sum("s") / F.sum("n")).alias("mean"))
