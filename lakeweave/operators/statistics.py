"""Percentiles, histograms, paired gates, window functions, approximate aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, table
from .tables import folder


@query("SELECT event_type, list_sort(list(value))[least(count(*) - 1, (count(*) * 0.95)::BIGINT - CASE WHEN (count(*) * 0.95)::BIGINT > count(*) * 0.95 THEN 1 ELSE 0 END) + 1] AS p95 FROM events GROUP BY event_type")
def latency_pct(spark: SparkSession, d: str) -> DataFrame:
    return nearest_rank(table(spark, d, "events"), "event_type", "value", 0.95).withColumnRenamed("at_rank", "p95")


def nearest_rank(rows: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """The value at place min(n - 1, int(q n)) of each group."""
    places = lambda n: [F.least(n - 1, F.floor(n * F.lit(q).cast("decimal(4,3)")))]
    return ranked(rows, group, value, places).select(group, F.col("value").alias("at_rank"))


def ranked(rows: DataFrame, group: str, value: str, places: Callable[[Column], list[Column]], slices: int = 64) -> DataFrame:
    """group, which, value: the values at some places (from 0, given the number n of
    rows) of each group in order. A group is cut into slices at approximate quantiles,
    which are counted exactly; only the slices that hold a place are sorted, so no
    group, however large, is ever in one task. The cuts are written, as they must be
    the same wherever they are used."""
    spark = rows.sparkSession
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    path = f"{folder(spark)}/cuts"
    at = [k / slices for k in range(1, slices)]
    rows.filter(F.col(value).isNotNull()).groupBy(group).agg(F.percentile_approx(value, at, 1000).alias("cuts"), F.count(F.lit(1)).alias("n")).write.parquet(path)
    cut = counts.join(spark.read.parquet(path), group)
    cut = cut.withColumn("slice", F.size(F.filter("cuts", lambda x: x < F.col(value)))).select(group, value, "c", "n", "slice")
    sums = cut.groupBy(group, "slice").agg(F.sum("c").alias("s"), F.first("n").alias("n"))
    before = F.sum("s").over(Window.partitionBy(group).orderBy("slice")) - F.col("s")  # as many rows as slices
    asked = [F.struct(F.lit(i).alias("which"), p.cast("long").alias("place")) for i, p in enumerate(places(F.col("n")))]
    here = F.filter(F.array(*asked), lambda x: (x["place"] >= F.col("before")) & (x["place"] < F.col("before") + F.col("s")))
    held = sums.withColumn("before", before).withColumn("places", here).filter(F.size("places") > 0).select(group, "slice", "before", "places")
    some = cut.join(held, [group, "slice"])
    end = F.col("before") + F.sum("c").over(Window.partitionBy(group, "slice").orderBy(value))
    hit = F.filter("places", lambda x: (x["place"] < F.col("end")) & (x["place"] >= F.col("end") - F.col("c")))
    return some.withColumn("end", end).select(group, F.explode(hit).alias("x"), F.col(value).alias("value")).select(group, "x.which", "value")


@query("SELECT event_type, b AS le, count(*) FILTER (value <= b) AS n FROM events CROSS JOIN (VALUES (1), (2), (5), (10), (25), (50), (100), (250), (500), (1000)) v(b) GROUP BY ALL")
def latency_hist(spark: SparkSession, d: str) -> DataFrame:
    bounds = (1, 2, 5, 10, 25, 50, 100, 250, 500, 1000)
    sums = table(spark, d, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"b{b}") for b in bounds])
    return sums.unpivot("event_type", [f"b{b}" for b in bounds], "b", "n").select("event_type", F.expr("int(substring(b, 2))").alias("le"), "n")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def pool_pct(spark: SparkSession, d: str) -> DataFrame:
    return interpolated(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


def interpolated(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles of each group, interpolated between the two values around their place."""
    place = lambda n, q: (n - 1) * F.lit(q)
    around = ranked(rows, group, value, lambda n: [f(place(n, q)) for q in shares.values() for f in (F.floor, F.ceil)])
    found = around.groupBy(group).agg(*[F.max(F.when(F.col("which") == i, F.col("value"))).alias(f"v{i}") for i in range(2 * len(shares))])  # a few rows each
    n = rows.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    part = lambda q: place(F.col("n"), q) - F.floor(place(F.col("n"), q))
    between = lambda i, q: F.col(f"v{2 * i}") + (F.col(f"v{2 * i + 1}") - F.col(f"v{2 * i}")) * part(q)
    return found.join(n, group).select(group, *[F.round(between(i, q), 6).alias(name) for i, (name, q) in enumerate(shares.items())])


@query("SELECT user_id, count(*) AS n, round(min(value), 6) AS lo, round(median(value), 6) AS med, round(max(value), 6) AS hi FROM events GROUP BY user_id")
def timing_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("value"), 6).alias("lo"), F.round(F.percentile("value", 0.5), 6).alias("med"), F.round(F.max("value"), 6).alias("hi"))


_AB = "SELECT user_id, median(value) FILTER (event_id % 2 = 0) AS a, median(value) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY user_id"


@query(f"SELECT user_id, round(b / a, 6) AS ratio, b / a > 1.20 AS failed FROM ({_AB})")
def paired_gate(spark: SparkSession, d: str) -> DataFrame:
    side = lambda k: F.percentile(F.when(F.col("event_id") % 2 == k, F.col("value")), 0.5)
    both = table(spark, d, "events").groupBy("user_id").agg(side(0).alias("a"), side(1).alias("b"))
    ratio = F.try_divide("b", "a")
    return both.select("user_id", F.round(ratio, 6).alias("ratio"), (ratio > 1.20).alias("failed"))


@query("WITH m AS (SELECT user_id, event_type, median(value) AS m FROM events GROUP BY ALL) SELECT x.user_id, x.event_type, round(x.m / b.m, 6) AS ratio FROM m x JOIN m b ON b.user_id = x.user_id AND b.event_type = 'click'")
def baseline_ratio(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.percentile("value", 0.5).alias("m"))
    base = F.max(F.when(F.col("event_type") == "click", F.col("m"))).over(Window.partitionBy("user_id"))  # a user's few kinds
    return m.withColumn("base", base).filter("base is not null").select("user_id", "event_type", F.round(F.try_divide("m", "base"), 6).alias("ratio"))


@query("SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events")
def counter_delta(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") - F.lag("event_id").over(w)).alias("delta"))


@query("""SELECT c_custkey, rank() OVER w AS rnk, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS quarter FROM customer
 WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)""")
def rank_dense(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy("c_mktsegment")
    kinds = (F.rank().over(w).cast("bigint").alias("rnk"), F.dense_rank().over(w).cast("bigint").alias("dense"), F.ntile(4).over(w.orderBy("c_mktsegment", "c_custkey")).cast("bigint").alias("quarter"))
    return table(spark, d, "customer").select("c_custkey", *kinds)


@query("""SELECT event_id, first_value(event_id) OVER w AS first, last_value(event_id) OVER w AS last, CAST(sum(event_id) OVER w AS BIGINT) AS total FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""")
def rows_frame(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 1)
    return table(spark, d, "events").select("event_id", F.first("event_id").over(w).alias("first"), F.last("event_id").over(w).alias("last"), F.sum("event_id").over(w).alias("total"))


@query()
def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))
