"""Event streams by snapshots: windows between ticks, acks, retries, lag, and time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, table

#: A snapshot: all transactions below ``xmin`` and, below ``xmax``, those not in ``xip`` are visible.
Tick = tuple[int, int, list[int]]
_TX = "(event_id * 7919) % 1009"


def visible(tx: Column, tick: Tick) -> Column:
    xmin, xmax, xip = tick
    running = tx.isin(xip) if xip else F.lit(False)
    return (tx < xmin) | ((tx < xmax) & ~running)


def between(events: DataFrame, start: Tick, end: Tick) -> DataFrame:
    """Events that the end's snapshot sees and the start's doesn't, whatever their number."""
    return events.filter(visible(F.col("txid"), end) & ~visible(F.col("txid"), start))


def stream(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.expr(_TX).alias("txid"), "user_id", "event_type", "ts")


A, B = (300, 340, [310, 311, 325]), (600, 600, [])
_SEE = lambda t: f"(txid < {t[0]} OR (txid < {t[1]} AND NOT list_contains({t[2]}::BIGINT[], txid)))"
_ST = f"(SELECT event_id AS seq, {_TX} AS txid, user_id, event_type, ts FROM events)"


@query(f"SELECT seq, txid FROM {_ST} WHERE {_SEE(B)} AND NOT {_SEE(A)}")
def tick_window(spark: SparkSession, d: str) -> DataFrame:
    return between(stream(spark, d), A, B).select("seq", "txid")


@query("SELECT seq, txid FROM (VALUES (1, 10), (2, 11), (3, 12), (4, 13), (5, 14)) v(seq, txid) WHERE seq IN (2, 4, 5)")
def late_commit(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, 10), (2, 11), (3, 12), (4, 13), (5, 14)], "seq int, txid int")
    return between(rows, (11, 13, [11]), (15, 15, []))


@query(f"SELECT 'latest' AS kind, (SELECT max(seq) FROM {_ST}) AS cursor UNION ALL SELECT 'earliest', 0 UNION ALL SELECT 'exact', 77")
def subscribe_from(spark: SparkSession, d: str) -> DataFrame:
    latest = stream(spark, d).agg(F.lit("latest").alias("kind"), F.max("seq").alias("cursor"))
    return latest.unionByName(spark.createDataFrame([("earliest", 0), ("exact", 77)], "kind string, cursor long"))


@query(f"SELECT NULL::BIGINT AS seq, count(*)::BIGINT AS info FROM {_ST} WHERE user_id = 5 UNION ALL SELECT seq, txid FROM {_ST} WHERE user_id = 5")
def batch_events(spark: SparkSession, d: str) -> DataFrame:
    rows = stream(spark, d).filter("user_id = 5")
    head = rows.agg(F.lit(None).cast("bigint").alias("seq"), F.count(F.lit(1)).alias("info"))
    return head.unionByName(rows.select("seq", F.col("txid").alias("info"))).orderBy(F.asc_nulls_first("seq"))


@query("""WITH b AS (SELECT c_nationkey AS consumer, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS tick, c_custkey % 11 <> 5 AS acked FROM customer)
 SELECT consumer, CAST(coalesce(min(tick) FILTER (NOT acked) - 1, max(tick)) AS BIGINT) AS cursor FROM b GROUP BY consumer""")
def ack_chain(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("consumer"), F.row_number().over(w).cast("bigint").alias("tick"), (F.col("c_custkey") % 11 != 5).alias("acked"))
    return cursors(rows)


def cursors(batches: DataFrame) -> DataFrame:
    """How far each consumer's cursor goes: over acked batches without a gap."""
    return batches.groupBy("consumer").agg(F.coalesce(F.min(F.when(~F.col("acked"), F.col("tick"))) - 1, F.max("tick")).alias("cursor"))


@query("SELECT o_orderkey AS tick, o_orderkey % 4 AS member FROM orders")
def coop_assign(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("tick"), F.pmod("o_orderkey", F.lit(4)).alias("member"))


_NACK = "(SELECT event_id, event_id % 8 + 1 AS next_retry, ts FROM events WHERE event_type = 'error')"


def nacked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_type = 'error'").select("event_id", (F.col("event_id") % 8 + 1).alias("next_retry"), "ts")


@query(f"SELECT event_id, next_retry, CASE WHEN next_retry > 5 THEN 'dead' ELSE 'retry' END AS route FROM {_NACK}")
def nack_route(spark: SparkSession, d: str) -> DataFrame:
    return nacked(spark, d).select("event_id", "next_retry", F.when(F.col("next_retry") > 5, "dead").otherwise("retry").alias("route"))


@query(f"SELECT event_id, ts + INTERVAL 60 SECOND AS due FROM {_NACK} WHERE next_retry <= 5 AND ts + INTERVAL 60 SECOND <= TIMESTAMP '2024-01-15' ORDER BY due, event_id LIMIT 100")
def retry_due(spark: SparkSession, d: str) -> DataFrame:
    rows = nacked(spark, d).filter("next_retry <= 5").select("event_id", F.expr("ts + interval 60 seconds").alias("due"))
    return rows.filter("due <= timestamp_ntz'2024-01-15'").orderBy("due", "event_id").limit(100)


@query(f"SELECT event_id, next_retry FROM {_NACK} WHERE next_retry > 5 ORDER BY event_id DESC LIMIT 100")
def dlq_topk(spark: SparkSession, d: str) -> DataFrame:
    return nacked(spark, d).filter("next_retry > 5").select("event_id", "next_retry").orderBy(F.desc("event_id")).limit(100)


@query(f"SELECT user_id AS consumer, (SELECT count(*) FROM events) - max(event_id) - 1 AS lag FROM events WHERE event_type = 'click' GROUP BY user_id")
def consumer_lag(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    total = e.agg(F.count(F.lit(1)).alias("n"))  # one row
    return e.filter("event_type = 'click'").groupBy(F.col("user_id").alias("consumer")).agg(F.max("event_id").alias("at")).crossJoin(F.broadcast(total)).select("consumer", (F.col("n") - F.col("at") - 1).alias("lag"))


@query("SELECT count(*) AS events, max(event_id) AS max_seq, count(DISTINCT user_id) AS consumers, count(*) FILTER (event_type = 'error') AS errors, min(ts) AS oldest FROM events")
def stream_info(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("events"), F.max("event_id").alias("max_seq"), F.countDistinct("user_id").alias("consumers"), F.count_if(F.col("event_type") == "error").alias("errors"), F.min("ts").alias("oldest"))


@query("SELECT event_id AS tick FROM events WHERE ts >= TIMESTAMP '2024-01-20' OR event_id = 0 OR event_id IN (SELECT doc_id FROM labels)")
def prune_ticks(spark: SparkSession, d: str) -> DataFrame:
    ticks = table(spark, d, "events").select(F.col("event_id").alias("tick"), "ts")
    used = table(spark, d, "labels").select(F.col("doc_id").alias("tick"))
    low = ticks.agg(F.min("tick").alias("tick"))
    old = ticks.filter("ts < timestamp_ntz'2024-01-20'").join(used, "tick", "left_anti").join(low, "tick", "left_anti")
    return ticks.select("tick").join(old, "tick", "left_anti")


@query("SELECT DISTINCT c_nationkey % 3 AS segment FROM customer LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON doc_id = c_custkey WHERE l.doc_id IS NULL OR c_custkey < 10")
def pinned_segments(spark: SparkSession, d: str) -> DataFrame:
    ticks = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("c_custkey"), F.lit(1).alias("t"))
    subs = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 3).alias("segment")).join(ticks, "c_custkey", "left")
    return subs.filter("t is null or c_custkey < 10").select("segment").distinct()  # a subscription without a tick pins


@query("SELECT batch, event, count(*) AS deliveries, min(event_id) AS first FROM (SELECT user_id % 40 AS batch, event_id % 500 AS event, event_id FROM events) GROUP BY batch, event")
def deliver_once(spark: SparkSession, d: str) -> DataFrame:
    """Repeated deliveries of an event of a batch count as one, the first (ST17)."""
    keys = [(F.col("user_id") % 40).alias("batch"), (F.col("event_id") % 500).alias("event")]
    return table(spark, d, "events").groupBy(*keys).agg(F.count(F.lit(1)).alias("deliveries"), F.min("event_id").alias("first"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("w.start", "event_type", "n")


@query("SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY s")
def sliding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("w.start", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", "w.start", "n")
