"""Delivery of event streams: appends, ticks, batches for consumers and members, acks, retries, dead letters, rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import at
from ..registry import query, table
from .tables import folder

_NOW = "2024-01-20 00:00:00"


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with seq, 1 to n in their order, without one task that sorts all:
    ranges are sorted apart, and each goes on where the ranges before it end."""
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", 33), F.expr("_id & 8589934591")
    ranges = ranges.withColumn("_part", part)
    sizes = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranges.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn("seq", F.col("_before") + place + 1).drop("_id", "_part", "_before")


_APPENDED = "(SELECT event_id, 100 + row_number() OVER (ORDER BY ts, event_id) AS seq FROM events)"


@query(f"SELECT event_id, seq, 2 AS segment FROM {_APPENDED}")
def stream_append(spark: SparkSession, d: str) -> DataFrame:
    """New events get numbers in their order after the last one, in the current segment (ST1, SK8, WN1)."""
    new = numbered(table(spark, d, "events").select("event_id", "ts"), "ts", "event_id")
    return new.select("event_id", (F.col("seq") + 100).alias("seq"), F.lit(2).alias("segment"))


_EV = "(SELECT event_id AS seq, (event_id * 7919) % 1009 AS txid, user_id, event_type, ts FROM events)"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.expr("(event_id * 7919) % 1009").alias("txid"), "user_id", "event_type", "ts")


@query(f"""SELECT t AS tick, min(txid) FILTER (txid % 97 = 5 AND txid >= t * 200) AS xmin, t * 200 + 200 AS xmax, coalesce(list(DISTINCT txid ORDER BY txid) FILTER (txid % 97 = 5 AND txid >= t * 200 AND txid < t * 200 + 200), []) AS xip,
 max(seq) FILTER (txid < t * 200 + 200 AND txid % 97 <> 5) AS max_seq FROM {_EV}, (SELECT unnest([0, 1, 2, 3, 4]) AS t) GROUP BY t""")
def make_ticks(spark: SparkSession, d: str) -> DataFrame:
    """A tick is a snapshot: the oldest open transaction, the next one, the open ones in between, and the last number seen (ST2, AG6)."""
    rows = events(spark, d).withColumn("t", F.explode(F.array(*map(F.lit, range(5)))))  # five ticks
    start, end = F.col("t") * 200, F.col("t") * 200 + 200
    open_ = (F.col("txid") % 97 == 5) & (F.col("txid") >= start)
    sums = rows.groupBy(F.col("t").alias("tick")).agg(
        F.min(F.when(open_, F.col("txid"))).alias("xmin"), F.sort_array(F.collect_set(F.when(open_ & (F.col("txid") < end), F.col("txid")))).alias("xip"),
        F.max(F.when((F.col("txid") < end) & (F.col("txid") % 97 != 5), F.col("seq"))).alias("max_seq"),
    )
    return sums.select("tick", "xmin", (F.col("tick") * 200 + 200).alias("xmax"), "xip", "max_seq")


#: Fixed cases of a receive: consumer, cursor tick, next tick, active batch or none, limit.
_ASKS = "('idle', 3, 4, NULL, 100000), ('busy', 1, 2, 17, 100), ('small', 0, 1, NULL, 1), ('done', 5, 5, NULL, 0)"


@query(f"""WITH c AS (SELECT * FROM (VALUES {_ASKS}) v(consumer, last_tick, next_tick, active, most)), n AS (SELECT consumer, count(*) AS seen FROM c JOIN {_EV} ON txid >= last_tick * 200 AND txid < next_tick * 200 GROUP BY consumer)
 SELECT consumer, CASE WHEN active IS NOT NULL THEN 'active' WHEN coalesce(seen, 0) = 0 THEN 'empty' WHEN seen > least(CASE WHEN most <= 0 THEN 100 ELSE most END, 100000) THEN 'over limit' ELSE 'batch' END AS outcome,
 CASE WHEN active IS NULL THEN coalesce(seen, 0) END AS events, CASE WHEN active IS NULL AND coalesce(seen, 0) = 0 THEN next_tick ELSE last_tick END AS cursor FROM c LEFT JOIN n USING (consumer)""")
def receive(spark: SparkSession, d: str) -> DataFrame:
    """What a consumer gets: the batch it still has, else what its end tick sees and its
    start tick doesn't, all of it or an error; an empty window moves the cursor (ST4)."""
    asks = spark.sql(f"SELECT * FROM VALUES {_ASKS} AS v(consumer, last_tick, next_tick, active, most)")
    per_tick = events(spark, d).groupBy(F.expr("txid div 200").alias("tick")).agg(F.count(F.lit(1)).alias("n"))
    spans = asks.select("consumer", F.explode(F.expr("case when last_tick < next_tick then sequence(last_tick, next_tick - 1) else array() end")).alias("tick"))
    seen = spans.join(per_tick, "tick").groupBy("consumer").agg(F.sum("n").alias("seen"))
    rows = asks.join(seen, "consumer", "left").withColumn("seen", F.coalesce("seen", F.lit(0).cast("bigint")))
    most = F.least(F.when(F.col("most") <= 0, 100).otherwise(F.col("most")), F.lit(100_000))
    free = F.col("active").isNull()
    outcome = F.when(~free, "active").when(F.col("seen") == 0, "empty").when(F.col("seen") > most, "over limit").otherwise("batch")
    return rows.select("consumer", outcome.alias("outcome"), F.when(free, F.col("seen")).alias("events"), F.when(free & (F.col("seen") == 0), F.col("next_tick")).otherwise(F.col("last_tick")).alias("cursor"))


_SUBS = "(SELECT c_custkey AS consumer, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE c_custkey % 50 END AS asked FROM customer)"


@query(f"""WITH t AS (SELECT DISTINCT event_id // 40 AS tick FROM events WHERE event_id // 40 % 7 <> 3)
 SELECT consumer, asked, CASE WHEN asked IS NULL THEN (SELECT max(tick) FROM t) WHEN asked = 0 THEN (SELECT min(tick) FROM t) ELSE t.tick END AS cursor,
 CASE WHEN asked > 0 AND t.tick IS NULL THEN 'no such tick' ELSE 'ok' END AS outcome FROM {_SUBS} s LEFT JOIN t ON t.tick = s.asked""")
def subscribe(spark: SparkSession, d: str) -> DataFrame:
    """A subscription starts at the latest tick, at the earliest, or at one that must exist (ST3)."""
    tick = F.expr("event_id div 40")
    ticks = table(spark, d, "events").filter(tick % 7 != 3).select(tick.alias("asked")).distinct()
    ends = ticks.agg(F.min("asked").alias("lo"), F.max("asked").alias("hi"))  # one row
    k = F.col("c_custkey")
    subs = table(spark, d, "customer").select(k.alias("consumer"), F.when(k % 3 == 1, 0).when(k % 3 == 2, k % 50).alias("asked"))
    rows = subs.join(ticks.withColumn("tick", F.col("asked")), "asked", "left").crossJoin(F.broadcast(ends))
    cursor = F.when(F.col("asked").isNull(), F.col("hi")).when(F.col("asked") == 0, F.col("lo")).otherwise(F.col("tick"))
    return rows.select("consumer", "asked", cursor.alias("cursor"), F.when((F.col("asked") > 0) & F.col("tick").isNull(), "no such tick").otherwise("ok").alias("outcome"))


@query("""WITH a AS (SELECT o_custkey % 100 AS consumer, nullif('m' || o_orderkey % 4, 'm0') AS member, o_orderkey AS batch, o_orderstatus = 'O' AS open FROM orders),
 g AS (SELECT consumer, member, min(batch) FILTER (open) AS active, count(*) AS asked FROM a GROUP BY consumer, member)
 SELECT consumer, member, active, asked, CASE WHEN member IS NULL AND bool_or(member IS NOT NULL) OVER (PARTITION BY consumer) THEN 'refused' WHEN active IS NOT NULL THEN 'active' ELSE 'new' END AS outcome FROM g""")
def receive_coop(spark: SparkSession, d: str) -> DataFrame:
    """Members of a consumer each have one batch at a time; once there are members, a receive without a name is refused (ST5)."""
    k = F.col("o_orderkey") % 4
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("consumer"), F.when(k != 0, F.concat(F.lit("m"), k)).alias("member"), F.col("o_orderkey").alias("batch"), (F.col("o_orderstatus") == "O").alias("open"))
    g = rows.groupBy("consumer", "member").agg(F.min(F.when(F.col("open"), F.col("batch"))).alias("active"), F.count(F.lit(1)).alias("asked"))
    named = F.bool_or(F.col("member").isNotNull()).over(Window.partitionBy("consumer"))  # a consumer's few members
    return g.select("consumer", "member", "active", "asked", F.when(F.col("member").isNull() & named, "refused").when(F.col("active").isNotNull(), "active").otherwise("new").alias("outcome"))


_BATCH = "(SELECT c_nationkey AS consumer, c_custkey AS batch, c_custkey AS start_tick, c_custkey + 25 AS end_tick, c_custkey % 175 < 160 AS acked FROM customer)"


@query(f"""WITH RECURSIVE b AS (SELECT * FROM {_BATCH}), c AS (SELECT consumer, min(start_tick) AS tick FROM b GROUP BY consumer),
 chain AS (SELECT consumer, tick FROM c UNION ALL SELECT b.consumer, b.end_tick FROM chain JOIN b ON b.consumer = chain.consumer AND b.start_tick = chain.tick AND b.acked)
 SELECT consumer, max(tick) AS cursor, count(*) - 1 AS chained FROM chain GROUP BY consumer""")
def ack_ticks(spark: SparkSession, d: str) -> DataFrame:
    """A cursor moves over acked batches as long as each starts where the one before ended (ST7, JN15)."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("consumer"), k.alias("start_tick"), (k + 25).alias("end_tick"), (k % 175 < 160).alias("acked"))
    return chained(rows)


def chained(batches: DataFrame) -> DataFrame:
    """consumer, cursor, chained: from each consumer's first tick over acked batches that
    follow each other. Ways are doubled in each round, so a chain of n batches takes
    about log2(n) joins; each round is written, so none is made again."""
    root = folder(batches.sparkSession)

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return batches.sparkSession.read.parquet(f"{root}/{name}")

    first = batches.groupBy("consumer").agg(F.min("start_tick").alias("cursor"))
    step = batches.filter("acked").select("consumer", F.col("start_tick").alias("from"), F.col("end_tick").alias("to"), F.lit(1).cast("bigint").alias("n"))
    rounds = max(1, (batches.groupBy("consumer").count().agg(F.max("count")).first()[0] or 1).bit_length())
    at_ = first.withColumn("chained", F.lit(0).cast("bigint"))
    jumps = [saved(step, "0")]
    for k in range(1, rounds):
        s = jumps[-1]
        t = s.select("consumer", F.col("from").alias("to"), F.col("to").alias("then"), F.col("n").alias("more"))
        jumps.append(saved(s.join(t, ["consumer", "to"]).select("consumer", "from", F.col("then").alias("to"), (F.col("n") + F.col("more")).alias("n")), str(k)))
    for j in reversed(jumps):  # the longest way first
        at_ = at_.join(j.withColumnRenamed("from", "cursor"), ["consumer", "cursor"], "left").select("consumer", F.coalesce("to", "cursor").alias("cursor"), (F.col("chained") + F.coalesce("n", F.lit(0))).alias("chained"))
    return at_


_RETRY = "(SELECT event_id, event_id % 8 + 1 AS next_retry, ts, user_id FROM events WHERE event_type = 'error')"


@query(f"""WITH due AS (SELECT event_id, next_retry, ts + INTERVAL 60 SECOND AS due FROM {_RETRY} WHERE next_retry <= 5 AND ts + INTERVAL 60 SECOND <= TIMESTAMP '{_NOW}' ORDER BY due, event_id LIMIT 200)
 SELECT event_id, next_retry AS retry_count, (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY due, event_id) AS seq FROM due""")
def retries_appended(spark: SparkSession, d: str) -> DataFrame:
    """Due retries, the oldest first, come again as new events with their count (ST9)."""
    e = table(spark, d, "events")
    rows = e.filter("event_type = 'error'").select("event_id", (F.col("event_id") % 8 + 1).alias("retry_count"), F.expr("ts + interval 60 seconds").alias("due"))
    due = rows.filter((F.col("retry_count") <= 5) & (F.col("due") <= at(_NOW))).orderBy("due", "event_id").limit(200)
    last = e.agg(F.max("event_id").alias("last"))  # one row
    w = Window.orderBy("due", "event_id")  # of the 200 rows
    return due.withColumn("k", F.row_number().over(w)).crossJoin(F.broadcast(last)).select("event_id", "retry_count", (F.col("last") + F.col("k")).alias("seq"))


@query(f"""SELECT event_id, CASE WHEN ts < TIMESTAMP '{_NOW}' - INTERVAL 12 DAY THEN 'purged' WHEN user_id % 4 = 1 THEN 'replayed' ELSE 'kept' END AS outcome,
 CASE WHEN outcome = 'replayed' THEN 0 WHEN outcome = 'kept' THEN next_retry END AS retry_count FROM {_RETRY} WHERE next_retry > 5""")
def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """Dead letters: old ones are purged, those asked for are delivered again with a count of 0, others stay (ST10)."""
    rows = table(spark, d, "events").filter("event_type = 'error'").withColumn("next_retry", F.col("event_id") % 8 + 1).filter("next_retry > 5")
    outcome = F.when(F.col("ts") < at("2024-01-08 00:00:00"), "purged").when(F.col("user_id") % 4 == 1, "replayed").otherwise("kept")
    return rows.withColumn("outcome", outcome).select("event_id", "outcome", F.when(F.col("outcome") == "replayed", 0).when(F.col("outcome") == "kept", F.col("next_retry")).cast("bigint").alias("retry_count"))


_SEG = f"(SELECT user_id % 3 AS segment, count(*) AS events, min(ts) AS started, bool_or(user_id % 30 = 7) AS pinned FROM events GROUP BY 1)"


@query(f"""SELECT segment, (segment + 1) % 3 AS target, events, pinned, CASE WHEN started + INTERVAL 3 DAY > TIMESTAMP '{_NOW}' THEN 'early' WHEN (SELECT t.pinned AND t.events > 0 FROM {_SEG} t WHERE t.segment = (s.segment + 1) % 3) THEN 'refused' ELSE 'rotated' END AS outcome FROM {_SEG} s""")
def rotate(spark: SparkSession, d: str) -> DataFrame:
    """Three segments in turn: after half of the retention the next one is emptied and
    used, unless a consumer still needs what is in it (ST11)."""
    s = table(spark, d, "events").groupBy((F.col("user_id") % 3).alias("segment")).agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("started"), F.bool_or(F.col("user_id") % 30 == 7).alias("pinned"))
    target = s.select(F.col("segment").alias("target"), (F.col("pinned") & (F.col("events") > 0)).alias("held"))
    rows = s.withColumn("target", (F.col("segment") + 1) % 3).join(F.broadcast(target), "target", "left")  # three rows
    outcome = F.when(F.col("started") + F.expr("interval 3 days") > at(_NOW), "early").when(F.col("held"), "refused").otherwise("rotated")
    return rows.select("segment", "target", "events", "pinned", outcome.alias("outcome"))


@query(f"""SELECT count(*) AS events, max(seq) AS max_seq, min(ts) AS oldest, max(ts) AS newest, count(DISTINCT user_id % 3) AS segments, (SELECT count(DISTINCT event_id // 40) FROM events) AS ticks, (SELECT max(event_id // 40) FROM events) AS last_tick,
 (SELECT count(*) FROM customer) AS subscriptions, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS active_batches, (SELECT count(*) FROM {_RETRY} WHERE next_retry <= 5) AS retries, (SELECT count(*) FROM {_RETRY} WHERE next_retry > 5) AS dead FROM {_EV}""")
def stream_totals(spark: SparkSession, d: str) -> DataFrame:
    """All eleven figures of a stream in one row (AG5, ST14)."""
    count = lambda name, by, where="true": table(spark, d, name).filter(where).agg(F.count(F.lit(1)).alias(by))
    error, again = F.col("event_type") == "error", F.col("event_id") % 8 + 1
    e = table(spark, d, "events").agg(
        F.count(F.lit(1)).alias("events"), F.max("event_id").alias("max_seq"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.countDistinct(F.col("user_id") % 3).alias("segments"),
        F.countDistinct(F.expr("event_id div 40")).alias("ticks"), F.max(F.expr("event_id div 40")).alias("last_tick"), F.count_if(error & (again <= 5)).alias("retries"), F.count_if(error & (again > 5)).alias("dead"),
    )
    return e.crossJoin(count("customer", "subscriptions")).crossJoin(count("orders", "active_batches", "o_orderstatus = 'O'"))  # one row each
