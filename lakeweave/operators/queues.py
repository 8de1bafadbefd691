"""Job queues: staging, claims, transitions, leases, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import at, backoff
from ..registry import query, table
from .jobs import SOURCES, STATES

_NOW = "1998-01-01 00:00:00"
_JOBS = f"""(SELECT o_orderkey AS seq, o_orderstatus AS queue, CAST(split_part(o_orderpriority, '-', 1) AS INT) AS priority, o_orderdate AS visible,
 ['available', 'scheduled', 'active', 'completed'][o_orderkey % 4 + 1] AS state, (o_orderkey % 5)::INT AS attempt FROM orders)"""
_DUE = f"state <> 'completed' AND visible <= TIMESTAMP '{_NOW}' AND NOT (state = 'active' AND attempt >= 3)"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as jobs."""
    state = F.element_at(F.array(*map(F.lit, ("available", "scheduled", "active", "completed"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("queue"), F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).cast("int").alias("priority"), F.col("o_orderdate").alias("visible"), state.alias("state"), (F.col("o_orderkey") % 5).cast("int").alias("attempt"))


def due(rows: DataFrame, now: str) -> DataFrame:
    """Jobs that a worker may claim: visible, not ended, not out of attempts."""
    return rows.filter((F.col("state") != "completed") & (F.col("visible") <= at(now)) & ~((F.col("state") == "active") & (F.col("attempt") >= 3)))


def claimed(rows: DataFrame) -> DataFrame:
    """A claimed job's next row."""
    attempt = F.when(F.col("state") == "active", F.col("attempt") + 1).otherwise(F.greatest("attempt", F.lit(1)))
    return rows.select("seq", "queue", "priority", attempt.alias("attempt"), F.lit("active").alias("state"))


_NEXT = "CASE WHEN state = 'active' THEN attempt + 1 ELSE greatest(attempt, 1) END AS attempt, 'active' AS state"


@query(f"SELECT seq, queue, priority, {_NEXT} FROM {_JOBS} WHERE queue = 'O' AND {_DUE} ORDER BY priority DESC, visible, seq LIMIT 25")
def claim_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = due(jobs(spark, d).filter("queue = 'O'"), _NOW)
    return claimed(rows.orderBy(F.desc("priority"), "visible", "seq").limit(25))


@query(f"SELECT seq, queue, priority, {_NEXT} FROM {_JOBS} WHERE queue IN ('P', 'F') AND {_DUE} ORDER BY queue = 'F', priority DESC, visible, seq LIMIT 2000")
def claim_multi(spark: SparkSession, d: str) -> DataFrame:
    order = F.create_map(F.lit("P"), F.lit(0), F.lit("F"), F.lit(1))  # queues in the order asked for
    rows = due(jobs(spark, d).filter(F.col("queue").isin("P", "F")), _NOW)
    return claimed(rows.orderBy(order[F.col("queue")], F.desc("priority"), "visible", "seq").limit(2000))


@query("""SELECT o_orderkey AS seq, CASE WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN 'scheduled' ELSE 'available' END AS state, 3 AS max_attempts,
 CASE WHEN o_orderkey % 3 = 0 THEN 1000 ELSE (o_orderkey % 3) * 10 END::INT AS retry_initial_ms, CASE WHEN o_orderkey % 4 < 1 THEN 2.0::DOUBLE ELSE (o_orderkey % 4)::DOUBLE END AS retry_coefficient FROM orders""")
def job_stage(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    given = table(spark, d, "orders").select(k.alias("seq"), "o_orderdate", ((k % 3) * 10).alias("initial"), (k % 4).cast("double").alias("factor"))
    return staged(given, _NOW)


def staged(rows: DataFrame, now: str) -> DataFrame:
    """New jobs with defaults filled in."""
    return rows.select("seq", F.when(F.col("o_orderdate") > at(now), "scheduled").otherwise("available").alias("state"), F.lit(3).alias("max_attempts"), F.when(F.col("initial") <= 0, 1000).otherwise(F.col("initial")).cast("int").alias("retry_initial_ms"), F.when(F.col("factor") < 1, 2.0).otherwise(F.col("factor")).alias("retry_coefficient"))


_TABLE = """('enqueue', 'new', 'available or scheduled'), ('schedule_due', 'scheduled', 'available'), ('schedule_due', 'retryable', 'available'), ('lease', 'available', 'active'),
 ('lease_expired', 'active', 'available or discarded'), ('ack', 'active', 'completed'), ('nack', 'active', 'retryable or discarded'), ('heartbeat', 'active', 'active'), ('cancel', 'scheduled', 'cancelled'), ('cancel', 'available', 'cancelled'),
 ('cancel', 'pending', 'cancelled'), ('cancel', 'active', 'cancelled'), ('cancel', 'retryable', 'cancelled'), ('expire', 'scheduled', 'discarded'), ('expire', 'available', 'discarded'), ('expire', 'retryable', 'discarded')"""
_WHO = "(SELECT o_orderkey AS seq, ['new', 'pending', 'scheduled', 'available', 'active', 'retryable', 'completed', 'cancelled', 'discarded'][o_orderkey % 9 + 1] AS state, ['enqueue', 'schedule_due', 'lease', 'lease_expired', 'ack', 'nack', 'heartbeat', 'cancel', 'expire'][o_orderkey // 9 % 9 + 1] AS event FROM orders)"


@query(f"SELECT seq, w.event, w.state, t.n AS next FROM {_WHO} w LEFT JOIN (VALUES {_TABLE}) t(e, s, n) ON t.e = w.event AND t.s = w.state")
def job_transition(spark: SparkSession, d: str) -> DataFrame:
    """Where each of the nine events may take a job; null where its state refuses it.
    ``jobs.transition`` gives the state itself, by clocks and attempts (JB3)."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % 9 + 1).cast("int"))
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("seq"), pick([e for e, _ in SOURCES], F.expr("o_orderkey div 9")).alias("event"), pick(("new", *STATES), k).alias("state"))
    ends = {"enqueue": "available or scheduled", "schedule_due": "available", "lease": "active", "lease_expired": "available or discarded", "ack": "completed", "nack": "retryable or discarded", "heartbeat": "active", "cancel": "cancelled", "expire": "discarded"}
    rules = spark.createDataFrame([(e, s, ends[e]) for e, states in SOURCES for s in states.split()], "event string, state string, next string")
    return rows.join(F.broadcast(rules), ["event", "state"], "left").select("seq", "event", "state", "next")  # a table of fixed size


@query("SELECT i AS attempt, CAST(round(least(60000.0, 1000.0 * pow(2.0, greatest(i, 1) - 1))) AS BIGINT) AS job_ms, CAST(round(least(300.0, 2.0 * pow(2.0, greatest(i, 1) - 1))) AS BIGINT) AS outbox_s FROM range(0, 21) t(i)", name="backoff")
def backoff_table(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("id")
    return spark.range(21).select(a.alias("attempt"), backoff(a, 1000, 2, 60_000).alias("job_ms"), backoff(a, 2, 2, 300).alias("outbox_s"))


@query(f"SELECT seq FROM {_JOBS} WHERE NOT (state = 'completed' AND visible < TIMESTAMP '1996-01-01')")
def expire_jobs(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).filter(~((F.col("state") == "completed") & (F.col("visible") < at("1996-01-01 00:00:00")))).select("seq")


@query(f"SELECT seq, CASE WHEN state = 'active' AND attempt >= 3 AND visible <= TIMESTAMP '{_NOW}' THEN 'discarded' ELSE state END AS state FROM {_JOBS}")
def discard_leases(spark: SparkSession, d: str) -> DataFrame:
    gone = (F.col("state") == "active") & (F.col("attempt") >= 3) & (F.col("visible") <= at(_NOW))
    return jobs(spark, d).select("seq", F.when(gone, "discarded").otherwise(F.col("state")).alias("state"))


@query(f"SELECT seq % 50 AS worker, bool_and(state = 'active' OR priority > 1) AS extended, count(*) AS n FROM {_JOBS} WHERE state <> 'completed' GROUP BY 1")
def heartbeat_gate(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).filter("state <> 'completed'").groupBy((F.col("seq") % 50).alias("worker")).agg(F.bool_and((F.col("state") == "active") | (F.col("priority") > 1)).alias("extended"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT seq FROM {_JOBS} WHERE NOT attempt = 4 AND visible <= TIMESTAMP '{_NOW}' AND state <> 'active' ORDER BY visible, queue, seq LIMIT 64")
def outbox_claim(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs(spark, d).filter((F.col("attempt") != 4) & (F.col("visible") <= at(_NOW)) & (F.col("state") != "active"))
    return rows.orderBy("visible", "queue", "seq").limit(64).select("seq")


def enqueue(current: DataFrame, new: DataFrame) -> DataFrame:
    """Appends jobs; an id that is there already fails the whole batch."""
    if new.join(current, "seq", "left_semi").limit(1).count() or new.groupBy("seq").count().filter("count > 1").limit(1).count():
        raise ValueError("a job id is there already")
    return current.unionByName(new)
