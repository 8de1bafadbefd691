"""The life of a job: events with clocks and attempts, lease checks, heartbeats, bounded expiry, appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import at
from ..registry import query, table

NOW = "1998-01-01 00:00:00"
_NOW = f"TIMESTAMP '{NOW}'"

#: Orders as jobs with every column that a state change reads.
_JOB = """(SELECT o_orderkey AS seq, o_orderstatus AS queue,
 ['pending', 'scheduled', 'available', 'active', 'retryable', 'completed', 'cancelled', 'discarded'][o_orderkey % 8 + 1] AS state,
 (o_orderkey // 8 % 4)::INT AS attempt, 3 AS max_attempts, o_orderdate AS scheduled_at, o_orderdate + INTERVAL 30 DAY AS expires_at,
 'lease-' || o_custkey % 7 AS lease, o_orderdate + INTERVAL 600 DAY AS lease_until,
 CASE WHEN o_orderkey % 8 = 5 THEN o_orderdate + INTERVAL 1 DAY END AS completed_at, CASE WHEN o_orderkey % 8 = 6 THEN o_orderdate + INTERVAL 2 DAY END AS cancelled_at,
 CASE WHEN o_orderkey % 8 = 7 THEN o_orderdate + INTERVAL 3 DAY END AS discarded_at, o_orderdate AS created_at FROM orders)"""
STATES = ("pending", "scheduled", "available", "active", "retryable", "completed", "cancelled", "discarded")


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as jobs."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    after = lambda days, state: F.when(k % 8 == state, day + F.make_dt_interval(F.lit(days)))
    return table(spark, d, "orders").select(
        k.alias("seq"), F.col("o_orderstatus").alias("queue"), F.element_at(F.array(*map(F.lit, STATES)), (k % 8 + 1).cast("int")).alias("state"),
        F.expr("int(o_orderkey div 8 % 4)").alias("attempt"), F.lit(3).alias("max_attempts"), day.alias("scheduled_at"), (day + F.make_dt_interval(F.lit(30))).alias("expires_at"),
        F.concat(F.lit("lease-"), F.col("o_custkey") % 7).alias("lease"), (day + F.make_dt_interval(F.lit(600))).alias("lease_until"),
        after(1, 5).alias("completed_at"), after(2, 6).alias("cancelled_at"), after(3, 7).alias("discarded_at"), day.alias("created_at"),
    )


#: Event, states that take it.
SOURCES = (
    ("enqueue", "new"),
    ("schedule_due", "scheduled retryable"),
    ("lease", "available"),
    ("lease_expired", "active"),
    ("ack", "active"),
    ("nack", "active"),
    ("heartbeat", "active"),
    ("cancel", "scheduled available pending active retryable"),
    ("expire", "scheduled available retryable"),
)


def transition(event: Column, state: Column, attempt: Column, most: Column, scheduled: Column, expires: Column, now: Column, retryable: Column) -> Column:
    """state and attempt after an event, null where the event is refused: from a state
    that doesn't take it, or before its clock."""
    takes = F.lit(False)
    for name, states in SOURCES:
        takes = takes | ((event == name) & state.isin(states.split()))
    due, over, more = scheduled <= now, expires <= now, attempt < most
    early = ((event == "schedule_due") & ~F.coalesce(due, F.lit(False))) | ((event == "expire") & ~F.coalesce(over, F.lit(False)))
    after = (
        F.when(event == "enqueue", F.when(scheduled > now, "scheduled").otherwise("available"))
        .when(event == "schedule_due", "available")
        .when(event == "lease", "active")
        .when(event == "lease_expired", F.when(more, "available").otherwise("discarded"))
        .when(event == "ack", "completed")
        .when(event == "nack", F.when(retryable & more, "retryable").otherwise("discarded"))
        .when(event == "cancel", "cancelled")
        .when(event == "expire", "discarded")
        .otherwise(state)
    )
    tried = F.when((event == "lease") & (attempt == 0), 1).when(more & ((event == "lease_expired") | ((event == "nack") & retryable)), attempt + 1).otherwise(attempt)
    return F.when(takes & ~early, F.struct(after.alias("state"), tried.alias("attempt")))


_EVENTS = "['enqueue', 'schedule_due', 'lease', 'lease_expired', 'ack', 'nack', 'heartbeat', 'cancel', 'expire']"


@query(f"""WITH a AS (SELECT *, unnest({_EVENTS}) AS event FROM {_JOB}), b AS (SELECT * REPLACE (CASE WHEN event = 'enqueue' AND state = 'pending' THEN 'new' ELSE state END AS state), seq % 5 <> 0 AS again FROM a)
 SELECT seq, event, state, CASE
  WHEN event = 'enqueue' THEN CASE WHEN state = 'new' THEN CASE WHEN scheduled_at > {_NOW} THEN 'scheduled' ELSE 'available' END END
  WHEN event = 'schedule_due' THEN CASE WHEN state IN ('scheduled', 'retryable') AND scheduled_at <= {_NOW} THEN 'available' END
  WHEN event = 'lease' THEN CASE WHEN state = 'available' THEN 'active' END
  WHEN event = 'cancel' THEN CASE WHEN state NOT IN ('new', 'completed', 'cancelled', 'discarded') THEN 'cancelled' END
  WHEN event = 'expire' THEN CASE WHEN state IN ('scheduled', 'available', 'retryable') AND expires_at <= {_NOW} THEN 'discarded' END
  WHEN state <> 'active' THEN NULL WHEN event = 'ack' THEN 'completed' WHEN event = 'heartbeat' THEN 'active'
  WHEN event = 'lease_expired' THEN CASE WHEN attempt < 3 THEN 'available' ELSE 'discarded' END
  WHEN event = 'nack' THEN CASE WHEN again AND attempt < 3 THEN 'retryable' ELSE 'discarded' END END AS next,
  CASE WHEN event = 'lease' AND state = 'available' THEN greatest(attempt, 1) WHEN state = 'active' AND attempt < 3 AND (event = 'lease_expired' OR event = 'nack' AND again) THEN attempt + 1
  WHEN next IS NOT NULL THEN attempt END AS tries FROM b""")
def job_events(spark: SparkSession, d: str) -> DataFrame:
    """Each of the nine events on each job (JB3)."""
    names = [name for name, _ in SOURCES]
    rows = jobs(spark, d).withColumn("event", F.explode(F.array(*map(F.lit, names))))
    state = F.when((F.col("event") == "enqueue") & (F.col("state") == "pending"), "new").otherwise(F.col("state"))
    rows = rows.withColumn("state", state)
    out = transition(*map(F.col, ("event", "state", "attempt", "max_attempts", "scheduled_at", "expires_at")), at(NOW), F.col("seq") % 5 != 0)
    return rows.withColumn("t", out).select("seq", "event", "state", F.col("t.state").alias("next"), F.col("t.attempt").alias("tries"))


#: Requests: every job is asked to ack, nack or cancel with the token of its own lease or a stale one.
_ASKED = "(SELECT *, ['ack', 'nack', 'cancel'][seq % 3 + 1] AS event, CASE WHEN seq % 11 = 0 THEN 'stale' ELSE lease END AS token FROM " + _JOB + ")"


@query(f"""SELECT seq, event, CASE WHEN event = 'cancel' THEN CASE WHEN state IN ('completed', 'cancelled', 'discarded') THEN 'conflict' ELSE 'ok' END
 WHEN state <> 'active' THEN 'conflict' WHEN token <> lease OR lease_until <= {_NOW} THEN 'stale' ELSE 'ok' END AS outcome,
 CASE WHEN outcome <> 'ok' THEN state WHEN event = 'ack' THEN 'completed' WHEN event = 'cancel' THEN 'cancelled' WHEN attempt < 3 THEN 'retryable' ELSE 'discarded' END AS state,
 CASE WHEN outcome = 'ok' AND event = 'nack' AND attempt < 3 THEN least(60000, 1000 * (CASE attempt WHEN 2 THEN 2 ELSE 1 END)) END::BIGINT AS delay_ms FROM {_ASKED}""")
def job_mutate(spark: SparkSession, d: str) -> DataFrame:
    """Ack, nack and cancel: a state that refuses is a conflict; ack and nack also need
    the lease's own token before its end; the delay counts the attempt before (JB4)."""
    rows = jobs(spark, d).withColumn("event", F.element_at(F.array(*map(F.lit, ("ack", "nack", "cancel"))), (F.col("seq") % 3 + 1).cast("int")))
    rows = rows.withColumn("token", F.when(F.col("seq") % 11 == 0, "stale").otherwise(F.col("lease")))
    return mutated(rows, at(NOW)).select("seq", "event", "outcome", "state", "delay_ms")


def mutated(rows: DataFrame, now: Column, initial_ms: int = 1000, factor: float = 2.0, most_ms: int = 60_000) -> DataFrame:
    """Adds outcome and delay_ms, and replaces state and attempt, of jobs that are asked for an ``event`` with a ``token``."""
    after = transition(*map(F.col, ("event", "state", "attempt", "max_attempts", "scheduled_at", "expires_at")), now, F.lit(True))
    stale = (F.col("event") != "cancel") & ~F.coalesce((F.col("token") == F.col("lease")) & (F.col("lease_until") > now), F.lit(False))
    rows = rows.withColumn("t", after).withColumn("outcome", F.when(F.col("t").isNull(), "conflict").when(stale, "stale").otherwise("ok"))
    wait = F.least(F.lit(float(most_ms)), initial_ms * F.pow(F.lit(factor), F.greatest("attempt", F.lit(1)) - 1))
    ok = F.col("outcome") == "ok"
    rows = rows.withColumn("delay_ms", F.when(ok & (F.col("t.state") == "retryable"), F.round(wait)).cast("bigint"))
    return rows.withColumn("state", F.when(ok, F.col("t.state")).otherwise(F.col("state"))).withColumn("attempt", F.when(ok, F.col("t.attempt")).otherwise(F.col("attempt"))).drop("t")


@query(f"""WITH asked AS (SELECT o_custkey % 200 AS call, o_orderkey AS seq, o_orderkey % 97 <> 3 AS fresh FROM orders WHERE o_orderkey % 8 = 3 UNION ALL SELECT 1000, -1, true),
 found AS (SELECT call, a.seq, queue, state = 'active' AND fresh AND lease_until > {_NOW} - INTERVAL 900 DAY AS valid FROM asked a LEFT JOIN {_JOB} j USING (seq))
 SELECT call, count(*) AS jobs, count(DISTINCT queue) AS queues, bool_and(coalesce(valid, false)) AS extended FROM found GROUP BY call""")
def heartbeat_call(spark: SparkSession, d: str) -> DataFrame:
    """A call extends all of its leases, over any number of queues, or none: one
    unknown job, wrong state or stale lease refuses it (JB5, X16)."""
    asked = table(spark, d, "orders").filter("o_orderkey % 8 = 3").select((F.col("o_custkey") % 200).alias("call"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 97 != 3).alias("fresh"))
    asked = asked.unionByName(spark.createDataFrame([(1000, -1, True)], "call long, seq long, fresh boolean"))
    return extended(asked, jobs(spark, d), at("1995-07-16 00:00:00"))


def extended(asked: DataFrame, known: DataFrame, now: Column) -> DataFrame:
    """call, jobs, queues, extended of heartbeats for the jobs that each call names."""
    found = asked.join(known.select("seq", "queue", "state", "lease_until"), "seq", "left")
    valid = F.coalesce((F.col("state") == "active") & F.col("fresh") & (F.col("lease_until") > now), F.lit(False))
    return found.groupBy("call").agg(F.count(F.lit(1)).alias("jobs"), F.countDistinct("queue").alias("queues"), F.bool_and(valid).alias("extended"))


_ENDED = "coalesce(completed_at, cancelled_at, discarded_at, created_at)"
_OLD = f"(expires_at <= {_NOW} AND seq % 10 = 1 OR state IN ('completed', 'cancelled', 'discarded') AND {_ENDED} <= {_NOW} - INTERVAL 400 DAY)"


@query(f"SELECT seq, state FROM {_JOB} WHERE seq NOT IN (SELECT seq FROM {_JOB} WHERE {_OLD} ORDER BY {_ENDED}, seq LIMIT 4096)")
def expire_bounded(spark: SparkSession, d: str) -> DataFrame:
    """What is left after the oldest expired or ended jobs went, a bounded number at a time (JB6, JN16)."""
    rows = jobs(spark, d).withColumn("expires_at", F.when(F.col("seq") % 10 == 1, F.col("expires_at")))
    gone = ended(rows, at(NOW), 400).orderBy("ended", "seq").limit(4096).select("seq")
    return rows.join(gone, "seq", "left_anti").select("seq", "state")


def ended(rows: DataFrame, now: Column, keep_days: int) -> DataFrame:
    """Jobs past their expiry, or ended for longer than they are kept, with when they ended."""
    moment = F.coalesce("completed_at", "cancelled_at", "discarded_at", "created_at")
    old = F.col("state").isin("completed", "cancelled", "discarded") & (moment <= now - F.make_dt_interval(F.lit(keep_days)))
    return rows.withColumn("ended", moment).filter(F.coalesce(F.col("expires_at") <= now, F.lit(False)) | old)


@query(f"""SELECT queue, count(*) FILTER (state = 'available') AS available, count(*) FILTER (state = 'scheduled') AS scheduled, count(*) FILTER (state = 'active') AS active,
 count(*) FILTER (state = 'retryable') AS retryable, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'cancelled') AS cancelled,
 count(*) FILTER (state = 'discarded') AS discarded, count(*) AS total FROM {_JOB} GROUP BY queue""")
def queue_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all seven states and in total (AG1)."""
    states = ("available", "scheduled", "active", "retryable", "completed", "cancelled", "discarded")
    return jobs(spark, d).groupBy("queue").agg(*[F.count_if(F.col("state") == s).alias(s) for s in states], F.count(F.lit(1)).alias("total"))


@query("""WITH new AS (SELECT o_custkey AS id, min(o_orderkey) AS first, count(*) AS times FROM orders WHERE o_orderkey % 3 = 1 GROUP BY o_custkey)
 SELECT id, CASE WHEN times > 1 OR c_custkey IS NOT NULL THEN 'duplicate' ELSE 'added' END AS outcome, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) + CASE WHEN (SELECT bool_or(n.times > 1
 OR n.id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)) FROM new n) THEN 0 ELSE (SELECT count(*) FROM new) END AS jobs_after FROM new LEFT JOIN customer ON c_custkey = id AND c_custkey % 2 = 0""")
def enqueue_batch(spark: SparkSession, d: str) -> DataFrame:
    """A batch is added as a whole or, where an id is known or repeated, not at all (JB1)."""
    known = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit(True).alias("known"))
    new = table(spark, d, "orders").filter("o_orderkey % 3 = 1").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("times"))
    marked = new.join(known, "id", "left").withColumn("bad", F.col("known").isNotNull() | (F.col("times") > 1))
    sums = marked.agg(F.bool_or("bad").alias("refused"), F.count(F.lit(1)).alias("new")).crossJoin(known.agg(F.count(F.lit(1)).alias("old")))  # one row
    after = F.col("old") + F.when(F.col("refused"), 0).otherwise(F.col("new"))
    return marked.crossJoin(F.broadcast(sums)).select("id", F.when(F.col("bad"), "duplicate").otherwise("added").alias("outcome"), after.alias("jobs_after"))
