"""Key-value state, expiry, eviction, garbage and admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import at, chunks, live, not_deleted, written
from ..registry import AS_OF, query, table

_T = f"TIMESTAMP '{AS_OF}'"
_EXP = "ts + (user_id % 20) * INTERVAL 1 DAY"


def expiring(spark: SparkSession, d: str) -> DataFrame:
    """Events as entries with an expiry; every seventh has none."""
    e = table(spark, d, "events")
    return e.withColumn("expires", F.when(F.col("event_id") % 7 != 0, F.col("ts") + F.make_dt_interval(F.col("user_id").cast("int") % 20)))


_ENTRY = f"(SELECT *, CASE WHEN event_id % 7 <> 0 THEN {_EXP} END AS expires FROM events)"


@query(f"SELECT event_id FROM {_ENTRY} WHERE (expires IS NULL OR expires > {_T}) AND event_type <> 'click'")
def ttl_live(spark: SparkSession, d: str) -> DataFrame:
    tag = F.when(F.col("event_type") == "click", "deleted:1").otherwise("etag")
    return expiring(spark, d).filter(live(F.col("expires"), AS_OF) & not_deleted(tag)).select("event_id")


@query(f"SELECT event_id, CASE WHEN expires IS NULL THEN -1 WHEN expires <= {_T} THEN -2 ELSE (epoch_us(expires) - epoch_us({_T})) // 1000000 END::BIGINT AS ttl FROM {_ENTRY}")
def ttl_remaining(spark: SparkSession, d: str) -> DataFrame:
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    e = F.col("expires")
    return expiring(spark, d).select("event_id", F.when(e.isNull(), -1).when(e <= at(AS_OF), -2).otherwise(F.floor((us(e) - us(at(AS_OF))) / 1_000_000)).cast("bigint").alias("ttl"))


@query(f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN expires IS NULL WHEN 1 THEN expires IS NOT NULL WHEN 2 THEN coalesce(expires < {_T} + INTERVAL 5 DAY, false)
 ELSE coalesce(expires > {_T} + INTERVAL 5 DAY, true) END AS applied FROM {_ENTRY}""")
def expire_cond(spark: SparkSession, d: str) -> DataFrame:
    new = at(AS_OF) + F.make_dt_interval(F.lit(5))
    e, k = F.col("expires"), F.col("event_id") % 4
    # NX, XX, GT (an expiry must exist), LT (none counts as infinite)
    ok = F.when(k == 0, e.isNull()).when(k == 1, e.isNotNull()).when(k == 2, F.coalesce(e < new, F.lit(False))).otherwise(F.coalesce(e > new, F.lit(True)))
    return expiring(spark, d).select("event_id", ok.alias("applied"))


@query(f"SELECT event_id, coalesce(expires > {_T} AND epoch_us(expires) - epoch_us({_T}) < (epoch_us(expires) - epoch_us(ts)) / 2.0, false) AS touched FROM {_ENTRY}")
def touch_half(spark: SparkSession, d: str) -> DataFrame:
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    left, whole = us(F.col("expires")) - us(at(AS_OF)), us(F.col("expires")) - us(F.col("ts"))
    return expiring(spark, d).select("event_id", F.coalesce((left > 0) & (left < whole / 2), F.lit(False)).alias("touched"))


@query(f"SELECT event_id, expires FROM {_ENTRY} WHERE expires <= {_T} ORDER BY expires, event_id LIMIT 4096")
def expire_batch(spark: SparkSession, d: str) -> DataFrame:
    return expiring(spark, d).filter(F.col("expires") <= at(AS_OF)).select("event_id", "expires").orderBy("expires", "event_id").limit(4096)


@query("""WITH x AS (SELECT o_orderkey, o_custkey AS size, sum(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey) - o_custkey AS before FROM orders)
 SELECT o_orderkey FROM x WHERE before < (SELECT sum(size) FROM x) - (SELECT sum(size) * 9 // 10 FROM x)""")
def evict_budget(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("size"), "o_orderdate")
    used = orders.agg(F.sum("size")).first()[0]
    return evict(orders, "o_orderdate", "o_orderkey", used - used * 9 // 10).select("o_orderkey")


def evict(rows: DataFrame, moment: str, key: str, excess: int) -> DataFrame:
    """Oldest rows until ``excess`` is freed: sums of days first, then a running
    sum inside the days that matter, so no single task sorts all rows."""
    dated = rows.withColumn("day", F.to_date(moment))
    sums = dated.groupBy("day").agg(F.sum("size").alias("s"))
    ahead = F.coalesce(F.sum("s").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each day
    days = sums.select("day", ahead.alias("ahead")).filter(F.col("ahead") < excess)
    inside = F.sum("size").over(Window.partitionBy("day").orderBy(moment, key)) - F.col("size")
    return dated.join(days, "day").withColumn("before", F.col("ahead") + inside).filter(F.col("before") < excess)


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    last = F.max(F.struct("ts", "event_id", "value")).alias("x")  # combines before the shuffle
    return table(spark, d, "events").groupBy("user_id").agg(last).select("user_id", "x.event_id", "x.value")


@query("SELECT user_id, event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old, value AS new FROM events")
def upsert_old(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.lag("value").over(w).alias("old"), F.col("value").alias("new"))


_DEDUPE = "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts {0}, event_id {0}) AS r FROM events) WHERE r = 1"


@query(_DEDUPE.format("ASC"))
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("x")).select("user_id", "event_type", "x.event_id")


@query(_DEDUPE.format("DESC"))
def dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("x")).select("user_id", "event_type", "x.event_id")


@query("SELECT count(*) AS survivors, (SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE quality = 1) AS deleted FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def delete_many(spark: SparkSession, d: str) -> DataFrame:
    docs, keys = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    marked = docs.join(keys, "doc_id", "left")
    return marked.agg(F.count_if(F.col("quality").isNull()).alias("survivors"), F.count_if(F.col("quality") == 1).alias("deleted"))


@query("SELECT o_orderkey AS file_id FROM orders UNION ALL SELECT unnest([o_orderkey + 100000, o_orderkey + 200000]) FROM orders")
def dead_files(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey")
    return o.select(F.explode(F.array("o_orderkey", F.col("o_orderkey") + 100_000, F.col("o_orderkey") + 200_000)).alias("file_id"))


def unreferenced(files: DataFrame, *references: DataFrame) -> DataFrame:
    """Files that no reference names; array references come in exploded, so every join is an equality."""
    for r in references:
        files = files.join(r, "file_id", "left_anti")
    return files


_GARBAGE = """SELECT o_orderkey AS file_id FROM orders WHERE o_orderkey <> 0 AND o_orderkey NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)
 AND o_orderkey NOT IN (SELECT unnest([doc_id + 1, doc_id + 500]) FROM labels) AND o_orderkey NOT IN (SELECT conv_id FROM conversations)"""


def garbage(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "orders").filter("o_orderkey <> 0").select(F.col("o_orderkey").alias("file_id"), "o_orderdate")
    whole = table(spark, d, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("file_id"))
    parts = table(spark, d, "labels").select(F.explode(F.array(F.col("doc_id") + 1, F.col("doc_id") + 500)).alias("file_id"))
    return unreferenced(files, whole, parts, table(spark, d, "conversations").select(F.col("conv_id").alias("file_id")))


@query(_GARBAGE)
def garbage_anti(spark: SparkSession, d: str) -> DataFrame:
    return garbage(spark, d).select("file_id")


@query(f"{_GARBAGE} AND o_orderdate < TIMESTAMP '1997-01-01'")
def reapable(spark: SparkSession, d: str) -> DataFrame:
    return garbage(spark, d).filter("o_orderdate < timestamp_ntz'1997-01-01'").select("file_id")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY l_orderkey")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    kept = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")).join(gone, "l_orderkey", "left_anti")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).join(kept, "l_orderkey", "left_semi")


@query("SELECT user_id, CASE WHEN user_id % 10 = 3 THEN NULL ELSE CAST(100 + sum(event_id % 5) AS BIGINT) END AS value FROM events GROUP BY user_id")
def kv_incr(spark: SparkSession, d: str) -> DataFrame:
    deltas = table(spark, d, "events").groupBy("user_id").agg(F.sum(F.col("event_id") % 5).alias("d"))
    stored = F.when(F.col("user_id") % 10 == 3, "abc").otherwise(" 100 ")
    return deltas.withColumn("s", stored).select("user_id", F.expr("try_add(try_cast(trim(s) as bigint), d)").alias("value"))


@query("SELECT p_partkey, substr(rpad(p_name, 40, '.'), 1, 30) || 'XYZ' || substr(rpad(p_name, 40, '.'), 34) AS value FROM part")
def kv_setrange(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", written(F.rpad("p_name", 40, ".").cast("binary"), b"XYZ", 30).cast("string").alias("value"))


@query("SELECT user_id AS key, arg_min(event_id, (ts, event_id)) AS owner FROM events WHERE event_type = 'click' GROUP BY user_id")
def lease_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_type = 'click'").groupBy(F.col("user_id").alias("key")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("owner"))


@query("SELECT source, CAST(sum(n_chars) AS BIGINT) AS used, sum(n_chars) + 1000 > 120000 AS over FROM documents GROUP BY source")
def quota_check(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("used")).select("source", "used", (F.col("used") + 1000 > 120_000).alias("over"))


@query("SELECT source, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(*) AS objects, CAST(sum((octet_length(encode(text)) + 8119) // 8120) AS BIGINT) AS chunks FROM documents GROUP BY source")
def namespace_usage(spark: SparkSession, d: str) -> DataFrame:
    size = F.octet_length("text")
    return table(spark, d, "documents").groupBy("source").agg(F.sum(size).cast("bigint").alias("bytes"), F.count(F.lit(1)).alias("objects"), F.sum(chunks(size)).alias("chunks"))


_FACTS = "('lag', 5.0, 10.0, 60.0), ('dead', 3.0, 0.0, 100.0), ('connections', 190.0, 90.0, 100.0)"


@query(f"SELECT rule, CASE WHEN value > fail THEN 'FAIL' WHEN value > warn THEN 'WARN' ELSE 'PASS' END AS status FROM (VALUES {_FACTS}) v(rule, value, warn, fail)")
def doctor_rules(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return spark.sql(f"SELECT * FROM VALUES {_FACTS} AS v(rule, value, warn, fail)").select("rule", F.when(v > F.col("fail"), "FAIL").when(v > F.col("warn"), "WARN").otherwise("PASS").alias("status"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = d.n_chars % 2 WHERE l.doc_id IS NULL")
def guarded_delete(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).alias("version"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("bigint").alias("version")), ["doc_id", "version"], "left_anti").select("doc_id")


@query("SELECT o_orderkey, l.quality IS NOT NULL AS matched, CASE WHEN l.quality IS NULL THEN 'abandon' WHEN o_orderkey % 5 = 0 THEN 'dead' ELSE 'commit' END AS action FROM orders LEFT JOIN labels l ON doc_id = o_orderkey")
def outbox_commit(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "labels").select(F.col("doc_id").alias("o_orderkey"), "quality")
    rows = table(spark, d, "orders").select("o_orderkey").join(tokens, "o_orderkey", "left")
    hit = F.col("quality").isNotNull()
    return rows.select("o_orderkey", hit.alias("matched"), F.when(~hit, "abandon").when(F.col("o_orderkey") % 5 == 0, "dead").otherwise("commit").alias("action"))
