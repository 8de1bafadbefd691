"""Key-value commands with their options: each is a column function or a join over the table of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import at, live
from ..registry import AS_OF, query, table
from .keyvalue import _ENTRY, expiring

_T = f"TIMESTAMP '{AS_OF}'"
#: Entries by user: the latest event is the stored value; every third user's entry has no expiry.
_STORED = f"(SELECT user_id AS key, max(event_id) AS value, arg_max({{'e': expires}}, event_id).e AS expires FROM {_ENTRY} GROUP BY user_id)"


def stored(spark: SparkSession, d: str) -> DataFrame:
    """key, value, expires: the latest event of each user as an entry."""
    last = F.max(F.struct("event_id", "expires")).alias("x")
    return expiring(spark, d).groupBy(F.col("user_id").alias("key")).agg(last).select("key", F.col("x.event_id").alias("value"), "x.expires")


_LIVE = f"(expires IS NULL OR expires > {_T})"


@query(f"SELECT key, CASE WHEN {_LIVE} THEN length(value::VARCHAR) ELSE 0 END AS strlen, CASE WHEN {_LIVE} THEN 'string' ELSE 'none' END AS type, CASE WHEN {_LIVE} THEN value END AS value FROM (SELECT key, value, expires FROM {_STORED})")
def kv_get(spark: SparkSession, d: str) -> DataFrame:
    """GET, STRLEN and TYPE: an expired entry is as none (KV1)."""
    there = live(F.col("expires"), AS_OF)
    return stored(spark, d).select("key", F.when(there, F.length(F.col("value").cast("string"))).otherwise(0).cast("bigint").alias("strlen"), F.when(there, "string").otherwise("none").alias("type"), F.when(there, F.col("value")).alias("value"))


@query(f"""WITH asked AS (SELECT c_custkey % 300 AS key, c_custkey AS new, ['', 'NX', 'XX'][c_custkey % 3 + 1] AS cond, ['', 'KEEPTTL', 'EX', 'PXAT'][c_custkey % 4 + 1] AS ttl FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey % 300 ORDER BY c_custkey) = 1),
 m AS (SELECT a.*, s.value AS old, s.expires FROM asked a LEFT JOIN {_STORED} s ON s.key = a.key AND (s.expires IS NULL OR s.expires > {_T}))
 SELECT key, old, cond = '' OR (cond = 'NX') = (old IS NULL) AS applied, CASE WHEN applied THEN new ELSE old END AS value,
 CASE WHEN NOT applied THEN expires WHEN ttl = 'KEEPTTL' THEN expires WHEN ttl = 'EX' THEN {_T} + INTERVAL 90 SECOND WHEN ttl = 'PXAT' THEN TIMESTAMP '2024-02-01 00:00:00.250' END AS expires FROM m""")
def kv_set(spark: SparkSession, d: str) -> DataFrame:
    """SET with NX, XX, GET, KEEPTTL, EX and PXAT: the old value, whether the condition
    held, and the entry after it (KV3, KV4, SF12)."""
    c = table(spark, d, "customer").groupBy((F.col("c_custkey") % 300).alias("key")).agg(F.min("c_custkey").alias("new"))
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("new") % len(names) + 1).cast("int"))
    asked = c.withColumn("cond", pick("", "NX", "XX")).withColumn("ttl", pick("", "KEEPTTL", "EX", "PXAT"))
    now = stored(spark, d).filter(live(F.col("expires"), AS_OF)).select("key", F.col("value").alias("old"), "expires")
    m = asked.join(now, "key", "left")
    applied = (F.col("cond") == "") | ((F.col("cond") == "NX") == F.col("old").isNull())
    option = F.when(F.col("ttl") == "EX", expiry("EX", F.lit(90), AS_OF)).when(F.col("ttl") == "PXAT", expiry("PXAT", F.lit(1_706_745_600_250), AS_OF))
    after = F.when(~applied | (F.col("ttl") == "KEEPTTL"), F.col("expires")).otherwise(option)
    return m.select("key", "old", applied.alias("applied"), F.when(applied, F.col("new")).otherwise(F.col("old")).alias("value"), after.alias("expires"))


def expiry(option: str, amount: Column, as_of: str) -> Column:
    """The moment that EX or PX (from the clock on) or EXAT or PXAT (since 1970) names; null for another option or an amount under 1."""
    zone = lambda c: c.cast("timestamp_ntz")
    us = amount * (1_000_000 if option.startswith("EX") else 1000)
    base = F.lit(0) if option.endswith("AT") else F.unix_micros(at(as_of).cast("timestamp"))
    return F.when((amount >= 1) & F.lit(option in ("EX", "PX", "EXAT", "PXAT")), zone(F.timestamp_micros(base + us)))


_OPT = "unnest(['EX', 'PX', 'EXAT', 'PXAT', 'ZZ'])"


@query(f"""SELECT user_id, option, CASE WHEN n < 1 THEN NULL WHEN option = 'EX' THEN {_T} + n * INTERVAL 1 SECOND WHEN option = 'PX' THEN {_T} + n * INTERVAL 1 MILLISECOND
 WHEN option = 'EXAT' THEN make_timestamp(n * 1000000) WHEN option = 'PXAT' THEN make_timestamp(n * 1000) END AS expires FROM (SELECT user_id, n, {_OPT} AS option FROM (SELECT user_id, max(event_id) - 5 AS n FROM events GROUP BY user_id))""")
def expiry_option(spark: SparkSession, d: str) -> DataFrame:
    """An option and its amount as a moment (SF12)."""
    rows = table(spark, d, "events").groupBy("user_id").agg((F.max("event_id") - 5).alias("n"))
    each = [F.struct(F.lit(o).alias("option"), expiry(o, F.col("n"), AS_OF).alias("expires")) for o in ("EX", "PX", "EXAT", "PXAT", "ZZ")]
    return rows.select("user_id", F.explode(F.array(*each)).alias("x")).select("user_id", "x.option", "x.expires")


@query(f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '+PT' || event_id % 50 || 'M' WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+02:00') ELSE 'soon' END AS said,
 CASE event_id % 4 WHEN 0 THEN {_T} + (event_id % 50) * INTERVAL 1 MINUTE WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS moment FROM events""")
def when_parse(spark: SparkSession, d: str) -> DataFrame:
    """A moment said as RFC 3339 or as a duration from the clock on (SF8)."""
    k, ts = F.col("event_id"), F.col("ts")
    iso = lambda tail: F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(tail))
    said = F.when(k % 4 == 0, F.concat(F.lit("+PT"), k % 50, F.lit("M"))).when(k % 4 == 1, iso("Z")).when(k % 4 == 2, iso("+02:00")).otherwise("soon")
    return table(spark, d, "events").select("event_id", said.alias("said")).withColumn("moment", moment(F.col("said"), AS_OF))


def moment(said: Column, as_of: str) -> Column:
    """RFC 3339, or ``+`` and an ISO-8601 duration of hours, minutes and seconds; else null."""
    part = lambda u: F.coalesce(F.regexp_extract(said, f"([0-9]+){u}", 1).try_cast("int"), F.lit(0))
    later = at(as_of) + F.make_dt_interval(F.lit(0), part("H"), part("M"), part("S").cast("decimal(18,6)"))
    exact = F.when(said.rlike(r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)\z"), said.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(said.rlike(r"\A\+PT(\d+H)?(\d+M)?(\d+S)?\z") & (said != "+PT"), later).otherwise(exact)


@query(f"WITH asked AS (SELECT event_id % 400 AS key FROM events) SELECT count(*) AS asked, (SELECT count(*) FROM asked a JOIN {_STORED} s ON s.key = a.key WHERE {_LIVE}) AS there, (SELECT count(DISTINCT a.key) FROM asked a JOIN {_STORED} s ON s.key = a.key WHERE {_LIVE}) AS deleted FROM asked")
def kv_exists(spark: SparkSession, d: str) -> DataFrame:
    """EXISTS counts a key as often as it is asked for, DEL once (KV8)."""
    asked = table(spark, d, "events").groupBy((F.col("event_id") % 400).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    now = stored(spark, d).filter(live(F.col("expires"), AS_OF)).select("key", F.lit(True).alias("there"))
    hit = F.col("there").isNotNull()
    return asked.join(now, "key", "left").agg(F.sum("n").alias("asked"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("bigint").alias("there"), F.count_if(hit).alias("deleted"))


@query(f"""SELECT s.key, CASE WHEN l.key IS NOT NULL THEN NULL ELSE value END AS value, l.key IS NOT NULL AND {_LIVE} AS removed, CASE WHEN {_LIVE} THEN value END AS returned
 FROM {_STORED} s LEFT JOIN (SELECT DISTINCT doc_id AS key FROM labels) l ON l.key = s.key""")
def kv_getdel(spark: SparkSession, d: str) -> DataFrame:
    """GETDEL: the value that was there, and the table after it (KV4)."""
    gone = table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.lit(True).alias("gone")).distinct()
    rows, there = stored(spark, d).join(gone, "key", "left"), live(F.col("expires"), AS_OF)
    gone = F.col("gone").isNotNull()
    return rows.select("key", F.when(~gone, F.col("value")).alias("value"), (gone & there).alias("removed"), F.when(there, F.col("value")).alias("returned"))


@query(f"SELECT key, coalesce(expires > {_T}, false) AS persisted, CASE WHEN expires > {_T} THEN NULL ELSE expires END AS expires FROM {_STORED}")
def kv_persist(spark: SparkSession, d: str) -> DataFrame:
    """PERSIST takes an expiry away where a live entry has one (KV9)."""
    has = F.coalesce(F.col("expires") > at(AS_OF), F.lit(False))
    return stored(spark, d).select("key", has.alias("persisted"), F.when(~has, F.col("expires")).alias("expires"))


@query("SELECT p_partkey, encode(p_name) || encode('-' || p_brand) AS value, octet_length(encode(p_name || '-' || p_brand)) AS size FROM part")
def kv_append(spark: SparkSession, d: str) -> DataFrame:
    """APPEND adds bytes and says how many there are then (KV6)."""
    value = F.concat(F.col("p_name").cast("binary"), F.concat(F.lit("-"), "p_brand").cast("binary"))
    return table(spark, d, "part").select("p_partkey", value.alias("value"), F.octet_length(value).cast("bigint").alias("size"))


@query(f"""WITH new AS (SELECT user_id AS key, arg_max(event_id, (ts, event_id)) AS value, min(event_id) AS place FROM events WHERE event_type = 'click' GROUP BY user_id)
 SELECT coalesce(n.key, s.key) AS key, coalesce(n.value, s.value) AS value, CASE WHEN n.key IS NULL THEN s.expires END AS expires, n.place,
 CASE WHEN n.key IS NOT NULL THEN s.value END AS old_file FROM new n FULL JOIN {_STORED} s ON s.key = n.key""")
def kv_mset(spark: SparkSession, d: str) -> DataFrame:
    """MSET: of repeated keys the last value counts, at the first one's place; expiries go, and replaced files are queued (KV5, SK3, OB7)."""
    new = table(spark, d, "events").filter("event_type = 'click'").groupBy(F.col("user_id").alias("key")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("value"), F.min("event_id").alias("place"))
    return upserted(stored(spark, d), new)


def upserted(current: DataFrame, new: DataFrame) -> DataFrame:
    """The state after ``new`` (key, value, place) replaced its keys: key, value, expires, place, and the value of each replaced entry."""
    n, s = new.withColumn("new", F.lit(True)), current.select("key", F.col("value").alias("was"), F.col("expires").alias("until"))
    hit = F.col("new").isNotNull()
    return n.join(s, "key", "full").select("key", F.coalesce("value", "was").alias("value"), F.when(~hit, F.col("until")).alias("expires"), "place", F.when(hit, F.col("was")).alias("old_file"))


_SCANNED = f"(SELECT 'user:' || key AS name FROM {_STORED} WHERE {_LIVE})"


@query(f"SELECT name, (SELECT max(name) FROM (SELECT name FROM {_SCANNED} WHERE name > 'user:100' AND regexp_full_match(name, 'user:1[^/]*') ORDER BY name LIMIT 20)) AS cursor FROM {_SCANNED} WHERE name > 'user:100' AND regexp_full_match(name, 'user:1[^/]*') ORDER BY name LIMIT 20")
def kv_scan(spark: SparkSession, d: str) -> DataFrame:
    """SCAN with a pattern; the cursor is the last key given (KV10)."""
    names = stored(spark, d).filter(live(F.col("expires"), AS_OF)).select(F.concat(F.lit("user:"), F.col("key")).alias("name"))
    page = names.filter((F.col("name") > "user:100") & F.col("name").rlike(r"\Auser:1[^/]*\z")).orderBy("name").limit(20)
    return page.crossJoin(F.broadcast(page.agg(F.max("name").alias("cursor"))))  # one row


@query(f"""WITH caches AS (SELECT source AS name, count(*) AS entries FROM documents GROUP BY source), pending AS (SELECT DISTINCT source AS name FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
 SELECT c.name, entries, p.name IS NOT NULL AS pending, CASE WHEN (SELECT count(*) FROM pending) > 0 THEN entries ELSE 0 END AS after_flush_all, CASE WHEN p.name IS NULL THEN 0 ELSE entries END AS after_flush FROM caches c LEFT JOIN pending p ON p.name = c.name""")
def kv_flush(spark: SparkSession, d: str) -> DataFrame:
    """DBSIZE, and FLUSHDB and FLUSHALL, which a pending upload refuses: its own cache's or any one's (KV11, X12)."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("name"))
    pending = table(spark, d, "labels").filter("toxic = 1").select("doc_id").distinct().withColumn("p", F.lit(1))
    c = docs.join(pending, "doc_id", "left").groupBy("name").agg(F.count(F.lit(1)).alias("entries"), F.max("p").isNotNull().alias("pending"))
    any_pending = c.agg(F.bool_or("pending").alias("any"))  # one row
    kept = lambda gate: F.when(gate, F.col("entries")).otherwise(0).cast("bigint")
    return c.crossJoin(F.broadcast(any_pending)).select("name", "entries", "pending", kept(F.col("any")).alias("after_flush_all"), kept(F.col("pending")).alias("after_flush"))


@query(f"""SELECT key, owner, CASE WHEN expires IS NULL OR expires > {_T} THEN owner ELSE asker END AS holder, NOT (expires IS NULL OR expires > {_T}) AS acquired
 FROM (SELECT s.key, s.value AS owner, s.expires, c.asker FROM {_STORED} s JOIN (SELECT c_custkey % 300 AS key, min(c_custkey) AS asker FROM customer GROUP BY 1) c USING (key))""")
def lease_acquire(spark: SparkSession, d: str) -> DataFrame:
    """A fill lease goes to the first who asks once the holder's has expired (CT3)."""
    asks = table(spark, d, "customer").groupBy((F.col("c_custkey") % 300).alias("key")).agg(F.min("c_custkey").alias("asker"))
    held = live(F.col("expires"), AS_OF)
    rows = stored(spark, d).join(asks, "key")
    return rows.select("key", F.col("value").alias("owner"), F.when(held, F.col("value")).otherwise(F.col("asker")).alias("holder"), (~held).alias("acquired"))


@query(f"""WITH n AS (SELECT doc_id, lang, source FROM documents), c AS (SELECT doc_id FROM labels WHERE quality = 1)
 SELECT n.doc_id, CASE WHEN n.doc_id % 5 = 0 AND n.doc_id % 2 = 0 THEN 'expired' WHEN c.doc_id IS NOT NULL THEN 'shadowed' ELSE 'known' END AS origin FROM n LEFT JOIN c ON c.doc_id = n.doc_id""")
def origin_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What is remembered of an origin counts until it expires and only while no cached object stands for it (CT7)."""
    cached = table(spark, d, "labels").filter("quality = 1").select("doc_id", F.lit(True).alias("cached"))
    rows = table(spark, d, "documents").select("doc_id").join(cached, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("doc_id") % 10 == 0, "expired").when(F.col("cached").isNotNull(), "shadowed").otherwise("known").alias("origin"))
