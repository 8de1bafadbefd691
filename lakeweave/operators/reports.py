"""Measurements and digests: gates, capacity, load records, logs, checksums, timestamps, casts, arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import at
from ..registry import query, table
from .statistics import ranked

#: Events as requests of two profiles in blocks of the order A B B A.
_REQ = "(SELECT event_id, user_id % 20 AS op, event_id // 4 AS cycle, CASE WHEN event_id % 4 IN (0, 3) THEN 'a' ELSE 'b' END AS side, value + 1 AS ms, 1000.0 / (value + 1) AS rate FROM events)"


def requests(spark: SparkSession, d: str) -> DataFrame:
    side = F.when((F.col("event_id") % 4).isin(0, 3), "a").otherwise("b")
    ms = F.col("value") + 1
    return table(spark, d, "events").select("event_id", (F.col("user_id") % 20).alias("op"), F.expr("event_id div 4").alias("cycle"), side.alias("side"), ms.alias("ms"), (1000.0 / ms).alias("rate"))


@query(f"""WITH c AS (SELECT op, cycle, median(ms) FILTER (side = 'a') AS a, median(ms) FILTER (side = 'b') AS b, median(rate) FILTER (side = 'a') AS ra, median(rate) FILTER (side = 'b') AS rb FROM {_REQ} GROUP BY op, cycle),
 r AS (SELECT op, count(*) AS pairs, median(b / a) AS slower, median(rb / ra) AS faster FROM c WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY op) SELECT op, pairs, round(slower, 6) AS time_ratio, round(faster, 6) AS rate_ratio, slower > 1.20 OR faster < 0.80 AS failed FROM r""")
def paired_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each block of four measures both profiles twice, in alternating order; the median
    of the blocks' ratios fails above 1.20 in time or under 0.80 in rate (AG19, WN9)."""
    of = lambda c, s: F.percentile(F.when(F.col("side") == s, F.col(c)), 0.5)
    blocks = requests(spark, d).groupBy("op", "cycle").agg(of("ms", "a").alias("a"), of("ms", "b").alias("b"), of("rate", "a").alias("ra"), of("rate", "b").alias("rb")).filter("a is not null and b is not null")  # four rows each
    sums = blocks.groupBy("op").agg(F.count(F.lit(1)).alias("pairs"), F.percentile(F.col("b") / F.col("a"), 0.5).alias("t"), F.percentile(F.col("rb") / F.col("ra"), 0.5).alias("r"))
    return sums.select("op", "pairs", F.round("t", 6).alias("time_ratio"), F.round("r", 6).alias("rate_ratio"), ((F.col("t") > 1.20) | (F.col("r") < 0.80)).alias("failed"))


@query(f"SELECT op, side, count(*) AS n, round(median(ms), 6) AS p50, round(median(rate), 6) AS rate, round(median(rate) * 20, 6) AS capacity FROM {_REQ} GROUP BY op, side")
def capacity_summary(spark: SparkSession, d: str) -> DataFrame:
    """Median time and rate of each operation and profile, and what twenty workers give (AG20)."""
    sums = requests(spark, d).groupBy("op", "side").agg(F.count(F.lit(1)).alias("n"), F.percentile("ms", 0.5).alias("m"), F.percentile("rate", 0.5).alias("r"))
    return sums.select("op", "side", "n", F.round("m", 6).alias("p50"), F.round("r", 6).alias("rate"), F.round(F.col("r") * 20, 6).alias("capacity"))


@query(f"""WITH f AS (SELECT op, median(rate) AS floor FROM {_REQ} WHERE side = 'a' GROUP BY op) SELECT op, round(median(r.rate), 6) AS rate, round(100 * median(r.rate) / any_value(floor), 4) AS share FROM {_REQ} r JOIN f USING (op) WHERE side = 'b' GROUP BY op""")
def floor_share(spark: SparkSession, d: str) -> DataFrame:
    """How much of the bare transport's rate each operation reaches (X24)."""
    of = lambda s: F.percentile(F.when(F.col("side") == s, F.col("rate")), 0.5)
    sums = requests(spark, d).groupBy("op").agg(of("a").alias("floor"), of("b").alias("r")).filter("floor is not null and r is not null")
    return sums.select("op", F.round("r", 6).alias("rate"), F.round(100 * F.col("r") / F.col("floor"), 4).alias("share"))


_RANK = "list_sort(list(value))[least(count(*) - 1, floor(count(*) * {q})::BIGINT) + 1]"


@query(f"""SELECT event_type, count(*) AS requests, round(count(*) / (date_diff('second', min(ts), max(ts)) + 1), 6) AS requests_per_s, round(sum(user_id) / 1048576.0 / (date_diff('second', min(ts), max(ts)) + 1), 9) AS mib_per_s,
 {_RANK.format(q=0.50)} AS p50, {_RANK.format(q=0.90)} AS p90, {_RANK.format(q=0.99)} AS p99, max(value) AS most FROM events GROUP BY event_type""")
def load_record(spark: SparkSession, d: str) -> DataFrame:
    """Rates and nearest-rank percentiles of each kind of request; no kind is ever in one task (X25)."""
    e = table(spark, d, "events")
    secs = F.floor((F.unix_micros(F.date_trunc("second", F.max("ts")).cast("timestamp")) - F.unix_micros(F.date_trunc("second", F.min("ts")).cast("timestamp"))) / 1_000_000) + 1
    sums = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("requests"), secs.alias("s"), F.sum("user_id").alias("bytes"), F.max("value").alias("most"))
    ranks = ranked(e, "event_type", "value", lambda n: [F.least(n - 1, F.floor(n * F.lit(q).cast("decimal(4,2)"))) for q in (0.5, 0.9, 0.99)])
    wide = ranks.groupBy("event_type").agg(*[F.max(F.when(F.col("which") == i, F.col("value"))).alias(name) for i, name in enumerate(("p50", "p90", "p99"))])  # three rows each
    return sums.join(wide, "event_type").select("event_type", "requests", F.round(F.col("requests") / F.col("s"), 6).alias("requests_per_s"), F.round(F.col("bytes") / 1048576.0 / F.col("s"), 9).alias("mib_per_s"), "p50", "p90", "p99", "most")


_LINE = "(SELECT event_id, CASE WHEN event_id % 50 = 7 THEN 'garbage' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || ['GET', 'PUT', 'HEAD'][event_id % 3 + 1] || ' /b/' || user_id || '?x=' || event_id || ' ' || [200, 206, 404, 503][event_id % 4 + 1] || ' ' || (event_id % 900) || 'ms' END AS line FROM events)"


@query(f"""SELECT regexp_extract(line, ' (GET|PUT|HEAD) ', 1) AS method, TRY_CAST(nullif(regexp_extract(line, ' ([0-9]{{3}}) [0-9]+ms$', 1), '') AS INT) AS status, count(*) AS n, CAST(sum(TRY_CAST(nullif(regexp_extract(line, ' ([0-9]+)ms$', 1), '') AS BIGINT)) AS BIGINT) AS ms, count(DISTINCT nullif(regexp_extract(line, ' (/[^ ?]*)', 1), '')) AS paths FROM {_LINE} GROUP BY 1, 2""")
def request_log(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a request log, parsed and counted; a line that is none counts apart (SC30)."""
    i = F.col("event_id")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), pick(("GET", "PUT", "HEAD")), F.lit(" /b/"), "user_id", F.lit("?x="), i, F.lit(" "), pick((200, 206, 404, 503)).cast("string"), F.lit(" "), i % 900, F.lit("ms"))
    lines = table(spark, d, "events").select(F.when(i % 50 == 7, "garbage").otherwise(line).alias("line"))
    p = log_fields(lines)
    return p.groupBy("method", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("ms"), F.countDistinct("path").alias("paths"))


def log_fields(lines: DataFrame) -> DataFrame:
    """method, path, status, ms of each ``line``."""
    got = lambda p: F.regexp_extract("line", p, 1)
    return lines.select(got(" (GET|PUT|HEAD) ").alias("method"), F.nullif(got(r" (/[^ ?]*)"), F.lit("")).alias("path"), got(r" ([0-9]{3}) [0-9]+ms\z").try_cast("int").alias("status"), got(r" ([0-9]+)ms\z").try_cast("bigint").alias("ms"))


@query("SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(avg(o_custkey), 6) AS customers, round(sum(o_totalprice) / count(*), 2) AS rounded FROM orders GROUP BY o_orderstatus")
def mean_round(spark: SparkSession, d: str) -> DataFrame:
    """avg and round (AG12)."""
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.avg("o_custkey"), 6).alias("customers"), F.round(F.sum("o_totalprice") / F.count(F.lit(1)), 2).alias("rounded"))


@query("SELECT conv_id, md5(string_agg(md5(text), '' ORDER BY turn)) AS hex_md5, sha256(unhex(string_agg(sha256(text), '' ORDER BY turn))) || '-' || count(*) AS sha_etag FROM conversations GROUP BY conv_id")
def multipart_sha(spark: SparkSession, d: str) -> DataFrame:
    """The digest of an upload's parts' digests (AG24)."""
    parts = F.sort_array(F.collect_list(F.struct("turn", F.md5("text").alias("m"), F.sha2("text", 256).alias("s"))))
    p = table(spark, d, "conversations").groupBy("conv_id").agg(parts.alias("p"))  # an upload's own parts
    return p.select("conv_id", F.md5(F.array_join("p.m", "")).alias("hex_md5"), F.concat(F.sha2(F.unhex(F.array_join("p.s", "")), 256), F.lit("-"), F.size("p")).alias("sha_etag"))


@query("""SELECT doc_id, octet_length(encode(text)) AS size, ((octet_length(encode(text)) + 8119) // 8120)::BIGINT AS rows, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL""")
def framed_digests(spark: SparkSession, d: str) -> DataFrame:
    """What a writer keeps of each object that it cuts into rows: size, rows and digests (SK1, SF5)."""
    size = F.octet_length("text").cast("bigint")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", size.alias("size"), F.floor((size + 8119) / 8120).alias("rows"), F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query("""SELECT event_id, make_timestamp(((event_id * 10000000 + 116444736000000000 + 123) - 116444736000000000) // 10) AS ntfs, make_timestamp(event_id * 86400 * 1000000) AS unix FROM events""")
def file_times(spark: SparkSession, d: str) -> DataFrame:
    """NTFS times count tenths of a microsecond since 1601, the extended field seconds since 1970 (SF13)."""
    ticks = F.col("event_id") * 10_000_000 + 116_444_736_000_000_000 + 123
    return table(spark, d, "events").select("event_id", ntfs_time(ticks).alias("ntfs"), F.timestamp_seconds(F.col("event_id") * 86400).cast("timestamp_ntz").alias("unix"))


def ntfs_time(ticks: Column) -> Column:
    return F.timestamp_micros(F.floor((ticks - 116_444_736_000_000_000) / 10)).cast("timestamp_ntz")


@query("SELECT event_id, (event_id / 2.0)::DOUBLE::INTEGER AS nearest, floor(event_id / 2.0)::INTEGER AS down FROM events")
def cast_rounding(spark: SparkSession, d: str) -> DataFrame:
    """A cast that rounds halves to the even number, and one that truncates (SF18)."""
    half = F.col("event_id") / 2
    return table(spark, d, "events").select("event_id", F.bround(half).cast("int").alias("nearest"), half.cast("int").alias("down"))


@query("SELECT vec_id, list_position(x, 3) AS place, list_contains(x, 2) AS has, list_append(x, label) AS longer, len(x) AS size, list_sum(list_transform(x, lambda v: v * 2))::BIGINT AS doubled FROM (SELECT vec_id, label, [vec_id % 5, vec_id % 3 + 1, 3] AS x FROM embeddings)")
def array_functions(spark: SparkSession, d: str) -> DataFrame:
    """Place, membership, append, size and transform of arrays (SF22)."""
    i = F.col("vec_id")
    x = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("label"), F.array(i % 5, i % 3 + 1, F.lit(3).cast("bigint")).alias("x"))
    double = F.aggregate(F.transform("x", lambda v: v * 2), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return x.select("vec_id", F.array_position("x", 3).cast("int").alias("place"), F.array_contains("x", 2).alias("has"), F.array_append("x", F.col("label")).alias("longer"), F.size("x").cast("bigint").alias("size"), double.alias("doubled"))


@query("SELECT label, list(vec_id ORDER BY vec_id) AS ids FROM embeddings GROUP BY label")
def ordered_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Ordered arrays of ids by group (AG6, SF22)."""
    return table(spark, d, "embeddings").groupBy("label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


@query("SELECT c_custkey, to_json({'key': c_custkey, 'segment': c_mktsegment, 'nation': c_nationkey}) AS row FROM customer")
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON (SF25)."""
    return table(spark, d, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))).alias("row"))


@query("""SELECT p_partkey, lower(p_name) AS name, regexp_full_match(lower(p_name), '[a-z0-9_-]{1,128}') AS valid, octet_length(encode(lower(p_name) || p_brand)) <= 2048 AS fits FROM part""")
def metadata_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of user metadata: lower case, of letters, digits, - and _, and not too long (SF6)."""
    name = F.lower("p_name")
    return table(spark, d, "part").select("p_partkey", name.alias("name"), name.rlike(r"\A[a-z0-9_-]{1,128}\z").alias("valid"), (F.octet_length(F.concat(name, "p_brand")) <= 2048).alias("fits"))


@query("""SELECT doc_id, trim(tag, '"') AS bare, regexp_full_match(trim(tag, '"'), '[0-9a-f]{32}(-[0-9]+)?') AS valid FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '"' || md5(text) || '"' WHEN 1 THEN md5(text) || '-12' WHEN 2 THEN md5(text) || '-' ELSE 'W/x' END AS tag FROM documents WHERE text IS NOT NULL)""")
def etag_valid(spark: SparkSession, d: str) -> DataFrame:
    """Tags without their quotes, and whether they are an MD5 with or without a number of parts (SF3)."""
    i, m = F.col("doc_id") % 4, F.md5("text")
    tag = F.when(i == 0, F.concat(F.lit('"'), m, F.lit('"'))).when(i == 1, F.concat(m, F.lit("-12"))).when(i == 2, F.concat(m, F.lit("-"))).otherwise("W/x")
    bare = F.regexp_replace("tag", r'\A"+|"+\z', "")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", tag.alias("tag")).select("doc_id", bare.alias("bare"), bare.rlike(r"\A[0-9a-f]{32}(-[0-9]+)?\z").alias("valid"))


@query("SELECT o_orderkey, (xor(f, f >> 31) & 2147483647)::INT AS pin FROM (SELECT o_orderkey, o_orderkey * 6364136223 + o_custkey AS f FROM orders)")
def pin_key(spark: SparkSession, d: str) -> DataFrame:
    """A 31-bit id of a file's number: its low and high halves mixed (SF32)."""
    f = F.col("o_orderkey") * 6_364_136_223 + F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", f.bitwiseXOR(F.shiftright(f, 31)).bitwiseAND(F.lit(2_147_483_647)).cast("int").alias("pin"))


@query("""SELECT s_suppkey, attempt, CASE WHEN initial <= 0 THEN 0 ELSE round(least(60000.0, initial * pow(CASE WHEN factor <= 0 THEN 2 ELSE factor END, greatest(attempt, 1) - 1))) END::BIGINT AS delay
 FROM (SELECT s_suppkey, (s_suppkey % 9)::INT AS attempt, (s_suppkey % 5 * 250)::DOUBLE AS initial, (s_suppkey % 4 - 1)::DOUBLE AS factor FROM supplier)""")
def backoff_rows(spark: SparkSession, d: str) -> DataFrame:
    """Delays by the rows' own settings: a factor of 0 or less means 2, an attempt under 1 the first (SF9)."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select("s_suppkey", (k % 9).cast("int").alias("attempt"), (k % 5 * 250).cast("double").alias("initial"), (k % 4 - 1).cast("double").alias("factor"))
    factor = F.when(F.col("factor") <= 0, 2.0).otherwise(F.col("factor"))
    wait = F.round(F.least(F.lit(60_000.0), F.col("initial") * F.pow(factor, F.greatest("attempt", F.lit(1)) - 1)))
    return rows.select("s_suppkey", "attempt", F.when(F.col("initial") <= 0, 0).otherwise(wait).cast("bigint").alias("delay"))


@query("""SELECT l_orderkey, any_value(l_quantity) FILTER (r = 1) AS first_quantity, count(*) AS missed, CAST(sum(len) AS BIGINT) AS bytes FROM (SELECT l_orderkey, l_quantity, l_linenumber * 10 AS len, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem) GROUP BY l_orderkey""")
def first_of_group(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each group in order, with the group's sums."""
    first = F.min_by("l_quantity", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(first.alias("first_quantity"), F.count(F.lit(1)).alias("missed"), F.sum(F.col("l_linenumber") * 10).alias("bytes"))


_MISS = "(SELECT l_orderkey AS file, l_linenumber::BIGINT AS chunk, count(*) AS n FROM lineitem WHERE l_partkey % 4 <> 0 GROUP BY ALL)"


@query(f"""WITH g AS (SELECT file, chunk, chunk - row_number() OVER (PARTITION BY file ORDER BY chunk) AS island FROM {_MISS}), c AS (SELECT *, (row_number() OVER (PARTITION BY file, island ORDER BY chunk) - 1) // 2 AS piece FROM g)
 SELECT file, min(chunk) AS first, max(chunk) AS last, count(*) AS chunks FROM c GROUP BY file, island, piece""")
def missing_runs(spark: SparkSession, d: str) -> DataFrame:
    """Missing chunks that follow each other are read at once, two at most (PR14, CT2)."""
    from pyspark.sql import Window

    rows = table(spark, d, "lineitem").filter("l_partkey % 4 <> 0").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("bigint").alias("chunk")).distinct()
    island = F.col("chunk") - F.row_number().over(Window.partitionBy("file").orderBy("chunk"))  # a file's own chunks
    piece = F.expr("int((k - 1) div 2)")
    runs = rows.withColumn("island", island).withColumn("k", F.row_number().over(Window.partitionBy("file", "island").orderBy("chunk"))).withColumn("piece", piece)
    return runs.groupBy("file", "island", "piece").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"), F.count(F.lit(1)).alias("chunks")).drop("island", "piece")
