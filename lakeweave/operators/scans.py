"""Scans, filters, projections and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import hex_number
from ..registry import query, table

DEC = "decimal(18,2)"
WIDE = "decimal(38,2)"


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_qty,
 CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_price, count(*) AS n
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def q1_pricing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast(DEC)).cast(WIDE).alias("sum_qty"), F.sum(F.col("l_extendedprice").cast(DEC)).cast(WIDE).alias("sum_price"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 777")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter("o_orderkey = 777").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT count(*) AS n FROM lineitem")
def count_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM lineitem
 WHERE l_shipdate >= TIMESTAMP '1995-06-01' AND l_shipdate < TIMESTAMP '1995-07-01'""")
def month_sum(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").filter("l_shipdate >= timestamp_ntz'1995-06-01' and l_shipdate < timestamp_ntz'1995-07-01'")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast(DEC)).cast(WIDE).alias("total"))


@query("""SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM orders,
 (SELECT count(*) AS c FROM orders) WHERE o_orderkey >= c // 2 AND o_orderkey < c // 2 + c // 100""")
def range_1pct(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    n = orders.count()  # from the files' footers
    rows = orders.filter(F.col("o_orderkey").between(n // 2, n // 2 + n // 100 - 1))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast(DEC)).cast(WIDE).alias("total"))


@query("SELECT count(*) AS n FROM part WHERE md5(p_name) LIKE 'ab%'")
def string_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(F.md5("p_name").startswith("ab")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total, count(l_extendedprice) AS n FROM lineitem")
def projection_sum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.sum(F.col("l_extendedprice").cast(DEC)).cast(WIDE).alias("total"), F.count("l_extendedprice").alias("n"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE user_id BETWEEN 10 AND 19 GROUP BY user_id")
def group_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("user_id between 10 and 19").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY event_type")
def group_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"))


@query("SELECT event_type AS key, count(*) AS n FROM events GROUP BY event_type")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    as_map = counts.agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))  # a few kinds
    return as_map.select(F.explode("m").alias("key", "n"))


@query("""SELECT count(*) FILTER (o_orderstatus = 'F') AS n_f, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'O') AS DECIMAL(38,2)) AS sum_o,
 min(o_orderkey) FILTER (o_orderstatus = 'P') AS first_p FROM orders""")
def filtered_aggs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice").cast(DEC))).cast(WIDE).alias("sum_o"), F.min(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))).alias("first_p"))


@query("""SELECT count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) AS total FROM orders""")
def state_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"], F.count(F.lit(1)).alias("total"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 42 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def recent_topk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter("o_custkey = 42").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20)


@query("SELECT o_orderstatus, o_orderdate, o_orderkey FROM orders ORDER BY o_orderstatus DESC, o_orderdate, o_orderkey LIMIT 100")
def multi_sort(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderstatus", "o_orderdate", "o_orderkey").orderBy(F.desc("o_orderstatus"), "o_orderdate", "o_orderkey").limit(100)


@query("SELECT n_name, (SELECT count(*) FROM nation) AS total FROM nation ORDER BY n_name LIMIT 5 OFFSET 10")
def limit_offset(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    return nation.select("n_name").orderBy("n_name").offset(10).limit(5).crossJoin(F.broadcast(nation.agg(F.count(F.lit(1)).alias("total"))))  # one row


def with_options(df: DataFrame, **wanted: object) -> DataFrame:
    """Filters by the parameters that are given; none of them leaves all rows."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 ORDER BY n_name")
def optional_filter(spark: SparkSession, d: str) -> DataFrame:
    return with_options(table(spark, d, "nation"), n_regionkey=2, n_name=None).select("n_nationkey", "n_name").orderBy("n_name")


@query("SELECT min(revision) AS lo, max(revision) AS hi, count(*) FILTER (revision IS NULL) AS nulls FROM (SELECT *, 7::BIGINT AS revision FROM orders)")
def default_fill(spark: SparkSession, d: str) -> DataFrame:
    evolved = table(spark, d, "orders").withColumn("revision", F.lit(7).cast("bigint"))
    return evolved.agg(F.min("revision").alias("lo"), F.max("revision").alias("hi"), F.count_if(F.col("revision").isNull()).alias("nulls"))


@query()
def schema_list(spark: SparkSession, d: str) -> DataFrame:
    fields = table(spark, d, "orders").schema.fields
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)], "place int, column_name string, column_type string")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) > 3")
def having(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).filter("n > 3")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT md5(concat(o_orderkey, '-', o_custkey)) AS payload, o_orderkey % 97 AS k, o_orderkey // 97 AS q FROM orders")
def payload_md5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.md5(F.concat_ws("-", "o_orderkey", "o_custkey")).alias("payload"), (F.col("o_orderkey") % 97).alias("k"), F.expr("o_orderkey div 97").alias("q"))


@query("""SELECT count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes,
 CAST(sum(CAST('0x' || substr(md5(text), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM documents""")
def table_digest(spark: SparkSession, d: str) -> DataFrame:
    return digest(table(spark, d, "documents"), "doc_id", "text")


def digest(df: DataFrame, key: str, text: str) -> DataFrame:
    """A digest of a table that doesn't depend on the order of rows."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(key).cast("bigint").alias("ids"), F.sum(F.octet_length(text)).cast("bigint").alias("bytes"), F.sum(hex_number(F.md5(text))).cast("bigint").alias("digest"))


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, octet_length(encode(text)) AS n_bytes FROM documents")
def checksums(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), F.octet_length("text").cast("bigint").alias("n_bytes"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND user_id < 20")
def json_has_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("user_id < 20").filter(F.get_json_object("props", "$.k").isNotNull()).select("event_id")


@query("""SELECT vec_id, len(embedding)::BIGINT AS dim, round(list_sum(list_transform(embedding[1:4], lambda x: x::DOUBLE * 2)), 5) AS head,
 len(list_filter(embedding, lambda x: x > 0))::BIGINT AS positive FROM embeddings""")
def array_ops(spark: SparkSession, d: str) -> DataFrame:
    head = F.aggregate(F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 2), F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("bigint").alias("dim"), F.round(head, 5).alias("head"), F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint").alias("positive"))


@query("""SELECT id, list_filter(list_transform(range(1, len(p) + 1, 2), lambda i: p[i] || '=' || p[i + 1]), lambda x: x IS NOT NULL)[1] AS first_pair, len(p)::BIGINT // 2 AS pairs
 FROM (SELECT c_custkey AS id, ['name', c_name, 'segment', c_mktsegment] AS p FROM customer)""")
def pairs_to_map(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment").alias("p"))
    m = F.map_from_arrays(F.filter("p", lambda x, i: i % 2 == 0), F.filter("p", lambda x, i: i % 2 == 1))
    return p.select("id", F.concat(F.lit("name="), F.element_at(m, "name")).alias("first_pair"), F.size(m).cast("bigint").alias("pairs"))


@query("""SELECT id, make_timestamp(1980 + (v >> 25), (v >> 21) & 15, (v >> 16) & 31, (v >> 11) & 31, (v >> 5) & 63, ((v & 31) * 2)::DOUBLE) AS at
 FROM (SELECT o_orderkey AS id, (((o_orderkey % 40) << 25) | ((o_orderkey % 12 + 1) << 21) | ((o_orderkey % 28 + 1) << 16) | ((o_orderkey % 24) << 11) | ((o_orderkey % 60) << 5) | (o_orderkey % 30)) AS v FROM orders)""")
def dos_time(spark: SparkSession, d: str) -> DataFrame:
    v = F.expr("((o_orderkey % 40) << 25) | ((o_orderkey % 12 + 1) << 21) | ((o_orderkey % 28 + 1) << 16) | ((o_orderkey % 24) << 11) | ((o_orderkey % 60) << 5) | (o_orderkey % 30)")
    part = lambda at, bits: f"int((v >> {at}) & {bits})"
    moment = F.expr(f"make_timestamp_ntz(1980 + {part(25, 127)}, {part(21, 15)}, {part(16, 31)}, {part(11, 31)}, {part(5, 63)}, 2 * {part(0, 31)})")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), v.alias("v")).select("id", moment.alias("at"))


@query("""SELECT lsn, CAST('0x' || split_part(lsn, '/', 1) AS BIGINT) * 4294967296 + CAST('0x' || split_part(lsn, '/', 2) AS BIGINT) AS bytes
 FROM (SELECT printf('%X/%X', o_orderkey % 16, o_orderkey * 1000) AS lsn FROM orders)""")
def lsn_bytes(spark: SparkSession, d: str) -> DataFrame:
    number = lambda i: F.conv(F.element_at(F.split("lsn", "/"), i), 16, 10).cast("bigint")
    rows = table(spark, d, "orders").select(F.concat(F.hex(F.col("o_orderkey") % 16), F.lit("/"), F.hex(F.col("o_orderkey") * 1000)).alias("lsn"))
    return rows.select("lsn", (number(1) * 4294967296 + number(2)).alias("bytes"))


@query("SELECT o_orderkey, xor(o_orderkey, o_orderkey >> 3) & 1023 AS pin FROM orders")
def bit_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.expr("(o_orderkey ^ (o_orderkey >> 3)) & 1023").alias("pin"))


@query("SELECT o_orderkey, CAST(greatest(1, least(8, floor((o_orderkey * 1000000 / 2.0 - 67108864) / 67108864))) AS BIGINT) AS workers FROM orders")
def read_workers(spark: SparkSession, d: str) -> DataFrame:
    n = F.floor((F.col("o_orderkey") * 1000000 / 2 - 67108864) / 67108864)
    return table(spark, d, "orders").select("o_orderkey", F.greatest(F.lit(1), F.least(F.lit(8), n)).cast("bigint").alias("workers"))
