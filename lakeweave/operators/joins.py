"""Join shapes and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, table


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name")


_OFFSETS = "(SELECT event_id, user_id % 100 AS conv_id, event_id % 1500 AS off FROM events)"
_FRAMES = """(SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS lo, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS hi FROM conversations)"""


@query(f"SELECT event_id, turn, (off - lo)::BIGINT AS inside FROM {_OFFSETS} o JOIN {_FRAMES} f ON f.conv_id = o.conv_id AND off >= lo AND off < hi")
def range_join(spark: SparkSession, d: str) -> DataFrame:
    """Each offset meets the frame that holds it (JN10)."""
    n = F.length("text").cast("bigint")
    hi = F.sum(n).over(Window.partitionBy("conv_id").orderBy("turn"))
    frames = table(spark, d, "conversations").select("conv_id", "turn", (hi - n).alias("lo"), hi.alias("hi"))
    offsets = table(spark, d, "events").select("event_id", (F.col("user_id") % 100).alias("conv_id"), (F.col("event_id") % 1500).alias("off"))
    return contained(offsets, frames, "conv_id", 256).select("event_id", "turn", (F.col("off") - F.col("lo")).alias("inside"))


def contained(points: DataFrame, ranges: DataFrame, key: str, step: int) -> DataFrame:
    """Points (``off``) with the ranges (``lo``, ``hi``) of the same key that hold them. Both
    are cut into cells of ``step``, so the join is on equal values and hot keys are spread."""
    cell = lambda c: F.floor(c / step)
    cells = ranges.filter("hi > lo").withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
    return points.withColumn("cell", cell(F.col("off"))).join(cells, [key, "cell"]).filter("off >= lo and off < hi").drop("cell")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o.filter("o_orderstatus = 'P'"), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT coalesce(doc_id, -1) AS doc_id, quality FROM documents FULL JOIN labels USING (doc_id)")
def full_outer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "full").select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "quality")


@query("SELECT r_name, n_name FROM region, nation")
def cross_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_name").crossJoin(table(spark, d, "region").select("r_name"))  # both of fixed size


@query("SELECT n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def star_join(spark: SparkSession, d: str) -> DataFrame:
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    per_order = li.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("t"))  # fewer rows before the next shuffle
    rows = per_order.join(o, per_order.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rows.groupBy("n_name").agg(F.sum("t").cast("decimal(38,2)").alias("total"))


@query("""SELECT b.doc_id, length(d.text)::BIGINT AS n FROM (SELECT doc_id FROM documents WHERE lang = 'fr' AND n_chars > 1000) b JOIN documents d USING (doc_id)""")
def late_materialize(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    narrow = docs.filter("lang = 'fr' and n_chars > 1000").select("doc_id")
    return docs.select("doc_id", "text").join(narrow, "doc_id").select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("SELECT ord, k::BIGINT AS key, o_custkey AS value FROM (SELECT unnest(range(6)) AS ord, unnest([7, 3, 999999999, 7, 0, 12]) AS k) LEFT JOIN orders ON o_orderkey = k")
def mget(spark: SparkSession, d: str) -> DataFrame:
    return lookup(spark, table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value")), [7, 3, 999_999_999, 7, 0, 12])


def lookup(spark: SparkSession, rows: DataFrame, keys: list[int]) -> DataFrame:
    """Values in the order of the request; repeated keys answer each time, missing ones with null."""
    wanted = spark.createDataFrame(list(enumerate(keys)), "ord long, key long")
    found = rows.filter(F.col("key").isin(sorted(set(keys))))  # reaches the scan
    return wanted.join(found, "key", "left").select("ord", "key", "value")


@query("SELECT i AS place, v AS value, 100 + row_number() OVER (ORDER BY i) AS seq FROM (SELECT unnest(range(1, 6)) AS i, unnest(['a','b','c','d','e']) AS v)")
def positional_join(spark: SparkSession, d: str) -> DataFrame:
    given = spark.range(1).select(F.posexplode(F.array(*map(F.lit, "abcde"))).alias("i", "value")).withColumn("place", F.col("i").cast("bigint") + 1)
    seqs = spark.range(101, 106).select(F.col("id").alias("seq"))
    numbered = seqs.withColumn("place", F.row_number().over(Window.orderBy("seq")).cast("bigint"))  # one call's inputs
    return given.join(numbered, "place").select("place", "value", "seq")


@query("SELECT c_custkey, CASE WHEN m.new IS NULL THEN c_nationkey ELSE m.new END AS nation FROM customer LEFT JOIN (VALUES (1, 101), (2, 102), (7, 107)) m(old, new) ON c_nationkey = m.old")
def id_remap(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for x in (1, 101, 2, 102, 7, 107)])
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.try_element_at(pairs, F.col("c_nationkey")), F.col("c_nationkey")).alias("nation"))


@query("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def intersect(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.filter("event_type = 'click'").select("user_id").intersect(e.filter("event_type = 'purchase'").select("user_id"))


@query("SELECT o_custkey % 50 AS k FROM orders EXCEPT ALL SELECT c_custkey % 50 AS k FROM customer")
def except_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("k")).exceptAll(table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("k")))


SHADOW = """SELECT id, source FROM (SELECT id, source, row_number() OVER (PARTITION BY id ORDER BY p) AS r FROM
 (SELECT doc_id AS id, 'document' AS source, {0} AS p FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'label', {1} FROM labels)) WHERE r = 1"""


def prefer(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The union of two listings in which ``left`` shadows ``right`` on equal keys."""
    return left.unionByName(right.join(left.select(key), key, "left_anti").select(left.columns))


@query(SHADOW.format(1, 2))
def shadow_merge(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.lit("document").alias("source"))
    return prefer(a, table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit("label").alias("source")), "id")


@query(SHADOW.format(2, 1))
def priority_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit("label").alias("source"), F.lit(1).alias("p"))
    b = table(spark, d, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.lit("document").alias("source"), F.lit(2).alias("p"))
    return a.unionByName(b).groupBy("id").agg(F.min_by("source", "p").alias("source"))  # combines before the shuffle


@query("""WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts AS cts, event_id AS click FROM events WHERE event_type = 'click')
 SELECT event_id, click FROM e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.cts""")
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", F.lit(None).cast("bigint").alias("click"))
    right = e.filter("event_type = 'click'").select("user_id", "ts", F.lit(None).cast("bigint").alias("event_id"), F.col("event_id").alias("click"))
    return asof(left.unionByName(right)).filter("event_id is not null").select("event_id", F.col("last_click").alias("click"))


def asof(rows: DataFrame) -> DataFrame:
    """The latest ``click`` at or before each row of the same user, without a range join."""
    w = Window.partitionBy("user_id").orderBy("ts", F.col("click").isNull(), F.col("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("last_click", F.last("click", ignorenulls=True).over(w))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def string_agg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


@query("""SELECT (SELECT count(*) FROM (SELECT DISTINCT source FROM documents) s WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('src0'), ('src1'), ('gone')) v(n) WHERE n = source)) AS orphans,
 (SELECT count(*) FROM (VALUES ('src0'), ('src1'), ('gone')) v(n) WHERE NOT EXISTS (SELECT 1 FROM documents WHERE source = n)) AS missing""")
def catalog_diff(spark: SparkSession, d: str) -> DataFrame:
    there = table(spark, d, "documents").select(F.col("source").alias("n")).distinct()
    known = spark.createDataFrame([("src0",), ("src1",), ("gone",)], "n string")
    return there.join(known, "n", "left_anti").agg(F.count(F.lit(1)).alias("orphans")).crossJoin(known.join(there, "n", "left_anti").agg(F.count(F.lit(1)).alias("missing")))  # one row each


@query("""SELECT k AS name, CASE WHEN a.n IS NULL THEN 'missing' WHEN a.n IS DISTINCT FROM e.n THEN 'count' ELSE 'ok' END AS reason FROM (VALUES ('F', 1), ('O', 2), ('X', 3)) e(k, n)
 LEFT JOIN (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1) a USING (k)""")
def contract_check(spark: SparkSession, d: str) -> DataFrame:
    actual = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(F.count(F.lit(1)).alias("is"))
    expected = spark.createDataFrame([("F", 1), ("O", 2), ("X", 3)], "name string, n long")
    return expected.join(actual, "name", "left").select("name", F.when(F.col("is").isNull(), "missing").when(~F.col("is").eqNullSafe(F.col("n")), "count").otherwise("ok").alias("reason"))
