"""Byte ranges, chunks, segments, multipart manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import ROW_BYTES, bytes_between, chunks
from ..registry import query, table

_RANGES = "('bytes=0-9'), ('bytes=5-'), ('bytes=-3'), ('bytes=1-2,4-5'), ('bytes=-'), ('items=0-1')"
_PARSED = r"""SELECT h, TRY_CAST(regexp_extract(h, '^bytes=([0-9]+)-[0-9]*$', 1) AS BIGINT) AS first, TRY_CAST(regexp_extract(h, '^bytes=[0-9]+-([0-9]+)$', 1) AS BIGINT) AS last,
 TRY_CAST(regexp_extract(h, '^bytes=-([0-9]+)$', 1) AS BIGINT) AS suffix FROM (VALUES {0}) v(h)"""


def parsed(rows: DataFrame) -> DataFrame:
    """h, first, last, suffix of a Range header; several ranges are not understood."""
    got = lambda p: F.regexp_extract("h", p, 1).try_cast("bigint")
    return rows.select("h", got("^bytes=([0-9]+)-[0-9]*$").alias("first"), got("^bytes=[0-9]+-([0-9]+)$").alias("last"), got("^bytes=-([0-9]+)$").alias("suffix"))


@query(_PARSED.format(_RANGES))
def range_parse(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark.sql(f"SELECT * FROM VALUES {_RANGES} AS v(h)"))


def resolved(rows: DataFrame) -> DataFrame:
    """Adds start, end (inclusive) and valid for a range over ``size`` bytes."""
    size, first, last, suffix = map(F.col, ("size", "first", "last", "suffix"))
    start = F.when(suffix.isNotNull(), F.greatest(F.lit(0), size - suffix)).otherwise(F.coalesce(first, F.lit(0)))
    end = F.when(last.isNull(), size - 1).otherwise(F.least(last, size - 1))
    bad = (suffix == 0) | (first >= size) | (last < first)
    return rows.withColumn("valid", ~F.coalesce(bad, F.lit(False))).withColumn("start", F.when(F.col("valid"), start)).withColumn("end", F.when(F.col("valid"), end))


@query(f"""WITH r AS ({_PARSED.format("('bytes=10-99'), ('bytes=2000-'), ('bytes=-50'), ('bytes=-0'), ('bytes=9-3')")}), x AS (SELECT doc_id, h, n_chars AS size, first, last, suffix,
 NOT coalesce(suffix = 0 OR first >= n_chars OR last < first, false) AS valid FROM documents, r)
 SELECT doc_id, h, valid, CASE WHEN valid THEN CASE WHEN suffix IS NOT NULL THEN greatest(0, size - suffix) ELSE coalesce(first, 0) END END AS start,
 CASE WHEN valid THEN CASE WHEN last IS NULL THEN size - 1 ELSE least(last, size - 1) END END AS "end" FROM x""")
def range_resolve(spark: SparkSession, d: str) -> DataFrame:
    headers = parsed(spark.sql("SELECT * FROM VALUES ('bytes=10-99'), ('bytes=2000-'), ('bytes=-50'), ('bytes=-0'), ('bytes=9-3') AS v(h)"))
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("size"))
    return resolved(docs.crossJoin(F.broadcast(headers))).select("doc_id", "h", "valid", "start", "end")  # five headers


@query("""WITH x AS (SELECT p_partkey, p_name, length(p_name) AS n, -7 AS s0, -2 AS e0 FROM part), y AS (SELECT *, greatest(0, s0 + n) AS s, e0 + n AS e FROM x)
 SELECT p_partkey, CASE WHEN e < 0 OR s > e OR s >= n THEN '' ELSE substr(p_name, s + 1, least(e, n - 1) - s + 1) END AS part FROM y""")
def getrange(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", bytes_between(F.col("p_name").cast("binary"), -7, -2).cast("string").alias("part"))


_SEG = "SELECT conv_id, turn, sum(length(text)) OVER w - length(text) AS base, length(text) AS len FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """One row for each conversation with the cumulative ends of its turns: a multipart manifest."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("len"))
    ends = F.sum("len").over(Window.partitionBy("conv_id").orderBy("turn"))
    parts = rows.withColumn("end", ends).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "end"))).alias("p"))  # a manifest's own parts
    return parts.select("conv_id", F.col("p.turn").alias("parts"), F.col("p.end").alias("part_ends"))


def segment_rows(m: DataFrame) -> DataFrame:
    """A row for each part of a manifest: its base offset and length."""
    ends = F.col("part_ends")
    base = F.transform(ends, lambda e, i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(ends, i - 1)))
    return m.select("conv_id", F.explode(F.arrays_zip("parts", "part_ends", base.alias("base"))).alias("x")).select("conv_id", F.col("x.parts").alias("turn"), F.col("x.base").alias("base"), (F.col("x.part_ends") - F.col("x.base")).alias("len"))


@query(f"SELECT conv_id, turn, base::BIGINT AS base, len::BIGINT AS len FROM ({_SEG})")
def segments(spark: SparkSession, d: str) -> DataFrame:
    return segment_rows(manifest(spark, d))


@query(f"SELECT conv_id, turn, greatest(base, 100)::BIGINT AS lo, least(base + len - 1, 400)::BIGINT AS hi FROM ({_SEG}) WHERE base <= 400 AND base + len - 1 >= 100 AND len > 0")
def range_overlap(spark: SparkSession, d: str) -> DataFrame:
    return segment_rows(manifest(spark, d)).filter("base <= 400 and base + len - 1 >= 100 and len > 0").select("conv_id", "turn", F.greatest("base", F.lit(100)).alias("lo"), F.least(F.expr("base + len - 1"), F.lit(400)).alias("hi"))


@query("SELECT doc_id, unnest(range(300 - 300 % 256, n_chars, 256)) AS chunk FROM documents WHERE n_chars > 300")
def aligned_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("n_chars > 300").select("doc_id", F.explode(F.expr("sequence(300 - 300 % 256, n_chars - 1, bigint(256))")).alias("chunk"))


@query("""SELECT user_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM (SELECT user_id, day, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS g
 FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)) GROUP BY user_id, g""")
def gaps_islands(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    g = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    return days.withColumn("g", g).groupBy("user_id", "g").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days")).drop("g")


_PIECES = """CASE WHEN size <= 1048576 THEN 1 ELSE CASE WHEN size <= 67108864 THEN least(rows, CAST(ceil(size::DOUBLE / greatest(ceil(size / 8.0), 1048576)) AS BIGINT)) ELSE greatest(rows * 8120 // 8388608, 1) END END"""


@query(f"SELECT doc_id, {_PIECES} AS pieces FROM (SELECT doc_id, n_chars * 5000 AS size, (n_chars * 5000 + 8119) // 8120 AS rows FROM documents)")
def plan_pieces(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", (F.col("n_chars") * 5000).alias("size")).withColumn("rows", chunks(F.col("size")))
    each = F.greatest(F.ceil(F.col("size") / 8), F.lit(1 << 20))
    return rows.select("doc_id", F.when(F.col("size") <= 1 << 20, 1).when(F.col("size") <= 64 << 20, F.least("rows", F.ceil(F.col("size") / each))).otherwise(F.greatest(F.expr(f"rows * {ROW_BYTES} div {8 << 20}"), F.lit(1))).cast("bigint").alias("pieces"))


def chunk_rows(docs: DataFrame, row: int = ROW_BYTES) -> DataFrame:
    """doc_id, no, data: the UTF-8 bytes of each text in rows of fixed size."""
    data = F.col("text").cast("binary")
    rows = docs.select("doc_id", data.alias("b"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"int((octet_length(text) - 1) div {row})")))).alias("no"))
    return rows.select("doc_id", "no", F.substring("b", F.col("no") * row + 1, F.lit(row)).alias("data"))


@query("SELECT doc_id, i::INT AS no, least(8120, n - i * 8120)::BIGINT AS len FROM (SELECT doc_id, n, unnest(range(0, (n - 1) // 8120 + 1)) AS i FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents))")
def chunk_explode(spark: SparkSession, d: str) -> DataFrame:
    return chunk_rows(table(spark, d, "documents")).select("doc_id", "no", F.octet_length("data").cast("bigint").alias("len"))


@query("""SELECT doc_id, i::INT AS no, least(1000, n - i * 1000)::BIGINT AS len FROM (SELECT doc_id, n, unnest(range(0, (n - 1) // 1000 + 1)) AS i FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents WHERE doc_id = 7)) WHERE i BETWEEN 1 AND 3""")
def chunk_range(spark: SparkSession, d: str) -> DataFrame:
    return chunk_rows(table(spark, d, "documents").filter("doc_id = 7"), 1000).filter("no between 1 and 3").select("doc_id", "no", F.octet_length("data").cast("bigint").alias("len"))


@query("SELECT source, CAST(sum((octet_length(encode(text)) + 8119) // 8120) AS BIGINT) AS chunks FROM documents GROUP BY source")
def chunk_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.sum(chunks(F.octet_length("text"))).cast("bigint").alias("chunks"))


@query("SELECT doc_id, md5(text) AS md5, true AS complete FROM documents")
def reassemble(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    joined = chunk_rows(docs).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("no", "data"))).alias("c"))  # one object's chunks
    body = F.aggregate(F.col("c.data"), F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x))
    return joined.select("doc_id", body.alias("body")).join(docs.select("doc_id", F.octet_length("text").alias("size")), "doc_id").select("doc_id", F.md5("body").alias("md5"), (F.octet_length("body") == F.col("size")).alias("complete"))


@query("""WITH f AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS lo, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS hi FROM conversations)
 SELECT conv_id, o.off, turn FROM f JOIN (VALUES (0), (150), (700)) o(off) ON o.off >= lo AND o.off < hi""")
def frame_lookup(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    frames = table(spark, d, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("hi"), F.length("text").alias("n")).withColumn("lo", F.col("hi") - F.col("n"))
    offsets = F.filter(F.array(*map(F.lit, (0, 150, 700))), lambda x: (x >= F.col("lo")) & (x < F.col("hi")))
    return frames.select("conv_id", F.explode(offsets).alias("off"), "turn")


@query("""SELECT c.conv_id, count(*) AS listed, count(s.turn) AS found, coalesce(bool_and(s.turn IS NOT NULL AND s.e = md5(c.text)), true) AS valid FROM conversations c
 LEFT JOIN (SELECT conv_id, turn, md5(text) AS e FROM conversations WHERE turn <> 3) s ON s.conv_id = c.conv_id AND s.turn = c.turn GROUP BY c.conv_id""")
def multipart_plan(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "conversations").select("conv_id", "turn", F.md5("text").alias("want"))
    stored = table(spark, d, "conversations").filter("turn <> 3").select("conv_id", "turn", F.md5("text").alias("e"))
    got = listed.join(stored, ["conv_id", "turn"], "left")
    return got.groupBy("conv_id").agg(F.count(F.lit(1)).alias("listed"), F.count("e").alias("found"), F.bool_and(F.coalesce(F.col("e") == F.col("want"), F.lit(False))).alias("valid"))


@query("SELECT conv_id, md5(unhex(string_agg(md5(text), '' ORDER BY turn))) || '-' || count(*) AS etag FROM conversations GROUP BY conv_id")
def multipart_etag(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.md5("text").alias("m")))).alias("p"))  # an upload's own parts
    return parts.select("conv_id", F.concat(F.md5(F.unhex(F.array_join("p.m", ""))), F.lit("-"), F.size("p")).alias("etag"))


@query("""SELECT doc_id, CASE WHEN n_chars = 0 THEN 'zero' WHEN n_chars % 7 = 0 THEN 'pass' WHEN n_chars > 1000 AND n_chars <= 20000 AND n_chars % 3 = 0 THEN 'range'
 WHEN n_chars % 2 = 0 OR n_chars <= 8000 THEN 'cached' ELSE 'pass' END AS action FROM documents""")
def cache_plan(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    action = read_plan(n, readonly=n % 7 == 0, partial=n % 3 == 0, valid=n % 2 == 0, chunk=1000, span=20_000, whole=8000)
    return table(spark, d, "documents").select("doc_id", action.alias("action"))


def read_plan(size, readonly, partial, valid, chunk: int, span: int, whole: int):
    """zero, pass, range or cached, by the first rule that holds."""
    return F.when(size == 0, "zero").when(readonly, "pass").when((size > chunk) & (size <= span) & partial, "range").when(valid | (size <= whole), "cached").otherwise("pass")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'none' WHEN o_orderkey % 4 = 1 THEN CASE WHEN quality IS NULL THEN 'ok' ELSE 'failed' END
 WHEN o_orderkey % 4 = 2 THEN CASE WHEN quality IS NULL THEN 'failed' ELSE 'ok' END ELSE CASE WHEN quality = 1 THEN 'ok' ELSE 'failed' END END AS outcome FROM orders LEFT JOIN labels ON doc_id = o_orderkey""")
def precondition(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "labels").select(F.col("doc_id").alias("o_orderkey"), "quality")
    rows = table(spark, d, "orders").select("o_orderkey").join(now, "o_orderkey", "left")
    kind, there = F.col("o_orderkey") % 4, F.col("quality").isNotNull()
    ok = F.when(kind == 1, ~there).when(kind == 2, there).otherwise(F.coalesce(F.col("quality") == 1, F.lit(False)))
    return rows.select("o_orderkey", F.when(kind == 0, "none").when(ok, "ok").otherwise("failed").alias("outcome"))


@query("""SELECT doc_id, n < 16 OR n > 65536 OR len(list_distinct(list_transform(range(1, least(n, 512) + 1), lambda i: array_slice(b, i, i)))) > 200 AS skip
 FROM (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS n FROM documents)""")
def incompressible(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose first 512 bytes have over 200 distinct values, or that are too short or long to compress."""
    size = F.octet_length("text")
    head = F.hex(F.substring(F.col("text").cast("binary"), 1, 512))
    distinct = F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.expr("int(length(h) / 2)"))), lambda i: F.substring("h", i * 2 - 1, F.lit(2)))))
    return table(spark, d, "documents").select("doc_id", size.alias("size"), head.alias("h")).select("doc_id", ((F.col("size") < 16) | (F.col("size") > 65536) | (distinct > 200)).alias("skip"))
