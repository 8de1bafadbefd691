"""Objects: conditional reads of byte ranges, parts, copies, versions, listings and bulk deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import at, bytes_between, common_prefix, etag_matches, live, written
from ..plans.patterns import in_prefix
from ..registry import AS_OF, query, table
from .manifests import resolved

_T = f"TIMESTAMP '{AS_OF}'"
_OBJ = """(SELECT doc_id, source || '/' || lpad(doc_id::VARCHAR, 9, '0') AS key, encode(text) AS body, octet_length(encode(text)) AS size, md5(text) AS etag,
 CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '2024-01-01' + (doc_id % 30) * INTERVAL 1 DAY END AS expires, CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2023-12-01' + (doc_id % 20) * INTERVAL 1 HOUR END AS origin_modified,
 TIMESTAMP '2024-01-01' + (doc_id % 48) * INTERVAL 1 HOUR AS created FROM documents WHERE text IS NOT NULL)"""


def objects(spark: SparkSession, d: str) -> DataFrame:
    """Documents as objects."""
    i = F.col("doc_id")
    day = at("2024-01-01 00:00:00")
    hours = lambda n: F.make_dt_interval(F.lit(0), n.cast("int"))
    return table(spark, d, "documents").filter("text is not null").select(
        "doc_id", F.concat("source", F.lit("/"), F.lpad(i.cast("string"), 9, "0")).alias("key"), F.col("text").cast("binary").alias("body"), F.octet_length("text").cast("bigint").alias("size"), F.md5("text").alias("etag"),
        F.when(i % 7 != 0, day + F.make_dt_interval((i % 30).cast("int"))).alias("expires"), F.when(i % 3 == 0, at("2023-12-01 00:00:00") + hours(i % 20)).alias("origin_modified"), (day + hours(i % 48)).alias("created"),
    )


@query(f"SELECT key, size, etag, coalesce(origin_modified, created) AS last_modified FROM {_OBJ} WHERE expires IS NULL OR expires > {_T}")
def object_heads(spark: SparkSession, d: str) -> DataFrame:
    """Headers of live objects without their bodies; the origin's own time of change counts first (SC2, SF14)."""
    return headers(objects(spark, d), AS_OF)


def headers(rows: DataFrame, as_of: str) -> DataFrame:
    return rows.filter(live(F.col("expires"), as_of)).select("key", "size", "etag", F.coalesce("origin_modified", "created").alias("last_modified"))


@query(f"SELECT key, size, etag FROM {_OBJ} WHERE doc_id = 77 AND (expires IS NULL OR expires > {_T})")
def object_head(spark: SparkSession, d: str) -> DataFrame:
    """One live object's header; the key's filter reaches the scan (SC2)."""
    return headers(objects(spark, d).filter("doc_id = 77"), AS_OF).select("key", "size", "etag")


_ASK = f"""(SELECT *, CASE doc_id % 5 WHEN 1 THEN '"' || etag || '"' WHEN 2 THEN '"zzz"' END AS if_match, CASE doc_id % 5 WHEN 3 THEN '"zzz", W/"' || etag || '"' WHEN 4 THEN '"zzz"' END AS if_none,
 CASE WHEN doc_id % 3 = 1 THEN 10 WHEN doc_id % 3 = 2 THEN 100000 END AS first, CASE WHEN doc_id % 3 = 1 THEN 99 END AS last FROM {_OBJ})"""


@query(f"""WITH x AS (SELECT *, CASE WHEN doc_id % 5 = 2 THEN 412 WHEN doc_id % 5 = 3 THEN 304 WHEN first >= size THEN 416 WHEN first IS NOT NULL THEN 206 ELSE 200 END AS status FROM {_ASK})
 SELECT key, status, CASE WHEN status = 200 THEN etag WHEN status = 206 THEN md5(array_slice(body, first + 1, least(coalesce(last, size - 1), size - 1) + 1)) END AS md5,
 CASE WHEN status = 206 THEN 'bytes ' || first || '-' || least(coalesce(last, size - 1), size - 1) || '/' || size WHEN status = 416 THEN 'bytes */' || size END AS content_range FROM x""")
def object_read(spark: SparkSession, d: str) -> DataFrame:
    """A read with If-Match, If-None-Match and a range: 412, 304, 416, or the bytes (SC5, PR5)."""
    i = F.col("doc_id") % 5
    quoted = lambda before: F.concat(F.lit(before), F.col("etag"), F.lit('"'))
    asked = objects(spark, d).withColumn("if_match", F.when(i == 1, quoted('"')).when(i == 2, '"zzz"')).withColumn("if_none", F.when(i == 3, quoted('"zzz", W/"')).when(i == 4, '"zzz"'))
    k = F.col("doc_id") % 3
    asked = asked.withColumn("first", F.when(k == 1, 10).when(k == 2, 100_000)).withColumn("last", F.when(k == 1, 99)).withColumn("suffix", F.lit(None).cast("bigint"))
    return read(asked).select("key", "status", F.md5("part").alias("md5"), "content_range")


def read(asked: DataFrame) -> DataFrame:
    """Adds status, part (the bytes that are given) and content_range to reads of ``body``."""
    r = resolved(asked)
    ranged = F.coalesce(F.col("first"), F.col("suffix")).isNotNull()
    status = (
        F.when(F.col("if_match").isNotNull() & ~etag_matches(F.col("if_match"), F.col("etag")), 412)
        .when(F.col("if_none").isNotNull() & etag_matches(F.col("if_none"), F.col("etag")), 304)
        .when(ranged & ~F.col("valid"), 416)
        .when(ranged, 206)
        .otherwise(200)
    )
    r = r.withColumn("status", status)
    cut = F.substring("body", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start") + 1).cast("int"))
    part = F.when(F.col("status") == 200, F.col("body")).when(F.col("status") == 206, cut)
    span = F.when(F.col("status") == 206, F.concat(F.lit("bytes "), "start", F.lit("-"), "end", F.lit("/"), "size")).when(F.col("status") == 416, F.concat(F.lit("bytes */"), "size"))
    return r.withColumn("part", part).withColumn("content_range", span)


@query("SELECT p_partkey, total, TRY_CAST(nullif(regexp_extract(total, '^bytes [^/]*/([0-9]+)$', 1), '') AS BIGINT) AS size FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'bytes 0-9/*' WHEN p_partkey % 4 = 1 THEN p_name ELSE 'bytes 0-9/' || p_size * 100 END AS total FROM part)")
def content_range_total(spark: SparkSession, d: str) -> DataFrame:
    """The whole size that a Content-Range header names, if it does (X11)."""
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, "bytes 0-9/*").when(k == 1, F.col("p_name")).otherwise(F.concat(F.lit("bytes 0-9/"), F.col("p_size") * 100))
    return table(spark, d, "part").select("p_partkey", said.alias("total")).withColumn("size", F.regexp_extract("total", r"\Abytes [^/]*/([0-9]+)\z", 1).try_cast("bigint"))


_ENDS = "(SELECT conv_id, list(e ORDER BY turn) AS ends FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations) GROUP BY conv_id)"


@query(f"SELECT conv_id, n, len(ends)::BIGINT AS parts, CASE WHEN n <= len(ends) THEN coalesce(CASE WHEN n > 1 THEN ends[n - 1] END, 0)::BIGINT END AS start, CASE WHEN n <= len(ends) THEN (ends[n] - 1)::BIGINT END AS \"end\" FROM (SELECT *, unnest([1, 2, 3]) AS n FROM {_ENDS})")
def part_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of a part by its number; null where there is no such part (PR10)."""
    ends = F.sort_array(F.collect_list(F.struct("turn", "e")))
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.sum(F.length("text").cast("bigint")).over(w).alias("e")).groupBy("conv_id").agg(ends.alias("p"))  # a manifest's own parts
    rows = rows.select("conv_id", F.col("p.e").alias("ends"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("n"))
    end = F.try_element_at("ends", F.col("n"))
    return rows.select("conv_id", "n", F.size("ends").cast("bigint").alias("parts"), F.when(end.isNotNull(), F.coalesce(F.get("ends", F.col("n") - 2), F.lit(0).cast("bigint"))).alias("start"), (end - 1).alias("end"))


@query("""WITH p AS (SELECT conv_id, turn, md5(text) AS etag, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)
 SELECT conv_id, turn, etag, size, total, total > 4 AS truncated, CASE WHEN total > 4 THEN (SELECT max(q.turn) FROM p q WHERE q.conv_id = p.conv_id AND q.r <= 4) END AS next_marker FROM p WHERE r <= 4""")
def object_attributes(spark: SparkSession, d: str) -> DataFrame:
    """The first parts of each object with size and checksum, and where the next page begins (OB4, X18)."""
    parts = F.sort_array(F.collect_list(F.struct("turn", F.md5("text").alias("etag"), F.length("text").cast("bigint").alias("size"))))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(parts.alias("p"))  # an object's own parts
    total = F.size("p").cast("bigint")
    rows = rows.withColumn("total", total).withColumn("truncated", total > 4).withColumn("next_marker", F.when(total > 4, F.get("p", F.lit(3))["turn"]))
    return rows.select("conv_id", F.explode(F.slice("p", 1, 4)).alias("x"), "total", "truncated", "next_marker").select("conv_id", "x.turn", "x.etag", "x.size", "total", "truncated", "next_marker")


@query("""WITH stored AS (SELECT conv_id, turn, md5(text) AS etag, length(text) AS size FROM conversations), listed AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN conv_id % 9 = 4 THEN -turn ELSE turn END) AS place,
 CASE WHEN conv_id % 7 = 3 AND turn = 1 THEN 'other' ELSE etag END AS etag FROM stored WHERE NOT (turn = 2 AND conv_id % 2 = 0) UNION ALL SELECT DISTINCT conv_id, 1000, 1000, 'none' FROM stored WHERE conv_id % 11 = 5),
 j AS (SELECT l.conv_id, l.turn, l.place, l.turn <= lag(l.turn) OVER (PARTITION BY l.conv_id ORDER BY place) AS back, s.turn IS NULL AS missing, s.etag <> l.etag AS differs, s.size FROM listed l LEFT JOIN stored s ON s.conv_id = l.conv_id AND s.turn = l.turn)
 SELECT conv_id, count(*) AS parts, CASE WHEN bool_or(coalesce(back, false)) THEN 'order' WHEN bool_or(missing OR coalesce(differs, false)) THEN 'invalid' ELSE 'ok' END AS outcome, CAST(sum(size) AS BIGINT) AS size,
 (SELECT count(*) FROM stored s WHERE s.conv_id = j.conv_id) - count(*) FILTER (NOT missing) AS garbage FROM j GROUP BY conv_id""")
def multipart_complete(spark: SparkSession, d: str) -> DataFrame:
    """Completing an upload: parts must be listed in ascending order and be stored with
    the same tag; stored parts that are not listed become garbage (OB2, OB3, X17)."""
    c = F.col("conv_id")
    stored = table(spark, d, "conversations").select("conv_id", "turn", F.md5("text").alias("tag"), F.length("text").cast("bigint").alias("size"))
    by = F.when(c % 9 == 4, -F.col("turn")).otherwise(F.col("turn"))
    listed = stored.filter(~((F.col("turn") == 2) & (c % 2 == 0))).select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(by)).alias("place"), F.when((c % 7 == 3) & (F.col("turn") == 1), "other").otherwise(F.col("tag")).alias("etag"))
    extra = stored.filter(c % 11 == 5).select("conv_id").distinct().select("conv_id", F.lit(1000).cast("bigint").alias("turn"), F.lit(1000).alias("place"), F.lit("none").alias("etag"))
    return completed(listed.unionByName(extra), stored)


def completed(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """conv_id, parts, outcome, size, garbage of uploads whose ``listed`` parts have a ``place``."""
    back = F.col("turn") <= F.lag("turn").over(Window.partitionBy("conv_id").orderBy("place"))  # an upload's own parts
    j = listed.withColumn("back", back).join(stored, ["conv_id", "turn"], "left")
    bad = F.col("tag").isNull() | (F.col("tag") != F.col("etag"))
    sums = j.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts"), F.bool_or(F.coalesce("back", F.lit(False))).alias("order"), F.bool_or(bad).alias("bad"), F.sum("size").alias("size"), F.count("tag").alias("found"))
    return sums.join(stored.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conv_id").select("conv_id", "parts", F.when(F.col("order"), "order").when(F.col("bad"), "invalid").otherwise("ok").alias("outcome"), "size", (F.col("n") - F.col("found")).alias("garbage"))


@query("""SELECT conv_id, turn, md5(text) AS etag, sha256(text) AS sha256, length(text) AS size, CASE WHEN n = 1 AND conv_id % 2 = 0 THEN 'share' ELSE 'copy' END AS how,
 CASE WHEN n = 1 AND conv_id % 2 = 0 THEN conv_id * 1000 + turn ELSE 1000000 + conv_id * 1000 + turn END AS file_id FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""")
def copy_part(spark: SparkSession, d: str) -> DataFrame:
    """Copies into the same place share the file where the whole object is one; others get a new one; checksums come along (OB5, OB6)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))  # an object's own parts
    share = (F.col("n") == 1) & (F.col("conv_id") % 2 == 0)
    rows = table(spark, d, "conversations").withColumn("n", n)
    own = F.col("conv_id") * 1000 + F.col("turn")
    return rows.select("conv_id", "turn", F.md5("text").alias("etag"), F.sha2("text", 256).alias("sha256"), F.length("text").cast("bigint").alias("size"), F.when(share, "share").otherwise("copy").alias("how"), F.when(share, own).otherwise(own + 1_000_000).alias("file_id"))


@query(f"SELECT key, 'null' AS version, true AS latest, size, coalesce(origin_modified, created) AS last_modified FROM {_OBJ} WHERE (expires IS NULL OR expires > {_T}) AND key > 'src0/000000010' AND starts_with(key, 'src') ORDER BY key LIMIT 50")
def list_versions(spark: SparkSession, d: str) -> DataFrame:
    """Each current object is its one version (OB10)."""
    rows = headers(objects(spark, d), AS_OF).filter(in_prefix(F.col("key"), "src") & (F.col("key") > "src0/000000010")).orderBy("key").limit(50)
    return rows.select("key", F.lit("null").alias("version"), F.lit(True).alias("latest"), "size", "last_modified")


#: Start of a page: after this key; a folder that holds it has been given.
_AFTER = "https://c"
_FOLD = """(SELECT CASE WHEN instr(substr(url, 9), '/') > 0 THEN 'https://' || substr(substr(url, 9), 1, instr(substr(url, 9), '/')) ELSE url END AS name, instr(substr(url, 9), '/') > 0 AS is_prefix, url FROM pages WHERE starts_with(url, 'https://') AND url > 'https://c')"""


@query(f"""WITH n AS (SELECT name, is_prefix, max(url) AS last FROM {_FOLD} WHERE NOT (is_prefix AND starts_with('{_AFTER}', name)) GROUP BY name, is_prefix), r AS (SELECT *, row_number() OVER (ORDER BY name) AS k FROM n)
 SELECT replace(replace(name, ':', '%3A'), '/', '%2F') AS name, is_prefix, (SELECT count(*) > 15 FROM r) AS truncated, (SELECT last FROM r WHERE k = 15) AS token FROM r WHERE k <= 15""")
def list_objects(spark: SparkSession, d: str) -> DataFrame:
    """A page of a folded listing: prefix, delimiter, start-after, max-keys over keys
    and folders, the token of the last key consumed, and names encoded for URLs (OB9, OB11, TK2)."""
    got = folded_page(table(spark, d, "pages").select("url"), "url", "https://", "/", _AFTER, 15)
    encoded = F.replace(F.replace("name", F.lit(":"), F.lit("%3A")), F.lit("/"), F.lit("%2F"))
    return got.withColumn("name", encoded)


def folded_page(rows: DataFrame, key: str, prefix: str, delimiter: str, after: str, most: int) -> DataFrame:
    """name, is_prefix, truncated, token. A folder is one entry, whatever it holds, and
    is passed over if ``after`` lies in it; a page of no entries is not truncated."""
    folder = common_prefix(F.col(key), prefix, delimiter)
    rows = rows.filter(in_prefix(F.col(key), prefix) & (F.col(key) > F.lit(after))).select(F.coalesce(folder, F.col(key)).alias("name"), folder.isNotNull().alias("is_prefix"), F.col(key).alias("k"))
    rows = rows.filter(~(F.col("is_prefix") & F.startswith(F.lit(after), F.col("name"))))
    page = rows.groupBy("name", "is_prefix").agg(F.max("k").alias("last")).orderBy("name").limit(most + 1)
    kept = page.agg(F.sort_array(F.collect_list(F.struct("name", "is_prefix", "last"))).alias("p"))  # at most ``most`` + 1 entries
    token = F.try_element_at("p", F.least(F.size("p"), F.lit(most)))["last"]
    return kept.select(F.explode(F.slice("p", 1, most)).alias("x"), (F.size("p") > most).alias("truncated"), token.alias("token")).select("x.name", "x.is_prefix", "truncated", "token")


@query(f"""SELECT o_orderkey AS asked, CASE WHEN doc_id IS NULL THEN 'absent' WHEN NOT (expires IS NULL OR expires > {_T}) THEN 'expired' ELSE 'deleted' END AS status, CASE WHEN doc_id IS NOT NULL THEN doc_id * 10 END AS file_id
 FROM orders LEFT JOIN {_OBJ} ON doc_id = o_orderkey // 2 AND o_orderkey % 2 = 0""")
def bulk_delete(spark: SparkSession, d: str) -> DataFrame:
    """A row for each key that is asked for: deleted, expired or absent, with the file that is queued (OB1, X19)."""
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("asked"), F.when(F.col("o_orderkey") % 2 == 0, F.expr("o_orderkey div 2")).alias("doc_id"))
    rows = asked.join(objects(spark, d).select("doc_id", "expires", F.lit(True).alias("there")), "doc_id", "left")
    status = F.when(F.col("there").isNull(), "absent").when(~live(F.col("expires"), AS_OF), "expired").otherwise("deleted")
    return rows.select("asked", status.alias("status"), F.when(F.col("there").isNotNull(), F.col("doc_id") * 10).alias("file_id"))


@query(f"""SELECT key FROM {_OBJ} WHERE starts_with(key, 'src1') AND key >= 'src1/' AND key > 'src1/000000003' ORDER BY key LIMIT 40""")
def origin_listing(spark: SparkSession, d: str) -> DataFrame:
    """An origin is listed from the folder that the prefix lies in, then by prefix and start (X9)."""
    prefix, after = "src1", "src1/000000003"
    floor = prefix[: prefix.rfind("/") + 1] if "/" in prefix else ""
    rows = objects(spark, d).select("key").filter((F.col("key") >= floor) & in_prefix(F.col("key"), prefix) & (F.col("key") > after))
    return rows.orderBy("key").limit(40)


@query(f"""SELECT key, asked, CASE asked WHEN 'if_absent' THEN 'If-None-Match: *' WHEN 'if_present' THEN 'If-Match: ' || coalesce(etag, '*') WHEN 'if_match' THEN CASE WHEN etag IS NULL THEN 'refuse' ELSE 'If-Match: ' || etag END ELSE '' END AS header
 FROM (SELECT key, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE etag END AS etag, ['none', 'if_absent', 'if_present', 'if_match'][doc_id % 4 + 1] AS asked FROM {_OBJ})""")
def origin_precondition(spark: SparkSession, d: str) -> DataFrame:
    """A write's condition as the header that its origin understands (X10)."""
    i = F.col("doc_id")
    rows = objects(spark, d).select("key", F.when(i % 5 != 0, F.col("etag")).alias("etag"), F.element_at(F.array(*map(F.lit, ("none", "if_absent", "if_present", "if_match"))), (i % 4 + 1).cast("int")).alias("asked"))
    own = F.concat(F.lit("If-Match: "), F.col("etag"))
    header = F.when(F.col("asked") == "if_absent", "If-None-Match: *").when(F.col("asked") == "if_present", F.coalesce(own, F.lit("If-Match: *"))).when(F.col("asked") == "if_match", F.coalesce(own, F.lit("refuse"))).otherwise("")
    return rows.select("key", "asked", header.alias("header"))


@query(f"SELECT doc_id, md5(CASE WHEN size < 3 THEN ''::BLOB ELSE array_slice(body, greatest(size - 40, 0) + 1, size - 2) END) AS md5 FROM {_OBJ}")
def getrange_bytes(spark: SparkSession, d: str) -> DataFrame:
    """GETRANGE counts bytes, not characters (PR9)."""
    return objects(spark, d).select("doc_id", F.md5(bytes_between(F.col("body"), -40, -3)).alias("md5"))


@query(f"SELECT doc_id, md5(CASE WHEN size >= 50 THEN array_slice(body, 1, 50) ELSE body || unhex(repeat('00', 50 - size)) END || encode('XYZ') || CASE WHEN size > 53 THEN array_slice(body, 54, size) ELSE ''::BLOB END) AS md5 FROM {_OBJ}")
def setrange_bytes(spark: SparkSession, d: str) -> DataFrame:
    """SETRANGE writes bytes at a byte offset, after zeros where the value is shorter (KV6)."""
    return objects(spark, d).select("doc_id", F.md5(written(F.col("body"), b"XYZ", 50)).alias("md5"))


_BLOCK = 32 * 8120  # bytes of the rows of one cached block


@query(f"""WITH p AS (SELECT doc_id, n_chars * 5000 AS size, doc_id * 1000 % (n_chars * 5000 + 1) AS start FROM documents WHERE n_chars > 0), q AS (SELECT *, least(start + 500000, size) AS stop FROM p),
 b AS (SELECT doc_id, size, start, stop, unnest(range(start // {_BLOCK}, (greatest(stop, start + 1) - 1) // {_BLOCK} + 1)) AS block FROM q)
 SELECT doc_id, count(*) AS blocks, count(*) FILTER ((doc_id + block) % 3 = 0) AS hits, min(block) * {_BLOCK} AS aligned_start, least(max(block) * {_BLOCK} + {_BLOCK}, any_value(size)) AS aligned_end FROM b GROUP BY doc_id""")
def block_fill(spark: SparkSession, d: str) -> DataFrame:
    """A read widened to whole blocks: those that are cached, and what is fetched for the others (X22)."""
    rows = table(spark, d, "documents").filter("n_chars > 0").select("doc_id", (F.col("n_chars") * 5000).alias("size"))
    rows = rows.withColumn("start", F.col("doc_id") * 1000 % (F.col("size") + 1)).withColumn("stop", F.least(F.col("start") + 500_000, F.col("size")))
    block = lambda c: F.floor(c / _BLOCK)
    rows = rows.withColumn("blocks", F.sequence(block(F.col("start")), block(F.greatest("stop", F.col("start") + 1) - 1)))
    hits = F.size(F.filter("blocks", lambda b: (F.col("doc_id") + b) % 3 == 0))
    end = F.least(F.array_max("blocks") * _BLOCK + _BLOCK, F.col("size"))
    return rows.select("doc_id", F.size("blocks").cast("bigint").alias("blocks"), hits.cast("bigint").alias("hits"), (F.array_min("blocks") * _BLOCK).alias("aligned_start"), end.alias("aligned_end"))
