"""Object listings: keyset pages, delimiter folding, globs, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import common_prefix, etag_matches
from ..plans.patterns import glob, in_prefix
from ..registry import query, table


def page(rows: DataFrame, key: str, prefix: str, after: str, size: int) -> DataFrame:
    """The next keys by byte order after ``after``; both bounds reach the scan."""
    return rows.filter(in_prefix(F.col(key), prefix) & (F.col(key) > F.lit(after))).orderBy(key).limit(size)


@query("SELECT url, page_id FROM pages WHERE starts_with(url, 'https://') AND url > 'https://b' ORDER BY url LIMIT 20")
def list_keyset(spark: SparkSession, d: str) -> DataFrame:
    return page(table(spark, d, "pages").select("url", "page_id"), "url", "https://", "https://b", 20)


def fold(rows: DataFrame, key: str, prefix: str, delimiter: str) -> DataFrame:
    """name, is_prefix, n: plain keys, and one row for each common prefix."""
    p = common_prefix(F.col(key), prefix, delimiter)
    return rows.filter(in_prefix(F.col(key), prefix)).groupBy(F.coalesce(p, F.col(key)).alias("name"), p.isNotNull().alias("is_prefix")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN i > 0 THEN 'https://' || substr(r, 1, i) ELSE url END AS name, i > 0 AS is_prefix, count(*) AS n
 FROM (SELECT url, substr(url, 9) AS r, instr(substr(url, 9), '/') AS i FROM pages WHERE starts_with(url, 'https://')) GROUP BY ALL""")
def list_delimiter(spark: SparkSession, d: str) -> DataFrame:
    return fold(table(spark, d, "pages"), "url", "https://", "/")


@query("""WITH p AS (SELECT url, row_number() OVER (ORDER BY url) AS r FROM pages WHERE url > 'http://c')
 SELECT url, (SELECT count(*) > 10 FROM p) AS truncated, (SELECT url FROM p WHERE r = 10) AS token FROM p WHERE r <= 10""")
def page_truncated(spark: SparkSession, d: str) -> DataFrame:
    return paged(table(spark, d, "pages").select("url"), "url", "http://c", 10)


def paged(rows: DataFrame, key: str, after: str, size: int) -> DataFrame:
    """A page with whether more follow and the token of its last key: one key more is read."""
    got = page(rows, key, "", after, size + 1)
    keys = got.agg(F.sort_array(F.collect_list(key)).alias("k"))  # at most size + 1 keys
    return keys.select(F.explode(F.slice("k", 1, size)).alias(key), (F.size("k") > size).alias("truncated"), F.try_element_at("k", F.least(F.size("k"), F.lit(size))).alias("token"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE (l_orderkey > 100 OR (l_orderkey = 100 AND l_linenumber > 2)) AND l_orderkey < 200
 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50""")
def composite_keyset(spark: SparkSession, d: str) -> DataFrame:
    k = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    # The first column's bound alone is what a scan can use.
    return table(spark, d, "lineitem").select(k).filter("l_orderkey >= 100 and l_orderkey < 200 and (l_orderkey > 100 or l_linenumber > 2)").orderBy(k).limit(50)


@query(r"""SELECT url FROM pages WHERE regexp_full_match(url, 'https://[^/]*\.example\.com/en/[^/]*')""")
def glob_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("url").filter(glob(F.col("url"), "https://*.example.com/en/*"))


@query(r"""SELECT url, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages""")
def path_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("url", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1).alias("path"))


@query("SELECT p_partkey, url_encode(p_name) AS encoded, replace(url_encode(p_name), '%2F', '/') AS with_slashes FROM part")
def url_display(spark: SparkSession, d: str) -> DataFrame:
    """Percent-encoding that keeps unreserved characters and, on request, slashes."""
    encoded = F.replace(F.replace(F.replace(F.url_encode("p_name"), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return table(spark, d, "part").select("p_partkey", encoded.alias("encoded"), F.replace(encoded, F.lit("%2F"), F.lit("/")).alias("with_slashes"))


#: Content types by file extension.
TYPES = (
    ("parquet", "application/vnd.apache.parquet"),
    ("tsv", "text/tab-separated-values"),
    ("sf", "text/tab-separated-values"),
    ("csv", "text/csv"),
    ("json", "application/json"),
    ("zip", "application/zip"),
    ("gz", "application/gzip"),
    ("html", "text/html; charset=utf-8"),
    ("txt", "text/plain; charset=utf-8"),
    ("png", "image/png"),
)
_EXT = "['.parquet', '.TSV', '.sf', '.csv', '.JSON', '.tar.zip', '.gz', '.html', '', '.d/file']"


@query(f"""SELECT doc_id, k, CASE regexp_extract(lower(k), '[.]([^./]+)$', 1) WHEN 'parquet' THEN 'application/vnd.apache.parquet' WHEN 'tsv' THEN 'text/tab-separated-values' WHEN 'sf' THEN 'text/tab-separated-values' WHEN 'csv' THEN 'text/csv'
 WHEN 'json' THEN 'application/json' WHEN 'zip' THEN 'application/zip' WHEN 'gz' THEN 'application/gzip' WHEN 'html' THEN 'text/html; charset=utf-8' ELSE 'application/octet-stream' END AS content_type FROM (SELECT doc_id, source || '/' || doc_id || {_EXT}[doc_id % 10 + 1] AS k FROM documents)""")
def content_type(spark: SparkSession, d: str) -> DataFrame:
    ends = (".parquet", ".TSV", ".sf", ".csv", ".JSON", ".tar.zip", ".gz", ".html", "", ".d/file")
    key = F.concat("source", F.lit("/"), "doc_id", F.element_at(F.array(*map(F.lit, ends)), (F.col("doc_id") % 10 + 1).cast("int")))
    return table(spark, d, "documents").select("doc_id", key.alias("k")).withColumn("content_type", type_of(F.col("k")))


def type_of(key: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TYPES for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(key, r"\.([^./]+)$", 1))), F.lit("application/octet-stream"))


_NAMES = "('abc'), ('A'), ('a_b.c-1'), (''), ('é'), ('a b'), ('" + "x" * 58 + "'), ('" + "x" * 59 + "')"


@query(f"SELECT k, regexp_full_match(k, '[a-z0-9._-]{{1,58}}') AS name_ok, regexp_full_match(k, '[a-z][a-z0-9_-]*(\\.[a-z][a-z0-9_-]*)*') AND length(k) <= 255 AS type_ok FROM (VALUES {_NAMES}) v(k)")
def valid_name(spark: SparkSession, d: str) -> DataFrame:
    keys = spark.sql(f"SELECT * FROM VALUES {_NAMES} AS v(k)")
    return keys.select("k", F.col("k").rlike(r"\A[a-z0-9._-]{1,58}\z").alias("name_ok"), (F.col("k").rlike(r"\A[a-z][a-z0-9_-]*(\.[a-z][a-z0-9_-]*)*\z") & (F.octet_length("k") <= 255)).alias("type_ok"))


_TAGS = """('"a", "b"', 'b'), ('*', 'x'), ('W/"q"', 'q'), ('"z"', 'q'), ('', ''), ('a,,b', 'b')"""


@query(f"""SELECT h, e, trim(h) = '*' OR len(list_filter(list_transform(string_split(h, ','), lambda x: trim(regexp_replace(trim(x), '^W/', ''), '"')), lambda x: x = e AND x <> '')) > 0 AS ok FROM (VALUES {_TAGS}) v(h, e)""")
def etag_match(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM VALUES {_TAGS} AS v(h, e)")
    return rows.select("h", "e", etag_matches(F.col("h"), F.col("e")).alias("ok"))


_DUR = "('PT1H'), ('PT90S'), ('PT1H30M5S'), ('PT'), ('P1D'), ('PT2M'), ('x')"


@query(f"""SELECT k, CASE WHEN regexp_full_match(k, 'PT([0-9]+H)?([0-9]+M)?([0-9]+S)?') AND k <> 'PT' THEN coalesce(TRY_CAST(regexp_extract(k, '([0-9]+)H', 1) AS BIGINT), 0) * 3600
 + coalesce(TRY_CAST(regexp_extract(k, '([0-9]+)M', 1) AS BIGINT), 0) * 60 + coalesce(TRY_CAST(regexp_extract(k, '([0-9]+)S', 1) AS BIGINT), 0) END AS seconds FROM (VALUES {_DUR}) v(k)""")
def iso_duration(spark: SparkSession, d: str) -> DataFrame:
    part = lambda u: F.coalesce(F.regexp_extract("k", f"([0-9]+){u}", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    ok = F.col("k").rlike(r"\APT([0-9]+H)?([0-9]+M)?([0-9]+S)?\z") & (F.col("k") != "PT")
    return spark.sql(f"SELECT * FROM VALUES {_DUR} AS v(k)").select("k", F.when(ok, part("H") * 3600 + part("M") * 60 + part("S")).alias("seconds"))
