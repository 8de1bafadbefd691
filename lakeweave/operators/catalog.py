"""Names, attributes and catalogues: archive keys, schemas, targets, JSON attributes, usage, contracts, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import chunks
from ..registry import query, table

#: Kinds of archive by the suffix of their key.
ARCHIVES = ((".tar.zst", "tar_zstd"), (".tzst", "tar_zstd"), (".zip", "zip"), (".tar", "tar"))
_KEYS = """(SELECT page_id, CASE page_id % 8 WHEN 0 THEN url || '.ZIP/a/b.txt' WHEN 1 THEN url || '.tar/x.zip/y' WHEN 2 THEN url || '.tar.zst/' WHEN 3 THEN url || '.tzst/../etc'
 WHEN 4 THEN url || '.zip//abs' WHEN 5 THEN url || '.zip' WHEN 6 THEN url || '.Tar.Zst/dir/f.parquet' ELSE url END AS key FROM pages)"""


@query(f"""WITH m AS (SELECT page_id, key, regexp_extract(key, '(?is)^(.*?\\.(tar\\.zst|tzst|zip|tar))/(.*)$', ['archive', 'suffix', 'member']) AS x FROM {_KEYS})
 SELECT page_id, CASE WHEN ok THEN x.archive END AS archive, CASE WHEN ok THEN x.member END AS member, CASE WHEN ok THEN CASE lower(x.suffix) WHEN 'zip' THEN 'zip' WHEN 'tar' THEN 'tar' ELSE 'tar_zstd' END END AS kind
 FROM (SELECT *, x.archive <> '' AND NOT starts_with(x.member, '/') AND NOT list_contains(string_split(x.member, '/'), '..') AS ok FROM m)""")
def archive_key_split(spark: SparkSession, d: str) -> DataFrame:
    """The archive and the member that a key names, at the earliest archive suffix (PR20)."""
    i, url = F.col("page_id") % 8, F.col("url")
    tails = (".ZIP/a/b.txt", ".tar/x.zip/y", ".tar.zst/", ".tzst/../etc", ".zip//abs", ".zip", ".Tar.Zst/dir/f.parquet")
    key = url
    for k, tail in enumerate(tails):
        key = F.when(i == k, F.concat(url, F.lit(tail))).otherwise(key)
    return table(spark, d, "pages").select("page_id", key.alias("key")).withColumn("x", archive_parts(F.col("key"))).select("page_id", "x.archive", "x.member", "x.kind")


def archive_parts(key: Column) -> Column:
    """archive, member, kind; null where there is none or the member's path is unsafe."""
    pattern = r"(?is)\A(.*?\.(tar\.zst|tzst|zip|tar))/(.*)\z"
    archive, suffix, member = (F.regexp_extract(key, pattern, g) for g in (1, 2, 3))
    safe = ~member.startswith("/") & ~member.contains("\0") & ~F.array_contains(F.split(member, "/"), "..")
    kind = F.try_element_at(F.create_map(*[F.lit(x) for s, k in ARCHIVES for x in (s, k)]), F.concat(F.lit("."), F.lower(suffix)))
    return F.when((archive != "") & safe, F.struct(archive.alias("archive"), member.alias("member"), kind.alias("kind")))


#: Schema prefix, kind, largest value that is stored inline.
KINDS = (("s3b_", "bucket", 65536), ("s3c_", "cache", 8120), ("s3w_", "writeback", 65536), ("s3q_", "queue", 8120))


@query("""WITH s AS (SELECT doc_id, ['s3b_', 's3c_', 's3w_', 's3q_', 'pg_', 's3b'][doc_id % 6 + 1] || CASE WHEN doc_id % 13 = 0 THEN 'Bad Name' WHEN doc_id % 17 = 0 THEN '' ELSE source END AS schema FROM documents)
 SELECT doc_id, schema, CASE WHEN ok THEN CASE substr(schema, 1, 4) WHEN 's3b_' THEN 'bucket' WHEN 's3c_' THEN 'cache' WHEN 's3w_' THEN 'writeback' ELSE 'queue' END END AS kind, CASE WHEN ok THEN substr(schema, 5) END AS name,
 CASE WHEN ok THEN CASE WHEN substr(schema, 1, 4) IN ('s3b_', 's3w_') THEN 65536 ELSE 8120 END END AS inline_max FROM (SELECT *, regexp_full_match(schema, 's3[bcwq]_[a-z0-9._-]{1,58}') AS ok FROM s)""")
def schema_parse(spark: SparkSession, d: str) -> DataFrame:
    """The kind and name in a schema's name; null if it is no namespace's (PR21)."""
    i = F.col("doc_id")
    head = F.element_at(F.array(*map(F.lit, ("s3b_", "s3c_", "s3w_", "s3q_", "pg_", "s3b"))), (i % 6 + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", F.concat(head, F.when(i % 13 == 0, "Bad Name").when(i % 17 == 0, "").otherwise(F.col("source"))).alias("schema"))
    return rows.withColumn("x", schema_parts(F.col("schema"))).select("doc_id", "schema", "x.kind", "x.name", "x.inline_max")


def schema_parts(schema: Column) -> Column:
    start, name = F.substring(schema, 1, 4), F.substring(schema, F.lit(5), F.length(schema))
    of = lambda k: F.create_map(*[F.lit(x) for row in KINDS for x in (row[0], row[k])])
    ok = start.isin([k[0] for k in KINDS]) & name.rlike(r"\A[a-z0-9._-]{1,58}\z")
    return F.when(ok, F.struct(F.try_element_at(of(1), start).alias("kind"), name.alias("name"), F.try_element_at(of(2), start).alias("inline_max")))


@query("""WITH k AS (SELECT o_orderkey, ['plain', 's3://b/k/x', 's3://b/', 's3:///k', 's3://b'][o_orderkey % 5 + 1] || CASE WHEN o_orderkey % 5 = 1 THEN o_custkey::VARCHAR ELSE '' END AS raw FROM orders), m AS (SELECT *, regexp_extract(raw, '^s3://([^/]+)/(.+)$', ['b', 'k']) AS x FROM k)
 SELECT o_orderkey, CASE WHEN x.b <> '' THEN 'bucket' ELSE 'cache' END AS kind, CASE WHEN x.b <> '' THEN x.b ELSE 'main' END AS namespace, CASE WHEN x.b <> '' THEN x.k ELSE raw END AS key, NOT starts_with(raw, 's3://') AS writable FROM m""")
def target_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Where a key leads: reads may cross over to a bucket, writes may not (PR22)."""
    i = F.col("o_orderkey") % 5
    raw = F.concat(F.element_at(F.array(*map(F.lit, ("plain", "s3://b/k/x", "s3://b/", "s3:///k", "s3://b"))), (i + 1).cast("int")), F.when(i == 1, F.col("o_custkey").cast("string")).otherwise(""))
    rows = table(spark, d, "orders").select("o_orderkey", raw.alias("raw"))
    bucket, key = (F.regexp_extract("raw", r"(?s)\As3://([^/]+)/(.+)\z", g) for g in (1, 2))
    far = bucket != ""
    return rows.select("o_orderkey", F.when(far, "bucket").otherwise("cache").alias("kind"), F.when(far, bucket).otherwise("main").alias("namespace"), F.when(far, key).otherwise(F.col("raw")).alias("key"), (~F.col("raw").startswith("s3://")).alias("writable"))


_ATTRS = "(SELECT event_id, props, '{\"k\":' || user_id || ',\"tier\":\"' || event_type || '\"}' AS patch FROM events)"


@query(f"""WITH m AS (SELECT event_id, json_merge_patch(props, patch) AS j FROM {_ATTRS}) SELECT event_id, json_extract_string(j, '$.k') AS k, json_extract_string(j, '$.tier') AS tier,
 len(json_keys(j)) AS keys, len(json_keys(j)) - CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS left_keys FROM m""")
def attrs_merge(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of a JSON object are set, the newer value counts, or taken away (SF20, X14)."""
    patch = F.to_json(F.create_map(F.lit("k"), F.col("user_id").cast("string"), F.lit("tier"), F.col("event_type")))
    kind = "map<string,string>"
    rows = table(spark, d, "events").select("event_id", merged(F.from_json("props", kind), F.from_json(patch, kind)).alias("m"))
    less = F.when(F.col("event_id") % 2 == 0, removed(F.col("m"), "tier")).otherwise(F.col("m"))
    return rows.select("event_id", F.col("m")["k"].alias("k"), F.col("m")["tier"].alias("tier"), F.size("m").cast("bigint").alias("keys"), F.size(less).cast("bigint").alias("left_keys"))


def merged(old: Column, new: Column) -> Column:
    """Two attribute maps as one; the newer map's values count."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def removed(attrs: Column, name: str) -> Column:
    return F.map_filter(attrs, lambda k, _: k != name)


@query("""WITH u AS (SELECT source AS name, ['bucket', 'cache', 'queue'][(length(source) + ascii(right(source, 1))) % 3 + 1] AS kind, sum(octet_length(encode(text))) AS bytes, count(*) AS objects, min(n_chars) AS oldest FROM documents WHERE text IS NOT NULL GROUP BY source)
 SELECT kind, CASE WHEN grouping(name) = 1 THEN NULL ELSE name END AS name, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(objects) AS BIGINT) AS objects, max(oldest) AS oldest FROM u GROUP BY ROLLUP (kind, name) HAVING kind IS NOT NULL OR grouping(kind) = 1""")
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Usage of each namespace, of each kind, and of all (AG4)."""
    kind = F.element_at(F.array(*map(F.lit, ("bucket", "cache", "queue"))), ((F.length("source") + F.ascii(F.right("source", F.lit(1)))) % 3 + 1).cast("int"))
    u = table(spark, d, "documents").filter("text is not null").groupBy(F.col("source").alias("name")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("objects"), F.min("n_chars").alias("oldest"), F.first(kind).alias("kind"))
    return u.rollup("kind", "name").agg(F.sum("bytes").alias("bytes"), F.sum("objects").alias("objects"), F.max("oldest").alias("oldest"))


@query("""WITH p AS (SELECT conv_id, turn, length(text) AS n FROM conversations), m AS (SELECT conv_id, sum(n) AS bytes, sum((n + 99) // 100) AS rows, min(turn) AS oldest FROM p GROUP BY conv_id)
 SELECT conv_id % 10 AS namespace, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS objects, CAST(sum(rows) AS BIGINT) AS rows, min(oldest) AS oldest FROM m GROUP BY 1""")
def namespace_rows(spark: SparkSession, d: str) -> DataFrame:
    """Bytes, objects, stored rows of all parts, and the oldest, of each namespace (AG3)."""
    n = F.length("text").cast("bigint")
    m = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(n).alias("sizes"), F.min("turn").alias("oldest"))  # an object's own parts
    total = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda s, x: s + x)
    rows = F.aggregate(F.transform("sizes", lambda x: chunks(x, 100)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return m.groupBy((F.col("conv_id") % 10).alias("namespace")).agg(F.sum(total).alias("bytes"), F.count(F.lit(1)).alias("objects"), F.sum(rows).alias("rows"), F.min("oldest").alias("oldest"))


_SPACES = "(SELECT DISTINCT source AS name FROM documents)"


@query(f"""WITH cat AS (SELECT name FROM {_SPACES} WHERE name <> 'src1' UNION ALL SELECT 'gone' UNION ALL SELECT 'lost'), own AS (SELECT DISTINCT source AS name FROM documents)
 SELECT coalesce(c.name, o.name) AS name, CASE WHEN c.name IS NULL THEN 'adopt' WHEN o.name IS NULL THEN 'drop' ELSE 'keep' END AS action, coalesce(n, 0) AS objects FROM cat c FULL JOIN own o ON o.name = c.name LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) s ON s.source = o.name""")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue and what is stored: stored namespaces that it lacks are adopted, its empty names dropped (OB8, X3)."""
    own = table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    listed = own.select("name").filter("name <> 'src1'").unionByName(spark.createDataFrame([("gone",), ("lost",)], "name string"))
    rows = listed.withColumn("c", F.lit(1)).join(own, "name", "full")
    return rows.select("name", F.when(F.col("c").isNull(), "adopt").when(F.col("n").isNull(), "drop").otherwise("keep").alias("action"), F.coalesce("n", F.lit(0).cast("bigint")).alias("objects"))


@query("""SELECT 'copy' AS namespace, source, count(*) AS objects, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE source <> 'src0' GROUP BY source UNION ALL SELECT 'origin', source, count(*), CAST(sum(n_chars) AS BIGINT) FROM documents GROUP BY source""")
def clone_namespace(spark: SparkSession, d: str) -> DataFrame:
    """A clone is a table of its own: what is dropped from it stays in its origin (OB8, SK6)."""
    from .tables import Versions

    origin, copy = Versions(spark), Versions(spark)
    origin.append(table(spark, d, "documents").select("doc_id", "source", "n_chars"))
    copy.append(origin.read())
    copy.delete(F.col("source") == "src0")
    sums = lambda t, name: t.read().groupBy("source").agg(F.count(F.lit(1)).alias("objects"), F.sum("n_chars").alias("chars")).select(F.lit(name).alias("namespace"), "source", "objects", "chars")
    return sums(copy, "copy").unionByName(sums(origin, "origin"))


_CONTRACTS = "('O', 'orderkey,custkey', 'f1'), ('F', 'orderkey', 'f1'), ('O', 'orderkey', 'f2'), ('P', 'custkey', 'f3')"
_TARGETS = "('t1', 'O'), ('t2', 'F'), ('t3', 'P')"


@query(f"""WITH c(scope, arguments, name) AS (VALUES {_CONTRACTS}), t(target, scope) AS (VALUES {_TARGETS}), cat AS (SELECT o_orderstatus AS scope, 'f' || (o_orderkey % 2 + 1) AS name, string_agg(DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN 'orderkey' ELSE 'orderkey' END, ',') AS arguments, count(*) AS n FROM orders GROUP BY ALL)
 SELECT target, name, CASE WHEN cat.n IS NULL THEN 'missing' WHEN cat.arguments IS DISTINCT FROM c.arguments THEN 'arguments' ELSE 'ok' END AS reason FROM t JOIN c USING (scope) LEFT JOIN cat USING (scope, name)""")
def contract_targets(spark: SparkSession, d: str) -> DataFrame:
    """Each target is held against the contracts of its scope; the first reason that fails counts (X1)."""
    contracts = spark.sql(f"SELECT * FROM VALUES {_CONTRACTS} AS v(scope, arguments, name)")
    targets = spark.sql(f"SELECT * FROM VALUES {_TARGETS} AS v(target, scope)")
    name = F.concat(F.lit("f"), F.col("o_orderkey") % 2 + 1)
    found = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("scope"), name.alias("name")).agg(F.lit("orderkey").alias("has"), F.count(F.lit(1)).alias("n"))
    rows = targets.join(contracts, "scope").join(found, ["scope", "name"], "left")
    return rows.select("target", "name", F.when(F.col("n").isNull(), "missing").when(~F.col("has").eqNullSafe(F.col("arguments")), "arguments").otherwise("ok").alias("reason"))


_FACTS = """(SELECT 'dead uploads' AS fact, count(*) AS value, 0 AS warn, 100 AS fail FROM labels WHERE toxic = 1 UNION ALL SELECT 'largest namespace', max(n), 400, 1000000 FROM (SELECT count(*) AS n FROM documents GROUP BY source)
 UNION ALL SELECT 'oldest open order', date_diff('day', min(o_orderdate), TIMESTAMP '1998-01-01'), 30, 365 FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'idle customers', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)), 100000000, 200000000)"""


@query(f"SELECT fact, value, CASE WHEN value > fail THEN 'FAIL' WHEN value > warn THEN 'WARN' ELSE 'PASS' END AS status FROM {_FACTS}")
def doctor_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts that are read from the tables, against the limits of their rules (CT13, X4)."""
    t = lambda name: table(spark, d, name)
    fact = lambda df, name, value: df.agg(F.lit(name).alias("fact"), value.cast("bigint").alias("value"))
    days = F.datediff(F.lit("1998-01-01").cast("date"), F.to_date(F.min("o_orderdate")))
    rows = fact(t("labels").filter("toxic = 1"), "dead uploads", F.count(F.lit(1)))
    rows = rows.unionByName(fact(t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")), "largest namespace", F.max("n")))
    rows = rows.unionByName(fact(t("orders").filter("o_orderstatus = 'O'"), "oldest open order", days))
    rows = rows.unionByName(fact(t("customer").join(t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti"), "idle customers", F.count(F.lit(1))))
    limits = spark.createDataFrame([("dead uploads", 0, 100), ("largest namespace", 400, 1_000_000), ("oldest open order", 30, 365), ("idle customers", 100_000_000, 200_000_000)], "fact string, warn long, fail long")
    return judged(rows.join(F.broadcast(limits), "fact")).select("fact", "value", "status")  # four rules


def judged(facts: DataFrame) -> DataFrame:
    """Adds status: FAIL above ``fail``, WARN above ``warn``, else PASS."""
    v = F.col("value")
    return facts.withColumn("status", F.when(v > F.col("fail"), "FAIL").when(v > F.col("warn"), "WARN").otherwise("PASS"))


@query("""SELECT s_suppkey, need, usable, CASE WHEN need > usable THEN 'FAIL' WHEN need * 10 > usable * 9 THEN 'WARN' ELSE 'PASS' END AS status
 FROM (SELECT s_suppkey, (g + s) * (p + least(p, 64)) + 5 AS need, 400 AS usable FROM (SELECT s_suppkey, s_suppkey % 4 + 1 AS g, s_suppkey % 3 AS s, s_suppkey % 90 AS p FROM supplier))""")
def connection_need(spark: SparkSession, d: str) -> DataFrame:
    """Connections that a fleet needs: (gateways + spares) x (pool + at most 64 for reads) + others (X23)."""
    k = F.col("s_suppkey")
    need = connections(k % 4 + 1, k % 3, k % 90, F.lit(5))
    rows = table(spark, d, "supplier").select("s_suppkey", need.alias("need"), F.lit(400).alias("usable"))
    return rows.withColumn("status", F.when(F.col("need") > F.col("usable"), "FAIL").when(F.col("need") * 10 > F.col("usable") * 9, "WARN").otherwise("PASS"))


def connections(gateways: Column, spares: Column, pool: Column, other: Column) -> Column:
    return (gateways + spares) * (pool + F.least(pool, F.lit(64))) + other


@query("""WITH t AS (SELECT o_orderkey, quality FROM orders LEFT JOIN labels ON doc_id = o_orderkey), u AS (SELECT o_orderkey, ['if_absent', 'if_match', 'always'][o_orderkey % 3 + 1] AS how, quality IS NOT NULL AS there, quality = 1 AS same, o_orderkey % 7 = 0 AS unsupported FROM t)
 SELECT o_orderkey, how, CASE WHEN unsupported AND how <> 'always' THEN 'dead' WHEN how = 'if_absent' AND there OR how = 'if_match' AND NOT coalesce(same, false) THEN 'abandon' ELSE 'upload' END AS action FROM u""")
def upload_decision(spark: SparkSession, d: str) -> DataFrame:
    """An upload to the origin: a conflict gives it up, a condition that the origin doesn't know ends it (X8)."""
    now = table(spark, d, "labels").select(F.col("doc_id").alias("o_orderkey"), "quality")
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey").join(now, "o_orderkey", "left").withColumn("how", F.element_at(F.array(*map(F.lit, ("if_absent", "if_match", "always"))), (k % 3 + 1).cast("int")))
    clash = ((F.col("how") == "if_absent") & F.col("quality").isNotNull()) | ((F.col("how") == "if_match") & ~F.coalesce(F.col("quality") == 1, F.lit(False)))
    return rows.select("o_orderkey", "how", F.when((k % 7 == 0) & (F.col("how") != "always"), "dead").when(clash, "abandon").otherwise("upload").alias("action"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'gone' WHEN attempts + 1 >= 8 THEN 'dead' ELSE 'waiting' END AS state, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE attempts + 1 END AS attempts,
 CASE WHEN o_orderkey % 9 <> 0 AND attempts + 1 < 8 THEN o_orderdate + least(300, 2 * pow(2, attempts))::INT * INTERVAL 1 SECOND END AS next_attempt FROM (SELECT *, (o_orderkey // 3 % 9)::INT AS attempts FROM orders)""")
def outbox_fail(spark: SparkSession, d: str) -> DataFrame:
    """A failed upload waits for 2 s, twice as long each time, 300 s at most, and is dead
    after eight; a committed one is deleted (CT4, X7)."""
    k, tries = F.col("o_orderkey"), F.expr("int(o_orderkey div 3 % 9)")
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", tries.alias("a"))
    wait = F.least(F.lit(300), F.pow(F.lit(2), F.col("a") + 1)).cast("int")
    done, dead = k % 9 == 0, F.col("a") + 1 >= 8
    return rows.select("o_orderkey", F.when(done, "gone").when(dead, "dead").otherwise("waiting").alias("state"), F.when(~done, F.col("a") + 1).alias("attempts"), F.when(~done & ~dead, F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait.cast("decimal(18,6)"))).alias("next_attempt"))


@query("""SELECT doc_id, CASE WHEN quality = 0 THEN 'tombstone' WHEN quality = 1 THEN 'pending' ELSE 'cached' END AS state, coalesce(quality, 2) <> 0 AS listed FROM documents LEFT JOIN labels USING (doc_id)""")
def write_back_listing(spark: SparkSession, d: str) -> DataFrame:
    """What waits to be written counts over the cache; a pending deletion hides it (CT5, SO5)."""
    waiting = table(spark, d, "labels").select("doc_id", "quality")
    rows = table(spark, d, "documents").select("doc_id").join(waiting, "doc_id", "left")
    state = F.when(F.col("quality") == 0, "tombstone").when(F.col("quality") == 1, "pending").otherwise("cached")
    return rows.select("doc_id", state.alias("state"), (state != "tombstone").alias("listed"))
