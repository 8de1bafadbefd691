"""Vector, text, spatial and curve queries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cosine_distance
from ..registry import query, table
from .tables import folder


def nearest(vectors: DataFrame, target: list[float], k: int) -> DataFrame:
    """The k nearest by cosine distance: a top-k, no shuffle of all rows."""
    q = F.array(*map(F.lit, target))
    return vectors.select("vec_id", cosine_distance(F.col("embedding"), q).alias("x")).orderBy("x", "vec_id").limit(k)


@query("""SELECT vec_id, abs(round(x, 6)) AS distance FROM (SELECT vec_id, 1 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) AS x FROM
 (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e, (SELECT list_transform(embedding, lambda v: v::DOUBLE) FROM embeddings WHERE vec_id = 42) AS q FROM embeddings)) ORDER BY x, vec_id LIMIT 10""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    target = [float(x) for x in v.filter("vec_id = 42").select("embedding").first()[0]]  # one row
    return nearest(v, target, 10).select("vec_id", F.abs(F.round("x", 6)).alias("distance"))


@query()
def vector_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of the ten nearest an index of random hyperplanes finds: buckets within one bit."""
    import numpy as np

    v = table(spark, d, "embeddings")
    target = [float(x) for x in v.filter("vec_id = 42").select("embedding").first()[0]]
    planes = np.random.default_rng(1).normal(size=(8, 4, len(target)))
    sides = lambda e, t: [F.aggregate(F.zip_with(e, F.array(*map(F.lit, p.tolist())), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x) >= 0 for p in planes[t]]
    own = [[bool(np.dot(p, target) >= 0) for p in planes[t]] for t in range(8)]
    near = lambda e, t: sum(((s == F.lit(o)).cast("int") for s, o in zip(sides(e, t), own[t], strict=True)), F.lit(0)) >= 3
    found = v.filter(F.array_max(F.array(*[near(F.col("embedding"), t) for t in range(8)])))
    exact, approx = nearest(v, target, 10).select("vec_id"), nearest(found, target, 10).select("vec_id")
    return exact.intersect(approx).agg(F.count(F.lit(1)).alias("found"))


_WORDS = r"list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), n AS (SELECT count(*) AS c, avg(len(ws)) AS al FROM w),
 t AS (SELECT doc_id, q, len(ws) AS dl, len(list_filter(ws, lambda x: x = q)) AS tf FROM w, (VALUES ('the'), ('license')) v(q)), f AS (SELECT q, count(*) FILTER (tf > 0) AS df FROM t GROUP BY q)
 SELECT doc_id, round(sum(ln(1 + (c - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))), 6) AS score FROM t JOIN f USING (q), n WHERE tf > 0 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25(table(spark, d, "documents"), ["the", "license"], 10)


def bm25(docs: DataFrame, terms: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents for a few terms of letters; term counts stay on the row, so nothing is exploded or joined."""
    text = F.lower("text")
    occurrences = lambda t: F.regexp_count(text, F.lit(f"(?<![a-z]){t}(?![a-z])"))
    counts = docs.select("doc_id", F.regexp_count(text, F.lit("[a-z]+")).alias("dl"), *[occurrences(t).alias(f"tf{i}") for i, t in enumerate(terms)])
    path = f"{folder(docs.sparkSession)}/counts"
    counts.write.parquet(path)  # a few numbers for each document, so its text is read once
    rows = docs.sparkSession.read.parquet(path)
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("al"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), s[f"df{i}"]
        score = score + F.lit(math.log(1 + (s.n - df + 0.5) / (df + 0.5))) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.lit(s.al)))
    some = F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))]) if len(terms) > 1 else F.col("tf0")
    return rows.filter(some > 0).select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


@query("SELECT count(*) AS inside FROM range(0, 5000) t(i) WHERE i % 100 > 10 AND i % 100 < 50 AND i // 100 > 10 AND i // 100 < 50")
def spatial_within(spark: SparkSession, d: str) -> DataFrame:
    points = spark.range(5000).select((F.col("id") % 100).alias("x"), F.expr("id div 100").alias("y"))
    return points.filter("x > 10 and x < 50 and y > 10 and y < 50").agg(F.count(F.lit(1)).alias("inside"))  # the boundary isn't within


@query("""SELECT doc_id, 'POINT (' || x || ' ' || y || ')' AS said, x > 10 AND x < 60 AND y > 20 AND y < 80 AS inside, greatest(10, x - 5) AS xmin, least(60, x + 5) AS xmax FROM (SELECT doc_id, doc_id % 100 AS x, n_chars % 100 AS y FROM documents)""")
def spatial_text(spark: SparkSession, d: str) -> DataFrame:
    """Points as text, points strictly inside an envelope, and where two envelopes overlap (SF28)."""
    x, y = F.col("doc_id") % 100, F.col("n_chars") % 100
    inside = (x > 10) & (x < 60) & (y > 20) & (y < 80)
    said = F.concat(F.lit("POINT ("), x, F.lit(" "), y, F.lit(")"))
    return table(spark, d, "documents").select("doc_id", said.alias("said"), inside.alias("inside"), F.greatest(F.lit(10), x - 5).alias("xmin"), F.least(F.lit(60), x + 5).alias("xmax"))


@query("SELECT doc_id FROM (SELECT doc_id, doc_id % 100 AS x, n_chars % 100 AS y FROM documents) WHERE x <= 40 AND x + 2 >= 20 AND y <= 60 AND y + 3 >= 30")
def bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    box = F.struct((F.col("doc_id") % 100).alias("xmin"), (F.col("doc_id") % 100 + 2).alias("xmax"), (F.col("n_chars") % 100).alias("ymin"), (F.col("n_chars") % 100 + 3).alias("ymax"))
    return table(spark, d, "documents").select("doc_id", box.alias("bbox")).filter("bbox.xmin <= 40 and bbox.xmax >= 20 and bbox.ymin <= 60 and bbox.ymax >= 30").select("doc_id")


_LON, _LAT = "(doc_id * 37 % 360 - 180)::DOUBLE", "(n_chars * 13 % 160 - 80)::DOUBLE"


@query(f"""SELECT doc_id, CAST(floor(({_LON} + 180) / 360 * 1024) AS BIGINT) AS px, CAST(floor((1 - asinh(tan(radians({_LAT}))) / pi()) / 2 * 1024) AS BIGINT) AS py FROM documents""")
def mercator_tile(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = (F.col("doc_id") * 37 % 360 - 180).cast("double"), (F.col("n_chars") * 13 % 160 - 80).cast("double")
    return table(spark, d, "documents").select("doc_id", F.floor((lon + 180) / 360 * 1024).cast("bigint").alias("px"), F.floor((1 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2 * 1024).cast("bigint").alias("py"))


def curve(x: Column, y: Column, bits: int) -> Column:
    """Place on a space-filling curve: in each step the quadrant's number is
    appended and the axes are turned into that quadrant's own frame."""
    place, turns = F.lit(0).cast("bigint"), [x.cast("bigint"), y.cast("bigint")]
    for k in range(bits - 1, -1, -1):
        a, b = turns
        rx, ry = F.shiftright(a, k).bitwiseAND(1), F.shiftright(b, k).bitwiseAND(1)
        place = place * 4 + (F.lit(3) * rx).bitwiseXOR(ry)
        low = (1 << k) - 1
        la, lb = a.bitwiseAND(low), b.bitwiseAND(low)
        fa, fb = F.when((ry == 0) & (rx == 1), low - la).otherwise(la), F.when((ry == 0) & (rx == 1), low - lb).otherwise(lb)
        turns = [F.when(ry == 0, fb).otherwise(fa), F.when(ry == 0, fa).otherwise(fb)]
    return place


_STEP = "SELECT id, k - 1 AS k, p * 4 + xor(3 * rx, ry) AS p, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN low - lb ELSE lb END ELSE la END AS a, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN low - la ELSE la END ELSE lb END AS b"


@query(f"""WITH RECURSIVE h AS (SELECT event_id AS id, 3 AS k, 0::BIGINT AS p, event_id % 16 AS a, user_id % 16 AS b FROM events UNION ALL
 {_STEP} FROM (SELECT id, k, p, (a >> k) & 1 AS rx, (b >> k) & 1 AS ry, (1 << k) - 1 AS low, a & ((1 << k) - 1) AS la, b & ((1 << k) - 1) AS lb FROM h WHERE k >= 0))
 SELECT p AS cell, count(*) AS n FROM h WHERE k = -1 AND p BETWEEN 20 AND 90 GROUP BY p""")
def hilbert_filter(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "events").select((F.col("event_id") % 16).alias("x"), (F.col("user_id") % 16).alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))  # cells first
    cells = steps.select(curve(F.col("x"), F.col("y"), 4).alias("cell"), "n").filter("cell between 20 and 90")
    return cells.groupBy("cell").agg(F.sum("n").alias("n"))


def tiles(spark: SparkSession, side: int = 8, pixels: int = 16) -> DataFrame:
    """A synthetic raster: block, band (gzip of little-endian floats); a pixel's value is its column plus 1000 times its row."""

    def make(batches):
        import gzip

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            blocks = batch.column(0).to_pylist()
            bands = []
            for b in blocks:
                ty, tx = divmod(b, side)
                y, x = np.mgrid[0:pixels, 0:pixels]
                bands.append(gzip.compress((tx * pixels + x + 1000.0 * (ty * pixels + y)).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.int64()), "band": pa.array(bands, pa.binary())})

    return spark.range(side * side).withColumnRenamed("id", "block").mapInArrow(make, "block long, band binary")


def pixel_stats(rows: DataFrame, place: int | None = None) -> DataFrame:
    """block, value (sum of the tile, or one pixel's value)."""

    def decode(batches):
        import gzip

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            arrays = [np.frombuffer(gzip.decompress(b), "<f4") for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"block": batch.column(0), "value": pa.array([float(a.sum(dtype=np.float64) if place is None else a[place]) for a in arrays], pa.float64())})

    return rows.select("block", "band").mapInArrow(decode, "block long, value double")


@query("SELECT 11::BIGINT AS block, 3 * 16 + 5 + 1000.0::DOUBLE * (16 + 2) AS value")
def raster_point(spark: SparkSession, d: str) -> DataFrame:
    return pixel_stats(tiles(spark).filter("block = 11"), 2 * 16 + 5)  # only the tile's block is decoded


@query("SELECT sum(x + 1000.0::DOUBLE * y) AS total, count(*) AS pixels FROM range(0, 128) a(x), range(0, 128) b(y)")
def raster_scan(spark: SparkSession, d: str) -> DataFrame:
    return pixel_stats(tiles(spark)).agg(F.sum("value").alias("total"), (F.count(F.lit(1)) * 256).alias("pixels"))
