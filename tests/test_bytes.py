"""Checksums against known values and a bit-by-bit form; the codec there and back."""

import random

from pyspark.sql import functions as F

from lakeweave.functions.bytes import LANE, compress_block, crc, crc32c, decompress_block


def slow(data, poly, bits):
    ones = reg = (1 << bits) - 1
    for b in data:
        reg ^= b
        for _ in range(8):
            reg = reg >> 1 ^ (poly if reg & 1 else 0)
    return reg ^ ones


def test_known_checksums():
    assert f"{int(crc('crc32c')([b'123456789'])[0]):08x}" == "e3069283"
    assert f"{int(crc('crc64nvme')([b'123456789'])[0]):016x}" == "ae8b14860a799888"


def test_checksums_of_any_length():
    r = random.Random(5)
    values = [r.randbytes(n) for n in (0, 1, 7, 8, LANE - 1, LANE, LANE + 1, 3 * LANE + 5)] + [bytes(2 * LANE), b""]
    for name, poly, bits in (("crc32c", 0x82F63B78, 32), ("crc64nvme", 0x9A6C9329AC4BC9B5, 64)):
        assert [int(x) for x in crc(name)(values)] == [slow(v, poly, bits) for v in values]
    assert len(crc("crc32c")([])) == 0


def test_blocks_come_back(spark):
    r = random.Random(6)
    blocks = [None, b"", b"short", b"a" * 15, b"a" * 16, b"abc" * 5000, r.randbytes(4096), b"a" * 65_536, b"a" * 65_537]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "id int, data binary").withColumn("stored", compress_block("data"))
    got = rows.withColumn("back", decompress_block("stored", F.octet_length("data"))).withColumn("crc", crc32c("data")).orderBy("id").collect()
    assert [None if x.back is None else bytes(x.back) for x in got] == blocks
    assert [x.stored is not None and len(x.stored) < len(x.data) for x in got] == [False, False, False, False, False, True, False, True, False] or len(got[4].stored) <= 16
    assert got[0].crc is None and got[1].crc == "00000000"


def test_codec_query_takes_bounded_parts(spark, tmp_path):
    from lakeweave.functions import batches
    from lakeweave.operators.blocks import block_codec

    r = random.Random(7)
    texts = [None, "", "é" * 40, "word " * 400, *["".join(r.choices("abcdefgh \n", k=3000)) for _ in range(2500)]]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for name, default, _ in batches.BATCHES:
        spark.conf.set(name, default)
    out = block_codec(spark, str(tmp_path))
    assert [spark.conf.get(name) for name, _, _ in batches.BATCHES] == [value for _, _, value in batches.BATCHES]
    plan = out._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") and "ArrowEvalPython" not in plan  # one worker a task, no block goes back to Spark
    got = {x.doc_id: x[1:] for x in out.collect()}
    assert got == {i: (None if t is None else len(t.encode()), True, True) for i, t in enumerate(texts)}
