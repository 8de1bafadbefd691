"""Golden cases that SQL doesn't cover."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeweave.functions import columns
from lakeweave.operators import analytics, delivery, jobs, joins, queues, statistics, streams
from lakeweave.operators.tables import Versions
from lakeweave.plans.patterns import glob_regex, literal_prefix, prefix_end
from lakeweave.sources import files
from lakeweave.sources.files import clean_name
from lakeweave.streaming import windows

DATA = "/root/testdata/sf0.001"


@given(st.text(min_size=1, max_size=6), st.text(max_size=6))
def test_prefix_end_is_above_its_keys(prefix, rest):
    try:
        key = (prefix + rest).encode()
        prefix.encode()
    except UnicodeEncodeError:
        return
    end = prefix_end(prefix)
    assert end is None or key < end.encode()


def test_globs_stay_inside_a_folder():
    import re

    assert literal_prefix("a/b*c") == "a/b"
    assert re.match(glob_regex("a/*.t?t"), "a/x.txt")
    assert not re.match(glob_regex("a/*"), "a/b/c")
    assert re.match(glob_regex(r"\*[ab]"), "*a")


def test_member_names():
    assert clean_name("./a//b") == "a/b"
    assert [clean_name(x) for x in ("/a", "a/", "../a", "a/../b", "C:/x", "")] == [None] * 6


def test_raster_values(spark):
    assert analytics.pixel_stats(analytics.tiles(spark).filter("block = 9"), 0).first().value == 16 + 1000.0 * 16


def test_versions_stay_readable(spark):
    t = Versions(spark)
    t.append(spark.range(10))
    t.update(F.col("id") > 7, id=F.col("id") * 10)
    t.delete(F.col("id") < 5)
    assert [t.read(v).count() for v in (1, 2, 3)] == [10, 10, 5]
    assert {r.id for r in t.read().collect()} == {5, 6, 7, 80, 90}


def test_enqueue_refuses_known_ids(spark):
    a = spark.range(3).withColumnRenamed("id", "seq")
    assert queues.enqueue(a, spark.range(3, 5).withColumnRenamed("id", "seq")).count() == 5
    with pytest.raises(ValueError):
        queues.enqueue(a, spark.range(2, 4).withColumnRenamed("id", "seq"))


def test_snapshots_deliver_late_commits(spark):
    rows = spark.createDataFrame([(1, 10), (2, 11), (3, 12), (4, 13), (5, 14)], "seq int, txid int")
    assert [r.seq for r in streams.between(rows, (11, 13, [11]), (15, 15, [])).orderBy("seq").collect()] == [2, 4, 5]


def test_acks_stop_at_a_gap(spark):
    rows = spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 3, False), (1, 4, True)], "consumer int, tick long, acked boolean")
    assert streams.cursors(rows).first().cursor == 2


def test_left_shadows_right(spark):
    a, b = spark.createDataFrame([("k", 1)], "key string, v int"), spark.createDataFrame([("k", 2), ("m", 3)], "key string, v int")
    assert {tuple(r) for r in joins.prefer(a, b, "key").collect()} == {("k", 1), ("m", 3)}


def test_overlay_pads(spark):
    assert spark.range(1).select(columns.written(F.lit(b"ab"), b"XY", 4)).first()[0] == b"ab\0\0XY"
    assert spark.range(1).select(columns.bytes_between(F.lit("aé".encode()), -2, -1)).first()[0] == "é".encode()


def test_streaming_windows_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    got = []
    q = windows.deliver(windows.tumbling(windows.read(spark, f"{tmp_path}/in", events.schema), late="40 days"), lambda df, _: got.extend(df.collect()), f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert q.exception() is None
    last = max(r.start for r in got) if got else None  # windows that the watermark has closed
    want = {(r.start, r.event_type, r.n) for r in windows.tumbling(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert {(r.start, r.event_type, r.n) for r in got} == {w for w in want if last and w[0] <= last}


def test_streaming_windows_without_waiting(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    early, late = events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1").unionByName(events.limit(1).selectExpr("event_id", "ts + interval 400 days as ts", "user_id", "event_type", "value", "props"))
    early.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []
    for part in (None, late):
        if part is not None:
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = windows.deliver(windows.tumbling(windows.read(spark, f"{tmp_path}/in", events.schema), late="60 days"), lambda df, _: got.extend(df.collect()), f"{tmp_path}/cp")
        q.awaitTermination(120)
    want = {(r.start, r.event_type, r.n) for r in windows.tumbling(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert {(r.start, r.event_type, r.n) for r in got} == want


def test_streaming_delivers_each_event_once(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").limit(50)
    events.union(events).write.parquet(f"{tmp_path}/in")
    got = []
    q = windows.deliver(windows.once(windows.read(spark, f"{tmp_path}/in", events.schema), "event_id", late="40 days"), lambda df, _: got.extend(df.collect()), f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert len(got) == len({r.event_id for r in got}) == 50


def test_another_session_opens_a_table_by_its_manifests(spark):
    t = Versions(spark)
    t.append(spark.range(10))
    t.add("v", F.col("id") * 2)
    t.rename("v", "w")
    seen = Versions.open(spark, t.root)
    assert seen.versions == t.versions and seen.read().columns == ["id", "w"] and seen.read(1).columns == ["id"]
    seen.drop("w")
    with pytest.raises(Exception, match="(?i)exist"):
        t.append(spark.range(1))  # the same number again


def test_archives_by_a_data_source(spark):
    spark.dataSource.register(files.ArchiveSource)
    root = files.stored_archives(spark)
    got = spark.read.format("archive").load(root)
    assert sorted((r.name, bytes(r.content)) for r in got.collect()) == sorted((r.name, bytes(r.content)) for r in files.read_archives(spark, root).collect())


def test_seek_tables_that_are_none():
    import io

    good = files.seekable_zstd([b"abc", b"defg"])
    assert [f[2:] for f in files.seek_table(io.BytesIO(good))] == [(0, 3), (3, 4)]
    for bad in (b"", b"x" * 40, good[:-1], good + b"x", b"y" + good):
        assert files.seek_table(io.BytesIO(bad)) == []


def test_ranks_of_hot_and_odd_groups(spark):
    import random

    r = random.Random(1)
    rows = [("hot", float(r.choice((r.randint(0, 5), r.randint(0, 10**6))))) for _ in range(5000)] + [("one", 3.0), ("tie", 1.0), ("tie", 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(x.g, x.which): x.value for x in statistics.ranked(df, "g", "v", lambda n: [F.lit(0), F.floor(n / 2), n - 1]).collect()}
    for g in ("hot", "one", "tie"):
        v = sorted(x for k, x in rows if k == g)
        assert [got[g, i] for i in range(3)] == [v[0], v[len(v) // 2], v[-1]]
    assert not any(g == "none" for g, _ in got)


def test_numbers_go_on_over_ranges(spark):
    got = delivery.numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), "k").orderBy("k").collect()
    assert [(r.k, r.seq) for r in got] == [(k, k + 1) for k in range(1000)]


def test_chains_of_batches(spark):
    rows = [(1, k, k + 1, k != 700) for k in range(1000)] + [(2, 5, 9, False), (3, 0, 4, True), (3, 5, 9, True)]
    got = {r.consumer: (r.cursor, r.chained) for r in delivery.chained(spark.createDataFrame(rows, "consumer int, start_tick long, end_tick long, acked boolean")).collect()}
    assert got == {1: (700, 700), 2: (5, 0), 3: (4, 1)}


def test_events_before_their_clock_are_refused(spark):
    lit = lambda x: F.lit(x).cast("timestamp_ntz")
    step = lambda event, state, attempt=1, again=True: spark.range(1).select(jobs.transition(F.lit(event), F.lit(state), F.lit(attempt), F.lit(3), lit("2024-01-02"), lit("2024-01-03"), lit("2024-01-01"), F.lit(again)).alias("t")).first().t
    assert step("schedule_due", "scheduled") is None and step("expire", "available") is None and step("expire", "pending") is None
    assert tuple(step("enqueue", "new", 0)) == ("scheduled", 0) and tuple(step("lease", "available", 0)) == ("active", 1)
    assert tuple(step("nack", "active", 3)) == ("discarded", 3) and tuple(step("nack", "active", 1)) == ("retryable", 2) and tuple(step("nack", "active", 1, False)) == ("discarded", 1)
    assert tuple(step("lease_expired", "active", 2)) == ("available", 3) and step("ack", "completed") is None
