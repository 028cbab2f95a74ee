import time

from pyspark.sql import functions as F

from inventa.operators import state as ST
from inventa.streaming import sync

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def source(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value").where("user_id < 40")
    e.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    return e, sync.changes(spark, str(tmp_path / "in"), SCHEMA, 1)


def as_set(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_last_write_equals_batch(spark, small, tmp_path):
    batch, stream = source(spark, small, tmp_path)
    got = sync.drain(sync.last_write(stream, "user_id", ["ts", "event_id"], "value"), "lww", "complete", str(tmp_path / "c"))
    assert as_set(got) == as_set(ST.latest(batch, ["user_id"], ["ts", "event_id"], ["value"]))


def test_peers_equal_batch(spark, small, tmp_path):
    batch, stream = source(spark, small, tmp_path)
    got = sync.drain(sync.peers(stream, "user_id", "ts"), "peers", "complete", str(tmp_path / "c"))
    assert as_set(got) == as_set(ST.last_seen(batch, "user_id", "ts"))


def test_once_per_key(spark, small, tmp_path):
    batch, stream = source(spark, small, tmp_path)
    got = sync.drain(sync.once_per_key(stream, ["user_id", "event_type"]), "once", "append", str(tmp_path / "c"))
    assert got.count() == batch.select("user_id", "event_type").distinct().count()


def test_versions_only_rise(spark, tmp_path):
    """Rows that come out of order, in one batch and over several, are those of the batch form."""
    rows = [("a", 1, 3), ("a", 2, 2), ("a", 3, 5), ("b", 1, 1), ("b", 2, 1), ("a", 4, 4), ("a", 5, 6), ("c", 1, 9), ("c", 2, 8), ("c", 3, 10)]
    schema = "key string, t long, version long"
    want = as_set(ST.monotonic(spark.createDataFrame(rows, schema), ["key"], ["t"], "version"))
    for cut in (2, 5, 10):
        where = tmp_path / f"in{cut}"
        for part in (rows[:cut], rows[cut:]):
            if part:
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(where))
        stream = sync.changes(spark, str(where), schema, 1)
        got = sync.drain(sync.above_last(stream, "key", "version", ["t"]), f"rise{cut}", "append", str(tmp_path / f"c{cut}"))
        assert as_set(got) == want
    # With a timeout a query looks for what to forget for ever, so this one is stopped.
    out = sync.above_last(stream, "key", "version", ["t"], "1 hour").writeStream.format("memory").queryName("forget").outputMode("append").option("checkpointLocation", str(tmp_path / "cf")).start()
    end = time.monotonic() + 40
    while time.monotonic() < end and spark.table("forget").count() < len(want):
        time.sleep(0.3)
    out.stop()
    assert as_set(spark.table("forget")) == want


def test_silence(spark, tmp_path):
    """One watcher hears a peer, the other does not and is told so when its time is over."""
    for k, part in enumerate(([("w", "open"), ("v", "open")], [("v", "peer")])):
        spark.createDataFrame(part, "watch string, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = sync.changes(spark, str(tmp_path / "in"), "watch string, kind string", 1)
    q = sync.polled(sync.silence(stream, "watch", "kind", 1.0).writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")), "500 milliseconds").start()
    end = time.monotonic() + 40
    while time.monotonic() < end and spark.table("quiet").count() < 2:
        time.sleep(0.3)
    q.stop()
    got = {r.watch: r.alert for r in spark.table("quiet").collect()}
    assert got["w"] is True and set(got) == {"v", "w"}


def test_a_new_run_stops_the_one_before(spark, tmp_path):
    rate = spark.readStream.format("rate").load()
    runs = sync.Runs()
    first = runs.start(rate.writeStream.format("noop"))
    old = runs.query
    second = runs.start(rate.writeStream.format("noop"))
    assert not old.isActive and not runs.current(first) and runs.current(second)
    runs.stop()
    assert not runs.current(second)


def test_batch_silence(spark):
    t = lambda s: f"2024-01-01 00:00:{s:02d}"
    pings = spark.createDataFrame([("x", t(5)), ("y", t(30)), ("y", t(31))], "peer string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    watches = spark.createDataFrame([(1, t(20), t(38)), (2, t(40), t(50)), (3, t(0), t(4)), (4, t(52), t(59))], "watch int, started string, now string").withColumns({c: F.col(c).cast("timestamp") for c in ("started", "now")})
    assert {r.watch: r.peers for r in ST.known_peers(pings, watches).collect()} == {1: ["x", "y"], 2: ["y"]}
    assert {r.watch: r.alert for r in ST.silent(pings, watches).collect()} == {1: False, 2: False, 3: False, 4: False}
    late = watches.withColumn("now", F.col("now") + F.expr("interval 20 seconds"))
    assert {r.watch: r.alert for r in ST.silent(pings.limit(0), late).collect()} == {k: True for k in (1, 2, 3, 4)}
