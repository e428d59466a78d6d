"""Streams give what the batch form gives."""

from pyspark.sql import functions as F

from pagemill.streaming import watch

VISITS = [("u", 1, "a"), ("u", 2, "a"), ("u", 3, "b"), ("v", 1, "x"), ("u", 4, "a"), ("v", 5, "y")]


def drain(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def source(spark, tmp_path, parts):
    schema = "url string, ts timestamp, hash string"
    for k, part in enumerate(parts):
        rows = spark.createDataFrame(part, "url string, t long, hash string")
        rows.select("url", F.timestamp_seconds("t").alias("ts"), "hash").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")


def test_watch_keeps_state_across_batches(spark, tmp_path):
    got = drain(watch.watch(source(spark, tmp_path, [VISITS[:3], VISITS[3:]])), "watched")
    events = sorted((r.url, r.ts.timestamp(), r.first_seen, r.changed, r.seq) for r in got)
    assert [e[2:] for e in events] == [(True, False, 0), (False, False, 0), (False, True, 1), (False, True, 2), (True, False, 0), (False, True, 1)]


def test_atlas_counts_by_window(spark, tmp_path):
    stream = source(spark, tmp_path, [VISITS]).select("ts", F.col("url").alias("host"), F.col("hash").alias("code"))
    got = drain(watch.atlas(stream), "atlas", "complete")
    assert {(r["host"], r["code"]): r["count"] for r in got} == {("u", "a"): 3, ("u", "b"): 1, ("v", "x"): 1, ("v", "y"): 1}


def test_submissions_once_a_day(spark, tmp_path):
    stream = source(spark, tmp_path, [VISITS]).select("ts", F.concat("url", "hash").alias("key"))
    assert sorted(r.key for r in drain(watch.once_a_day(stream), "once")) == ["ua", "ub", "vx", "vy"]


def test_hosts_are_bounded_and_counts_nearly_right(spark, tmp_path):
    import random
    from collections import Counter

    r = random.Random(6)
    hosts = [f"h{min(int(r.paretovariate(0.6)), 10_000)}" for _ in range(30_000)] + [f"once{k}" for k in range(10_000)] + [None] * 50
    r.shuffle(hosts)
    most, shards = 60, 3
    for k in range(4):
        spark.createDataFrame([(h,) for h in hosts[k::4]], "host string").coalesce(1).write.parquet(f"{tmp_path}/{k}")
    stream = spark.readStream.schema("host string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    rows = drain(watch.top_hosts(stream, most, shards), "top_hosts", "update")
    last = {s: max(x.batch for x in rows if x.shard == s) for s in {x.shard for x in rows}}
    final = [x for x in rows if x.batch == last[x.shard]]
    exact = Counter(h or "" for h in hosts)
    assert len(exact) > 10_000 and len(last) == shards
    for shard in last:
        own = {x.host: x for x in final if x.shard == shard}
        total = sum(x["count"] for x in own.values())
        assert len(own) == most and len({x.host for x in own.values()}) == most
        assert all(x["count"] - x.error <= exact[x.host] <= x["count"] and x.error <= total / most for x in own.values())
    bound = sum(exact.values()) / most
    assert {h for h, n in exact.items() if n > bound} <= {x.host for x in final}


def test_few_hosts_are_counted_exactly(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([("a",), ("b",), ("a",)], "host string").coalesce(1).write.parquet(f"{tmp_path}/{k}")
    stream = spark.readStream.schema("host string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    rows = drain(watch.top_hosts(stream, 5, 1), "few_hosts", "update")
    assert {(x.host, x["count"], x.error) for x in rows if x.batch == 1} == {("a", 4, 0), ("b", 2, 0)}
