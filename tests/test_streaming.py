import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sdkatlas.plans import corpus
from sdkatlas.plans.stream_queries import events_as
from sdkatlas.streaming import arrivals, refresh

SF = "/root/testdata/sf0.001"


def test_late_specs_as_a_stream(spark, tmp_path):
    events = corpus.table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    # Event-time order, in several files, and one late pair of events that closes the windows.
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "events"))
    last = events.agg(F.max("ts").alias("ts"))
    closing = [last.select((F.col("ts") + F.expr("interval 30 days")).alias("ts"), F.lit(kind).alias("event_type"), F.lit(-1).cast("bigint").alias("user_id")) for kind in ("signup", "view")]
    for part in closing:
        events.limit(0).unionByName(part, allowMissingColumns=True).write.mode("append").parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    joined = arrivals.late_specs(events_as(stream, "signup", "sdk_ts"), events_as(stream, "view", "spec_ts"), wait_seconds=6 * 3600, delay="10 minutes")
    (joined.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination())
    streamed = Counter(tuple(r) for r in spark.table("late").filter("origin_commit <> 'c-1'").collect())
    batch = arrivals.late_specs(events_as(events, "signup", "sdk_ts"), events_as(events, "view", "spec_ts"), wait_seconds=6 * 3600)
    assert streamed == Counter(tuple(r) for r in batch.collect()) and len({r[-1] for r in streamed}) == 2


def test_first_publication_wins(spark):
    """N events of a commit and M publications: a row for each commit, never N x M."""
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    commits = spark.createDataFrame([("a", at(0)), ("a", at(0)), ("a", at(2)), ("b", at(0)), ("c", at(9))], "origin_commit string, sdk_ts timestamp_ntz")
    specs = spark.createDataFrame([("a", at(4)), ("a", at(3)), ("a", at(5)), ("a", at(3)), ("b", at(6)), ("c", at(8)), ("d", at(1))], "origin_commit string, spec_ts timestamp_ntz")
    found = {(r.origin_commit, r.sdk_ts): (r.spec_ts, r.status) for r in arrivals.late_specs(commits, specs).collect()}
    assert found == {("a", at(0)): (at(3), "arrived"), ("a", at(2)): (at(3), "arrived"), ("b", at(0)): (None, "timed_out"), ("c", at(9)): (None, "timed_out")}


def test_settling_in_any_order_of_arrival():
    """Whatever the batches, as long as no event is older than the watermark, the outcome is that of all events at once."""
    rng = random.Random(4)
    for _ in range(200):
        wait = rng.choice([3, 10])
        events = [(rng.randrange(60), rng.random() < 0.5) for _ in range(rng.randrange(1, 25))]
        expected = {(t, min((p for p, s in events if s and t <= p <= t + wait), default=None)) for t, s in events if not s}
        arrival = sorted(events, key=lambda e: e[0] + rng.uniform(0, 8))
        found, waiting, published, watermark, again = [], [], [], 0, None
        for i in range(0, len(arrival) + 3, 3):
            fresh = [e for e in arrival[i:i + 3]]
            assert all(t >= watermark for t, _ in fresh)
            waiting, published = waiting + [t for t, s in fresh if not s], published + [t for t, s in fresh if s]
            rows, waiting, published, again = arrivals.settle(waiting, published, watermark, wait)
            found += rows
            rest = arrival[i + 3:]
            watermark = max(watermark, min((t for t, _ in rest), default=1000))
        rows, waiting, published, again = arrivals.settle(waiting, published, watermark, wait)
        found += rows
        assert set(found) == expected and len(found) == len(expected)
        assert (waiting, published, again) == ([], [], None)  # no state stays behind


def test_refresh_writes_only_what_changed(spark, tmp_path):
    arrived, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "repo_id bigint, doc string"
    current = {}

    def build(repos):
        rows = spark.createDataFrame(list(current.items()), schema)
        kept = rows.join(repos, "repo_id", "left_semi")
        return kept.select("repo_id", F.lit("spec").alias("artifact"), F.col("doc").alias("payload")).unionByName(
            kept.select("repo_id", F.lit("manifest").alias("artifact"), F.concat(F.lit("m"), F.substr("doc", F.lit(1), F.lit(1))).alias("payload")))

    def arrive(rows):
        current.update(rows)
        spark.createDataFrame(list(rows.items()), schema).coalesce(1).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(schema).parquet(arrived)
        refresh.refresh(stream, store, str(tmp_path / "cp"), build).awaitTermination()
        return {(r.repo_id, r.artifact, r.payload, r.batch) for r in refresh.stored(spark, store).collect()}

    first = arrive({1: "a1", 2: "b1"})
    assert first == {(1, "spec", "a1", 0), (1, "manifest", "ma", 0), (2, "spec", "b1", 0), (2, "manifest", "mb", 0)}
    assert arrive({1: "a1"}) == first
    second = arrive({2: "b2"})
    assert second - first == {(2, "spec", "b2", 2)}
    refresh.publish(spark.createDataFrame([(2, "b2")], schema), 2, store, build)
    assert {(r.repo_id, r.artifact, r.payload, r.batch) for r in refresh.stored(spark, store).collect()} == second


def artifacts(rows):
    def build(repos):
        frame = repos.sparkSession.createDataFrame(rows, "repo_id bigint, payload string").join(repos, "repo_id", "left_semi")
        return frame.select("repo_id", F.explode(F.array(F.lit("spec"), F.lit("manifest"))).alias("artifact"), "payload")
    return build


def seen(spark, store):
    return Counter((r.repo_id, r.artifact, r.payload, r.batch) for r in refresh.stored(spark, store).collect())


def test_a_half_written_batch_is_invisible(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    touched = lambda *ids: spark.createDataFrame([(i,) for i in ids], "repo_id bigint")
    refresh.publish(touched(1, 2), 0, store, artifacts([(1, "a"), (2, "b")]))
    first = seen(spark, store)
    assert len(first) == 4
    with monkeypatch.context() as broken:  # breaks off when the payloads are there and the log is not
        broken.setattr(refresh, "complete", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            refresh.publish(touched(1), 1, store, artifacts([(1, "half")]))
    assert (tmp_path / "store" / "batch=1").exists() and seen(spark, store) == first and refresh.next_batch(spark, store) == 1
    log = refresh.read_log(spark, store)
    assert {r.digest for r in refresh.digests(spark, store, log).collect()} == {r.digest for r in refresh.stored(spark, store).collect()}
    refresh.publish(touched(1), 1, store, artifacts([(1, "whole")]))
    assert seen(spark, store) - first == Counter({(1, "spec", "whole", 1): 1, (1, "manifest", "whole", 1): 1})


def test_compacted_digests_decide_alike(spark, tmp_path):
    """With and without compaction, the same batches write the same versions; a repeated batch changes nothing."""
    rng = random.Random(2)
    steps = [[(i, rng.choice("xyz")) for i in rng.sample(range(6), 3)] for _ in range(5)]
    results = []
    for every in (2, 100):
        store = str(tmp_path / f"store{every}")
        for n, rows in enumerate(steps):
            batch = spark.createDataFrame(rows, "repo_id bigint, payload string")
            refresh.publish(batch, n, store, artifacts(rows), buckets=8, compact_every=every)
        before = seen(spark, store)
        refresh.publish(batch, n, store, artifacts(rows), buckets=8, compact_every=every)
        assert seen(spark, store) == before
        results.append(before)
        assert (refresh.read_log(spark, store).snapshot >= 0) == (every == 2)
    assert results[0] == results[1]
    kept = {}
    for rows in steps:
        kept.update(rows)
    assert {(r.repo_id, r.payload) for r in refresh.stored(spark, store).groupBy("repo_id", "artifact").agg(F.max_by("payload", "batch").alias("payload")).collect()} == set(kept.items())


def test_only_touched_buckets_are_read(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = [(i, f"p{i}") for i in range(40)]
    refresh.publish(spark.createDataFrame(rows, "repo_id bigint, payload string"), 0, store, artifacts(rows), buckets=16)
    log = refresh.read_log(spark, store)
    assert log.buckets == 16
    buckets = [r[0] for r in refresh.digests(spark, store, log).select("bucket").distinct().limit(2).collect()]
    found = refresh.digests(spark, store, log, buckets)
    assert {r.bucket for r in found.collect()} == set(buckets)
    read = found.inputFiles()
    assert read
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
