import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lexmill.streaming import health

SCHEMA = "run string, kind string, ts timestamp"
T0 = datetime(2024, 5, 1)


def brute(events, grace=15.0, silence=30.0):
    """Changes by walking through each run's events."""
    rank, out = {"start": 0, "progress": 1, "finish": 2}, []
    for run in {e[0] for e in events}:
        now, due = None, None
        for _, kind, ts in sorted((e for e in events if e[0] == run and e[1] in rank), key=lambda e: (e[2], rank[e[1]])):
            if due is not None and ts >= due:
                out.append((run, "stuck", due))
                now, due = "stuck", None
            if kind == "finish":
                out.append((run, "finished", ts))
                now, due = None, None
            elif kind == "start" and now is None:
                out.append((run, "starting", ts))
                now, due = "starting", ts + timedelta(seconds=grace)
            elif kind == "progress":
                out += [(run, "ok", ts)] if now != "ok" else []
                now, due = "ok", ts + timedelta(seconds=silence, milliseconds=1)
        if due is not None:
            out.append((run, "stuck", due))
    return sorted(out)


def some_events(seed):
    rng, out = random.Random(seed), []
    for run in "abcdef":
        at = T0
        for _ in range(30):
            at += timedelta(seconds=rng.choice([0, 1, 5, 14, 15, 16, 29, 30, 31, 60]))
            out.append((run, rng.choice(["start", "progress", "progress", "progress", "finish", "other"]), at))
    return out


def test_changes_over_a_whole_log_equal_the_walk(spark):
    events = [e for seed in range(3) for e in some_events(seed)]
    events = [(f"{run}{i // 180}", kind, at) for i, (run, kind, at) in enumerate(events)]
    got = health.health_of(spark.createDataFrame(events, SCHEMA), "run", "kind", "ts")
    assert sorted((r.run, r.health, r.at) for r in got.collect()) == brute(events)


def _streamed(spark, tmp_path, name):
    source = f"file://{tmp_path}/{name}"
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(source)
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), put


def test_by_event_time_the_stream_equals_the_log(spark, tmp_path):
    events = some_events(7)
    stream, put = _streamed(spark, tmp_path, "events")
    changes = health.run_health(stream, "run", "kind", "ts", late="0 seconds")
    query = changes.writeStream.format("memory").queryName("by_event").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c1").start()
    cuts = [T0 + timedelta(seconds=s) for s in (0, 150, 400, 10_000)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        put([e for e in events if lo < e[2] <= hi])
        query.processAllAvailable()
    put([("z", "start", T0 + timedelta(days=1))])
    query.processAllAvailable()
    query.stop()
    got = sorted((r.run, r.health, r.at) for r in spark.table("by_event").filter("run <> 'z'").collect())
    assert got == brute([e for e in events if e[2] > T0])


def test_by_processing_time_a_stall_is_told_without_an_event(spark, tmp_path):
    stream, put = _streamed(spark, tmp_path, "live")
    changes = health.run_health(stream, "run", "kind", "ts", grace_s=2, silence_s=3)
    query = changes.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(processingTime="500 milliseconds").start()

    def told(run, n):
        end = time.time() + 60
        while time.time() < end:
            rows = sorted(spark.table("live").filter(F.col("run") == run).collect(), key=lambda r: r.at)
            if len(rows) >= n:
                return [r.health for r in rows], [r.at for r in rows]
            time.sleep(0.5)
        raise AssertionError((run, rows))

    try:
        put([("quiet", "start", T0)])
        names, at = told("quiet", 2)
        assert names == ["starting", "stuck"] and at[1] - at[0] == timedelta(seconds=2)
        put([("quiet", "progress", T0)])
        names, at = told("quiet", 4)
        assert names == ["starting", "stuck", "ok", "stuck"] and at[3] - at[2] == timedelta(seconds=3, milliseconds=1)
        put([("quiet", "finish", T0)])
        assert told("quiet", 5)[0][-1] == "finished"
    finally:
        query.stop()
