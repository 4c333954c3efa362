from __future__ import annotations

import glob
import gzip
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from rillstream.sources import json_values, pipe, sinks, writers
from rillstream.streaming import stateful


def test_concatenated_values(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a":1} {"a":2}\n[1,\n2] "x" oops')
    rows = json_values.read_values(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.value for r in rows] == ['{"a":1}', '{"a":2}', "[1,\n2]", '"x"', None] and rows[-1].err
    flat = json_values.read_values(spark, str(tmp_path), arrays=True).where("err is null").orderBy("pos").collect()
    assert [r.value for r in flat] == ['{"a":1}', '{"a":2}', "1", "2", '"x"']


def rows_of(path):
    with (gzip.open(path, "rt") if path.endswith(".gz") else open(path)) as f:
        return [json.loads(line) for line in f]


def test_rolled_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "b" * 33) for i in range(8)], "i long, t string")  # lines of 50 bytes
    for limit, files in ((0, 1), (20, 8), (120, 3)):
        for zipped in (False, True):
            base = str(tmp_path / f"{limit}-{zipped}")
            target = sinks.Target(base).with_gzip() if zipped else sinks.Target(base)
            sinks.write_rolled(df, target, "i", limit, "base")
            found = sorted(glob.glob(f"{base}/*"))
            assert len(found) == files and all(p.endswith(".ndjson.gz" if zipped else ".ndjson") for p in found)
            assert [r["i"] for p in found for r in rows_of(p)] == list(range(8))


def test_clustered_files_are_sorted(spark, tmp_path):
    values = random.Random(31).choices(range(12), k=25)
    from rillstream.operators.order import cluster_runs

    df = spark.createDataFrame([(i, "a b/ü", v) for i, v in enumerate(values)], "pos long, name string, v long")
    done = sinks.write_clustered(cluster_runs(df, "v", "pos", ["name"]), sinks.Target(str(tmp_path)), ["name"], "cluster_id", "pos")
    assert sum(r["rows"] for r in done.collect()) == len(values)
    files = sorted(glob.glob(f"{tmp_path}/**/*.json", recursive=True))
    assert files[0].endswith("name=a+b%2F%C3%BC/sorted_records_p0000_s.json")
    runs = [[r["v"] for r in rows_of(f)] for f in files]
    assert all(r == sorted(r) for r in runs) and sorted(sum(runs, [])) == sorted(values)


def test_targets():
    t = sinks.Target("/base/").with_prefix("a").with_suffix("b")
    assert t.named("f.json") == "/base/a/b/f.json" and t.with_gzip().named("f.json") == "/base/a/b/f.json.gz" and t.with_gzip().named("f.gz") == "/base/a/b/f.gz"


def test_generators_agree_with_themselves(spark):
    one, two = (json_values.random_events(spark, 30, 2, 500).collect() for _ in range(2))
    assert one == two and all(r.event_time.minute == 1 for r in one)
    assert [r.val for r in json_values.descending(spark, 3).orderBy("pos").collect()] == [3, 2, 1, 0]
    assert json_values.literal(spark, [{"val": 1}, (2,), 3], "val long").count() == 3


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, (i * 7) % 20, 1_700_000_000 + 10 * ((i * 13) % 40)) for i in range(40)], "i long, k int, v long, s long")
    rows.withColumn("ts", F.timestamp_seconds("s")).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    got = stateful.run_available(stateful.ordered_stream(stream.select("i", "k", "ts").withWatermark("ts", "0 seconds"), ["k"], "ts", "i"), "t").collect()
    for k in (0, 1):
        own = sorted((r.emitted, r.ts, r.i) for r in got if r.k == k)
        assert [o[0] for o in own] == list(range(len(own))) and [o[1:] for o in own] == sorted(o[1:] for o in own) and own


def test_hooks_and_idle_streams(spark, tmp_path):
    from rillstream.streaming import hooks

    spark.range(10).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    run = hooks.batch_writer(lambda df, n: seen.append(("write", df.count())), lambda df, n: seen.append("before"), lambda df, n: seen.append("after"))
    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "log")).start()
    hooks.stop_when_idle(query, 2)
    assert not query.isActive and seen == ["before", ("write", 10), "after"]


def test_files_written_again_replace_those_that_are_there(spark, tmp_path):
    df = spark.createDataFrame([(i, "k") for i in range(5)], "i long, k string")
    target = sinks.Target(str(tmp_path / "a b"))
    for _ in range(2):
        done = sinks.write_routed(df, target, ["k"], "i").collect()
    assert sum(r["rows"] for r in done) == 5
    found = [p for p in glob.glob(f"{target.base}/**/*", recursive=True, include_hidden=True) if p.endswith((".json", ".part"))]
    assert len(found) == len(done) and sorted(r["i"] for p in found for r in rows_of(p)) == list(range(5))


def test_a_cache_of_open_files(tmp_path):
    now = [0.0]
    cache = writers.WriterCache(f"file://{tmp_path}", True, max_open=2, ttl_s=10, clock=lambda: now[0])
    seen = []
    cache.before_close.append(lambda p: seen.append(("before", p)))
    cache.after_close.append(lambda p: seen.append(("after", p)))
    assert cache.requires_new("a_{suffix}") and cache.free() == 2
    for path in ("a_{suffix}", "b_{suffix}", "a_{suffix}", "c_{suffix}"):
        cache.write(path, b"1\n")
    assert seen == [("before", "b_{suffix}"), ("after", "b_{suffix}")] and cache.free() == 0 and not cache.requires_new("a_{suffix}")
    now[0] = 10.0
    cache.write("d", b"2\n")
    assert list(cache.open) == ["d"]
    cache.close_path("nothing")
    cache.close()
    found = cache.finished().to_pylist()
    assert [f["rows"] for f in found] == [1, 2, 1, 1] and len({f["file"] for f in found}) == 4 and cache.finished().num_rows == 0
    with pytest.raises(ValueError):
        cache.write("d", b"3\n")


def test_pipe_waits_and_stops(spark):
    p = pipe.RecordPipe(spark, "v long", chunk=10, room=20)
    for k in range(25):
        p.push(k)
    p.stop()
    p.stop()
    with pytest.raises(pipe.PipeStopped):
        p.push(1)
    assert [(r.pos, r.v) for r in stateful.run_available(p.stream(), "p").orderBy("pos").collect()] == [(k, k) for k in range(25)]

    class Query:
        isActive, recentProgress = True, []

    class Progress:
        batchId, numInputRows = 0, 10

    slow, query = pipe.RecordPipe(spark, "v long", chunk=10, room=20), Query()
    slow.attach(query)
    for k in range(29):
        slow.push(k)
    writer = threading.Thread(target=slow.push, args=(29,))
    writer.start()
    writer.join(1)
    assert writer.is_alive() and slow.written == 20  # 20 wait to be read
    query.recentProgress = [Progress()]
    writer.join(30)
    assert not writer.is_alive() and slow.written == 30


def test_appending_in_memory(spark):
    sink = sinks.MemorySink()
    sink.append(spark.range(2), "a")
    sink.append(spark.range(1), "a")
    assert sorted((r.part, r.value) for r in sink.read("a").collect()) == [(0, '{"id":0}'), (0, '{"id":1}'), (1, '{"id":0}')]
    sink.clear()
    assert sink.parts == {}


def test_streams_keep_nulls_and_large_numbers(spark, tmp_path):
    big = (1 << 60) + 1
    rows = [(0, None, big, 4.0), (1, None, None, 2.0), (2, None, big, None), (3, 1, None, float("nan")), (4, 1, big, 1.0)]
    df = spark.createDataFrame(rows, "i long, k int, big long, v double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("i")))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = stateful.run_available(stateful.cluster_runs_stream(stream.drop("ts"), ["k"], "v", "i"), "n").collect()
    assert {r.i: (r.k, r.big, r.cluster_id) for r in got} == {r[0]: (r[1], r[2], c) for r, c in zip(rows, [0, 1, 2, 0, 1], strict=True)}
    kept = stateful.run_available(stateful.ordered_stream(stream.withWatermark("ts", "0 seconds"), ["k"], "ts", "i"), "o").collect()
    assert {(r.i, r.big) for r in kept} <= {(r[0], r[2]) for r in rows} and len(kept) >= 4


def test_memory_view(spark):
    sinks.memory_view(spark.createDataFrame([(1, None)], "a int, b string"), "kept")
    assert [r.value for r in spark.sql("select * from kept").collect()] == ['{"a":1,"b":null}']


def test_clustered_files_hold_every_user(spark, tmp_path):
    from rillstream.plans.queries import QUERIES

    events = [(i, 7 * (i % 12), float((i * 37) % 11)) for i in range(240)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["write_clustered_roundtrip"](spark, str(tmp_path)).collect()
    want = {}
    for _, user, value in events:
        tails = want.setdefault(user, [])
        k = next((i for i, t in enumerate(tails) if value >= t[0]), len(tails))
        tails[k:k + 1] = [(value, (tails[k][1] if k < len(tails) else 0) + 1)]
    assert sorted(map(tuple, got)) == sorted((f"user_id={u}/sorted_records_p{k:04d}_s.json", n) for u, tails in want.items() for k, (_, n) in enumerate(tails))
    assert max(want) > 40 and sum(r.rows for r in got) == len(events)


def test_cached_files_are_few_where_paths_alternate(spark, tmp_path):
    kinds = random.Random(8).choices("abcde", k=3000)
    df = spark.createDataFrame(list(enumerate(kinds)), "i long, k string").coalesce(1)
    path = F.concat(F.lit("k="), F.col("k"), F.lit("/f_{suffix}.json"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        for most, held in ((5, {}), (5 + 5 * 3, {"held": 1})):  # all rows at once; 6 batches, of which 5 open the 3 closed files
            target = sinks.Target(str(tmp_path / str(most)), gzip=True)
            done = sinks.write_cached(df, target, path, max_open=2, **held).collect()
            found = sorted(glob.glob(f"{target.base}/**/*.gz", recursive=True))
            assert len(found) == len(done) == most and sum(r["rows"] for r in done) == 3000
            got = [(p.split("/k=")[1][0], [(r["i"], r["k"]) for r in rows_of(p)]) for p in found]
            assert all(rows == sorted(rows) and {k for _, k in rows} == {kind} for kind, rows in got)
            assert sorted(x for _, rows in got for x in rows) == list(enumerate(kinds))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
