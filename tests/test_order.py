"""Ordered operators against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rillstream.operators import liveness, order, ordered_map, ranks, rolling, taps


def frame(spark, values, schema="pos long, v int"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], schema)


def first_fit(values):
    tails, out = [], []
    for v in values:
        k = next((i for i, t in enumerate(tails) if v >= t), len(tails))
        tails[k:k + 1] = [v]
        out.append(k)
    return out


def test_concat_keeps_streams_in_order(spark):
    a, b = frame(spark, range(10)), frame(spark, range(10, 20))
    got = [r.v for r in order.concat([a, b]).orderBy("stream_idx", "pos").collect()]
    assert got == list(range(20))
    with pytest.raises(ValueError):
        order.concat([])


@pytest.mark.parametrize("seed", range(3))
def test_merge_is_sorted_and_ties_go_to_the_later_stream(spark, seed):
    r = random.Random(seed)
    streams = [sorted(r.choices(range(-9, 25), k=r.randint(0, 17))) for _ in range(seed * 2 + 1)]
    dfs = [frame(spark, values) for values in streams]
    got = [(x.v, x.stream_idx, x.pos) for x in order.kway_merge(dfs, ["v"], "pos").collect()]
    want = sorted(((v, s, i) for s, values in enumerate(streams) for i, v in enumerate(values)), key=lambda x: (x[0], -x[1], x[2]))
    assert got == want
    ranked = order.merge_ranked(dfs, ["v"], "pos").orderBy("rank").collect()
    assert [(r.v, r.stream_idx, r.pos) for r in ranked] == want and [r["rank"] for r in ranked] == list(range(1, len(want) + 1))


@pytest.mark.parametrize("values", [[], [1], [1, 1, 2, 2, 1], [None, None, 1, None], [5] * 40])
@pytest.mark.parametrize("keyed", [False, True])
def test_dedup_adjacent(spark, values, keyed):
    df = frame(spark, values).withColumn("g", F.lit(1)).repartition(3)
    got = [r.v for r in order.dedup_adjacent(df, ["v"], "pos", ["g"] if keyed else []).orderBy("pos").collect()]
    want = [v for i, v in enumerate(values) if i == 0 or v is None or v != values[i - 1]]
    assert got == want


def test_sort_last_wins(spark):
    values = random.Random(1).choices(range(20), k=100)
    got = [(r.v, r.pos) for r in order.sort_last_wins(frame(spark, values).repartition(5), ["v"], "pos").collect()]
    assert got == sorted({v: i for i, v in enumerate(values)}.items())


def test_bounded_sort_with_room_for_all_is_a_sort_of_the_last_of_each_key(spark):
    values = random.Random(2).choices(range(30), k=60)
    df = frame(spark, values).withColumn("g", F.lit("a"))
    got = [r.v for r in order.bounded_sort(df, ["v"], "pos", 100, ["g"]).orderBy("emitted").collect()]
    assert got == sorted(set(values))
    short = [r.v for r in order.bounded_sort(df, ["v"], "pos", 1, ["g"]).orderBy("emitted").collect()]
    assert len(short) <= len(values)
    with pytest.raises(ValueError):
        order.bounded_sort(df, ["v"], "pos", 0, ["g"])


@pytest.mark.parametrize("lookahead", [1, 4, 16])
def test_bounded_sort_and_buffered_runs_equal_a_loop(spark, lookahead):
    r = random.Random(lookahead)
    values, held, want = [r.randint(0, 60) for _ in range(200)], {}, []
    for i, v in enumerate(values):
        if v not in held and len(held) == lookahead:
            low = min(held)
            want.append((low, held.pop(low)))
        held[v] = i
    want += sorted(held.items())
    df = frame(spark, values).withColumn("g", F.lit("a")).repartition(3)
    got = order.bounded_sort(df, ["v"], "pos", lookahead, ["g"]).orderBy("emitted").collect()
    assert [(x.v, x.pos) for x in got] == want
    runs = order.cluster_runs(df, "v", "pos", ["g"], buffer_size=lookahead).collect()
    assert {x.pos: x.cluster_id for x in runs} == dict(zip([p for _, p in want], first_fit([v for v, _ in want]), strict=True))


@pytest.mark.parametrize("seed", range(4))
def test_cluster_runs_is_first_fit_and_runs_are_sorted(spark, seed):
    r = random.Random(seed)
    values = [r.randint(0, 50) for _ in range(300)]
    df = frame(spark, values).withColumn("g", F.lit("a")).repartition(4)
    got = order.cluster_runs(df, "v", "pos", ["g"]).orderBy("pos").collect()
    assert [x.cluster_id for x in got] == first_fit(values)
    runs = {}
    for x in got:
        runs.setdefault(x.cluster_id, []).append(x.v)
    assert all(v == sorted(v) for v in runs.values())


def test_cluster_runs_of_several_partitions_and_a_buffer(spark):
    rows = [(i, i % 3, (i * 37) % 101) for i in range(200)]
    df = spark.createDataFrame(rows, "pos long, g int, v int")
    got = {x.pos: x.cluster_id for x in order.cluster_runs(df, "v", "pos", ["g"]).collect()}
    for g in range(3):
        own = [r for r in rows if r[1] == g]
        assert [got[r[0]] for r in own] == first_fit([r[2] for r in own])
    buffered = order.cluster_runs(df, "v", "pos", ["g"], buffer_size=30)
    assert buffered.agg(F.max("cluster_id")).first()[0] <= max(got.values())
    assert buffered.columns == [*df.columns, "cluster_id"]


def test_ranks_over_many_partitions(spark):
    values = random.Random(3).sample(range(1000), 300)
    df = frame(spark, values).repartition(7)
    got = {r.v: (r["rank"], r.before) for r in ranks.with_sum_before(ranks.with_rank(df, [F.col("v")]), [F.col("v")], F.col("v"), "before").collect()}
    total = 0
    for k, v in enumerate(sorted(values), 1):
        assert got[v] == (k, total)
        total += v


def test_ordered_set(spark):
    s = order.OrderedSet(frame(spark, [3, 1, 2, 3]), "v", "pos")
    assert s.bounds().first()[:] == (1, 3, 3)
    assert {(r.v, r.pos) for r in s.df.collect()} == {(1, 1), (2, 2), (3, 3)}
    assert s.delete_min().delete_max().bounds().first()[:] == (2, 2, 1)
    assert s.has(2) and not s.delete(frame(spark, [2])).has(2)
    assert s.insert(frame(spark, [9])).bounds().first()[1] == 9
    assert s.clear().bounds().first()[2] == 0 and s.clone().bounds().first()[2] == 3
    assert s.get(frame(spark, [1, 7])).count() == 1


def test_roll_by_size_ends_a_file_after_the_row_that_exceeds(spark):
    df = frame(spark, [30] * 9)
    files = lambda limit: [r.file_idx for r in rolling.roll_by_size(df, "v", "pos", limit).orderBy("pos").collect()]
    assert files(-5) == files(0) == [0] * 9
    assert files(29) == list(range(9))
    assert files(30) == [i // 2 for i in range(9)]
    assert files(90) == [i // 4 for i in range(9)]


BIG = (1 << 60) + 1


def test_nulls_and_large_numbers_stay_what_they_are(spark):
    rows = [(0, None, BIG, 4.0, "x"), (1, None, None, 2.0, None), (2, None, BIG, 0.0, "y"), (3, 7, None, float("nan"), "z"), (4, 7, BIG, None, None), (5, 7, 1, 1.0, ""), (6, None, 2, None, "w")]
    df = spark.createDataFrame(rows, "pos long, part int, big long, v double, s string").repartition(3)
    got = sorted(tuple(r) for r in order.cluster_runs(df, "v", "pos", ["part"]).collect())
    # null < numbers < NaN: 4, 2, 0, null fall; NaN, null rises to 1 in the second run
    assert [g[0] for g in got] == list(range(7)) and [g[-1] for g in got] == [0, 1, 2, 0, 1, 1, 3]
    assert [(g[1], g[2], g[4]) for g in got] == [(r[1], r[2], r[4]) for r in rows]
    sorted_ = order.bounded_sort(df, ["v"], "pos", 2, ["part"]).orderBy("part", "emitted").collect()
    assert [x.pos for x in sorted_] == [1, 2, 6, 0, 4, 5, 3] and {x.pos: x.big for x in sorted_} == {r[0]: r[2] for r in rows}
    rolled = rolling.roll_by_size(df.withColumn("n", F.lit(5)), "n", "pos", 9, ["part"]).collect()
    assert {x.pos: (x.file_idx, x.big) for x in rolled} == {0: (0, BIG), 1: (0, None), 2: (1, BIG), 6: (1, 2), 3: (0, None), 4: (0, BIG), 5: (1, 1)}
    keys = order.cluster_runs(df, "big", "pos", ["part"]).collect()
    assert {x.pos: x.cluster_id for x in keys} == {0: 0, 1: 1, 2: 0, 6: 1, 3: 0, 4: 0, 5: 1}


def test_names_of_helpers_may_be_taken(spark):
    df = frame(spark, [3, 3, 1]).withColumns({c: F.lit("own") for c in ("__pid", "__at", "__n", "__start", "__p_v", "__row", "__own", "__prev", "__before", "__new", "__seen", "__opens", "__emitted", "__end", "__v", "__t", "__last")})
    assert order.dedup_adjacent(df, ["v"], "pos").columns == df.columns and order.dedup_adjacent(df, ["v"], "pos").count() == 2
    assert order.dedup_adjacent(df, ["v"], "pos", ["__pid"]).count() == 2 and order.sort_last_wins(df, ["v"], "pos").count() == 2
    assert [r["rank"] for r in ranks.with_rank(df, [F.col("pos")]).orderBy("pos").collect()] == [1, 2, 3]
    assert [r.b for r in ranks.with_sum_before(df, [F.col("pos")], F.col("v"), "b").orderBy("pos").collect()] == [0, 3, 6]
    assert rolling.roll_by_size(df, "v", "pos", 3).count() == 3 and rolling.prefix_max_bytes(df, "v", "pos", 4).count() == 2
    assert order.cluster_runs(df, "v", "pos", ["__pid"], buffer_size=2).columns == [*df.columns, "cluster_id"]
    assert order.OrderedSet(df, "v", "pos").delete_min().df.count() == 1
    with pytest.raises(ValueError):
        order.cluster_runs(df, "v", "pos", [], "__PID")


def cascade(values, size):
    """Buffers behind each other, as a loop: (value, position) in the order they leave."""
    buffers, out = [], []
    for i, v in enumerate(values):
        for k, b in enumerate(buffers):
            if len(b) < size:
                b[v] = i
                break
            if v >= min(b) or k == 6:
                b[v] = i
                low = min(b)
                out.append((low, b.pop(low)))
                break
        else:
            buffers.append({v: i})
    return out + [x for b in buffers for x in sorted(b.items())]


@pytest.mark.parametrize("size", [1, 3, 10])
def test_cascaded_buffers_equal_a_loop(spark, size):
    r = random.Random(size)
    values = [200 - i + r.randint(0, 40) for i in range(150)] + [r.randint(0, 300) for _ in range(150)]
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        df = frame(spark, values).withColumn("g", F.lit("a")).repartition(3)
        want = cascade(values, size)
        got = order.cascaded_sort(df, ["v"], "pos", size, ["g"]).orderBy("emitted").collect()
        assert [(x.v, x.pos) for x in got] == want
        runs = order.cluster_runs(df, "v", "pos", ["g"], buffer_size=size, cascade=True).collect()
        assert {x.pos: x.cluster_id for x in runs} == dict(zip([p for _, p in want], first_fit([v for v, _ in want]), strict=True))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    with pytest.raises(ValueError):
        order.cascaded_sort(df, ["v"], "pos", 0, ["g"])


def test_an_index_of_keys(spark):
    rows = [("a", 0), ("a", 50), ("a", 170), ("b", 10), ("c", 175), ("d", 5), ("d", 120)]
    df = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    at = lambda s: F.timestamp_seconds(F.lit(s))
    got = {r.k: (r.created, r.alive) for r in liveness.liveness_index(df, ["k"], "ts", 100_000_000, at(180)).collect()}
    assert got == {"a": (2, True), "b": (1, False), "c": (1, True), "d": (2, True)}
    shut = {r.k: (r.created, r.alive) for r in liveness.liveness_index(df, ["k"], "ts", 500_000_000, at(180), at(120)).collect()}
    assert shut == {"a": (2, True), "b": (1, False), "c": (1, True), "d": (1, False)}


@pytest.mark.parametrize("seed", range(3))
def test_rolling_equals_a_loop(spark, seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, 5, 30, 200]) for _ in range(400)]
    want, written, index = [], 0, 0
    for n in sizes:
        want.append(index)
        written += n
        if written > 100:
            written, index = 0, index + 1
    df = frame(spark, sizes).withColumn("g", F.lit("a")).repartition(5)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in (7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            for within in ([], ["g"]):
                assert [x.file_idx for x in rolling.roll_by_size(df, "v", "pos", 100, within).orderBy("pos").collect()] == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert rolling.roll_by_size(df.limit(0), "v", "pos", 100).count() == 0


def test_prefix_max_bytes(spark):
    df = frame(spark, [10, 10, 10, 10]).repartition(3)
    taken = lambda n: sorted(r.pos for r in rolling.prefix_max_bytes(df, "v", "pos", n).collect())
    assert taken(0) == [] and taken(1) == [0] and taken(20) == [0, 1] and taken(21) == [0, 1, 2]


def test_taps(spark):
    df, seen = taps.counted(frame(spark, range(5)))
    assert taps.logged(df, "row %s").count() == 5 and seen.get["rows"] == 5


STAGE = lambda v: ordered_map.checked(v + 1, v == 33, "bad")


@pytest.mark.parametrize("errors,want", [
    ("ignore", [(0, 13, None), (1, 23, None), (2, None, "bad"), (3, 43, None)]), ("drop", [(0, 13, None), (1, 23, None), (3, 43, None)]), ("abort", [(0, 13, None), (1, 23, None), (2, None, "bad")]),
])
def test_ordered_stages(spark, errors, want):
    df = frame(spark, [10, 20, 33, 40])
    plain = lambda v: ordered_map.checked(v + 1, F.lit(False), "")
    got = ordered_map.ordered_map(df, "pos", "v", [STAGE, plain, plain], errors).orderBy("index").collect()
    assert [tuple(r) for r in got] == want


def test_abort_without_errors_keeps_all(spark):
    assert ordered_map.ordered_map(frame(spark, [1, 2]), "pos", "v", [STAGE], "abort").count() == 2
    with pytest.raises(ValueError):
        ordered_map.ordered_map(frame(spark, [1]), "pos", "v", [STAGE], "other")


def test_idle_sessions_end_at_exactly_the_gap(spark):
    rows = [(i, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate([0, 29, 59])]
    df = spark.createDataFrame(rows, "i long, t string").select("i", F.col("t").cast("timestamp").alias("ts"), F.lit(1).alias("k"))
    got = [r.session_id for r in liveness.idle_sessions(df, ["k"], "ts", 30_000_000).orderBy("i").collect()]
    assert got == [0, 0, 1]
    alarm = liveness.idle_alarms(df, ["k"], "ts", 30_000_000, F.lit("2024-01-01 00:01:28").cast("timestamp")).first()
    assert not alarm.idle and alarm.remaining_us == 1_000_000


def test_external_sort_of_global_runs_keeps_duplicates(spark):
    r = random.Random(9)
    values = [r.randrange(500) + k // 3 for k in range(160)] + [-4] * 6
    runs = order.cluster_runs(frame(spark, values).repartition(3), "v", "pos", [])
    assert [x.cluster_id for x in runs.orderBy("pos").collect()] == first_fit(values)
    got = order.external_sort(runs, ["v"], "cluster_id", "pos").collect()
    assert [x.v for x in got] == sorted(values)
    assert [(x.v, -x.cluster_id, x.pos) for x in got] == sorted((x.v, -x.cluster_id, x.pos) for x in got)
