from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstream.llm import ann, embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, v string, score string"
BAD = [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [], [1.0, 2.0]]


def cloud(seed, n, groups=5, d=8):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    for g in range(groups):
        own = r.choice(n, n // 12, replace=False)
        x[own] = x[own[0]] + 0.03 * r.normal(size=(len(own), d))
    x[r.choice(n, n // 20, replace=False)] = x[0]
    return x.astype(np.float32)


def frame(spark, x, labels=None, bad=True):
    rows = [(i, v.tolist(), None if labels is None else int(labels[i]), "x", "y") for i, v in enumerate(x)]
    rows += [(10_000 + i, v, 0, "x", "y") for i, v in enumerate(BAD)] if bad else []
    return spark.createDataFrame(rows, SCHEMA)


def exact(x, i, k):
    d = np.sqrt(((x.astype(np.float64) - x[i].astype(np.float64)) ** 2).sum(1))
    d[i] = np.inf
    order = np.lexsort((np.arange(len(x)), d))[:k]
    return order.tolist(), d[order].tolist()


@pytest.mark.parametrize("shard_rows", [100, 5000])
def test_neighbours(spark, shard_rows):
    x = cloud(1, 900)
    got = {}
    for r in ann.neighbours(frame(spark, x), F.col("vec_id") % 20 == 0, shard_rows=shard_rows).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    assert set(got) == set(range(0, 900, 20))
    for q, found in got.items():
        found.sort()
        ids, d = exact(x, q, 10)
        assert [f[0] for f in found] == list(range(1, 11)) and q not in [f[1] for f in found]
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        hits += len({f[1] for f in found} & set(ids))
        total += 10
        for _, v, s in found:
            assert s == np.sqrt(((x[v].astype(np.float64) - x[q].astype(np.float64)) ** 2).sum())
    assert hits / total >= 0.97


@pytest.mark.parametrize("mean", [0, 10_000])
@pytest.mark.parametrize("n", [3000, 9000])
def test_recall_of_a_graph(n, mean):
    x = (cloud(11, n, groups=7, d=16) + mean).astype(np.float32)
    g = ann.Graph.build(x, np.arange(n), seed=2)
    assert all(links.dtype == np.int32 and links.shape == (len(g.x), ann.MOST_LINKS) for links in g.levels) and len(g.levels) >= 3
    asked = np.arange(0, n, 30)
    q, v, d = g.search(asked, x[asked].astype(np.float64), 10)
    hits = 0
    for k, i in enumerate(asked.tolist()):
        hits += len(set(v[q == k].tolist()) & set(exact(x, i, 10)[0]))
    assert hits / (10 * len(asked)) >= 0.95


def test_lengths_and_repeated_ids(spark):
    rows = [(0, [1.0, 0]), (0, [0, 1.0]), (0, [1.0, 0]), (1, [1.0, 0.5]), (2, [0, 2.0]), (3, [1.0, 0, 0]), (100, [1.0, 0, 1]), (4, [5.0]), (200, [7.0]), (None, [1.0, 0]), (300, [1.0] * 5)]
    df = spark.createDataFrame([(i, [float(y) for y in v], 1, "x", "y") for i, v in rows], SCHEMA)
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.neighbours(df, F.col("vec_id") % 100 == 0, k=2).collect())
    r2, r125 = round(2**0.5, 9), round(1.25**0.5, 9)
    want = [(0, 1, 1, 0.5), (0, 2, 0, r2), (0, 1, 2, 1.0), (0, 2, 1, r125), (100, 1, 3, 1.0), (200, 1, 4, 2.0)]
    assert got == sorted(want)


def test_few_rows_and_none(spark):
    x = cloud(2, 5, groups=0)
    got = ann.neighbours(frame(spark, x), F.lit(True)).collect()
    assert len(got) == 20
    assert ann.neighbours(frame(spark, x).limit(0), F.lit(True)).count() == 0
    assert ann.neighbours(frame(spark, x[:1], bad=False), F.lit(True)).count() == 0


def test_recall_of_the_query_on_the_table(spark):
    from conftest import DATA

    from rillstream.llm.queries import QUERIES

    t = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.stack(t["embedding"]), t["vec_id"].to_numpy()
    got = {(r.query_id, r.vec_id) for r in QUERIES["op5_ann"](spark, DATA).collect()}
    want = {(int(ids[i]), int(ids[j])) for i in np.flatnonzero(ids % 100 == 0) for j in exact(x, i, 10)[0]}
    assert len(got & want) / len(want) >= 0.95


def slow_links(x, labels, least=0.98):
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(1))[:, None]
    s = (u @ u.T >= least) & (labels[:, None] == labels[None])
    np.fill_diagonal(s, False)
    root = np.arange(len(x))
    while True:
        new = np.array([min(root[i], root[s[i]].min(initial=root[i])) for i in range(len(x))])
        if (new == root).all():
            return s.sum(1), root
        root = new


@pytest.mark.parametrize("group_rows", [60, 5000])
def test_near_duplicate_vectors(spark, group_rows):
    x = cloud(3, 700)
    labels = np.arange(700) % 3 % 2
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame(spark, x, labels).repartition(5), group_rows=group_rows).collect()}
    n, root = slow_links(x, labels)
    assert len(got) == 700 + len(BAD)
    assert {i: (got[i].n_links, got[i].component_id, got[i].kept) for i in range(700)} == {i: (n[i], root[i], root[i] == i) for i in range(700)}
    assert all((got[10_000 + i].n_links, got[10_000 + i].component_id) == (0, 10_000 + i) for i in range(len(BAD)) if len(BAD[i] or []) != 2)


def test_saturated_lists_are_enlarged():
    r = np.random.default_rng(4)
    x = embedding_dedup.unit(r.normal(size=16) + 0.02 * r.normal(size=(400, 16)))
    got = embedding_dedup.descend(x, 0.98, 1)
    s = x @ x.T >= 0.98
    np.fill_diagonal(s, False)
    assert (got == s).all() and s.sum() > 32 * 400


def test_vectors_without_label_and_none(spark):
    x = cloud(5, 30)
    got = embedding_dedup.near_duplicates(frame(spark, x)).where("vec_id < 1000").collect()
    assert all(r.n_links == 0 and r.kept for r in got)
    assert embedding_dedup.near_duplicates(frame(spark, x).limit(0)).count() == 0


def test_a_dense_cluster_larger_than_a_group(spark):
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=8) + 0.01 * r.normal(size=(260, 8)), r.normal(size=(100, 8))]).astype(np.float32)
    labels = np.zeros(360, int)
    df = frame(spark, x, labels, bad=False)
    classes = df.select(F.lit("0").alias("label"), F.lit(8).alias("dim"), F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("copies"), F.col("embedding").cast("array<double>").alias("v"))
    dealt = embedding_dedup.cells(classes, classes.groupBy("label", "dim").count(), 0.98, 40, 0, 0.005)
    sizes = dealt.groupBy("label", "dim", "pass", "code", "p", "q").count()
    assert sizes.agg(F.max("count")).first()[0] <= 80 and dealt.where("p <> q").count() > 0
    got = {v.vec_id: v for v in embedding_dedup.near_duplicates(df, group_rows=40).collect()}
    n, root = slow_links(x, labels)
    assert {i: (got[i].n_links, got[i].component_id) for i in range(360)} == {i: (n[i], root[i]) for i in range(360)}


def test_repeated_and_null_ids_do_not_tie_vectors_together(spark):
    a, b = [1.0, 0, 0, 0], [0, 1.0, 0, 0]
    near_a, c = [1.0, 0.01, 0, 0], [0, 0, 1.0, 0]
    rows = [(5, a), (5, b), (7, near_a), (None, c), (9, [0, 0.001, 1.0, 0]), (None, [0, 0, 0, 1.0]), (3, b), (None, c), (5, [0.0, 0, 0, 0])]
    df = spark.createDataFrame([(i, [float(y) for y in v], 1, "x", "y") for i, v in rows], SCHEMA).repartition(4)
    got = sorted(map(str, embedding_dedup.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()))
    want = [(5, 1, 5, True), (5, 1, 3, False), (7, 1, 5, False), (None, 2, 9, False), (None, 2, 9, False), (9, 2, 9, True), (None, 0, None, False), (3, 1, 3, True), (5, 0, 5, True)]
    assert got == sorted(f"Row(vec_id={i}, n_links={n}, component_id={c}, kept={k})" for i, n, c, k in want)


def test_audit_repeats_until_nothing_is_missing(spark, monkeypatch):
    x = cloud(7, 400)
    labels = np.zeros(400, int)
    calls, real, search = [], embedding_dedup.missing, embedding_dedup.found_links
    monkeypatch.setattr(embedding_dedup, "missing", lambda *a: calls.append(real(*a)) or calls[-1])
    monkeypatch.setattr(embedding_dedup, "found_links", lambda *a: search(*a).where(F.lit(a[4] >= 2)))  # finds nothing twice
    got = {v.vec_id: v for v in embedding_dedup.near_duplicates(frame(spark, x, labels, bad=False)).collect()}
    n, root = slow_links(x, labels)
    assert {i: (got[i].n_links, got[i].component_id) for i in range(400)} == {i: (n[i], root[i]) for i in range(400)}
    assert len(calls) == 3 and all(lost == of > 0 for lost, of in calls[:2]) and calls[2][0] == 0
    monkeypatch.setattr(embedding_dedup, "ATTEMPTS", 1)
    with pytest.raises(RuntimeError):
        embedding_dedup.near_duplicates(frame(spark, x, labels, bad=False))

