"""Connected components of an undirected graph by alternating large-star and small-star rounds; a graph that was counted
and fits one task is solved there in one go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstream.llm.common import staged, unstage


#: Edges (16 bytes each) up to which one task takes them all.
ONE_TASK = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the smallest one of its component, and that one."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    off = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[off], nodes[label[off]]


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of edges as stars around the smallest node of its own components: never more edges than before."""
    for batch in batches:
        a, b = stars(*(batch[i].to_numpy(zero_copy_only=False) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a task at once."""
    held = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    yield from (b.rename_columns(["node", "root"]) for b in contracted(iter(held.combine_chunks().to_batches())))


def components(edges: DataFrame, label: str = "components", rounds: int = 40, most_alone: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node of edges(a long, b long) but the roots; root is the smallest node of its component.

    Every round is two joins on a node with its smallest neighbour, which Spark can split where a node is hot, and is
    written to the shared scratch folder, so a lost executor costs at most a round. No node's neighbours are gathered.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    held = staged(edges.mapInArrow(contracted, "a long, b long").distinct(), label)
    if held.count() <= most_alone:
        done = staged(held.coalesce(1).mapInArrow(solved, "node long, root long"), label)
        unstage(held)
        return done
    before = None
    for _ in range(rounds):
        both = held.union(held.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            held.select(F.col("b").alias("at"), F.col("a").alias("up"))
            .join(low.withColumnRenamed("a", "at"), "at")
            .select(F.col("up").alias("a"), F.least("at", "m").alias("b"))
            .distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = staged(small.union(least.select("a", F.col("m").alias("b"))).distinct(), label)
        unstage(held)
        held = after
        sign = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError("components did not settle")
    return held.select(F.col("a").alias("node"), F.col("b").alias("root"))
