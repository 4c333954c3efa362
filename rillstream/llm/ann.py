"""Approximate nearest neighbours with one hierarchical navigable small-world graph per shard.

Rows are dealt to shards by a hash of their id. A shard keeps each distinct vector once, with all ids that have it, and
a hierarchy of levels, each a random part of the one below. Levels are built from the top; a level takes its vectors in,
those of the level above first, in batches of up to BATCH_ROWS: a beam search through what is there finds each vector's
neighbours, and it is linked to diverse ones among these and its batch, and to near vectors of the level above, which
keeps tight clusters reachable. Links go both ways; a vector with more than MOST_LINKS keeps diverse ones. So a shard
costs about its rows times a search. The graph is stored as flat arrays of neighbour numbers.

Queries go in blocks to every shard, a bounded number of blocks at a time: greedy descent, then a beam on the ground
level; the beam is re-ranked exactly, and shard results, k each at most, are merged. Distances are worked out in double
precision around the shard's mean.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without id;
vectors of different length never meet, each length has its own graphs; rows that repeat id and vector count once; an id
with several vectors asks once with each, and its other vectors are candidates; ties go to the smaller id; an empty table
gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstream.llm.common import staged, usable_vector, vectors

#: Rows of a shard, about; queries of a block, about.
SHARD_ROWS = 16_384
BLOCK_ROWS = 512
#: Blocks that a task puts to a shard's graph: it holds these and the graph.
TOGETHER = 64
LINKS = 12
HUBS = 4
MOST_LINKS = 32
LEVEL_PART = 16
BATCH_ROWS = 1024
BUILD_BEAM = 48
BEAM = 400
AT_ONCE = 4


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, near enough for ordering."""
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]


def nearest(x: np.ndarray, at: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """For each of x[at] the k nearest of x[among] but itself, nearest first (numbers into x, -1 where there are too few)."""
    k = min(k, max(1, len(among) - 1))
    out = np.full((len(at), k), -1, np.int32)
    if len(among) < 2:
        return out
    for a in range(0, len(at), 512):
        own = at[a : a + 512]
        d = distances(x[own], x[among])
        d[own[:, None] == among[None]] = np.inf
        part = np.argpartition(d, k - 1, axis=1)[:, :k]
        order = np.take_along_axis(d, part, 1).argsort(1, kind="stable")
        out[a : a + 512] = among[np.take_along_axis(part, order, 1)]
    return out


def diverse(x: np.ndarray, at: np.ndarray, near: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates, nearest first, those nearer to the row than to any one kept before, then the rest."""
    out = np.full((len(at), keep), -1, np.int32)
    for a in range(0, len(at), 512):
        c = near[a : a + 512]
        v, base = x[np.maximum(c, 0)], x[at[a : a + 512]]
        to_row = ((v - base[:, None]) ** 2).sum(2)
        sq = (v * v).sum(2)
        between = sq[:, :, None] - 2 * np.einsum("nid,njd->nij", v, v) + sq[:, None, :]
        good = np.zeros(c.shape, bool)
        for j in range(c.shape[1]):
            closer = good[:, :j] & (between[:, j, :j] < to_row[:, j, None])
            good[:, j] = (c[:, j] >= 0) & ~closer.any(1)
        rank = np.where(good, 0, 1) * c.shape[1] + np.arange(c.shape[1])
        rank = np.where(c >= 0, rank, 10 * c.shape[1])
        order = rank.argsort(1, kind="stable")[:, :keep]
        out[a : a + 512, : order.shape[1]] = np.take_along_axis(c, order, 1)
    return out


def in_order(x: np.ndarray, at: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Each row's candidates once, nearest first, -1 behind."""
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == at[:, None]] = -1
    d = np.empty(cand.shape)
    for a in range(0, len(at), 256):
        own = cand[a : a + 256]
        d[a : a + 256] = np.where(own >= 0, ((x[np.maximum(own, 0)] - x[at[a : a + 256], None]) ** 2).sum(2), np.inf)
    return np.take_along_axis(cand, d.argsort(1, kind="stable"), 1)


class Graph:
    """vectors: distinct; ids and starts: the ids of each vector; levels: a neighbour array each, ground first."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, starts: np.ndarray, levels: list[np.ndarray], entry: int = 0):
        self.x, self.ids, self.starts, self.levels, self.entry = x, ids, starts, levels, entry
        self.centre = x.mean(0, dtype=np.float64) if len(x) else 0.0
        self.near = x.astype(np.float64) - self.centre
        self.sq = (self.near * self.near).sum(1)

    @staticmethod
    def build(raw: np.ndarray, ids: np.ndarray, seed: int = 1) -> Graph:
        x, inv = np.unique(raw, axis=0, return_inverse=True)
        order = np.lexsort((ids, inv))
        ids, inv = ids[order], np.ravel(inv)[order]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (inv[1:] != inv[:-1])
        ids, inv = ids[fresh], inv[fresh]
        starts = np.searchsorted(inv, np.arange(len(x) + 1))
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x)).astype(np.int32)
        sizes = [len(x)]  # members of a level: so many of `order`
        while sizes[-1] > 2 * LEVEL_PART:
            sizes.append(sizes[-1] // LEVEL_PART)
        g = Graph(x, ids, starts, [np.full((len(x), MOST_LINKS), -1, np.int32) for _ in sizes], int(order[0]))
        for level in range(len(sizes) - 1, -1, -1):
            g.grow(level, order[: sizes[level]])
        return g

    def grow(self, level: int, members: np.ndarray) -> None:
        """Takes the members into a level whose levels above are complete."""
        done = min(len(members), 64)
        first = members[:done]
        self.link(level, first, nearest(self.near, first, first, 2 * LINKS), np.zeros((done, 0), np.int32))
        while done < len(members):
            own = members[done : done + int(np.clip(done // 4, 64, BATCH_ROWS))]
            q = self.near[own]
            found = self.beam(q, BUILD_BEAM, level)
            hubs = self.beam(q, HUBS, level + 1) if level + 1 < len(self.levels) else np.zeros((len(own), 0), np.int32)
            inside = nearest(self.near, own, own, LINKS)
            self.link(level, own, np.concatenate([found, inside], 1), hubs)
            done += len(own)

    def link(self, level: int, own: np.ndarray, cand: np.ndarray, hubs: np.ndarray) -> None:
        """Links new members to diverse candidates and to hubs, and these back to them."""
        links = self.levels[level]
        kept = diverse(self.near, own, in_order(self.near, own, cand), LINKS)
        out = np.full((len(own), LINKS + hubs.shape[1]), -1, np.int32)
        out[:, :LINKS], out[:, LINKS:] = kept, hubs
        out = in_order(self.near, own, out)
        links[own, : out.shape[1]] = out
        src, dst = np.repeat(own, out.shape[1]), out.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        d = ((self.near[src] - self.near[dst]) ** 2).sum(1)
        order = np.lexsort((src, d, dst))
        src, dst = src[order], dst[order]
        to, begin = np.unique(dst, return_index=True)
        rank = np.arange(len(dst)) - np.repeat(begin, np.diff(np.append(begin, len(dst))))
        back = np.full((len(to), MOST_LINKS), -1, np.int32)
        ok = rank < MOST_LINKS
        back[np.searchsorted(to, dst[ok]), rank[ok]] = src[ok]
        every = in_order(self.near, to, np.concatenate([links[to], back], 1))
        many = (every >= 0).sum(1) > MOST_LINKS
        links[to[~many]] = every[~many, :MOST_LINKS]
        if many.any():
            links[to[many]] = diverse(self.near, to[many], every[many], MOST_LINKS)

    def to_row(self) -> dict:
        return {
            "n": len(self.x), "dim": self.x.shape[1], "entry": self.entry, "wide": self.x.dtype == np.float64, "x": self.x.tobytes(), "ids": self.ids.astype("<i8").tobytes(),
            "starts": self.starts.astype("<i8").tobytes(), "links": np.concatenate(self.levels).astype("<i4").tobytes(),
        }

    @staticmethod
    def of_row(r: dict) -> Graph:
        x = np.frombuffer(r["x"], np.float64 if r["wide"] else np.float32).reshape(r["n"], r["dim"])
        links = np.frombuffer(r["links"], "<i4").reshape(-1, r["n"], MOST_LINKS)
        return Graph(x, np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["starts"], "<i8"), list(links), r["entry"])

    def to(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distance less the query's own part; infinite for -1."""
        at = np.maximum(nodes, 0)
        d = self.sq[at] - 2 * np.einsum("qkd,qd->qk", self.near[at], q)
        return np.where(nodes >= 0, d, np.inf)

    def beam(self, q: np.ndarray, width: int, level: int = 0) -> np.ndarray:
        """For each query (around the mean) the numbers of its nearest vectors found on a level, nearest first, -1 where
        there are fewer than width."""
        m, n = len(q), len(self.x)
        rows = np.arange(m)[:, None]
        cur = np.full((m, 1), self.entry, np.int32)
        d = self.to(q, cur)
        for links in self.levels[:level:-1]:
            live = np.arange(m)
            while len(live):
                near = links[cur[live, 0]]
                dn = self.to(q[live], near)
                best = dn.argmin(1)[:, None]
                better = np.take_along_axis(dn, best, 1) < d[live]
                cur[live] = np.where(better, np.take_along_axis(near, best, 1), cur[live])
                d[live] = np.where(better, np.take_along_axis(dn, best, 1), d[live])
                live = live[better[:, 0]]
        seen = np.zeros((m, n), bool)
        seen[rows, cur] = True
        nodes = np.full((m, width), -1, np.int32)
        dist = np.full((m, width), np.inf)
        done = np.ones((m, width), bool)
        nodes[:, :1], dist[:, :1], done[:, 0] = cur, d, False
        links = self.levels[level]
        live = np.arange(m)
        while len(live):
            opened = np.where(done[live], np.inf, dist[live]).argsort(1, kind="stable")[:, :AT_ONCE]
            use = ~np.take_along_axis(done[live], opened, 1)
            done[live[:, None], opened] = True
            at = np.where(use, nodes[live[:, None], opened], -1)
            near = np.where(at[:, :, None] >= 0, links[np.maximum(at, 0)], -1).reshape(len(live), -1)
            known = (near < 0) | seen[live[:, None], np.maximum(near, 0)]
            near = np.where(known, -1, near)
            near.sort(1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            r, c = np.nonzero(near >= 0)
            seen[live[r], near[r, c]] = True
            dn = np.full(near.shape, np.inf)
            dn[r, c] = self.sq[near[r, c]] - 2 * np.einsum("kd,kd->k", self.near[near[r, c]], q[live[r]])
            all_d = np.concatenate([dist[live], dn], 1)
            order = np.argpartition(all_d, width - 1, axis=1)[:, :width]
            dist[live] = np.take_along_axis(all_d, order, 1)
            nodes[live] = np.take_along_axis(np.concatenate([nodes[live], near], 1), order, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], near < 0], 1), order, 1) | np.isinf(dist[live])
            live = live[~done[live].all(1)]
        return np.take_along_axis(nodes, dist.argsort(1, kind="stable"), 1)

    def search(self, ids: np.ndarray, q: np.ndarray, k: int, width: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, found ids and exact distances, k for each query at most, its own row left out."""
        width = min(max(width, 2 * k), len(self.x))
        found = self.beam(q - self.centre, width)
        out_q, out_v, out_d = [], [], []
        for number, (own, vec, nodes) in enumerate(zip(ids.tolist(), q, found, strict=True)):
            nodes = nodes[nodes >= 0]
            d = np.sqrt(((self.x[nodes].astype(np.float64) - vec) ** 2).sum(1))
            order = d.argsort(kind="stable")
            cut = d[order[min(k, len(order) - 1)]]
            got: list[tuple[float, int]] = []
            for j in order:
                if d[j] > cut:
                    break
                a, b = self.starts[nodes[j]], self.starts[nodes[j] + 1]
                got += [(float(d[j]), v) for v in self.ids[a : min(b, a + k + 1)].tolist() if v != own or d[j] > 0]
            got = sorted(got)[:k]
            out_q += [number] * len(got)
            out_d += [g[0] for g in got]
            out_v += [g[1] for g in got]
        return np.array(out_q, np.int64), np.array(out_v, np.int64), np.array(out_d, np.float64)


SHARD = "shard int, n int, dim int, entry int, wide boolean, x binary, ids binary, starts binary, links binary"


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dim, v of the rows that take part."""
    good = rows.where(usable_vector(vector_col) & F.col(id_col).isNotNull())
    return good.select(F.col(id_col).cast("long").alias("vec_id"), F.size(vector_col).alias("dim"), F.col(vector_col).alias("v"))


def index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard and length of (vec_id, dim, v), staged; every row is in one graph."""
    shards = max(1, math.ceil(rows.count() / shard_rows))

    def build(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        g = Graph.build(vectors(t["v"]), t["vec_id"].to_numpy(), seed=key[0].as_py() + 1)
        row = {"shard": key[0].as_py(), **g.to_row()}
        kinds = {"shard": pa.int32(), "n": pa.int32(), "dim": pa.int32(), "entry": pa.int32(), "wide": pa.bool_()}
        return pa.table({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()})

    keyed = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return staged(keyed.groupBy("shard", "dim").applyInArrow(build, SHARD), "hnsw")


def search(shards: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (vec_id, dim, v) over all shards."""
    asked = staged(queries.distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    blocks = max(1, math.ceil(asked.count() / block_rows))

    def block(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        cols = {"block": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([key[1].as_py()], pa.int32())}
        for name in ("q", "vec_id"):
            cols[name] = pa.array([t[name].to_numpy().astype("<i8").tobytes()], pa.binary())
        return pa.table(cols | {"v": pa.array([vectors(t["v"]).astype(np.float64).tobytes()], pa.binary())})

    packed = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).groupBy("block", "dim").applyInArrow(block, "block int, dim int, q binary, vec_id binary, v binary")
    at = shards.select("shard", "dim").withColumnRenamed("shard", "to")  # a row for each graph
    sent = packed.withColumn("turn", F.floor(F.col("block") / TOGETHER).cast("int")).join(at, "dim")
    turns = F.sequence(F.lit(0), F.lit((blocks - 1) // TOGETHER))
    asked_of = shards.withColumn("turn", F.explode(turns))

    def run(questions: pa.Table, graphs: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if graphs.num_rows and questions.num_rows:
            g = Graph.of_row(graphs.slice(0, 1).to_pylist()[0])
            for j in range(questions.num_rows):
                q, ids = (np.frombuffer(questions[c][j].as_py(), "<i8") for c in ("q", "vec_id"))
                number, found, score = g.search(ids, np.frombuffer(questions["v"][j].as_py(), np.float64).reshape(len(ids), -1), k)
                out.append((q[number], ids[number], found, score))
        q, own, v, d = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"q": q, "query_id": own, "vec_id": v, "score": d})

    pairs = sent.groupBy("to", "dim", "turn").cogroup(asked_of.groupBy("shard", "dim", "turn"))
    found = pairs.applyInArrow(run, "q long, query_id long, vec_id long, score double")
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(rows: DataFrame, is_query: Column, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Indexes all usable rows and searches for those where is_query holds."""
    return search(index(usable(rows, id_col, vector_col), shard_rows), usable(rows.where(is_query), id_col, vector_col), k)
