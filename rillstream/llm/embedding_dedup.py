"""Embedding near-duplicates by NN-descent.

Equal vectors of a label become one class first, with a number of its own. Classes are dealt to groups of bounded size: a
label that fits is one group; a larger one is cut by the signs of random projections, in as many independent passes as
give a pair at the threshold a chance of `miss` at most to be apart in all of them. Where a cell of a cut is itself too
large - a dense cluster that no projection splits - its rows are cut evenly and every two of these parts form a group.

In a group, neighbour lists start from a forest of random projection trees and are refined by joins of neighbours with
their neighbours and reverse neighbours until they settle. A list all of whose entries are links may be too short: it
is enlarged through the links of its links until nothing is added. Links are the pairs whose cosine in double precision
reaches the threshold.

A group gives one row for each of its classes that has links: how many vectors it is linked to, and the first class it
is connected with. Pairs are never written out, so a cluster costs its length. A pair that several passes find is
counted by the first one in which both have the same signs, which every pass can tell.

After that an audit compares drawn classes, more of the labels that were cut, with all rows. While links are missing
everything is done again with longer lists, more trees and more passes; where that does not help, the job fails.

Defined results: vectors that are null, zero or hold null or non-finite components and rows without label link with
nothing and are their own component; vectors of different length do not link; repeated ids count as vectors of their
own, and do not tie their vectors together; a null id has links but a component only through others; an empty table
gives no rows.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstream.llm.common import sliced, staged, unstage, usable_vector, vectors
from rillstream.llm.components import components

log = logging.getLogger("rillstream")

LEAST = 0.98
#: Classes of a group at most, about.
GROUP_ROWS = 8192
LEAF = 48
SETTLED = 0.002
#: Classes drawn for the audit: among all, and among labels that were cut (of AUDIT_LABELS of these at most).
AUDITED = 256
AUDIT_LABELS = 64
ATTEMPTS = 6
#: How far below the threshold single precision may see a link, and above it the audit must.
SLACK = 1e-4
SURE = 1e-12
#: Label sizes and full cells up to which their tables are broadcast.
BROADCAST_SIZES = 100_000


@dataclass(frozen=True)
class Effort:
    """Entries of a list, trees, rounds, and the chance that a pair at the threshold meets in no pass."""

    entries: int = 16
    trees: int = 10
    rounds: int = 8
    miss: float = 0.005

    def more(self) -> Effort:
        return Effort(2 * self.entries, self.trees + 10, self.rounds + 4, self.miss / 20)


def merge(ids: np.ndarray, sims: np.ndarray, at: np.ndarray, new: np.ndarray, s: np.ndarray) -> int:
    """Puts candidates into the lists of rows `at`; how many entries changed."""
    k = ids.shape[1]
    all_ids = np.concatenate([ids[at], new], 1)
    all_s = np.concatenate([sims[at], np.where(new == at[:, None], -3, s)], 1)
    order = all_ids.argsort(1, kind="stable")
    all_ids, all_s = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_s, order, 1)
    all_s[:, 1:][all_ids[:, 1:] == all_ids[:, :-1]] = -3
    all_s[all_ids < 0] = -3
    top = np.argpartition(-all_s, k - 1, axis=1)[:, :k]
    best = np.take_along_axis(all_s, top, 1)
    kept = np.where(best > -2, np.take_along_axis(all_ids, top, 1), -1)
    changed = int((np.sort(kept, 1) != np.sort(ids[at], 1)).any(1).sum())
    ids[at], sims[at] = kept, best
    return changed


def leaves(x: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Cells of one random projection tree: cut at the median between two random members."""
    todo = [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            yield at
            continue
        a, b = rng.choice(len(at), 2, replace=False)
        side = x[at] @ (x[at[a]] - x[at[b]])
        order = side.argsort(kind="stable")
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]


def reverse(ids: np.ndarray) -> np.ndarray:
    """For each row up to as many rows that list it as it lists itself."""
    n, k = ids.shape
    src, dst = np.repeat(np.arange(n), k), ids.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = dst.argsort(kind="stable")
    src, dst = src[order], dst[order]
    rank = np.arange(len(dst)) - np.searchsorted(dst, dst)
    out = np.full((n, k), -1, ids.dtype)
    ok = rank < k
    out[dst[ok], rank[ok]] = src[ok]
    return out


def descend(x: np.ndarray, least: float, seed: int, effort: Effort = Effort()) -> np.ndarray:
    """Which rows of x (double precision, length 1) are linked: a symmetric matrix."""
    n = len(x)
    links = np.zeros((n, n), bool)
    if n < 2:
        return links
    rng = np.random.default_rng(seed)
    x32 = x.astype(np.float32)
    k = min(effort.entries, n - 1)
    ids, sims = np.full((n, k), -1, np.int32), np.full((n, k), -3, np.float32)
    for _ in range(effort.trees):
        for at in leaves(x32, rng):
            s = x32[at] @ x32[at].T
            merge(ids, sims, at, np.broadcast_to(at.astype(np.int32), s.shape), s)
    moved = np.ones(n, bool)
    for _ in range(effort.rounds):
        # Only rows whose own list or that of a neighbour has changed can learn of anyone new.
        live = np.flatnonzero(moved | (moved[np.maximum(ids, 0)] & (ids >= 0)).any(1))
        both = np.concatenate([ids, reverse(ids)], 1)
        before = ids.copy()
        for a in range(0, len(live), 256):
            at = live[a : a + 256]
            via = ids[at]
            cand = np.where(via[:, :, None] >= 0, both[np.maximum(via, 0)], -1).reshape(len(at), -1)
            cand = np.concatenate([cand, both[at, k:]], 1)
            s = np.einsum("ncd,nd->nc", x32[np.maximum(cand, 0)], x32[at])
            merge(ids, sims, at, cand, s)
        moved = (np.sort(ids, 1) != np.sort(before, 1)).any(1)
        if moved.sum() <= SETTLED * n:
            break
    near = (ids >= 0) & (sims >= least - SLACK)
    i, c = np.nonzero(near)
    links[i, ids[i, c]] = True
    links |= links.T
    for v in np.flatnonzero(near.all(1)).tolist() if k < n - 1 else []:
        own = np.flatnonzero(links[v])
        while True:  # the list is saturated: enlarge it through the links of a spread of its links
            seen = links[own[:: max(1, len(own) // effort.entries)]].any(0)
            seen[own] = False
            seen[v] = False
            cand = np.flatnonzero(seen)
            cand = cand[x[cand] @ x[v] >= least]
            if not len(cand):
                break
            own = np.concatenate([own, cand])
        links[v, own] = True
        links[own, v] = True
    checked(links, x, least)
    return links


def checked(links: np.ndarray, x: np.ndarray, least: float) -> None:
    """Takes out of links what does not reach the threshold in double precision, alike in both directions."""
    n = len(x)
    for a in range(0, n, 256):
        upper = links[a : a + 256] & (np.arange(n)[None] > np.arange(a, min(a + 256, n))[:, None])
        i, j = np.nonzero(upper)
        good = np.zeros(len(i), bool)
        if len(i) * 16 > upper.size:  # so many that one product is cheaper
            good = (x[a : a + 256] @ x.T)[i, j] >= least
        else:
            for b in range(0, len(i), 1 << 14):
                own = slice(b, b + (1 << 14))
                good[own] = np.einsum("kd,kd->k", x[a + i[own]], x[j[own]]) >= least
        i, j = i[~good] + a, j[~good]
        links[i, j] = False
        links[j, i] = False
    np.fill_diagonal(links, False)


def first_of_component(links: np.ndarray) -> np.ndarray:
    """For each row the first row it is connected with."""
    first, left = np.arange(len(links)), links.any(1)
    while left.any():
        start = int(left.argmax())
        left[start] = False
        front = np.array([start])
        while len(front):
            reached = links[front].any(0) & left
            left &= ~reached
            front = np.flatnonzero(reached)
            first[front] = start
    return first


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


FOUND = "node long, n long, root long"


def linked(t: pa.Table, cross: bool, number: int, least: float, seed: int, effort: Effort) -> pa.Table:
    """For each class of a group with links: the vectors it is linked to, as far as this pass counts them, and the first
    class it is connected with."""
    order = t["node"].to_numpy().argsort(kind="stable")  # results must not hang on the order rows come in
    t = t.take(pa.array(order))
    node, copies, part = t["node"].to_numpy(), t["copies"].to_numpy(), t["part"].to_numpy()
    links = descend(unit(vectors(t["v"])), least, seed, effort)
    if cross:
        links &= part[:, None] != part[None]
    first = first_of_component(links)
    if number:
        codes = vectors(t["codes"])
        for k in range(number):
            links &= codes[:, None, k] != codes[None, :, k]
    n = links @ copies.astype(np.float64)
    keep = np.flatnonzero((n > 0) | (first != np.arange(len(first))))
    return pa.table({"node": node[keep], "n": n[keep].astype(np.int64), "root": node[first[keep]]})


def bits(n: int, group_rows: int) -> int:
    return max(0, math.ceil(math.log2(n / group_rows)))


def passes(n: int, group_rows: int, least: float, miss: float) -> int:
    b = bits(n, group_rows)
    together = 1 - math.acos(least) / math.pi
    return math.ceil(math.log(miss) / math.log(1 - together**b)) if b else 1


def cells(classes: DataFrame, sizes: DataFrame, least: float, group_rows: int, seed: int, miss: float) -> DataFrame:
    """Classes with the group they go to (label, dim, pass, code, p, q): one row for each group a class is in. codes are
    those of the passes before. sizes: label, dim, count."""
    most = sizes.agg(F.max("count")).first()[0] or 0
    base = classes.select("label", "dim", "node", "copies", "v", F.lit(0).alias("pass"), F.lit(0).alias("code"), F.array().cast("array<int>").alias("codes"))
    if most > group_rows:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                t = pa.Table.from_batches([batch])
                dims, counts = t["dim"].to_numpy(), t["n"].to_numpy()
                for dim, n in sorted(set(zip(dims.tolist(), counts.tolist(), strict=True))):
                    own = np.flatnonzero((dims == dim) & (counts == n))
                    part = t.take(pa.array(own)).drop_columns(["n"])
                    x, many, b = vectors(part["v"]), passes(n, group_rows, least, miss), bits(n, group_rows)
                    planes = [np.random.default_rng([seed, k, b, dim]).normal(size=(dim, b)) for k in range(many)]
                    codes = np.stack([(x @ p > 0) @ (1 << np.arange(b)) for p in planes], 1).astype(np.int32)
                    for k in range(many):
                        out = part.append_column("pass", pa.array(np.full(len(own), k, np.int32))).append_column("code", pa.array(codes[:, k]))
                        out = out.append_column("codes", pa.array(list(codes[:, :k]), pa.list_(pa.int32())))
                        yield from out.combine_chunks().to_batches()

        sized = classes.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_SIZES else sizes, ["label", "dim"])
        base = sized.select("label", "dim", "node", "copies", "v", F.col("count").alias("n")).mapInArrow(run, "label string, dim int, node long, copies long, v array<double>, pass int, code int, codes array<int>")
        base = staged(base, "cells")
    key = ["label", "dim", "pass", "code"]
    full = base.groupBy(*key).count().where(F.col("count") > group_rows)
    full = full.select(*key, F.ceil(F.col("count") / (group_rows / 2)).cast("int").alias("parts"))
    if most <= group_rows:
        return base.select(*key, F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("part"), "node", "copies", "v", "codes")
    full = staged(full, "full-cells")
    dealt = base.join(F.broadcast(full) if full.count() <= BROADCAST_SIZES else full, key, "left")
    part = F.coalesce(F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")), F.lit(0)).cast("int")
    pairs = F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    spread = dealt.withColumn("part", part).select("*", F.explode(pairs).alias("with"))
    alone = F.col("with") < 0
    return spread.select(*key, F.when(alone, 0).otherwise(F.least("part", "with")).alias("p"), F.when(alone, 0).otherwise(F.greatest("part", "with")).alias("q"), "part", "node", "copies", "v", "codes")


def found_links(classes: DataFrame, sizes: DataFrame, least: float, group_rows: int, seed: int, effort: Effort) -> DataFrame:
    """node, n, root: a row for each class with links and group."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        return linked(t, key[-1].as_py(), key[2].as_py(), least, seed, effort)

    dealt = cells(classes, sizes, least, group_rows, seed, effort.miss).withColumn("cross", F.col("p") != F.col("q"))
    return dealt.groupBy("label", "dim", "pass", "code", "p", "q", "cross").applyInArrow(run, FOUND)


def drawn(classes: DataFrame, sizes: DataFrame, group_rows: int) -> pa.Table:
    """The classes an audit looks at: AUDITED of all, and of labels that were cut AUDITED in step with their size and 16
    each, of AUDIT_LABELS labels at most. label, node, v."""
    lot = F.xxhash64("node", F.lit("audit"))
    some = classes.select("label", "node", "v").orderBy(lot, "node").limit(AUDITED)
    cut = sizes.where(F.col("count") > group_rows).orderBy(F.xxhash64("label", "dim", F.lit("audit")), "label", "dim").limit(AUDIT_LABELS)
    shares = cut.withColumn("quota", F.ceil(AUDITED * F.col("count") / F.sum("count").over(Window.partitionBy())) + 16)  # AUDIT_LABELS rows
    order = Window.partitionBy("label", "dim").orderBy(lot, "node")
    few = classes.select("label", "dim", "node").join(F.broadcast(shares), ["label", "dim"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= AUDITED + 17).where("rank <= quota")
    return some.union(classes.join(F.broadcast(few.select("node")), "node").select("label", "node", "v")).dropDuplicates(["node"]).toArrow()


def missing(classes: DataFrame, sizes: DataFrame, counts: DataFrame, least: float, group_rows: int) -> tuple[int, int]:
    """Audit: (links that drawn classes have with all vectors of others and that are not in counts, links they have)."""
    asked = drawn(classes, sizes, group_rows)
    if not len(asked):
        return 0, 0
    held = classes.sparkSession.sparkContext.broadcast(asked)  # 2 * AUDITED + 17 * AUDIT_LABELS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        labels, nodes, rows = (held.value[c].to_pylist() for c in ("label", "node", "v"))
        for key in sorted({(label, len(v)) for label, v in zip(labels, rows, strict=True)}):
            at = [k for k, (label, v) in enumerate(zip(labels, rows, strict=True)) if (label, len(v)) == key]
            groups[key] = np.array([nodes[k] for k in at]), unit(np.array([rows[k] for k in at]))
        total: dict[int, int] = {}
        for batch in sliced(batches, 4096):
            t = pa.Table.from_batches([batch])
            own, node, copies = np.array(t["label"].to_pylist(), object), t["node"].to_numpy(), t["copies"].to_numpy()
            sizes = t["dim"].to_numpy()
            for (label, dim), (asking, x) in groups.items():
                at = np.flatnonzero((own == label) & (sizes == dim))
                if len(at):
                    hit = unit(vectors(t["v"].take(pa.array(at)))) @ x.T >= least + SURE
                    hit &= node[at][:, None] != asking[None]
                    for a, n in zip(asking.tolist(), (copies[at] @ hit).tolist(), strict=True):
                        total[a] = total.get(a, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["node", "n"])

    true = classes.select("label", "dim", "node", "copies", "v").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("true"))
    lost = F.greatest(F.col("true") - F.coalesce("others", F.lit(0)), F.lit(0))
    row = true.join(counts, "node", "left").agg(F.sum(lost), F.sum("true")).first()
    return row[0] or 0, row[1] or 0


def near_duplicates(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST, group_rows: int = GROUP_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    good = usable_vector(vector_col) & F.col(label_col).isNotNull()
    label, v = F.col(label_col).cast("string"), F.col(vector_col).cast("array<double>")
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.when(good, label).alias("label"), F.when(good, v).alias("v"))
    # Equal vectors meet by 128 bits of hashes; -0.0 and 0.0 may make two classes, which are linked like any others.
    own = own.withColumns({"h": F.xxhash64("label", "v"), "g": F.xxhash64(F.lit("again"), "v", "label")})
    known = own.where("label is not null")
    grouped = known.groupBy("label", "h", "g").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = staged(grouped.select("label", "h", "g", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("node"), "low", "copies", "v"), "vector-classes")
    sizes = staged(classes.groupBy("label", "dim").count(), "label-sizes")
    effort = Effort()
    for attempt in range(ATTEMPTS):
        found = staged(found_links(classes, sizes, least, group_rows, attempt, effort), "found")
        counts = found.groupBy("node").agg(F.sum("n").alias("others"))
        lost, of = missing(classes, sizes, counts, least, group_rows)
        log.info("audit %d: %d of %d links missing", attempt, lost, of)
        if not lost:
            break
        unstage(found)
        effort = effort.more()
    else:
        raise RuntimeError(f"{lost} of {of} audited links are missing after {ATTEMPTS} attempts")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b"), "embedding-components")
    group = F.coalesce("root", "node").alias("group")
    rooted = staged(classes.select("node", "low", "copies", "label", "h", "g").join(counts, "node", "left").join(roots, "node", "left").select("low", "copies", "others", "label", "h", "g", group), "rooted")
    least_ids = rooted.groupBy("group").agg(F.min("low").alias("component_id"))
    links = (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    named = rooted.join(least_ids, "group").select("label", "h", "g", links, "component_id")
    out = own.select("vec_id", "label", "h", "g").join(named, ["label", "h", "g"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
