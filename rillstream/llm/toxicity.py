"""Toxicity by a convolutional text classifier.

A word's embedding is the mean of hashed embeddings: of the word and of its character n-grams, so that unseen forms of
known stems count. Filters of several widths slide over the words; each filter's maximum over the whole text goes to a
logistic output. Because a filter is a sum over word offsets, a word's contribution to every filter and offset is worked
out once and remembered, and scoring a text is adding and taking maxima.

Every labelled row is learned from, whole, whatever its length. Rows are dealt by a hash of their text to FOLDS folds (2
where there are more than FEW); there is a model for each fold, trained in numpy on the executors on all rows of the other
folds and held against those of its own. The rows of a model are dealt to shards of about SHARD_ROWS rows and SHARD_CHARS
characters; a pass trains every shard from the same parameters and then averages them, a bucket's over the shards that
moved it. The start comes from counts over all rows. A score is the mean of the models' logits, moved so that the best
threshold for F1 of all rows, each scored by the model that has not seen it, falls on the score THRESHOLD: for each
language, told from the text alone by the language filters.

Defined results: null and empty texts get the score of no evidence; without labels of both kinds every score is the
share of label 1 seen (0 without labels); a row repeated with id, text and label is learned from once; where a label is
missing in a fold or in the rest, one model learns from all rows and is held against them; repeated rows get repeated
scores; further columns are ignored.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstream.llm.common import give_back, sliced, staged, unstage
from rillstream.llm.language_id import Filters

THRESHOLD = 0.3
#: Folds of the labelled rows; half as many where there are more rows than FEW.
FOLDS = 4
FEW = 8192
#: Rows and characters of a shard, about.
SHARD_ROWS = 16_384
SHARD_CHARS = 1 << 25
#: Labels that are broadcast to the texts; more are joined by shuffle.
BROADCAST_LABELS = 1_000_000
BUCKETS = 1 << 16
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Passes over all rows, more (up to ten times as many) until a shard has seen about STEPS texts.
EPOCHS = 2
STEPS = 20_000
#: Texts of a step, fewer where they have more than BATCH_WORDS words.
BATCH = 48
BATCH_WORDS = 1 << 18
RATE = 0.08
NGRAMS = (4, 5, 6)
#: A longer word is taken in parts of so many characters, which share so many with the part before.
LONGEST = 64
OVERLAP = 16
#: Words of a text whose filter outputs are held at once.
SPAN = 1 << 16
OFFSETS = sum(WIDTHS)
#: Stretches of buckets that are counted and averaged on their own.
BLOCKS = 16
STRIP = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”„…"


def bucket_lists(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of words, one after the other, and where each word's begin: the word and its n-grams of 4 to 6
    characters, with marks at both ends."""
    marked = [f"<{w}>" for w in ws]
    sizes = np.array([len(w) for w in marked], np.int64)
    c = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(c))  # characters from here to the word's end
    owner = np.repeat(np.arange(len(ws)), sizes)
    h = np.zeros(len(c), np.uint32)
    whole = np.array([zlib.crc32(w.encode()) for w in marked], np.uint32) % BUCKETS
    buckets, owners = [whole], [np.arange(len(ws))]
    for n in range(1, NGRAMS[-1] + 1):
        h = (h[: len(c) - n + 1] ^ c[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in NGRAMS:
            at = np.flatnonzero(left[: len(h)] >= n)
            buckets.append((h[at] + np.uint32(n)) % BUCKETS)
            owners.append(owner[at])
    buckets, owners = np.concatenate(buckets), np.concatenate(owners)
    order = owners.argsort(kind="stable")
    return buckets[order].astype(np.int32), np.searchsorted(owners[order], np.arange(len(ws)))


def words(text: str | None) -> list[str]:
    """What stands between white space; a word longer than LONGEST as its parts, each a word of its own."""
    ws = (text or "").lower().split()
    if max(map(len, ws), default=0) <= LONGEST:
        return ws
    return [p for w in ws for p in parts(w)]


def parts(w: str) -> list[str]:
    """Every character is in a part, and every run of up to OVERLAP characters whole in one."""
    if len(w) <= LONGEST:
        return [w]
    w = w.strip(STRIP)
    return [w[a : a + LONGEST] for a in range(0, max(1, len(w) - OVERLAP), LONGEST - OVERLAP)]


def chunked_lists(ws: list[str], together: int = 1 << 12) -> tuple[np.ndarray, np.ndarray]:
    """bucket_lists of many words, worked out for `together` at a time."""
    flats, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for a in range(0, len(ws), together):
        flat, starts = bucket_lists(ws[a : a + together])
        flats.append(flat)
        lengths.append(np.diff(np.append(starts, len(flat))))
    length = np.concatenate(lengths)
    return np.concatenate(flats), np.cumsum(length) - length


@dataclass
class Model:
    """emb: bucket embeddings; conv: for each width and offset DIM x FILTERS, side by side; then the logistic output.

    Joined models have the dimensions and filters of all.
    """

    emb: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    base: float
    prior: float | None = None
    shifts: dict[str, float] = field(default_factory=dict)
    languages: Filters | None = None


def windows(rows: np.ndarray, filters: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each width that fits its number and what every window of words gives to each of its filters."""
    col = 0
    for k, width in enumerate(WIDTHS):
        n = len(rows) - width + 1
        if n > 0:
            total = rows[:n, col * filters : (col + 1) * filters]
            for j in range(1, width):
                total = total + rows[j : j + n, (col + j) * filters : (col + j + 1) * filters]
            yield k, total
        col += width


class Places(dict):
    """A number for each word that was asked for; new: those since the last look."""

    new: list[str]

    def __missing__(self, w: str) -> int:
        self[w] = n = len(self)
        self.new.append(w)
        return n


class Scorer:
    """Scores texts; what each raw word adds to every filter and offset is worked out once, up to about `room` words."""

    room = 500_000
    together = 256

    def __init__(self, model: Model):
        self.model = model
        self.filters = len(model.bias) // len(WIDTHS)
        self.room = self.room * FILTERS // max(FILTERS, self.filters)
        self.place = Places()
        self.rows = np.zeros((1 << 14, OFFSETS * self.filters), np.float32)

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.place) > self.room:
            self.place = Places()
        self.place.new = []
        of = self.place.__getitem__
        out = [np.fromiter(map(of, ws), np.int64, len(ws)) for ws in texts]
        new = self.place.new
        n = len(self.place) - len(new)
        while n + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for a in range(0, len(new), 1 << 12):
            own = new[a : a + (1 << 12)]
            flat, starts = bucket_lists([w.strip(STRIP) for w in own])
            sizes = np.diff(np.append(starts, len(flat)))
            vec = np.add.reduceat(self.model.emb.take(flat, axis=0), starts, axis=0) / sizes[:, None].astype(np.float32)
            self.rows[n + a : n + a + len(own)] = vec @ self.model.conv
        return out

    def maxima(self, ids: np.ndarray) -> np.ndarray:
        best, f = np.zeros(len(WIDTHS) * self.filters, np.float32), self.filters  # max(0, .): rectified
        for a in range(0, len(ids), SPAN):
            for k, total in windows(self.rows.take(ids[a : a + SPAN + max(WIDTHS) - 1], axis=0), f):
                at = slice(k * f, (k + 1) * f)
                best[at] = np.maximum(best[at], total.max(0) + self.model.bias[at])
        return best

    def logits(self, texts: list[str | None]) -> np.ndarray:
        m, out = self.model, []
        for a in range(0, len(texts), self.together):
            out += [float(self.maxima(ids) @ m.out) + m.base for ids in self.numbers([words(t) for t in texts[a : a + self.together]])]
        return np.array(out)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        m = self.model
        if m.prior is not None:
            return np.full(len(texts), m.prior)
        z = self.logits(texts)
        if m.languages is not None and m.shifts:
            names, _ = m.languages.predict(texts)
            z = z + np.array([m.shifts.get(n, m.shifts[""]) for n in names])
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of stretches of an array, one after the other."""
    stops = np.cumsum(sizes)
    return np.repeat(starts - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)


class Texts:
    """Some texts as numbers of words, and the buckets of each word."""

    def __init__(self, docs: list[np.ndarray], names: list[str]):
        self.docs, self.names = docs, names
        self.every, self.begin = chunked_lists(names)
        self.length = np.diff(np.append(self.begin, len(self.every)))

    @staticmethod
    def numbered(texts: list[str | None]) -> tuple[list[np.ndarray], list[str]]:
        """Each text's words by number, and the words."""
        index: dict[str, int] = {}
        return [np.array([index.setdefault(w.strip(STRIP), len(index)) for w in words(t)], np.int32) for t in texts], list(index)

    def vectors(self, emb: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Embeddings of the words `used`; their buckets one after the other, where each word's begin and how many they are."""
        sizes = self.length[used]
        starts = np.cumsum(sizes) - sizes
        flat = self.every[gathered(self.begin[used], sizes)]
        vec = np.add.reduceat(emb.take(flat, axis=0), starts, axis=0) / sizes[:, None] if len(used) else np.zeros((0, DIM))
        return vec.astype(np.float32), flat, starts, sizes

    def logits(self, m: Model, at: np.ndarray) -> np.ndarray:
        """Of the texts `at`, by one model that is not joined."""
        out = np.zeros(len(self.docs))
        for batch in batches(self.docs, at, 16 * BATCH):
            used, inv = np.unique(np.concatenate([self.docs[i] for i in batch]), return_inverse=True)
            proj, n = self.vectors(m.emb, used)[0] @ m.conv, 0
            for i in batch:
                best, where = peaks(proj, inv[n : n + len(self.docs[i])])
                n += len(self.docs[i])
                out[i] = np.where(where >= 0, np.maximum(best + m.bias, 0), 0) @ m.out + m.base
        return out[at]

    def buckets(self, doc: np.ndarray) -> np.ndarray:
        own = np.unique(doc)
        return self.every[gathered(self.begin[own], self.length[own])]


def presence(own: Texts, y: np.ndarray, group: np.ndarray) -> dict[tuple[str, int], np.ndarray]:
    """For each group of texts (a language) and label in how many of its texts each bucket is."""
    out: dict[tuple[str, int], np.ndarray] = {}
    here = np.zeros(BUCKETS, bool)
    for doc, label, g in zip(own.docs, y.tolist(), group.tolist(), strict=True):
        here[own.buckets(doc)] = True
        at = np.flatnonzero(here)
        out.setdefault((g, label), np.zeros(BUCKETS, np.int64))[at] += 1
        here[at] = False
    return out


def contrast(seen: dict[tuple[str, int], np.ndarray], n: dict[tuple[str, int], int], size: int = BUCKETS) -> np.ndarray:
    """For each bucket how much surer it stands in texts of label 1 than of label 0, in the group of texts where that is
    most marked: deviations beyond 4, which chance explains for rare words, a tenth each and up to 2. n: texts.

    As the first dimension's start it lets maximum pooling look at telling words from the first step on.
    """
    best = np.zeros(size)
    for g in sorted({g for g, _ in n}):
        of = np.array([[n.get((g, 0), 0)], [n.get((g, 1), 0)]], float)
        if of.min() < 1:
            continue
        own = np.stack([seen.get((g, label), np.zeros(size)) for label in (0, 1)])
        rate, pooled = own / of, (own.sum(0) + 1) / (of.sum() + 2)
        z = (rate[1] - rate[0]) / np.sqrt(pooled * (1 - pooled) * (1 / of).sum())
        z = np.clip(np.sign(z) * np.maximum(np.abs(z) - 4, 0) / 10, -2, 2)
        best = np.where(np.abs(z) > np.abs(best), z, best)
    return best


@dataclass
class State:
    """A model in training with the sums of squares that Adagrad divides by: two columns of each bucket, and the rest."""

    emb: np.ndarray
    rest: np.ndarray

    @staticmethod
    def fresh(first: np.ndarray, seed: int) -> State:
        rng, filters = np.random.default_rng(seed), len(WIDTHS) * FILTERS
        emb = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        conv = rng.normal(0, 0.2, (DIM, OFFSETS * FILTERS))
        emb[:, 0], conv[0] = first, np.abs(conv[0]) + 0.5
        rest = np.concatenate([conv.ravel(), np.zeros(filters), rng.uniform(0.2, 0.5, filters), [-1.0]])
        return State(np.hstack([emb, np.full_like(emb, 1e-3)]), np.concatenate([rest, np.full(len(rest), 1e-3)]))

    def parts(self, half: int) -> list[np.ndarray]:
        """Views of conv, bias, out and base (half 0) or of their sums of squares (half 1)."""
        ends = np.cumsum([DIM * OFFSETS * FILTERS, len(WIDTHS) * FILTERS, len(WIDTHS) * FILTERS])
        conv, bias, out, base = np.split(np.split(self.rest, 2)[half], ends)
        return [conv.reshape(DIM, -1), bias, out, base]

    def model(self) -> Model:
        conv, bias, out, base = self.parts(0)
        return Model(np.ascontiguousarray(self.emb[:, :DIM]), *(x.astype(np.float32) for x in (conv, bias, out)), float(base[0]))

    def improve(self, own: Texts, y: np.ndarray, weight: np.ndarray, epochs: range, seed: list[int]) -> None:
        """Passes of Adagrad on the logistic loss; only the places of the maxima get gradients."""
        emb, g_emb = (np.ascontiguousarray(x) for x in np.hsplit(self.emb, 2))
        params, squares = self.parts(0), self.parts(1)
        for epoch in epochs:
            rate = RATE / (1 + 0.5 * epoch)
            for batch in batches(own.docs, np.random.default_rng([*seed, epoch]).permutation(len(own.docs))):
                used, inv = np.unique(np.concatenate([own.docs[i] for i in batch]), return_inverse=True)
                vec, flat, starts, sizes = own.vectors(emb, used)
                conv, bias, out, base = params
                proj = vec @ conv.astype(np.float32)
                d_proj, d_out, d_bias, d_base, at = np.zeros_like(proj), np.zeros_like(out), np.zeros_like(bias), np.zeros(1), 0
                for i in batch:
                    ids = inv[at : at + len(own.docs[i])]
                    at += len(ids)
                    best, where = peaks(proj, ids)
                    best = best + bias
                    on = (best > 0) & (where >= 0)
                    best = np.where(on, best, 0)
                    d = (1 / (1 + np.exp(-np.clip(best @ out + base[0], -50, 50))) - y[i]) * weight[i] / len(batch)
                    d_out += d * best
                    d_base += d
                    d_best = np.where(on, d * out, 0)
                    d_bias += d_best
                    if on.any():
                        word, col, of = HITS
                        good = on[of]
                        np.add.at(d_proj, (ids[where[of[good]] + word[good]], col[good]), d_best[of[good]])
                hit = np.flatnonzero(np.abs(d_proj).sum(1))
                d_vec = d_proj[hit] @ conv.T / sizes[hit, None]
                rows = flat[gathered(starts[hit], sizes[hit])]
                touched, to = np.unique(rows, return_inverse=True)
                d_emb = np.zeros((len(touched), DIM), np.float32)
                np.add.at(d_emb, to, np.repeat(d_vec, sizes[hit], axis=0).astype(np.float32))
                g_emb[touched] += d_emb**2
                emb[touched] -= rate * d_emb / np.sqrt(g_emb[touched])
                for p, g, d in zip(params, squares, (vec[hit].T @ d_proj[hit], d_bias, d_out, d_base), strict=True):
                    g += d**2
                    p -= rate * d / np.sqrt(g)
        self.emb = np.hstack([emb, g_emb])


def hits() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each offset of each filter: words after the window's first, column of the projection, the filter's number."""
    rows, col = [], 0
    for k, width in enumerate(WIDTHS):
        rows += [(j, (col + j) * FILTERS + f, k * FILTERS + f) for j in range(width) for f in range(FILTERS)]
        col += width
    return tuple(np.array(rows).T)


HITS = hits()


def batches(docs: list[np.ndarray], order: np.ndarray, texts: int = BATCH) -> Iterator[list[int]]:
    """Up to so many texts and, if there is more than one, BATCH_WORDS words."""
    out, n = [], 0
    for i in order.tolist():
        if out and (len(out) == texts or n + len(docs[i]) > BATCH_WORDS):
            yield out
            out, n = [], 0
        out.append(i)
        n += len(docs[i])
    if out:
        yield out


def peaks(proj: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's maximum over a text, without its bias, and the first word of the window; -1 where none fits."""
    best, where = np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS, -1)
    for a in range(0, len(ids), SPAN):
        for k, total in windows(proj.take(ids[a : a + SPAN + max(WIDTHS) - 1], axis=0), FILTERS):
            at, first = slice(k * FILTERS, (k + 1) * FILTERS), total.argmax(0)
            top = total[first, np.arange(FILTERS)]
            more = (where[at] < 0) | (top > best[at])
            best[at], where[at] = np.where(more, top, best[at]), np.where(more, first + a, where[at])
    return best, where


def passes(rows: float) -> int:
    return int(np.clip(round(STEPS / max(1, rows)), EPOCHS, 10 * EPOCHS))


def balance(y: np.ndarray, n: dict[int, int]) -> np.ndarray:
    """Weights by which both labels count the same in all n texts."""
    return np.where(y == 1, 0.5 * sum(n.values()) / max(1, n.get(1, 0)), 0.5 * sum(n.values()) / max(1, n.get(0, 0)))


def train(texts: list[str], y: np.ndarray, group: np.ndarray, seed: int = 5) -> Model:
    """A model of one shard."""
    own, n = Texts(*Texts.numbered(texts)), {}
    for key in zip(group.tolist(), y.tolist(), strict=True):
        n[key] = n.get(key, 0) + 1
    state = State.fresh(contrast(presence(own, y, group), n), seed)
    state.improve(own, y, balance(y, {v: int((y == v).sum()) for v in (0, 1)}), range(passes(len(texts))), [seed])
    return state.model()


def joined(models: list[Model]) -> Model:
    """One model whose logit is the mean of the models' logits."""
    k, w = len(models), len(WIDTHS)
    conv = np.zeros((k, DIM, OFFSETS, k, FILTERS), np.float32)
    for i, m in enumerate(models):
        conv[i, :, :, i] = m.conv.reshape(DIM, OFFSETS, FILTERS)
    bias, out = (np.stack([x.reshape(w, FILTERS) for x in xs], 1).ravel() for xs in ([m.bias for m in models], [m.out / k for m in models]))
    return Model(np.hstack([m.emb for m in models]), conv.reshape(k * DIM, -1), bias, out, sum(m.base for m in models) / k)


def best_shift(z: np.ndarray, y: np.ndarray) -> float:
    """What to add to the logits for the threshold of the best F1 to fall on THRESHOLD, midway between the two sides; equal
    logits stay together."""
    order = np.argsort(-z, kind="stable")
    z, hits = z[order], np.cumsum(y[order])
    ends = np.flatnonzero(np.append(z[1:] != z[:-1], True))
    f1 = 2 * hits[ends] / (ends + 1 + hits[-1])
    k = int(f1.argmax())
    high, low = z[ends[k]], z[ends[k + 1]] if k + 1 < len(ends) else z[ends[k]] - 2
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - (high + low) / 2)


@dataclass
class Folds:
    """What the models learn from: cells, a row for each model and shard with all its texts as numbers of words, read again in
    every pass without a shuffle. counts: rows and characters by fold, language and label. A cell's texts have an order of
    their own, so results do not depend on how the rows lay."""

    cells: DataFrame
    counts: dict[tuple[int, str, int], tuple[int, int]]
    folds: int = 1
    shards: int = 1
    seed: int = 5

    @staticmethod
    def of(rows: DataFrame) -> Folds:
        """As many folds as both labels are in, here and in the rest, and shards by rows and characters."""
        found = rows.groupBy("fold", "spoken", "y").agg(F.count("*"), F.sum(F.length("t"))).collect()  # a row for each language
        total = sum(r[3] for r in found)
        for folds in (FOLDS // 2 if total > FEW else FOLDS, 1):
            counts: dict[tuple[int, str, int], tuple[int, int]] = {}
            for fold, spoken, y, n, chars in found:
                a, b = counts.get((fold % folds, spoken, y), (0, 0))
                counts[fold % folds, spoken, y] = a + n, b + chars
            if len({(fold, y) for fold, _, y in counts}) == 2 * folds:
                break
        n, chars = (sum(x[i] for x in counts.values()) * max(1, folds - 1) / folds for i in (0, 1))
        shards = max(1, math.ceil(n / SHARD_ROWS), math.ceil(chars / SHARD_CHARS))
        fold, shard = F.col("fold") % folds, F.pmod(F.xxhash64(F.lit("shard"), "d", "t"), F.lit(shards)).cast("int")
        models = F.filter(F.array(*[F.lit(k) for k in range(folds)]), lambda k: (k != F.col("fold")) | F.lit(folds == 1))
        dealt = rows.withColumn("fold", fold).withColumn("model", F.explode(models)).withColumn("shard", shard)
        return Folds(staged(dealt.groupBy("model", "shard").applyInArrow(packed, CELL), "cells"), counts, folds, shards)

    def seen(self, model: int) -> dict[tuple[str, int], int]:
        """Rows that a model learns from, by language and label: those of the other folds."""
        out: dict[tuple[str, int], int] = {}
        for (fold, spoken, y), (n, _) in self.counts.items():
            if self.folds == 1 or fold != model:
                out[spoken, y] = out.get((spoken, y), 0) + n
        return out

    def starts(self) -> list[np.ndarray]:
        """Each model's contrast, from counts over all its rows."""
        of, size = [self.seen(k) for k in range(self.folds)], BUCKETS // BLOCKS

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for model, _, own, y, spoken, _ in unpacked(batches):
                found = presence(own, y, spoken).items()
                yield batch_of([(model, b, g, label, n[b * size : (b + 1) * size].tobytes()) for (g, label), n in found for b in range(BLOCKS)], COUNTED)

        def total(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            model, seen = key[0].as_py(), {}
            for g, label, n in zip(t["spoken"].to_pylist(), t["y"].to_pylist(), t["n"], strict=True):
                seen.setdefault((g, label), np.zeros(size, np.int64))
                seen[g, label] += np.frombuffer(n.as_py(), np.int64)
            return pa.Table.from_batches([batch_of([(model, key[1].as_py(), contrast(seen, of[model], size).tobytes())], SUMMED)])

        got = self.cells.mapInArrow(count, COUNTED).groupBy("model", "block").applyInArrow(total, SUMMED).collect()  # 8 bytes for each bucket and model
        blocks = {(r[0], r[1]): np.frombuffer(r[2]) for r in got}
        return [np.concatenate([blocks[k, b] for b in range(BLOCKS)]) for k in range(self.folds)]

    def improved(self, states: list[State], epochs: range) -> list[State]:
        """The models' states after passes over every shard, averaged."""
        held = self.cells.sparkSession.sparkContext.broadcast(states)  # 2 * BUCKETS x DIM floats a model
        n = [{v: sum(m for (_, label), m in self.seen(k).items() if label == v) for v in (0, 1)} for k in range(self.folds)]
        seed, size = self.seed, BUCKETS // BLOCKS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for model, shard, own, y, _, _ in unpacked(batches):
                before = held.value[model]
                state = State(before.emb, before.rest.copy())
                state.improve(own, y, balance(y, n[model]), epochs, [seed, model, shard])
                moved = (state.emb[:, DIM:] != before.emb[:, DIM:]).any(1)
                rows = [(model, b, shard, moved[b * size : (b + 1) * size].tobytes(), state.emb[b * size : (b + 1) * size].tobytes()) for b in range(BLOCKS)]
                yield batch_of([*rows, (model, BLOCKS, shard, b"", state.rest.tobytes())], MOVED)

        def mean(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            model, block = key[0].as_py(), key[1].as_py()
            t = t.sort_by("shard")
            if block == BLOCKS:
                out = sum(np.frombuffer(v.as_py()) for v in t["state"]) / t.num_rows
            else:
                old = held.value[model].emb[block * size : (block + 1) * size]
                total, times = np.zeros(old.shape), np.zeros((size, 1))
                for moved, v in zip(t["moved"], t["state"], strict=True):
                    at = np.frombuffer(moved.as_py(), bool)
                    total[at] += np.frombuffer(v.as_py(), np.float32).reshape(size, -1)[at]
                    times[at] += 1
                out = np.where(times > 0, total / np.maximum(times, 1), old).astype(np.float32)
            return pa.Table.from_batches([batch_of([(model, block, out.tobytes())], SUMMED)])

        moved = self.cells.mapInArrow(run, MOVED)
        got = {(r[0], r[1]): r[2] for r in moved.groupBy("model", "block").applyInArrow(mean, SUMMED).collect()}  # as large as held
        held.unpersist()
        emb = [np.concatenate([np.frombuffer(got[k, b], np.float32) for b in range(BLOCKS)]).reshape(BUCKETS, -1) for k in range(self.folds)]
        return [State(e, np.frombuffer(got[k, BLOCKS]).copy()) for k, e in enumerate(emb)]

    def train(self) -> list[Model]:
        states = [State.fresh(first, self.seed + k) for k, first in enumerate(self.starts())]
        n = passes(sum(self.seen(0).values()) / self.shards)
        for epochs in [range(n)] if self.shards == 1 else [range(k, k + 1) for k in range(n)]:
            states = self.improved(states, epochs)
        return [s.model() for s in states]

    def logits(self, models: list[Model]) -> DataFrame:
        """spoken, y and z of every row, by the model of its fold: from the cells of the model after that, which has not."""
        held, folds = self.cells.sparkSession.sparkContext.broadcast(models), self.folds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for model, _, own, y, spoken, fold in unpacked(batches):
                by = (model - 1) % folds
                at = np.flatnonzero(fold == by)
                z = own.logits(held.value[by], at)
                yield pa.RecordBatch.from_arrays([pa.array(spoken[at].tolist(), pa.string()), pa.array(y[at], pa.int32()), pa.array(z, pa.float64())], names=["spoken", "y", "z"])

        return self.cells.mapInArrow(run, "spoken string, y int, z double")

    def shifts(self, models: list[Model]) -> dict[str, float]:
        """best_shift of all rows (under "") and of the languages with five rows of either label. One task gets all rows of a
        language, twelve bytes each."""

        def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            y, z = (t[c].combine_chunks().to_numpy() for c in ("y", "z"))
            order = np.lexsort((y, z))
            return pa.table({"name": pa.array([key[0].as_py()], pa.string()), "shift": [best_shift(z[order], y[order])]})

        n = {}
        for (_, spoken, y), (rows, _) in self.counts.items():
            n[spoken, y] = n.get((spoken, y), 0) + rows
        names = sorted(g for g in {g for g, _ in n} if g and min(n.get((g, v), 0) for v in (0, 1)) >= 5)
        of = self.logits(models).withColumn("name", F.explode(F.array_distinct(F.array(F.lit(""), "spoken")))).where(F.col("name").isin("", *names))
        return {r[0]: r[1] for r in of.select("name", "y", "z").groupBy("name").applyInArrow(run, "name string, shift double").collect()}


COUNTED = "model int, block int, spoken string, y int, n binary"
SUMMED = "model int, block int, state binary"
MOVED = "model int, block int, shard int, moved binary, state binary"


CELL = "model int, shard int, names binary, words binary, sizes binary, y binary, fold binary, spoken binary"


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def packed(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """A cell: its texts by id, then text; small, as the JVM holds it whole."""
    rows = sorted(zip(*(t[c].to_pylist() for c in ("d", "t", "y", "fold", "spoken")), strict=True))
    docs, names = Texts.numbered([r[1] for r in rows])
    sizes, y, fold = np.array([len(d) for d in docs], np.int64), *(np.array([r[i] for r in rows], np.int32) for i in (2, 3))
    spoken = [r[4] for r in rows]
    del rows
    row = (key[0].as_py(), key[1].as_py(), *(zlib.compress(x, 1) for x in (json.dumps(names).encode(), np.concatenate(docs), sizes, y, fold, json.dumps(spoken).encode())))
    del docs, names
    give_back()
    return pa.Table.from_batches([batch_of([row], CELL)])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Texts, np.ndarray, np.ndarray, np.ndarray]]:
    """Model, shard, texts, labels, languages and folds of each cell."""
    give_back()
    for batch in sliced(batches, 1):
        model, shard, *rest = (c[0].as_py() for c in batch.columns)
        names, ids, sizes, y, fold, spoken = map(zlib.decompress, rest)
        docs = np.split(np.frombuffer(ids, np.int32), np.cumsum(np.frombuffer(sizes, np.int64))[:-1])
        texts = Texts(docs, json.loads(names))
        yield model, shard, texts, np.frombuffer(y, np.int32), np.array(json.loads(spoken), object), np.frombuffer(fold, np.int32)
        del batch, rest, names, ids, docs, texts


def labelled(docs: DataFrame, labels: DataFrame, languages: Filters | None, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """d, t, y, spoken, fold of every row of docs that labels has a label for; a null text is an empty one."""
    y = F.col(label_col).cast("int")
    known = labels.where(y.isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("d"), y.alias("y")).distinct()
    known = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    texts = docs.select(F.col(id_col).alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = texts.join(known, "d").select(F.col("d").cast("string").alias("d"), "t", "y").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            names = languages.predict(batch[1].to_pylist())[0] if languages is not None else [""] * batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], names=["d", "t", "y", "spoken"])

    told = rows.mapInArrow(run, "d string, t string, y int, spoken string")
    return told.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "t"), F.lit(FOLDS)).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, languages: Filters | None = None, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the texts of all rows of docs that labels has labels for."""
    rows = staged(labelled(docs, labels, languages, id_col, text_col, label_col), "labelled")
    dealt = Folds.of(rows)
    unstage(rows)
    kinds = {y for _, _, y in dealt.counts}
    if len(kinds) < 2:
        out = Model(*[np.zeros(1, np.float32)] * 4, 0.0, prior=float(1 in kinds))
    else:
        models = dealt.train()
        out = joined(models)
        out.shifts, out.languages = dealt.shifts(models), languages
    unstage(dealt.cells)
    return out


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for every row, one narrow pass over whole texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # FOLDS x BUCKETS x DIM floats at most, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        scorer = Scorer(held.value)
        for batch in sliced(batches):
            found = scorer.scores(batch[1].to_pylist())
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(found, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")
