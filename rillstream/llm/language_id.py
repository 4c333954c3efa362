"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the character n-grams of all languages: every slot is a bit mask of languages, and
the AND over an n-gram's slots is the set of all languages that contain it. A text's popcount for each language, less
the hits that the filter's own fill would give by chance, decides.

Fitting counts n-grams on the executors over a bounded sample of labelled texts (SAMPLE documents for each language,
drawn by hash) and keeps the most frequent GRAMS of each language, fewer where they would be more than MODEL_GRAMS in
all; the driver gets no more than these. Every language that a text is labelled with is learned: where there are more
than 64, a slot is several words wide.

Defined results: a null text or one without letters is `und` with score 0; ties go to the language first by code point;
letters of which no n-gram is known get the commonest language with score 0; without any labelled text all is `und`;
repeated rows get repeated results; further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstream.llm.common import sliced

UNKNOWN = "und"
ORDERS = (3, 4)
#: Documents for each language that the filters are fitted on, at about this number.
SAMPLE = 3000
#: N-grams kept for each language.
GRAMS = 40_000
#: An n-gram is not kept for a language that has it less often than this part of its frequency in another one: such
#: n-grams come from quoted foreign passages.
FOREIGN = 0.1
SLOT_BITS = 20
#: N-grams kept of all languages together, about.
MODEL_GRAMS = 6_000_000
#: Characters worked on at once.
CHUNK = 1 << 19
MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    out = np.zeros(0x110000, bool)
    for a in range(0x110000):
        if not 0xD800 <= a <= 0xDFFF:
            out[a] = chr(a).isalpha()
    return out


def letter_runs(text: str) -> np.ndarray:
    """Code points of the lower-cased text with one space for every run of anything but letters, and around it."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[c]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    c = np.where(is_letter, c, np.uint32(32))[keep]
    return np.concatenate([[np.uint32(32)], c, [np.uint32(32)]] if not len(c) or c[-1] != 32 else [[np.uint32(32)], c]).astype(np.uint64)


def grams(c: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that have letters inside (their ends may be spaces), and where they start."""
    n = len(c) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.ones(n, bool)
    for j in range(1, order - 1):
        inside &= c[j : j + n] != 32
    at = np.flatnonzero(inside)
    h = np.full(len(at), order, np.uint64)
    for j in range(order):
        h = (h ^ c[at + j]) * MIX
        h ^= h >> np.uint64(29)
    return h, at


def per_text(texts: list[str]) -> Iterator[tuple[int, int, list[np.ndarray], list[np.ndarray]]]:
    """In groups of about CHUNK characters: first and last text, and for each order hashes and where each text's begin."""
    first, size, runs = 0, 0, []
    for i, t in enumerate(texts):
        runs.append(letter_runs(t))
        size += len(runs[-1])
        if size >= CHUNK or i == len(texts) - 1:
            c = np.concatenate(runs)
            starts = np.cumsum([0, *map(len, runs)])
            hashes, bounds = [], []
            for order in ORDERS:
                h, at = grams(c, order)
                hashes.append(h)
                bounds.append(np.searchsorted(at, starts))
            yield first, i + 1, hashes, bounds
            first, size, runs = i + 1, 0, []


@dataclass
class Filters:
    """Bit l % width of slots[l // width, i] is set if an n-gram of language l was put into slot i; width: a word's bits."""

    languages: list[str]
    commonest: str
    slots: np.ndarray

    @staticmethod
    def of(by_language: dict[str, np.ndarray], commonest: str) -> Filters:
        names = sorted(by_language)
        kind = next((t for t in (np.uint8, np.uint16, np.uint32) if np.dtype(t).itemsize * 8 >= len(names)), np.uint64)
        width = np.dtype(kind).itemsize * 8
        slots = np.zeros((max(1, -(-len(names) // width)), 1 << SLOT_BITS), kind)
        for bit, name in enumerate(names):
            for i in Filters.places(by_language[name]):
                slots[bit // width, i] |= kind(1 << bit % width)
        return Filters(names, commonest, slots)

    @staticmethod
    def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), (h & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """The languages of each n-gram, a row for each word of the slots."""
        i, j = self.places(h)
        return self.slots[:, i] & self.slots[:, j]

    def bit(self, masks: np.ndarray, language: int) -> np.ndarray:
        width, kind = masks.dtype.itemsize * 8, masks.dtype.type
        return (masks[language // width] >> kind(language % width)) & kind(1)

    @functools.cached_property
    def by_chance(self) -> np.ndarray:
        """For each language the chance that an n-gram in no language's list seems to be in its list."""
        return np.array([self.bit(self.slots, b).mean() ** 2 for b in range(len(self.languages))])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        k, chance = len(self.languages), self.by_chance
        counts = np.zeros((len(texts), k))
        total = np.zeros(len(texts))
        for a, b, hashes, bounds in per_text([t or "" for t in texts]):
            for h, at in zip(hashes, bounds, strict=True):
                m = self.masks(h)
                total[a:b] += np.diff(at)
                for bit in range(k):
                    c = np.concatenate([[0], np.cumsum(self.bit(m, bit), dtype=np.int64)])
                    counts[a:b, bit] += np.diff(c[at])
        right = np.maximum(0, (counts - total[:, None] * chance) / (1 - np.minimum(chance, 0.999)))
        best = right.argmax(1)
        top = right[np.arange(len(texts)), best]
        names = [UNKNOWN if n == 0 else self.languages[i] if x > 0 else self.commonest for n, i, x in zip(total, best, top, strict=True)]
        return names, np.clip(np.divide(top, total, out=np.zeros(len(texts)), where=total > 0), 0, 1).tolist()


def unit_hash(col: Column) -> Column:
    """A number in [0, 1) from a value."""
    return F.pmod(F.xxhash64(F.lit("sample"), col), F.lit(1_000_000)) / F.lit(1_000_000.0)


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: float = SAMPLE, grams_kept: int = GRAMS) -> Filters:
    """Filters from rows whose text and language are not null; all of them, if sample is infinite."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    by_lang = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang")
    sizes = {r[0]: r[1] for r in by_lang.collect()}  # a row for each language
    if not sizes:
        return Filters.of({}, UNKNOWN)
    grams_kept = max(1, min(grams_kept, MODEL_GRAMS // len(sizes)))
    rates = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, sample / n))])
    rate = F.element_at(rates, F.col(lang_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            langs = np.array(batch[0].to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                texts = [batch[1][int(i)].as_py() for i in np.flatnonzero(langs == lang)]
                found = [h for _, _, hashes, _ in per_text(texts) for h in hashes]
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    sampled = rows.where(unit_hash(F.col(id_col)) < rate).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    counts = sampled.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= grams_kept).select("lang", "gram", "n").toArrow()
    coded = top["lang"].combine_chunks().dictionary_encode() if len(top) else pa.array([], pa.string()).dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    names, of = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    h, n = top["gram"].to_numpy().view(np.uint64), top["n"].to_numpy().astype(float)
    share = n / np.maximum(1.0, np.bincount(of, n, len(names)))[of] if len(n) else n
    _, inv = np.unique(h, return_inverse=True)
    most = np.zeros(inv.max() + 1 if len(inv) else 0)
    np.maximum.at(most, inv, share)
    own = share >= FOREIGN * most[inv]
    kept = {lang: np.zeros(0, np.uint64) for lang in sizes} | {lang: h[own & (of == k)] for k, lang in enumerate(names)}
    return Filters.of(kept, max(sorted(sizes), key=lambda k: sizes[k]))


def predict(docs: DataFrame, filters: Filters, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    held = docs.sparkSession.sparkContext.broadcast(filters)  # 2^SLOT_BITS slots, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            names, scores = held.value.predict(batch[1].to_pylist())
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, filters: Filters, *, text_col: str = "text", least: float = 0.15) -> DataFrame:
    """The rows of docs, all columns kept, whose text is in some learned language with at least this score.

    Where no language could be learned, all texts with letters stay.
    """
    if not filters.languages:
        return docs.where(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    held = docs.sparkSession.sparkContext.broadcast(filters)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            names, scores = held.value.predict(batch[at].to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
