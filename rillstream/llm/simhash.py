"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a non-zero vector of radius + 1 bits; table v keeps the positions whose vector has an odd inner
product with v. Up to `radius` differing positions span too little to meet every v, so some table keeps none of them:
every pair within the radius collides there, for certain. Inside a table, members of shared buckets are linked through
the values one flip of a dropped bit away: two fingerprints that reach the same value differ in two bits at most, and
all pairs of the bucket within the radius reach one. That is exact, and linear in the members.

Fingerprints, not ids, are what is linked, so ids that repeat with other texts do not tie these texts together.

Defined results: a null or wordless text has fingerprint zero, linked like any other; fewer words than a shingle form
one shingle; repeated rows share a component; a repeated id has a component for each of its texts; a null id gets a
component only through others (null if there are none); an empty table gives no rows. Bits count as set if set in over
half of the shingles, repeats included.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from rillstream.llm.common import free_name, sliced, staged, unstage
from rillstream.llm.components import components, stars

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Near copies: words of a shingle, and MinHash bands of so many rows. A pair at a similarity of 0.8 is missed once in
#: 37,000 (0.5904 ** 20), one at 0.9 practically never.
COPY_SHINGLE = 5
BANDS = 20
ROWS = 4
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
#: Texts or band keys (8 to 24 bytes each) up to which they are broadcast.
BROADCAST_TEXTS = 200_000
#: Texts of a bucket that are compared with as many others at once.
PART = 256


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits."""
    top = 1 << (radius + 1)
    order = list(range(64))
    random.Random(seed).shuffle(order)
    own = {bit: 1 + k % (top - 1) for k, bit in enumerate(order)}
    return [sum(1 << bit for bit in range(64) if (own[bit] & v).bit_count() & 1) for v in range(1, top)]


def word_hashes(words: list[bytes], shingle: int, seed: int = SEED) -> list[int]:
    """A hash of each word shingle in order, repeats included; fewer words make one shingle, none make none."""
    from xxhash import xxh64_intdigest as digest

    joined = b" ".join(words)
    if len(words) <= shingle:
        return [digest(joined, seed)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    return [digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits


def majority(h: list[int]) -> int:
    """The bits set in over half of the hashes."""
    n, counts = len(h), np.zeros(64, np.int64)
    if not n:
        return 0
    for a, b in pairwise([*range(0, n, 200_000), n]):
        bits = np.unpackbits(np.array(h[a:b], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return majority(word_hashes(words_of(text), shingle, seed))


def shingle_set(words: list[bytes], seed: int = SEED) -> np.ndarray:
    """Distinct hashes of a text's five-word shingles, sorted; fewer words make one shingle, none make none.

    Five words in a row are two three-word shingles that share a word, so their hashes are made of those.
    """
    return copy_set(words, word_hashes(words, SHINGLE, seed), seed)


def copy_set(words: list[bytes], threes: list[int], seed: int = SEED) -> np.ndarray:
    from xxhash import xxh64_intdigest as digest

    if len(words) <= COPY_SHINGLE:
        return np.array([digest(b" ".join(words), seed)] if words else [], np.uint64)
    h = np.array(threes, np.uint64)
    own = (h[:-2] * MULTIPLY) ^ h[2:]
    own = (own ^ (own >> np.uint64(32))) * MULTIPLY
    return np.unique(own ^ (own >> np.uint64(29)))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """MinHash: for each of BANDS bands a hash of ROWS minima, told apart by band."""
    r = np.random.default_rng(SEED)
    one, two = r.integers(0, 1 << 32, (2, BANDS * ROWS), np.uint32) | np.uint32(1)
    x, y = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for a in range(0, len(shingles), 4096):
        low = np.minimum(low, (x[a : a + 4096, None] * one + y[a : a + 4096, None] * two).min(0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ low[k::ROWS]) * MULTIPLY
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def unit(text: Column) -> Column:
    """Stands for a text beside its fingerprint or its id: 64 bits."""
    return F.xxhash64(text)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, copies: bool = False) -> DataFrame:
    """doc_id, unit and fp (the fingerprint's 64 bits as a long), one narrow pass; copies adds the MinHash `keys`
    and the number of shingles, `n`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps, keys, sizes = [], [], []
            for t in batch[2]:
                ws = words_of(t.as_py())
                h = word_hashes(ws, shingle)
                fps.append(signed(majority(h)))
                if copies:
                    own = copy_set(ws, h) if shingle == SHINGLE else shingle_set(ws)
                    keys.append(band_keys(own) if len(own) else None)
                    sizes.append(len(own))
            more = [pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int32())] if copies else []
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(fps, pa.int64()), *more], names=["doc_id", "unit", "fp", "keys", "n"][: 3 + 2 * copies])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), unit(text).alias("unit"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, unit long, fp long" + (", keys array<long>, n int" if copies else ""))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between fingerprints that connect exactly what pairs within the radius connect.

    distinct: fp, each once. The meeting points fit a radius of 2 and no other.
    """
    if radius != RADIUS:
        raise ValueError("only a radius of 2 is supported")
    masks = covering_masks(radius)
    flips = [[0, *(1 << b for b in range(64) if not m >> b & 1)] for m in masks]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks])).alias("t", "key"))
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    members = keyed.join(shared, ["t", "key"], "left_semi")
    by_table = F.array(*[F.array(*[F.lit(signed(x)).cast("long") for x in one]) for one in flips])
    met = (
        members.select("t", "fp", F.explode(F.element_at(by_table, F.col("t") + 1)).alias("flip"))
        .select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
        .groupBy("t", "mid")
        .agg(F.collect_set("fp").alias("fps"))  # at most 65 fingerprints are one flip from a value
        .where(F.size("fps") > 1)
    )
    return met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b").distinct()


def grouped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, similarity: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, unit, fp; groups: fp, group, component_id), staged. A group is named by its smallest fingerprint,
    its component_id is the smallest doc_id in it.

    With a similarity, texts that share at least that part of their word shingles (near_copies) are linked too.
    """
    rows = staged(fingerprints(docs, id_col, text_col, shingle, similarity is not None), "fingerprints", gather=similarity is None)
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), radius), "simhash")
    if similarity is not None:
        roots = near_copies(docs, rows, roots, id_col, text_col, similarity)
    named = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("group"))
    named = staged(named, "named")
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    return rows, named.join(least, "group").select("fp", "group", "component_id")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) for every row; options as for grouped."""
    rows, groups = grouped(docs, **options)
    return rows.join(groups, "fp").select("doc_id", "fp", "component_id")


def alike_rows(sets: pa.ListArray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j whose sets have at least that Jaccard similarity."""
    sizes = np.diff(sets.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, col, n = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    shared = n[col] > 1
    row, col = row[shared], np.unique(col[shared], return_inverse=True)[1]
    order = col.argsort(kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((len(sizes), len(sizes)), np.float32)
    bounds = np.searchsorted(col, np.arange(0, (col[-1] if len(col) else 0) + 4096, 4096))
    for k, (a, b) in enumerate(pairwise(bounds.tolist())):
        has = np.zeros((len(sizes), 4096), np.float32)
        has[row[a:b], col[a:b] - 4096 * k] = 1
        both += has @ has.T
    both = both.astype(np.float64)
    i, j = np.nonzero(np.triu(both >= (sizes[:, None] + sizes[None] - both) * similarity, 1))
    return i, j


def near_copies(docs: DataFrame, rows: DataFrame, roots: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(node, root) of fingerprints as in roots, joined further where texts have a Jaccard similarity of at least that
    over their sets of five-word shingles.

    Distinct texts that share a MinHash band are compared exactly. First each with the one among those in its buckets
    that shares the most with others; what is then in one component needs no more comparisons, so only buckets of several
    components follow, in blocks. Pairs are never written out. A cluster around a common original costs about its own
    length; texts that share buckets without being alike cost the square of their bucket in comparisons, not in rows.
    """
    once = rows.where("keys is not null").groupBy("unit", "fp").agg(F.min("doc_id").alias("doc"), F.first("keys").alias("keys"), F.first("n").alias("n"))
    once = staged(once, "distinct-texts")
    keyed = once.select("unit", "fp", "n", F.explode("keys").alias("key"))
    shared = staged(keyed.groupBy("key").count().where("count > 1").select("key"), "shared")
    few = shared.count() <= BROADCAST_TEXTS
    members = staged(keyed.join(F.broadcast(shared) if few else shared, "key", "left_semi").distinct(), "buckets")
    unstage(shared)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            sets = [shingle_set(words_of(t.as_py())).view(np.int64) for t in batch[2]]
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(sets, pa.list_(pa.int64()))], names=["unit", "fp", "shingles"])

    def sets_of(ends: DataFrame) -> DataFrame:
        """unit, fp, shingles of the texts named, which are taken up once more, one row of each."""
        wanted = staged(once.join(ends.distinct(), ["unit", "fp"]).select(F.col("unit").alias("wu"), "fp", "doc"), "wanted", gather=True)
        few = wanted.count() <= BROADCAST_TEXTS
        texts = docs.select(F.col(id_col).cast("long").alias("of"), F.col(text_col).cast("string").alias("text")).withColumn("unit", unit(F.col("text")))
        texts = texts.join(F.broadcast(wanted) if few else wanted, (F.col("unit") == F.col("wu")) & F.col("of").eqNullSafe(F.col("doc")))
        return staged(texts.select("unit", "fp", "text").mapInArrow(shingles, "unit long, fp long, shingles array<long>"), "shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        """Edges between fingerprints of the pairs (ua, a, ub, b) that are alike."""
        pairs = staged(pairs, "pairs")
        sets = sets_of(pairs.select(F.col("ua").alias("unit"), F.col("a").alias("fp")).union(pairs.select("ub", "b")))
        one, two = (sets.select(F.col("unit").alias(f"u{n}"), F.col("fp").alias(n), F.col("shingles").alias(f"s{n}")) for n in ("a", "b"))
        both = F.size(F.array_intersect("sa", "sb"))
        alike = pairs.join(one, ["ua", "a"]).join(two, ["ub", "b"]).where(both >= (F.size("sa") + F.size("sb") - both) * similarity)
        found = staged(alike.select("a", "b").distinct(), "alike")
        unstage(sets)
        return found

    def connected(mixed: DataFrame) -> DataFrame:
        """Edges that connect the texts of each bucket (key, unit, fp, root) that are alike and of different components.

        Buckets of the same texts are looked at once. A bucket is dealt to parts of PART texts, and every two parts meet;
        what comes out is a forest, never the pairs.
        """
        same = mixed.groupBy("key").agg(F.sum(F.xxhash64("unit", "fp").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("size"))
        chosen = same.groupBy("sum", "size").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("size") / PART).cast("int").alias("parts"))
        dealt = staged(mixed.join(chosen, "key").withColumn("part", F.pmod(F.xxhash64("unit", "fp", F.lit("part")), F.col("parts")).cast("int")), "dealt")
        sets = sets_of(dealt.select("unit", "fp"))
        with_sets = dealt.join(sets, ["unit", "fp"]).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = with_sets.withColumns({"p": F.least("part", "with"), "q": F.greatest("part", "with")}).select("key", "p", "q", "part", "fp", "root", "shingles")

        def compare(key: tuple, t: pa.Table) -> pa.Table:
            part, fp, root = (t[c].to_numpy() for c in ("part", "fp", "root"))
            i, j = alike_rows(t["shingles"].combine_chunks(), similarity)
            ok = root[i] != root[j]
            if key[1] != key[2]:
                ok &= part[i] != part[j]
            a, b = stars(fp[i[ok]], fp[j[ok]])
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        found = staged(met.groupBy("key", "p", "q").applyInArrow(compare, "a long, b long").distinct(), "alike")
        for done in (sets, dealt):
            unstage(done)
        return found

    # The text that shares the most buckets with others is most like all of them: a cluster's copies meet there.
    fits = F.least("n", "m") >= F.greatest("n", "m") * similarity  # no pair whose sizes differ more can be alike
    shares = members.join(members.groupBy("key").count(), "key").groupBy("unit", "fp").agg(F.sum("count").alias("shares"))
    scored = staged(members.join(shares, ["unit", "fp"]), "scored")
    centres = scored.groupBy("key").agg(F.max(F.struct("shares", "unit", "fp", "n")).alias("centre"))
    low = scored.join(centres, "key").withColumn("m", F.col("centre.n")).where(fits).groupBy("unit", "fp").agg(F.max("centre").alias("centre")).where("fp <> centre.fp")
    near = verified(low.select(F.col("unit").alias("ua"), F.col("fp").alias("a"), F.col("centre.unit").alias("ub"), F.col("centre.fp").alias("b")))
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(known.union(near), "near")
    unstage(scored)
    rooted = staged(members.join(roots, F.col("fp") == F.col("node"), "left").select("key", "unit", "fp", F.coalesce("root", "fp").alias("root")), "rooted")
    unstage(members)
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    mixed = staged(rooted.join(several, "key").select("key", "unit", "fp", "root"), "mixed")
    unstage(rooted)
    more = connected(mixed)
    for done in (mixed, once):
        unstage(done)
    if more.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "nearer")


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns kept, that stand for their group: the one with the group's smallest id, once.

    Where that id repeats in its group the row with the smallest digest of its text stays; where it stands in several
    groups, one row of each stays. Rows without id can't be named by a group and all stay. Groups are decided on slim
    rows; texts are moved once at most, to be matched with what stays.
    """
    rows, groups = grouped(docs, id_col=id_col, text_col=text_col, **options)
    doc, text, n = (free_name(docs, c) for c in ("_doc", "_text", "_n"))
    each = rows.join(groups, "fp").where("doc_id = component_id").groupBy("doc_id", "group", "unit").count()
    best = each.groupBy("doc_id", "group").agg(F.min(F.struct("unit", "count")).alias("u"))
    best = staged(best.select(F.col("doc_id").alias(doc), F.col("u.unit").alias(text), F.col("u.count").alias(n)), "representatives")
    own = (docs[id_col].cast("long") == F.col(doc)) & (unit(docs[text_col].cast("string")) == F.col(text))
    kept = docs.join(best, own)
    if not best.where(F.col(n) > 1).isEmpty():  # rows that repeat id and text
        others = [docs[f"`{f.name}`"] for f in docs.schema.fields if f.name not in (id_col, text_col) and not isinstance(f.dataType, MapType)]
        order = Window.partitionBy(doc, text).orderBy(F.xxhash64(F.lit(SEED), *others))
        kept = kept.withColumn(n, F.row_number().over(order)).where(F.col(n) == 1)
    kept = kept.select(*[docs[f"`{c}`"] for c in docs.columns])
    return kept.unionByName(docs.where(docs[id_col].isNull()))


def fingerprint_text(col: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))
