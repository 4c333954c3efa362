"""Mixing sources to target weights by capped water-filling.

Targets share the whole of all sizes by weight; a source whose share exceeds max_epochs times its size is clamped there
and the excess is shared again by weight among the rest until no share is above its cap. In one pass: with sources in
order of cap / weight, exactly a prefix is clamped, and prefix sums tell which.

A document is taken floor(target / size) times, and once more if it comes, in the order of a seeded hash, before the
point where the source's fraction is reached. That point is found from word sums of 4,096 hash ranges for each source
and then inside the one range that holds it, so that no task sorts a source.

The hash is of source, id and text, and of a number where rows repeat all three, so that every row is drawn by itself.

Defined results: null text has size 0; a null source is a source of its own, last; repeated rows, rows of one id and
rows without id are drawn each for itself (which of equal rows is drawn does not matter, how many are does not hang on
partitions); empty documents are taken 0 words; an empty table gives no rows; further columns are kept by mixed_documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstream.llm.common import WORD, free_name, staged, text_or_empty

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Hash ranges for each source are 2^RANGES.
RANGES = 12
HASH_BITS = 60
#: Sources up to which their table is broadcast (a row takes less than 200 bytes); more are joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Keys of repeated rows (16 bytes each) up to which they are broadcast.
BROADCAST_KEYS = 100_000


def n_words(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def row_key(id_col: Column, source_col: Column, text_col: Column, seed: int = SEED) -> Column:
    """16 bytes for source, id and text of a row."""
    source = F.coalesce(F.concat(F.lit("s"), source_col.cast("string")), F.lit("n"))
    doc, text = (F.coalesce(c, F.lit("")) for c in (id_col.cast("string"), F.md5(text_col.cast("string"))))
    return F.unhex(F.md5(F.concat_ws("/", F.lit(str(seed)), source, doc, text)))


def draw(key: Column, twin: Column) -> Column:
    """The seeded place of a row in its source's order: 60 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lower(F.hex(key)), twin.cast("string"))), 1, HASH_BITS // 4), 16, 10).cast("long")


def with_draw(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with their place. Rows of equal key are numbered; only these are moved, and of one key a task gets no more
    than a partition of rows holds."""
    repeated = staged(rows.groupBy(key).count().where("count > 1").select(key), "repeated")
    n = repeated.count()
    if not n:
        return rows.withColumn(name, draw(F.col(key), F.lit(0)))
    small = F.broadcast(repeated) if n <= BROADCAST_KEYS else repeated
    part, at, start = (free_name(rows, c) for c in ("_mix_part", "_mix_at", "_mix_start"))
    again = rows.join(small, key, "left_semi").withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()})
    again = staged(again, "repeated-rows")
    along = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = again.groupBy(key, part).count().select(key, part, F.coalesce(F.sum("count").over(along), F.lit(0)).alias(start))
    inside = again.withColumn(at, F.row_number().over(Window.partitionBy(key, part).orderBy(at)) - 1)
    numbered = inside.join(starts, [key, part]).withColumn(name, draw(F.col(key), F.col(start) + F.col(at)))
    once = rows.join(small, key, "left_anti").withColumn(name, draw(F.col(key), F.lit(0)))
    return once.unionByName(numbered.drop(part, at, start))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target of a table with one row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    weighed = sizes.withColumn("w", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    dec = lambda c: F.col(c).cast("decimal(38,0)")
    filled = (
        weighed.withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("w_from", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("clamped", dec("cap") * dec("w_from") <= (dec("total") - dec("before")) * dec("w"))
        .withColumn("left", F.col("total") - F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)).over(every))
        .withColumn("w_left", F.sum(F.when(F.col("clamped"), 0).otherwise(F.col("w"))).over(every))
    )
    share = (F.col("w") * F.col("left")).cast("double") / F.col("w_left").cast("double")
    return filled.select("source", "source_size", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sized rows: doc_id, source, size, u; sources: source, source_size, target, whole, cut), both staged.

    A document is taken `whole` times, and once more if u <= cut.
    """
    slim = staged(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size"),
            row_key(F.col(id_col), F.col(source_col), F.col(text_col), seed).alias("key"),
        ),
        "sized",
        gather=True,
    )
    rows = staged(with_draw(slim, "key", "u").drop("key"), "drawn")
    ranges = staged(
        rows.groupBy("source", F.shiftright("u", HASH_BITS - RANGES).alias("range")).agg(F.sum("size").alias("words")), "ranges"
    )
    aims = staged(targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs), "targets")
    aims = aims.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    aims = aims.withColumn("want", F.col("target") - F.col("whole") * F.col("source_size"))
    small = aims.count() <= BROADCAST_SOURCES
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        _by_source(ranges.withColumn("below", F.coalesce(F.sum("words").over(along), F.lit(0))), aims, ["want"], small)
        .where("below <= want and want < below + words")
        .select("source", "range", "below", "want")
    )
    inside = (
        _by_source(rows, edge, ["range", "below", "want"], small)
        .where(F.shiftright("u", HASH_BITS - RANGES) == F.col("range"))
        .groupBy("source", "u").agg(F.sum("size").alias("words"), F.first("below").alias("below"), F.first("want").alias("want"))
    )
    inner = Window.partitionBy("source").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        inside.withColumn("past", F.col("below") + F.coalesce(F.sum("words").over(inner), F.lit(0)))
        .where(F.col("past") + F.col("words") / 2 <= F.col("want"))
        .groupBy("source").agg(F.max("u").alias("last"))
    )
    starts = edge.select("source", (F.shiftleft(F.col("range"), HASH_BITS - RANGES) - 1).alias("first"))
    sources = (
        aims.join(starts.withColumnRenamed("source", "s1"), aims.source.eqNullSafe(F.col("s1")), "left")
        .join(cut.withColumnRenamed("source", "s2"), aims.source.eqNullSafe(F.col("s2")), "left")
        .select("source", "source_size", "target", "whole", F.coalesce("last", "first", F.lit(-1)).alias("cut"))
    )
    return rows, staged(sources, "sources")


def _by_source(rows: DataFrame, per_source: DataFrame, cols: list[str], small: bool) -> DataFrame:
    """rows with the columns of their source; broadcast only where the number of sources was checked."""
    other = per_source.select(F.col("source").alias("_mix_source"), *cols)
    return rows.join(F.broadcast(other) if small else other, rows["source"].eqNullSafe(F.col("_mix_source"))).drop("_mix_source")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and repeats (times taken) for every row."""
    rows, sources = plan(docs, **options)
    small = sources.count() <= BROADCAST_SOURCES
    repeats = F.col("whole") + F.when(F.col("u") <= F.col("cut"), 1).otherwise(0)
    return (
        _by_source(rows, sources, ["source_size", "target", "whole", "cut"], small)
        .withColumn("repeats", repeats.cast("long"))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")
    )


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The mixture itself: every document as many times as it is taken, with the columns of docs."""
    _, sources = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    small = sources.count() <= BROADCAST_SOURCES
    key, u, of, whole, cut, n = (free_name(docs, c) for c in ("_mix_key", "_mix_u", "_mix_of", "_mix_whole", "_mix_cut", "_mix_n"))
    drawn = with_draw(docs.withColumn(key, row_key(docs[id_col], docs[source_col], docs[text_col], seed)), key, u)
    other = sources.select(F.col("source").alias(of), F.col("whole").alias(whole), F.col("cut").alias(cut))
    joined = drawn.join(F.broadcast(other) if small else other, drawn[source_col].cast("string").eqNullSafe(F.col(of)))
    repeats = F.col(whole) + F.when(F.col(u) <= F.col(cut), 1).otherwise(0)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.when(repeats > 0, F.sequence(F.lit(1).cast("long"), repeats))).alias(n)).drop(n)


ORACLE_SQL = r"""
with e as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5('17/' || coalesce('s' || source, 'n') || '/' || coalesce(cast(doc_id as varchar), '') || '/' || coalesce(md5(text), '')) as key
  from documents),
d as (select *, cast('0x' || substr(md5(key || '/' || (row_number() over (partition by key) - 1)), 1, 15) as bigint) as u from e),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select source, source_size, source_size * 3 as cap, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as w from s),
f as (select *, coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
        sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as w_from,
        sum(source_size) over () as total from w),
c as (select *, cap * w_from <= (total - before) * w as clamped from f),
l as (select *, total - sum(case when clamped then cap else 0 end) over () as left_over, sum(case when clamped then 0 else w end) over () as w_left from c),
t as (select source, source_size, case when clamped then cast(cap as double) else cast(w * left_over as double) / cast(w_left as double) end as target from l),
a as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from t),
g as (select source, u, sum(size) as words from d group by source, u),
p as (select source, u, words, coalesce(sum(words) over (partition by source order by u rows between unbounded preceding and 1 preceding), 0) as past from g),
k as (select p.source, p.u, p.past + p.words / 2 <= a.target - a.whole * a.source_size as more from p join a on p.source is not distinct from a.source)
select d.doc_id, d.size, a.source_size, a.target, d.size * (a.whole + case when k.more then 1 else 0 end) as taken,
       a.whole + case when k.more then 1 else 0 end as repeats
from d join a on d.source is not distinct from a.source
join k on d.source is not distinct from k.source and d.u = k.u
"""
