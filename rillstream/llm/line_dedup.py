"""Line dedup by site-relative frequency, with DataFrame functions only.

A line that stands on more than `ratio` of its site's pages (and on min_pages at least) is boilerplate of that site and
is taken out of all of the site's pages. Lines are compared trimmed of spaces, by their md5; blank lines are kept.

min_pages says from how many pages on a line counts as shared at all: without it every line of a site with fewer than
1 / ratio pages would go, for one page of it is more than the ratio.

Only a digest for each distinct line of a page is shuffled, counted on the map side first; texts stay where they are. A
site has at most (lines of its average page / ratio) such lines, so they travel as one array for each site: broadcast
where they were counted to be few, else joined by site, pages of large sites being dealt to several copies of the array.

Defined results: a null text stays null; a null site is a site of its own; repeated rows count as pages each; a text of
which every line goes is empty; an empty table gives no rows; all other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstream.llm.common import free_name, staged

RATIO = 0.05
MIN_PAGES = 5
#: Boilerplate lines up to which they are broadcast (16 bytes each and the site's name).
BROADCAST_LINES = 100_000
#: Pages of a site for each copy of its array, where arrays are joined by shuffle.
SALT_PAGES = 100_000


def site_of(url: Column) -> Column:
    """The host of a URL in lower case without port; null if there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def digest(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line)))


def boilerplate(docs: DataFrame, site_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """(site and the digest of each line that is boilerplate there, staged; at, of: pages of each site)."""
    own = F.array_distinct(F.transform(F.filter(lines(F.col(text_col)), lambda x: F.trim(x) != ""), digest))
    page = F.array(F.lit(None).cast("binary"))  # stands for the page itself
    counts = staged(
        docs.select(F.col(site_col).cast("string").alias("site"), F.explode(F.concat(F.coalesce(own, F.expr("array()").cast("array<binary>")), page)).alias("line"))
        .groupBy("site", "line")
        .agg(F.count("*").alias("pages"))
        .where(f"line is null or pages >= {int(min_pages)}"),
        "line-counts",
    )
    totals = counts.where("line is null").select(F.col("site").alias("at"), F.col("pages").alias("of"))
    small = F.broadcast(totals) if totals.count() <= BROADCAST_LINES else totals
    found = counts.where("line is not null").join(small, F.col("site").eqNullSafe(F.col("at")))
    return staged(found.where(F.col("pages") > F.col("of") * F.lit(ratio)).select("site", "line"), "boilerplate"), totals


def drop_boilerplate(docs: DataFrame, *, site_col: str, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, count_col: str | None = None) -> DataFrame:
    """docs with text_col cleaned; count_col, if named, tells how many lines went."""
    bad, totals = boilerplate(docs, site_col, text_col, ratio, min_pages)
    at, gone, text, salt, big, copies = (free_name(docs, c) for c in ("_line_site", "_line_gone", "_line_text", "_line_salt", "_line_big", "_line_copies"))
    arrays = bad.groupBy(F.col("site").alias(at)).agg(F.collect_set("line").alias(gone))
    same = docs[site_col].cast("string").eqNullSafe(F.col(at))
    if bad.count() <= BROADCAST_LINES:
        joined = docs.join(F.broadcast(arrays), same, "left")
    else:
        # No more than one large site for SALT_PAGES pages of the corpus.
        large = staged(totals.where(F.col("of") > SALT_PAGES).select(F.col("at").alias(big), F.ceil(F.col("of") / SALT_PAGES).cast("int").alias(copies)), "large-sites")
        wide = F.broadcast(large) if large.count() <= BROADCAST_LINES else large
        copied = arrays.join(wide, F.col(at).eqNullSafe(F.col(big)), "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(copies, F.lit(1)) - 1)))
        dealt = docs.join(wide, docs[site_col].cast("string").eqNullSafe(F.col(big)), "left")
        dealt = dealt.withColumn(salt, F.coalesce(F.pmod(F.xxhash64(text_col), F.col(copies)).cast("int"), F.lit(0))).drop(big, copies)
        joined = dealt.join(copied.select(at, gone, F.col(salt).alias(copies)), same & (F.col(salt) == F.col(copies)), "left")
    kept = F.filter(lines(docs[text_col]), lambda x: ~F.array_contains(F.col(gone), digest(x)))
    joined = joined.withColumn(text, F.when(F.col(gone).isNull(), docs[text_col]).otherwise(F.array_join(kept, "\n")))
    cols = [F.col(text).alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns]
    if count_col is None:
        return joined.select(*cols)
    n = lambda t: F.coalesce(F.size(F.filter(lines(t), lambda x: F.trim(x) != "")), F.lit(0))
    dropped = F.when(docs[text_col].isNull(), 0).otherwise(n(docs[text_col]) - n(F.col(text)))
    return joined.select(*cols, dropped.cast("long").alias(count_col))


ORACLE_SQL = r"""
with l as (select source, doc_id, i as pos, string_split(text, chr(10))[i] as line
           from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) as r(i)),
n as (select source, count(*) as pages from documents group by source),
b as (select l.source, trim(line, ' ') as line from (select distinct source, doc_id, trim(line, ' ') as line from l) l
      join n on l.source is not distinct from n.source where trim(line, ' ') <> ''
      group by l.source, trim(line, ' '), n.pages having count(*) >= 5 and count(*) > n.pages * 0.05::double),
k as (select l.doc_id, string_agg(l.line, chr(10) order by l.pos) filter (where b.line is null) as text,
             count(*) filter (where b.line is not null) as lines_dropped
      from l left join b on l.source is not distinct from b.source and trim(l.line, ' ') = b.line group by l.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text, coalesce(k.lines_dropped, 0) as lines_dropped
from documents d left join k on d.doc_id = k.doc_id
"""
