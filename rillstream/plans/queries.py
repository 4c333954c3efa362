"""One query for each operator over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstream.functions import classify, partition, tuples
from rillstream.functions.jsontext import json_line, line_bytes
from rillstream.operators import liveness, order, ordered_map, ranks, rolling, taps
from rillstream.plans import inference
from rillstream.plans.scratch import scratch_path
from rillstream.sources import json_values, sinks
from rillstream.streaming import stateful

DAY_US = 86_400_000_000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def three_streams(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return [events.where(F.col("event_id") % 3 == k) for k in range(3)]


# --- combining, merging, deduplicating, sorting

STREAMS_SQL = "select event_id, user_id, value, cast(event_id % 3 as integer) as stream_idx from events"


@query(STREAMS_SQL)
def combine_concat(spark, sf_dir):
    return order.concat(three_streams(spark, sf_dir))


def in_order_of_rows(df: DataFrame, name: str = "rank") -> DataFrame:
    """df with the number of each row in the order the rows come in, which shows whether they are sorted."""
    return ranks.with_rank(df.withColumn("at", F.monotonically_increasing_id()), [F.col("at")], name).drop("at")


@query(f"select *, row_number() over (order by user_id, stream_idx desc, event_id) as rank from ({STREAMS_SQL})")
def merge_kway(spark, sf_dir):
    return in_order_of_rows(order.kway_merge(three_streams(spark, sf_dir), ["user_id"], "event_id"))


@query(f"select event_id, user_id, stream_idx, row_number() over (order by user_id, stream_idx desc, event_id) as rank from ({STREAMS_SQL})")
def merge_tie_rank(spark, sf_dir):
    return order.merge_ranked(three_streams(spark, sf_dir), ["user_id"], "event_id").select("event_id", "user_id", "stream_idx", "rank")


@query("select event_id, event_type from (select event_id, event_type, lag(event_type) over (order by event_id) as p from events) where event_type is null or p is null or event_type <> p")
def dedup_adjacent(spark, sf_dir):
    return order.dedup_adjacent(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_type"], "event_id")


@query("select user_id, event_id, event_type from (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) as p from events) where event_type is null or p is null or event_type <> p")
def dedup_adjacent_by_key(spark, sf_dir):
    return order.dedup_adjacent(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["event_type"], "event_id", ["user_id"])


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n = 1")
def sort_last_wins(spark, sf_dir):
    return order.sort_last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id")


def buffer_sql(size: int) -> str:
    """What a buffer of that many rows lets go: a row a step and, after a user's last row, what is left in it."""
    return f"""
with recursive e as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as rn, count(*) over (partition by user_id) as n from events),
b as (select user_id, rn, n, [{{'v': value, 'e': event_id}}] as held, cast(null as struct(v double, e bigint)) as gone from e where rn = 1
  union all
  select x.user_id, x.rn, x.n,
    list_append(list_filter(x.held, lambda h: h.v <> x.value and not (x.gone is not null and h.v = x.gone.v)), {{'v': x.value, 'e': x.event_id}}) as held, x.gone
  from (select e.*, b.held, case when len(b.held) >= {size} and not list_contains(list_transform(b.held, lambda h: h.v), e.value) then list_min(b.held) end as gone
        from b join e on e.user_id = b.user_id and e.rn = b.rn + 1) x),
o as (select user_id, rn, gone as r from b where gone is not null union all select user_id, rn + 1, unnest(held) as r from b where rn = n),
emitted as (select user_id, r.e as event_id, r.v as value, row_number() over (partition by user_id order by rn, r.v) - 1 as emitted from o)"""


@query(buffer_sql(16) + " select * from emitted")
def bounded_sort(spark, sf_dir):
    return order.bounded_sort(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["value"], "event_id", 16, ["user_id"])


RUNS_SQL = """
with recursive e as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as rn from events),
r as (select user_id, event_id, value, rn, 0 as cluster_id, [value] as tails from e where rn = 1
  union all
  select n.user_id, n.event_id, n.value, n.rn, n.idx - 1,
    case when n.idx > len(n.tails) then list_append(n.tails, n.value) else list_transform(n.tails, lambda x, i: case when i = n.idx then n.value else x end) end
  from (select e.*, r.tails, coalesce(list_position(list_transform(r.tails, lambda x: e.value >= x), true), len(r.tails) + 1) as idx
        from r join e on e.user_id = r.user_id and e.rn = r.rn + 1) n)
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.cluster_runs(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "value", "event_id", ["user_id"])


@query(RUNS_SQL + "select user_id, event_id, value, cast(cluster_id as integer) as cluster_id from r")
def cluster_runs(spark, sf_dir):
    return runs(spark, sf_dir)


@query(RUNS_SQL + "select user_id, cast(max(cluster_id) + 1 as bigint) as clusters, count(*) as n from r group by user_id")
def cluster_stats(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("user_id").agg((F.max("cluster_id") + 1).cast("bigint").alias("clusters"), F.count("*").alias("n"))


BUFFERED_SQL = buffer_sql(8) + ",\n" + re.sub(r"\be\b", "f", RUNS_SQL.split("with recursive ")[1]).replace("from events", "from emitted").replace("order by event_id", "order by emitted")


@query(BUFFERED_SQL + "select user_id, event_id, value, cast(cluster_id as integer) as cluster_id from r")
def cluster_runs_buffered(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return order.cluster_runs(events, "value", "event_id", ["user_id"], buffer_size=8)


@query()
def cluster_runs_cascaded(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return order.cluster_runs(events, "value", "event_id", ["user_id"], buffer_size=8, cascade=True)


GLOBAL_RUNS_SQL = RUNS_SQL.replace("partition by user_id ", "").replace("e.user_id = r.user_id and ", "")


@query(GLOBAL_RUNS_SQL + "select event_id, value, cast(cluster_id as integer) as cluster_id from r")
def global_runs(spark, sf_dir):
    """One sequence over all rows, as the runs of an external sort are filled."""
    return order.cluster_runs(table(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id", [])


@query(RUNS_SQL + "select event_id, row_number() over (order by value, cluster_id desc, event_id) as rank from r")
def external_sort_rank(spark, sf_dir):
    by = [F.col("value"), F.col("cluster_id").desc(), F.col("event_id")]
    return ranks.with_rank(runs(spark, sf_dir).select("event_id", "value", "cluster_id"), by).select("event_id", "rank")


@query(RUNS_SQL + "select event_id, value, row_number() over (order by value, cluster_id desc, event_id) as rank from r")
def external_sort(spark, sf_dir):
    return in_order_of_rows(order.external_sort(runs(spark, sf_dir), ["value"], "cluster_id", "event_id")).select("event_id", "value", "rank")


@query("select min(user_id) as min, max(user_id) as max, count(distinct user_id) as len from events")
def btree_min_max(spark, sf_dir):
    return order.OrderedSet(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id").bounds()


@query("select user_id, max(event_id) as event_id from events where user_id not in (select min(user_id) from events union all select max(user_id) from events) group by user_id")
def btree_delete_ends(spark, sf_dir):
    own = order.OrderedSet(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")
    return own.delete_min().delete_max().df


@query("select user_id, max(event_id) as event_id from events where user_id in (select c_custkey from customer) group by user_id")
def btree_get(spark, sf_dir):
    own = order.OrderedSet(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")
    return own.get(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")))


@query("select user_id, max(event_id) as event_id from (select user_id, event_id from events union all select c_custkey, -1 from customer) where user_id not in (select s_suppkey from supplier) group by user_id")
def btree_insert_delete(spark, sf_dir):
    own = order.OrderedSet(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id").clone()
    more = own.insert(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(-1).cast("long").alias("event_id")))
    return more.delete(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"))).df


@query("select count(*) as rows, count(*) as counted from events")
def count_tap(spark, sf_dir):
    tapped, seen = taps.counted(table(spark, sf_dir, "events"))
    n = tapped.agg(F.count("*").alias("rows")).collect()[0][0]
    return spark.createDataFrame([(n, seen.get["rows"])], "rows long, counted long")


@query("select event_id, event_type from events")
def log_tap(spark, sf_dir):
    return taps.logged(table(spark, sf_dir, "events").select("event_id", "event_type"), "event %s")


# --- partition keys

ESC = "replace(url_encode({}), '%20', '+')"


@query(f"select doc_id, 'source=' || {ESC.format('source')} || '/text=' || {ESC.format('text')} as partition_key, 'source=' || {ESC.format('source')} || '/text=' || {ESC.format('text')} || '/' as partition_path from documents")
def partition_encode(spark, sf_dir):
    kvs = partition.pairs(source=F.col("source"), text=F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", partition.partition_key(kvs).alias("partition_key"), partition.partition_path(kvs).alias("partition_path"))


@query("select doc_id, 3 as n, source, text from documents")
def partition_parse(spark, sf_dir):
    kvs = partition.pairs(source=F.col("source"), text=F.col("text"))
    path = F.concat(F.lit("base/no pair/a=b=c/x=%zz/"), partition.partition_path(kvs), F.lit("k=/file.json"))
    docs = table(spark, sf_dir, "documents").select("doc_id", partition.parse_path(path).alias("kvs"))
    return docs.select("doc_id", F.size("kvs").alias("n"), F.col("kvs")[0]["value"].alias("source"), F.col("kvs")[1]["value"].alias("text"))


@query("select event_id, event_type = 'click' as substring, event_type = 'click' and event_id % 2 = 0 as exact from events")
def partition_filter(spark, sf_dir):
    kvs = partition.pairs(type=F.col("event_type"))
    path = F.concat(F.when(F.col("event_id") % 2 == 0, "").otherwise("x"), partition.partition_path(kvs), F.lit("f.json"))
    wanted = partition.pairs(type=F.lit("click"))
    return table(spark, sf_dir, "events").select("event_id", partition.path_filter(path, wanted).alias("substring"), partition.path_filter(path, wanted, "exact").alias("exact"))


@query("select event_id, event_type as a, cast(user_id as varchar) as b, 2 as n from events")
def partition_as_map(spark, sf_dir):
    one = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    kvs = F.array(one("a", F.lit("first")), one("b", F.col("user_id")), one("a", F.col("event_type")))
    events = table(spark, sf_dir, "events").select("event_id", partition.as_map(kvs).alias("m"))
    return events.select("event_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.size("m").alias("n"))


# --- JSON lines in and out

@query("select n_nationkey, to_json({'n_name': n_name, 'n_nationkey': n_nationkey, 'n_regionkey': n_regionkey}) as line from nation")
def ndjson_lines(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return nation.select("n_nationkey", json_line(nation).alias("line"))


@query("select doc_id, text, lang from documents")
def json_read(spark, sf_dir):
    target = sinks.Target(scratch_path(spark, "lines"))
    sinks.write_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), target)
    return json_values.read_lines(spark, target.base, "doc_id long, text string, lang string")


@query("select n_nationkey, n_name from nation")
def json_concatenated(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    path = scratch_path(spark, "values")
    nation.select(json_line(nation).alias("v")).coalesce(1).agg(F.array_join(F.collect_list("v"), " ").alias("value")).write.text(path)
    values = json_values.read_values(spark, path).where("err is null")
    return values.select(F.from_json("value", "n_nationkey int, n_name string").alias("v")).select("v.*")


@query("select doc_id, text from documents")
def gzip_roundtrip(spark, sf_dir):
    target = sinks.Target(scratch_path(spark, "gz")).with_prefix("a").with_suffix("b").with_gzip()
    sinks.write_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), target, [F.col("doc_id")])
    return json_values.read_lines(spark, target.base, "doc_id long, text string")


@query("select event_id, event_type, value from events")
def write_partitioned_roundtrip(spark, sf_dir):
    target = sinks.Target(scratch_path(spark, "parts"))
    sinks.write_partitioned(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), target, ["event_type"], max_open=16)
    return sinks.read_back(spark, target, "event_id long, event_type string, value double")


@query("select doc_id, source, lang || ' / *' as lang, source as s, lang || ' / *' as l from documents")
def write_routed_roundtrip(spark, sf_dir):
    target = sinks.Target(scratch_path(spark, "routed"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat("lang", F.lit(" / *")).alias("lang"))
    sinks.write_routed(docs, target, ["source", "lang"], "doc_id", files=2)
    back = sinks.read_routed(spark, target, "doc_id long, source string, lang string")
    return back.select("doc_id", "source", "lang", F.col("partitions")[0]["value"].alias("s"), F.col("partitions")[1]["value"].alias("l"))


@query(RUNS_SQL + "select 'user_id=' || user_id || '/sorted_records_p' || lpad(cast(cluster_id as varchar), 4, '0') || '_s.json' as file, count(*) as rows from r group by all")
def write_clustered_roundtrip(spark, sf_dir):
    target = sinks.Target(scratch_path(spark, "clusters"))
    return sinks.write_clustered(runs(spark, sf_dir), target, ["user_id"], "cluster_id", "event_id")


@query("select event_id, event_type, value, event_type as kind from events")
def write_cached_roundtrip(spark, sf_dir):
    """Two files open at once: types come and go, and with them their files."""
    target = sinks.Target(scratch_path(spark, "cached"), gzip=True)
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    sinks.write_cached(events, target, F.concat(F.lit("kind="), F.col("event_type"), F.lit("/events_{suffix}.json")), max_open=2)
    back = sinks.read_routed(spark, target, "event_id long, event_type string, value double")
    return back.select("event_id", "event_type", "value", F.col("partitions")[0]["value"].alias("kind"))


@query("select event_type as path, event_id, part from (select *, 0 as part from events union all select *, 1 as part from events where event_id % 3 = 0)")
def memory_append(spark, sf_dir):
    sink, events = sinks.MemorySink(), table(spark, sf_dir, "events").select("event_type", "event_id")
    for rows in (events, events.where("event_id % 3 = 0")):
        sink.append(rows, "events")
    back = sink.read("events").select(F.from_json("value", "event_type string, event_id long").alias("v"), "part")
    return back.select(F.col("v.event_type").alias("path"), "v.event_id", "part")


ROLL_SQL = """
with recursive d as (select doc_id, strlen({size}) + 1 as b, row_number() over (order by doc_id) as rn from documents),
r as (select doc_id, rn, 0::bigint as file_idx, case when b > 20000 then 0 else b end as acc, case when b > 20000 then 1 else 0 end as nxt from d where rn = 1
  union all
  select d.doc_id, d.rn, r.nxt::bigint, case when r.acc + d.b > 20000 then 0 else r.acc + d.b end, case when r.acc + d.b > 20000 then r.nxt + 1 else r.nxt end
  from r join d on d.rn = r.rn + 1)
"""


@query(ROLL_SQL.format(size="text") + "select doc_id, file_idx from r")
def roll_by_size(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", line_bytes(F.col("text")).alias("b"))
    return rolling.roll_by_size(docs, "b", "doc_id", 20_000).select("doc_id", "file_idx")


ROLL_WITHIN_SQL = ROLL_SQL.format(size="text").replace("row_number() over (order by", "source, row_number() over (partition by source order by").replace("select doc_id, rn,", "select doc_id, source, rn,").replace("select d.doc_id, d.rn,", "select d.doc_id, d.source, d.rn,").replace("on d.rn", "on d.source = r.source and d.rn")


@query(ROLL_WITHIN_SQL + "select source, doc_id, file_idx from r")
def roll_by_size_within(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", line_bytes(F.col("text")).alias("b"))
    return rolling.roll_by_size(docs, "b", "doc_id", 20_000, ["source"]).select("source", "doc_id", "file_idx")


LINE_SQL = "to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source, 'text': text})"
for c in "&<>":  # six characters each where they are escaped
    LINE_SQL = f"replace({LINE_SQL}, '{c}', '......')"


@query(ROLL_SQL.format(size=LINE_SQL) + "select 'docs_' || lpad(cast(file_idx as varchar), 6, '0') || '.ndjson.gz' as file, count(*) as rows from r group by all")
def write_rolled_roundtrip(spark, sf_dir):
    target = sinks.Target(scratch_path(spark, "rolled"), gzip=True)
    return sinks.write_rolled(table(spark, sf_dir, "documents"), target, "doc_id", 20_000, "docs")


@query("select doc_id from (select doc_id, sum(strlen(text)) over (order by doc_id rows between unbounded preceding and 1 preceding) as before from documents) where coalesce(before, 0) < 100000")
def prefix_max_bytes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("b"))
    return rolling.prefix_max_bytes(docs, "b", "doc_id", 100_000).select("doc_id")


# --- schema inference

SAMPLES = ["1987-06-05", "2031-12-00", "2031-00-12", "1999-02-30", "2044-11-30 23:59:59", "1600-02-29T12:00:00Z", "1900-02-29T12:00:00Z", "2011-05-06T07:08:09-03:30", "2011-05-06T07:08:09 at noon", "2011-05-06T07:60:09",
           "42", "-300", "+17", "9223372036854775807", "-9223372036854775809", "6.25", "-2E-3", "3e999", "nan", "-inf", "12px", " 8", "T", "f", "True", "false", "1", "yes", "", "-"]
_SAMPLE_SQL = ", ".join(f"('{s}')" for s in SAMPLES)
CLASSIFY_SQL = f"""
with s as (select col0 as value from (values {_SAMPLE_SQL}) union all select cast(event_id as varchar) from events union all select cast(cast(ts as date) as varchar) from events
  union all select strftime(ts, '%Y-%m-%d %H:%M:%S') from events union all select strftime(ts, '%Y-%m-%dT%H:%M:%SZ') from events union all select event_type from events)
select value, case
  when regexp_full_match(value, '[0-9]{{4}}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])') then 'DATE'
  when regexp_full_match(value, '[0-9]{{4}}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[T ]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\\.[0-9]+)?(Z|[+-][0-9]{{2}}:[0-9]{{2}})') and try_cast(substr(value, 1, 10) as date) is not null then 'TIMESTAMP'
  when regexp_matches(value, '^[0-9]{{4}}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[T ]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]') then 'DATETIME'
  when regexp_full_match(value, '[+-]?[0-9]+') and try_cast(value as bigint) is not null then 'INTEGER'
  when regexp_full_match(value, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') and not isinf(coalesce(try_cast(value as double), 'inf'::double)) then 'FLOAT'
  when regexp_full_match(lower(value), '[+-]?inf(inity)?|nan') then 'FLOAT'
  when lower(value) in ('true', 'false', '1', '0', 't', 'f') then 'BOOLEAN' else 'STRING' end as token from s
"""


@query(CLASSIFY_SQL)
def classify_strings(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    fmt = lambda f: F.date_format("ts", f)
    cols = [F.col("event_id").cast("string"), fmt("yyyy-MM-dd"), fmt("yyyy-MM-dd HH:mm:ss"), fmt("yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("event_type")]
    values = spark.createDataFrame([(s,) for s in SAMPLES], "value string").union(events.select(F.explode(F.array(*cols))))
    return values.select("value", classify.classify(F.col("value")).alias("token"))


def schema_frame(spark: SparkSession, node: inference.Node) -> DataFrame:
    return spark.createDataFrame(inference.schema_rows(node), "path string, type string, mode string, conflict boolean")


@query("select 'k' as path, 'INTEGER' as type, 'NULLABLE' as mode, false as conflict")
def infer_schema_props(spark, sf_dir):
    return schema_frame(spark, inference.infer_schema(table(spark, sf_dir, "events"), "props", "event_id"))


MIXED = [
    '{"a_date": "2020-01-01", "counter": "1", "list": ["1", 2, "3.5"], "sub": {"a": "1", "b": 2}, "flips": 1, "gone": null}',
    '{"a_date": "2020-01-01T00:00:00Z", "counter": 1, "list": [], "sub": {"a": 1.5, "c": "x"}, "flips": {"x": 1}, "gone": null}',
    '{"a_date": "2020-01-01", "counter": [1], "list": [[4]], "sub": {"d": [{"e": true}]}, "flips": "text", "late": [null]}',
    '{"a_date": "2020-01-01", "counter": "x", "sub": {"d": [{"e": "t", "f": "z"}]}, "flips": {"y": "2020-01-01"}, "froze": "2020-01-01T00:00:00Z"}',
    '{"froze": 1, "sub": {"b": "word"}}',
]


@query("""select * from (values ('a_date', 'STRING', 'NULLABLE', false), ('counter', 'JSON', 'NULLABLE', true), ('flips', 'RECORD', 'NULLABLE', false), ('flips.x', 'INTEGER', 'NULLABLE', false),
  ('flips.y', 'DATE', 'NULLABLE', false), ('froze', 'JSON', 'NULLABLE', true), ('gone', '', '', false), ('late', '', 'REPEATED', false), ('list', 'FLOAT', 'REPEATED', false), ('sub', 'RECORD', 'NULLABLE', false),
  ('sub.a', 'FLOAT', 'NULLABLE', false), ('sub.b', 'STRING', 'NULLABLE', false), ('sub.c', 'STRING', 'NULLABLE', false), ('sub.d', 'RECORD', 'REPEATED', false), ('sub.d.e', 'BOOLEAN', 'NULLABLE', false),
  ('sub.d.f', 'STRING', 'NULLABLE', false)) t(path, type, mode, conflict)""")
def infer_schema_mixed(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(MIXED)), "pos long, line string").repartition(3)
    return schema_frame(spark, inference.infer_schema(rows, "line", "pos"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def infer_and_read(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "props")
    return inference.with_schema(events, "props", inference.infer_schema(events, "props", "event_id"))


_LATTICE_SQL = ", ".join(f"('{a}', '{b}', '{to or 'JSON'}', {str(to is None and a != b).lower()})" for (a, b), to in inference.RULES.items() if a != b)


@query(f"select * from (values {_LATTICE_SQL}) t(current, new, merged, conflict) union all select x, x, x, false from (values {', '.join(f'({chr(39)}{t}{chr(39)})' for t in inference.NEW_TYPES)}) s(x)")
def merge_lattice(spark, sf_dir):
    rows = [(a, b, *inference.merged(a, b)) for a in inference.TYPES for b in inference.NEW_TYPES]
    return spark.createDataFrame(rows, "current string, new string, merged string, conflict boolean")


# --- ordered maps

def doubled(v: Column) -> Column:
    return ordered_map.checked(v * 2, v % 50 == 49, F.concat(F.lit("bad "), v.cast("string")))


def added(v: Column) -> Column:
    return ordered_map.checked(v + 1, v % 64 == 0, "second")


def mapped(spark: SparkSession, sf_dir: str, stages: list, errors: str) -> DataFrame:
    return ordered_map.ordered_map(table(spark, sf_dir, "events"), "event_id", "event_id", stages, errors)


ONE_SQL = "select event_id as index, case when event_id % 50 <> 49 then event_id * 2 end as res, case when event_id % 50 = 49 then 'bad ' || event_id end as err from events"
TWO_SQL = f"select index, case when err is null and res % 64 <> 0 then res + 1 end as res, coalesce(err, case when res % 64 = 0 then 'second' end) as err from ({ONE_SQL})"


@query(ONE_SQL)
def ordered_ignore(spark, sf_dir):
    return mapped(spark, sf_dir, [doubled], ordered_map.IGNORE)


@query(f"select * from ({ONE_SQL}) where err is null")
def ordered_drop(spark, sf_dir):
    return mapped(spark, sf_dir, [doubled], ordered_map.DROP)


@query(ONE_SQL)
def ordered_python(spark, sf_dir):
    return mapped(spark, sf_dir, [ordered_map.python_stage(_double, "bigint")], ordered_map.IGNORE)


def _double(v: int) -> int:
    if v % 50 == 49:
        raise ValueError(f"bad {v}")
    return v * 2


@query(f"with o as ({ONE_SQL}) select * from o where index <= (select min(index) from o where err is not null)")
def ordered_abort(spark, sf_dir):
    return mapped(spark, sf_dir, [doubled], ordered_map.ABORT)


@query(TWO_SQL)
def ordered_stages(spark, sf_dir):
    return mapped(spark, sf_dir, [doubled, added], ordered_map.IGNORE)


@query(f"select * from ({TWO_SQL}) where err is null")
def ordered_stages_drop(spark, sf_dir):
    return mapped(spark, sf_dir, [doubled, added], ordered_map.DROP)


# --- tuples

@query("select event_id, row_number() over (order by event_type, value, event_id) as rank from events")
def tuple_pack_order(spark, sf_dir):
    keyed = tuples.with_key(table(spark, sf_dir, "events").select("event_type", "value", "event_id"), ["event_type", "value", "event_id"])
    return ranks.with_rank(keyed, [F.col("key")]).select("event_id", "rank")


@query("select p_partkey, p_size, p_brand, lower(hex(unhex('02') || encode(p_brand) || unhex('00') || case when p_size = 0 then unhex('14') else unhex('15' || lpad(hex(p_size), 2, '0')) end)) as key from part")
def tuple_pack_bytes(spark, sf_dir):
    keyed = tuples.with_key(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"), ["p_brand", "p_size"])
    return keyed.withColumn("key", F.lower(F.hex("key")))


@query("select event_id, event_type, value, user_id from events")
def tuple_roundtrip(spark, sf_dir):
    cols = ["event_id", "event_type", "value", "user_id"]
    keyed = tuples.with_key(table(spark, sf_dir, "events").select(*cols), cols)
    return keyed.select(tuples.unpacked(F.col("key"), "event_id long, event_type string, value double, user_id long").alias("t")).select("t.*")


@query("""with s as (select event_id, user_id % 5 as user, case when event_id % 4 = 0 then unhex('FFFFFFFFFFFFFFFFFFFF') else unhex(lpad(hex(event_id), 20, '0')) end as tx from events)
select event_id, event_id % 4 = 0 as incomplete, lower(hex(tx)) || lpad(lower(hex(user)), 4, '0') as stamp, case when event_id % 4 <> 0 then '33' || lower(hex(tx)) || lpad(lower(hex(user)), 4, '0') end as key from s""")
def versionstamps(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    user = (F.col("user_id") % 5).cast("int")
    known = F.struct(F.unhex(F.lpad(F.hex("event_id"), 20, "0")).alias("transaction"), user.alias("user"))
    rows = events.select("event_id", F.when(F.col("event_id") % 4 == 0, tuples.incomplete_stamp(user)).otherwise(known).alias("s"))
    return rows.select("event_id", tuples.has_incomplete(F.col("s")).alias("incomplete"), F.lower(F.hex(tuples.stamp_bytes(F.col("s")))).alias("stamp"), F.lower(F.hex(tuples.stamp_key(F.col("s")))).alias("key"))


# --- liveness

@query(f"""with n as (select max(ts) as last, max(ts) - interval 2 day as shut from events),
g as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as p from events)
select user_id, cast(sum(case when p is null or epoch_us(ts) - epoch_us(p) >= {DAY_US} or (p <= shut and ts > shut) then 1 else 0 end) as bigint) as created, max(ts) as last_ping,
  epoch_us(any_value(last)) - epoch_us(max(ts)) < {DAY_US} and max(ts) > any_value(shut) as alive from g, n group by user_id""")
def liveness_index(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = events.agg(F.max("ts")).first()[0]
    return liveness.liveness_index(events, ["user_id"], "ts", DAY_US, F.lit(now), F.lit(now) - F.expr("interval 2 days"))


@query(f"select event_id, user_id, cast(sum(case when gap >= {DAY_US} then 1 else 0 end) over (partition by user_id order by ts, event_id) as bigint) as session_id from (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap from events)")
def idle_sessions(spark, sf_dir):
    return liveness.idle_sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", DAY_US, "event_id").select("event_id", "user_id", "session_id")


@query(f"with n as (select max(ts) as now from events) select user_id, max(ts) as last_ping, greatest({DAY_US} - (epoch_us(any_value(now)) - epoch_us(max(ts))), 0) as remaining_us, {DAY_US} - (epoch_us(any_value(now)) - epoch_us(max(ts))) <= 0 as idle from events, n group by user_id")
def idle_alarms(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now")).first()[0]
    return liveness.idle_alarms(events, ["user_id"], "ts", DAY_US, F.lit(now))


# --- generated records

@query("select range - 1 as pos, range as val from range(1, 1001)")
def source_ascending(spark, sf_dir):
    return json_values.ascending(spark, 1000)


@query("select range as pos, 1000 - range as val from range(1001)")
def source_descending(spark, sf_dir):
    return json_values.descending(spark, 1000)


@query("select range as pos, cast('0x' || substr(md5('1/' || range), 1, 15) as bigint) % 20000 as val from range(1000)")
def source_random(spark, sf_dir):
    return json_values.random_values(spark, 20_000, 1000)


_UNIFORM = "((cast('0x' || substr(md5('1/{}/' || range), 1, 15) as bigint) % 1073741824 + 1) / 1073741825.0::double)"


@query(f"""select range as pos, printf('%05d', cast(trunc(sqrt(-2 * ln({_UNIFORM.format(1)})) * cos(2 * pi() * {_UNIFORM.format(2)}) * sqrt(30.0::double) + 15) as integer)) as id,
  make_timestamp(1000000 * (946688461 + 3600 * cast(floor({_UNIFORM.format(3)} * 48) as bigint))) as event_time from range(1000)""")
def source_random_events(spark, sf_dir):
    return json_values.random_events(spark, 30, 2, 1000)


@query("select range as pos, range * range as val from range(100)")
def source_pipe(spark, sf_dir):
    return json_values.pipe(spark, lambda push: [push((k * k,)) for k in range(100)], "val long")


@query("select range as pos, range * range as val from range(2500)")
def source_record_pipe(spark, sf_dir):
    """Read as a stream while it is written."""
    from rillstream.sources.pipe import RecordPipe

    pipe = RecordPipe(spark, "val long", chunk=1000, room=2000)
    for k in range(2500):
        pipe.push(k * k)
    pipe.stop()
    return stateful.run_available(pipe.stream(), "record-pipe")


# --- streams

def event_stream(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").select(*cols)  # a pattern may name a file


@query(ORACLES["cluster_runs"])
def stream_clusters(spark, sf_dir):
    found = stateful.cluster_runs_stream(event_stream(spark, sf_dir, "user_id", "event_id", "value"), ["user_id"], "value", "event_id")
    return stateful.run_available(found, "stream-clusters")


MARK_SQL = "epoch_ms((select max(ts) from events)) - 3600000"  # the watermark after all rows, in milliseconds


@query(f"select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) - 1 as emitted from events where epoch_us(ts) <= ({MARK_SQL}) * 1000")
def stream_ordered_emit(spark, sf_dir):
    events = event_stream(spark, sf_dir, "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 hour")
    return stateful.run_available(stateful.ordered_stream(events, ["user_id"], "ts", "event_id"), "stream-ordered")


@query(f"""with g as (select user_id, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) >= {DAY_US} then 1 else 0 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts) as n from g)
select user_id, min(ts) as first_ping, max(ts) as last_ping, count(*) as pings from s group by user_id, n having epoch_us(max(ts)) + {DAY_US} - 1 <= ({MARK_SQL}) * 1000""")
def stream_sessions(spark, sf_dir):
    events = event_stream(spark, sf_dir, "user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 hour")
    return stateful.run_available(stateful.sessions_stream(events, ["user_id"], "ts", "1 day"), "stream-sessions")


@query("select user_id, strftime(ts, '%Y-%m-%d') as day, cast(cluster_id as integer) as cluster_id, count(*) as rows from (" + RUNS_SQL.replace("partition by user_id order by event_id", "partition by user_id, cast(ts as date) order by event_id").replace("select user_id, event_id, value, row_number()", "select user_id, ts, event_id, value, row_number()").replace("select user_id, event_id, value, rn, 0 as", "select user_id, ts, event_id, value, rn, 0 as").replace("select n.user_id, n.event_id", "select n.user_id, n.ts, n.event_id").replace("e.rn = r.rn + 1", "cast(e.ts as date) = cast(r.ts as date) and e.rn = r.rn + 1") + "select * from r) group by all")
def flagship(spark, sf_dir):
    """Out-of-order events to sorted runs for each user and day."""
    events = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "value")
    found = order.cluster_runs(events, "value", "event_id", ["user_id", "day"])
    return found.groupBy("user_id", "day", "cluster_id").agg(F.count("*").alias("rows"))



@query("select count(*) as rows, count(*) as counted, true as closed_once from events")
def stream_counted(spark, sf_dir):
    """A stream whose rows are counted as it runs, with hooks around its end."""
    from rillstream.streaming.hooks import HookedStream

    count, closed = taps.RunningCount(spark), []
    path = scratch_path(spark, "stream-counted")
    try:
        query = count.tapped(event_stream(spark, sf_dir, "event_id")).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").start()
        stream = HookedStream(query).before_close(lambda: closed.append("before")).after_close(closed.append)
        stream.close()
        n = spark.read.schema("event_id long").parquet(f"{path}/out").count()
        for _ in range(100):  # progress is told a moment later
            if count.rows >= n:
                break
            time.sleep(0.1)
    finally:
        count.close()
    return spark.createDataFrame([(n, count.rows, closed == ["before", None])], "rows long, counted long, closed_once boolean")
