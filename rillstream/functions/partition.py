"""Hive-style partition keys: encode, parse, filter. A key/value list is array<struct<key string, value string>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIRS = "array<struct<key:string,value:string>>"


def escape(col: Column) -> Column:
    """Query escaping: space as +, and of the punctuation only - _ . ~ stay."""
    return F.replace(F.replace(F.url_encode(col), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def encode_pair(key: Column, value: Column) -> Column:
    return F.concat(escape(key), F.lit("="), escape(value))


def decode_pair(segment: Column) -> Column:
    """struct<key, value>, or null where the segment does not hold exactly one = or is not well escaped."""
    parts = F.split(segment, "=")
    key, value = (F.try_url_decode(F.try_element_at(parts, F.lit(k))) for k in (1, 2))
    good = (F.size(parts) == 2) & ~segment.rlike(r"%(?![0-9A-Fa-f]{2})") & key.isNotNull() & value.isNotNull()
    return F.when(good, F.struct(key.alias("key"), value.alias("value")))


def pairs(**columns: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in columns.items()])


def partition_key(kvs: Column) -> Column:
    return F.array_join(F.transform(kvs, lambda kv: encode_pair(kv["key"], kv["value"])), "/")


def parse_path(path: Column) -> Column:
    """The valid pairs of a path in order; other segments are passed over."""
    return F.filter(F.transform(F.split(path, "/"), decode_pair), lambda kv: kv.isNotNull())


def as_map(kvs: Column) -> Column:
    """map<string,string>; of equal keys the last counts."""
    latest = lambda kv, k: ~F.exists(F.slice(kvs, k + 2, F.size(kvs)), lambda later: later["key"] == kv["key"])
    return F.map_from_entries(F.filter(kvs, latest))


def path_filter(path: Column, kvs: Column, mode: str = "substring") -> Column:
    """Whether all pairs stand in the path. `substring` looks for key=value/ anywhere, so that xkey=value/ counts too;
    `exact` compares whole segments that a slash follows."""
    if mode == "substring":
        return F.forall(kvs, lambda kv: F.contains(path, F.concat(encode_pair(kv["key"], kv["value"]), F.lit("/"))))
    if mode != "exact":
        raise ValueError(mode)
    segments = F.split(path, "/")
    closed = F.slice(segments, F.lit(1), F.size(segments) - 1)
    return F.forall(kvs, lambda kv: F.array_contains(closed, encode_pair(kv["key"], kv["value"])))


def partition_path(kvs: Column) -> Column:
    """The key with a slash after it; empty without pairs or where there is no list."""
    return F.when(F.coalesce(F.size(kvs), F.lit(0)) > 0, F.concat(partition_key(kvs), F.lit("/"))).otherwise("")


def prune(df: DataFrame, path_col: str, wanted: dict[str, str]) -> DataFrame:
    """Rows whose path holds all wanted pairs as whole segments."""
    return df.where(path_filter(F.col(path_col), pairs(**{k: F.lit(v) for k, v in wanted.items()}), "exact"))
