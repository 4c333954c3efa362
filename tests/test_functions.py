from __future__ import annotations

import math
import random
import uuid
from urllib.parse import quote_plus

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillstream.functions import backoff, classify, partition, tuples
from rillstream.functions.jsontext import json_line

CASES = {
    "1987-06-05": "DATE", "2031-12-00": "STRING", "2031-00-12": "STRING", "2031-12-41": "STRING", "1999-02-30": "DATE", "2044-11-30 23:59:59": "DATETIME", "2044-11-30T23:59:59": "DATETIME",
    "1987-06-05T04:03:02Z": "TIMESTAMP", "1987-06-05 04:03:02Z": "TIMESTAMP", "2011-05-06T07:08:09-03:30": "TIMESTAMP", "1900-02-29T12:00:00Z": "DATETIME", "1600-02-29T12:00:00Z": "TIMESTAMP",
    "2011-05-06T07:08:09 at noon": "DATETIME", "2011-05-06T07:60:09": "STRING", "2011-05-06T25:08:09": "STRING", "42": "INTEGER", "0": "INTEGER", "-300": "INTEGER", "+17": "INTEGER", "9223372036854775807": "INTEGER",
    "9223372036854775808": "FLOAT", "-9223372036854775808": "INTEGER", "-9223372036854775809": "FLOAT", "6.25": "FLOAT", "-2E-3": "FLOAT", ".75": "FLOAT", "8.": "FLOAT", "3e999": "STRING", "INF": "FLOAT", "-infinity": "FLOAT", "nan": "FLOAT",
    "0xAp3": "FLOAT", "12px": "STRING", " 8": "STRING", "T": "BOOLEAN", "f": "BOOLEAN", "False": "BOOLEAN", "no": "STRING", "": "STRING", "3_500.25": "FLOAT", "2011-05-06T07:08:09.5+12:45": "TIMESTAMP",
}


def test_classes_of_strings(spark):
    assert {s: classify.token_of(s) for s in CASES} == CASES
    rows = spark.createDataFrame([(s,) for s in CASES], "s string").select("s", classify.classify(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in rows} == CASES


def test_column_and_python_classes_agree(spark):
    r = random.Random(4)
    pieces = ["2020", "-", "01", "31", "T", " ", "12", ":", "30", "Z", "+01:00", ".", "5", "e", "1", "t", "x", "-0", "+1", "02", "29"]
    made = {"".join(r.choices(pieces, k=r.randint(1, 9))) for _ in range(3000)} | {f"20{r.randint(0, 99):02d}-{r.randint(0, 13):02d}-{r.randint(0, 32):02d}{r.choice(['', 'T10:00:00Z', ' 10:00:00'])}" for _ in range(500)}
    rows = spark.createDataFrame([(s,) for s in made], "s string").select("s", classify.classify(F.col("s")).alias("t")).collect()
    assert [(x.s, x.t, classify.token_of(x.s)) for x in rows if x.t != classify.token_of(x.s)] == []


KVS = [("country", "São Tomé"), ("a b", "x=y&z"), ("path", "up/../down?*~'\""), ("empty", "")]
KEY = "/".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in KVS)


def one_row(spark, *cols):
    return spark.createDataFrame([(KVS,)], f"kvs {partition.PAIRS}").select(*cols).first()


def test_partition_keys_round_trip(spark):
    assert one_row(spark, partition.partition_key(F.col("kvs")))[0] == KEY
    back = one_row(spark, partition.parse_path(F.lit(f"/bucket/{KEY}/x=1=2/bad=%G1/file")))[0]
    assert [tuple(p) for p in back] == KVS
    assert one_row(spark, partition.partition_path(F.array().cast(partition.PAIRS)))[0] == ""
    assert one_row(spark, partition.partition_path(F.lit(None).cast(partition.PAIRS)))[0] == ""
    assert one_row(spark, partition.escape(F.lit("a b*~")))[0] == "a+b%2A~"


@pytest.mark.parametrize("path,pairs,substring,exact", [
    ("k=v/", {"k": "v"}, True, True), ("k=v", {"k": "v"}, False, False), ("xk=v/f", {"k": "v"}, True, False), ("a=1/k=v/f", {"k": "v", "a": "1"}, True, True), ("a=1/f", {"k": "v", "a": "1"}, False, False), ("any", {}, True, True),
])
def test_path_filter(spark, path, pairs, substring, exact):
    kvs = partition.pairs(**{k: F.lit(v) for k, v in pairs.items()}) if pairs else F.array().cast(partition.PAIRS)
    assert tuple(one_row(spark, partition.path_filter(F.lit(path), kvs), partition.path_filter(F.lit(path), kvs, "exact"))) == (substring, exact)


def test_map_keeps_the_last(spark):
    kvs = partition.pairs(a=F.lit("1"))
    twice = F.concat(kvs, partition.pairs(b=F.lit("2")), partition.pairs(a=F.lit("3")))
    assert one_row(spark, partition.as_map(twice))[0] == {"b": "2", "a": "3"}
    df = spark.createDataFrame([("a=1/b=2/f",), ("a=2/b=2/f",)], "p string")
    assert partition.prune(df, "p", {"a": "1"}).count() == 1


plain = st.one_of(st.none(), st.booleans(), st.integers(-(2**70), 2**70), st.floats(allow_nan=False), st.text(max_size=6), st.binary(max_size=6), st.uuids())
deep = st.lists(st.one_of(plain, st.lists(plain, max_size=3).map(tuple)), max_size=4).map(tuple)


@settings(max_examples=300, deadline=None)
@given(deep)
def test_tuples_round_trip(values):
    assert tuples.unpack(tuples.pack(values)) == values


RANK = {type(None): 0, bytes: 1, str: 2, tuple: 3, int: 4, float: 6, bool: 7, uuid.UUID: 8}


def order_key(values):
    out = []
    for v in values:
        x = v
        if isinstance(v, tuple):
            x = order_key(v)
        elif isinstance(v, str):
            x = v.encode()
        elif isinstance(v, uuid.UUID):
            x = v.bytes
        elif v is None:
            x = 0
        elif isinstance(v, float):
            x = (v, math.copysign(1, v))
        out.append((RANK[type(v)], x))
    return out


@settings(max_examples=300, deadline=None)
@given(deep, deep)
def test_bytes_order_is_tuple_order(a, b):
    ka, kb = order_key(a), order_key(b)
    pa, pb = tuples.pack(a), tuples.pack(b)
    assert (pa < pb) == (ka < kb) and (pa == pb) == (ka == kb)


def test_tuple_bytes():
    assert tuples.pack((0, 1, -1, 255, 256)).hex() == "14" + "1501" + "13fe" + "15ff" + "160100"
    assert tuples.pack(("a\x00b", b"\x00")).hex() == "026100ff6200" + "0100ff00"
    assert tuples.pack((None, (None, "x"), True, False)).hex() == "00" + "0500ff02780000" + "2726"
    assert tuples.pack((2**64, -(2**64))).hex() == "1d09010000000000000000" + "0bf6feffffffffffffffff"
    assert tuples.pack((1.0, tuples.Float32(-1.0))).hex() == "21bff0000000000000" + "20407fffff"
    assert tuples.unpack(tuples.pack((tuples.Float32(-1.0),))) == (tuples.Float32(-1.0),)


def test_versionstamps():
    done, open_ = tuples.Versionstamp(b"0123456789", 7), tuples.incomplete_versionstamp(3)
    assert tuples.unpack(tuples.pack((done,))) == (done,)
    assert tuples.has_incomplete_versionstamp(((open_,), 1)) and not tuples.has_incomplete_versionstamp((done,))
    with pytest.raises(ValueError):
        tuples.has_incomplete_versionstamp((open_, (open_,)))
    with pytest.raises(ValueError):
        tuples.pack((open_,))


@pytest.mark.parametrize("raw", [b"\x02abc", b"\x15", b"\x21\x00", b"\x30\x00", b"\x33\x00", b"\x05\x14", b"\x99", b"\x20", b"\x1d"])
def test_broken_tuples_raise(raw):
    with pytest.raises(ValueError):
        tuples.unpack(raw)


def test_unknown_types_raise():
    with pytest.raises(TypeError):
        tuples.pack((object(),))
    with pytest.raises(ValueError):
        tuples.pack((1 << 2048,))


def test_keys_of_a_frame(spark):
    df = spark.createDataFrame([(1, "a", None, (2, "x")), (None, "b", 1.5, None)], "i int, s string, d double, n struct<a:int,b:string>")
    keys = [bytes(r.key) for r in tuples.with_key(df, df.columns).collect()]
    assert keys[0] == tuples.pack((1, "a", None, (2, "x"))) and keys[1] == tuples.pack((None, "b", 1.5, None))


def test_keys_of_nulls_and_taken_names(spark):
    df = spark.createDataFrame([(1, "a", b"old"), (None, None, None)], "n long, s string, Key binary")
    keyed = tuples.with_key(df, ["n", "s"], "key")
    assert keyed.columns == ["n", "s", "key"]
    rows = keyed.select(F.when(F.col("n") == 1, F.col("key")).alias("k")).select(tuples.unpacked(F.col("k"), "n long, s string").alias("t")).select("t.*").collect()
    assert sorted(map(tuple, rows), key=str) == [(1, "a"), (None, None)]


def test_versionstamp_columns(spark):
    rows = spark.createDataFrame([(b"0123456789", 7), (tuples.UNSET, 258)], "transaction binary, user int").select(F.struct("transaction", "user").alias("s"))
    got = rows.select(tuples.is_incomplete(F.col("s")).alias("open"), tuples.stamp_bytes(F.col("s")).alias("raw"), tuples.stamp_key(F.col("s")).alias("key")).collect()
    assert [r.open for r in got] == [False, True] and bytes(got[0].key) == tuples.pack((tuples.Versionstamp(b"0123456789", 7),)) and got[1].key is None
    assert bytes(got[1].raw) == tuples.Versionstamp(tuples.UNSET, 258).pack()
    assert rows.select(tuples.incomplete_stamp(F.lit(3)).alias("i")).first().i.user == 3
    assert [r[0] for r in rows.select(tuples.count_incomplete(F.col("s"), F.col("s"))).collect()] == [0, 2]
    with pytest.raises(Exception, match="more than one incomplete"):
        rows.select(tuples.has_incomplete(F.col("s"), F.col("s"))).collect()


def test_json_lines(spark):
    df = spark.createDataFrame([("<&>", None, (2, 1))], "b string, a int, c struct<z:int,y:int>")
    assert df.select(json_line(df)).first()[0] == '{"a":null,"b":"\\u003c\\u0026\\u003e","c":{"y":1,"z":2}}'
    assert df.select(json_line(df, html_escape=False)).first()[0].startswith('{"a":null,"b":"<&>"')


def test_backoff():
    b = backoff.Backoff(min_s=0.5, rng=random.Random(1))
    for attempt in range(8):
        seen = [b.delay(attempt) for _ in range(200)]
        assert min(seen) >= 0 and max(seen) <= 0.5 * (2 ** (attempt + 1) - 1) and all(d / 0.5 == int(d / 0.5) for d in seen)
    assert min(b.delay(0) for _ in range(50)) == 0 and backoff.Backoff().max_attempts == 100
    assert all(backoff.Backoff(min_s=2, at_least_min=True, max_s=9).delay(a) in (2, 4, 6, 8, 9) for a in range(6))
    slept, tries = [], []

    def work():
        tries.append(1)
        if len(tries) < 4:
            raise OSError
        return "done"

    assert b.with_max_attempts(3).with_min(0.1).with_scale(2).retry(work, sleep=slept.append) == "done" and len(slept) == 3
    tries.clear()
    with pytest.raises(OSError):
        b.with_max_attempts(5).with_start_attempt(4).retry(work, sleep=slept.append)
    assert len(tries) == 2
    tries.clear()
    with pytest.raises(OSError):
        b.with_max_attempts(1).retry(work, sleep=slept.append)


