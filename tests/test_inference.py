from __future__ import annotations

import json
import random

import pytest

from rillstream.plans import inference as inf
from rillstream.plans.queries import MIXED


def infer(spark, rows, parts=3):
    lines = [(i, json.dumps(r)) for i, r in enumerate(rows)]
    df = spark.createDataFrame(lines, "pos long, line string").repartition(parts)
    return inf.infer_schema(df, "line", "pos")


def shape(node):
    return sorted(inf.schema_rows(node))


def parsed(rows):
    return [inf.parse(json.dumps(r)) for r in rows]


KNOWN = [
    ([{"when": "1987-06-05"}, {"when": "1987-06-06", "size": 4}, {"size": "5", "share": ".5"}], {"when": "DATE", "size": "INTEGER", "share": "FLOAT"}),
    ([{"at": "2011-05-06T07:08:09Z"}, {"at": "1987-06-05"}, {"open": "T"}, {"open": "12"}], {"at": "STRING", "open": "JSON"}),
    ([{"codes": ["7"]}, {"codes": [True]}, {"marks": [1, "2.5"]}], {"codes": "JSON", "marks": "FLOAT"}),
    ([{"box": {"w": 3}}, {"box": {"w": "3.5", "lid": {"on": "f"}}}, {"box": {"h": "tall"}}], {"box": "RECORD", "box.w": "FLOAT", "box.lid": "RECORD", "box.lid.on": "BOOLEAN", "box.h": "STRING"}),
    ([{"n": "word"}, {"n": 12}, {"m": 12}, {"m": "word"}], {"n": "JSON", "m": "STRING"}),
]


@pytest.mark.parametrize("rows,want", KNOWN)
def test_known_schemas(spark, rows, want):
    assert {p: t for p, t, _, _ in shape(infer(spark, rows))} == want
    assert shape(infer(spark, rows)) == shape(inf.fold(parsed(rows)))


@pytest.mark.parametrize("a,b,ab,ba", [
    ("INTEGER", "STRING", "STRING", "JSON"), ("BIGNUMERIC", "BOOLEAN", "BIGNUMERIC", "JSON"), ("INTEGER", "FLOAT", "FLOAT", "FLOAT"), ("DATE", "TIMESTAMP", "STRING", "STRING"),
    ("BOOLEAN", "INTEGER", "JSON", "JSON"), ("STRING", "DATE", "STRING", "STRING"), ("FLOAT", "BOOLEAN", "JSON", "JSON"),
])
def test_merging_depends_on_order(a, b, ab, ba):
    assert inf.merged(a, b) == (ab, False) and inf.merged(b, a) == (ba, False)


def test_contradictions_freeze():
    assert inf.merged("TIMESTAMP", "INTEGER") == ("JSON", True)
    froze = inf.fold(parsed([{"x": "2020-01-01T00:00:00Z"}, {"x": 1}, {"x": {"y": 1}}]))
    assert shape(froze) == [("x", "JSON", "NULLABLE", True)]
    assert len(inf.RULES) == 156


def test_edge_cases_in_order():
    rows = parsed([{"n": None, "l": [], "deep": [[1], [2.5]], "m": 1}, {"m": {"k": 1}}, {"m": "t"}, {"m": {"k": 2}}])
    got = {p: (t, m) for p, t, m, _ in shape(inf.fold(rows))}
    assert got == {"n": ("", ""), "l": ("", "REPEATED"), "deep": ("FLOAT", "REPEATED"), "m": ("RECORD", "NULLABLE"), "m.k": ("INTEGER", "NULLABLE")}


def value(r, depth=0):
    k = r.randint(0, 11 if depth < 3 else 8)
    if k == 9:
        return [value(r, depth + 1) for _ in range(r.randint(0, 3))]
    if k >= 10:
        return {c: value(r, depth + 1) for c in r.sample("abc", r.randint(0, 2))}
    return [None, True, "t", 1, 1.5, "2020-01-01", "2020-01-01T00:00:00Z", "word", "2020-01-01 00:00:00"][k]


@pytest.mark.parametrize("seed", range(6))
def test_parallel_equals_sequential(spark, seed):
    r = random.Random(seed)
    rows = [{c: value(r) for c in r.sample("xyz", r.randint(0, 3))} for _ in range(r.choice([3, 8, 30]))]
    assert shape(infer(spark, rows, r.randint(1, 6))) == shape(inf.fold(parsed(rows)))


def test_no_rows_and_reading_with_the_schema(spark):
    assert infer(spark, []).fields == []
    df = spark.createDataFrame(list(enumerate(MIXED)), "pos long, line string")
    node = inf.infer_schema(df, "line", "pos")
    assert inf.with_schema(df, "line", node).count() == len(MIXED)
    assert node.as_json()["type"] == "RECORD"
