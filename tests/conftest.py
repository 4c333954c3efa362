from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def canonical(rows, columns):
    """Rows as sorted tuples of text, columns by name."""
    at = [columns.index(c) for c in sorted(columns)]

    def text(v):
        if isinstance(v, bytes | bytearray):
            return bytes(v).hex()
        return repr(v) if isinstance(v, float) else str(v)

    return sorted(tuple(text(r[i]) for i in at) for r in rows)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Checks a query against its SQL."""

    def check(query, sql, sf_dir=DATA):
        got = query(spark, sf_dir)
        want = duck.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), names)

    return check
