"""The pipeline against a brute-force version of its stages on a small table."""

from __future__ import annotations

import random
from collections import Counter

import public_tokenizers
import pytest
from test_dedup_mix import slow_components, slow_fingerprint, slow_lines, slow_targets
from tokenizers import Tokenizer

import corpus_pipeline
from rillstream.llm import mixing
from rillstream.llm.packing import piece_lengths

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    en, de = ("the of and to in that was his".split(), "der die und das nicht ein zu von".split())
    out = []
    for i in range(120):
        own = en if i % 3 else de
        body = [" ".join(r.choices(own, k=12)) + f" {own[i % 8]}{i}" for _ in range(r.randint(1, 5))]
        text = "\n".join(["shared menu line", *body] if i % 4 == 0 else body)
        out.append((i, text, "en" if i % 3 else "de", ["s0", "s0", "s1", None][i % 4], len(text)))
    out += [(200 + k, out[1][1], "en", "s1", 3) for k in range(5)]
    out += [(300, None, "en", "s0", None), (301, "", "en", "s0", 0), (302, "12345 !!", None, "s1", 8), (303, out[2][1], None, None, 1), out[5]]
    return out


def test_stages(spark, rows, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    want = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    results = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, path)
        assert docs.columns == "doc_id text lang source n_chars".split()
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        results.append(docs.collect())
    assert Counter(r.doc_id for r in results[0]) == Counter(r[0] for r in want)
    texts = slow_lines([(r[3], r[1]) for r in want], 0.05, 5)
    want = [(r[0], t, r[2], r[3], len(t)) for r, t in zip(want, texts, strict=True)]
    assert Counter(map(tuple, results[1])) == Counter(want)
    fps = {r[0]: slow_fingerprint(r[1]) for r in want}
    ids = sorted(fps)
    root = slow_components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fps[a] ^ fps[b]).bit_count() <= 2])
    want = sorted({r for r in want if root[r[0]] == r[0]})
    assert sorted(map(tuple, results[2])) == want
    sizes = Counter()
    for r in want:
        sizes[r[3]] += len(r[1].split())
    target, taken = slow_targets(sizes), Counter()
    for r in results[3]:
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - target[s]) <= max(len(r[1].split()) for r in want) for s in sizes)
    assert {r.doc_id for r in results[3]} <= {r[0] for r in want} and max(Counter(r.doc_id for r in results[3]).values()) <= mixing.MAX_EPOCHS
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = corpus_pipeline.STAGES[4][1](spark, docs, path).collect()
    pieces = Counter()
    for r in results[3]:
        n = len(tok.encode(r.text, add_special_tokens=False).ids) + 1
        pieces.update((r.doc_id, n, p) for p in piece_lengths(n))
    assert Counter((r.doc_id, r.doc_tokens, r.length) for r in packed) == pieces
    got = corpus_pipeline.run(spark, path).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed)


def test_nothing_in_nothing_out(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_rest_works_without_these_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "rillstream", tmp_path / "rillstream", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
