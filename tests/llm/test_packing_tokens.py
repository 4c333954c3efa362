from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rillstream.llm import packing, runs, token_counts

SCHEMA = "doc_id long, text string, sequence_id string, length string, Doc_ID2 int"
TEXTS = [None, "", " ", "Hello, world. Ünïcode naïve café's", "a  b\n \nc", "x<|endoftext|>y <|startoftext|>", "日本語 テスト 123", "trail \n", "the cat " * 3000, "z" * 4000, "don't  I'LL\t\tgo \x1c a\x85b", "ßİǅ ﬁ", "same", "same"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], SCHEMA)


def reference(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_piece_lengths():
    for n in (1, 2, 3, 4095, 4096, 4097, 12345):
        parts = packing.piece_lengths(n)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 4096 for p in parts) and parts == sorted(parts, reverse=True)
        assert len(parts) == n // 4096 + (n % 4096).bit_count()


def test_pieces_hold_every_token_once(spark):
    tok, rows = reference("word_bpe_49k.json"), {}
    got = packing.pack(docs(spark, TEXTS), with_ids=True).collect()
    assert len({r.sequence_id for r in got}) == len(got)  # no sequence crosses documents
    for r in got:
        assert r.offset == 0 and r.length == len(r.ids) == 1 << r.bucket
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        rows.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(TEXTS):
        own = sorted(rows[i], key=lambda r: r.start)
        want = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        assert [x for r in own for x in r.ids] == want and own[0].doc_tokens == len(want)
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()


def test_packing_nothing_and_null_ids(spark):
    assert packing.pack(docs(spark, [])).count() == 0
    assert packing.pack(spark.createDataFrame([(None, "a")], "doc_id long, text string")).first().doc_id is None
    with pytest.raises(ValueError):
        packing.pack(docs(spark, []), max_len=1000)


def strange(seed, n):
    r = random.Random(seed)
    alphabet = [" ", "  ", "\n", "\t", "a", "B'", "'s", "é", "1", "12", "!?", " ", "<|endoftext|>", "日", "\x85", "\x1d", "　", "\r", "ß", "İ", "word", "$$$", "_"]
    return ["".join(r.choices(alphabet, k=r.randint(0, 12))) for _ in range(n)]


def test_fast_paths_equal_the_libraries():
    texts = strange(1, 4000)
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for t, e, got in zip(texts, words.tok.encode_batch(texts, add_special_tokens=False), list(words.of(texts)), strict=True):
        assert np.array(e.ids, "<u4").tobytes() == got, t
    count = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    for t, e, n in zip(texts, reference("byte_bpe_50k.json").encode_batch(texts, add_special_tokens=False), count.of(texts), strict=True):
        assert len(e.ids) == n, t


def test_memory_of_pieces_is_bounded():
    count = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    count.room = 10
    texts = [" ".join(f"w{i}" for i in range(k, k + 7)) for k in range(50)]
    for t in texts:
        assert count.of([t]) == [count.merged(t)] and count.kept <= 10 and len(count.most.h) + len(count.recent.h) == count.kept
    assert count.of([]) == [] and count.of(["", "a", ""]) == [0, 1, 0]


def test_every_whole_token_is_proved():
    count = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(count.whole) > 40_000
    some = sorted(count.whole)[::997]
    assert all(count.merged(t) == 1 for t in some)


def test_token_counts(spark):
    tok = reference("byte_bpe_50k.json")
    rows = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, TEXTS), limit=20).collect()}
    for i, t in enumerate(TEXTS):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert tuple(rows[i]) == (i, len((t or "").encode()), n, n > 20)
    assert token_counts.count_tokens(docs(spark, [])).count() == 0


def test_chunks_and_forgetting_do_not_show(monkeypatch):
    texts = strange(3, 300) + ["word " * 400, "x" * 3000, "é" * 700 + " tail", ""]
    path = public_tokenizers.path("word_bpe_49k.json")
    want = list(packing.WordIds(path).of(texts))
    monkeypatch.setattr(packing, "CHUNK", 500)
    small = packing.WordIds(path)
    small.room = 50
    assert list(small.of(texts)) == want and list(small.of(texts)) == want


def thue_morse(n):
    """Two words of n letters whose polynomial hashes modulo 2^64 are equal, whatever the odd base, from 1,024 letters on."""
    bits = [k.bit_count() & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_runs_of_equal_hash_are_told_apart(n):
    one, two = (f"x{w}y" for w in thue_morse(n))
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    c = np.frombuffer(f"{one} {two}".encode(), np.uint8)
    h = words.hashes(c, np.array([0, n + 3]), np.array([n + 2, 2 * n + 5]))
    assert h[0] == h[1]
    count = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    tok = reference("byte_bpe_50k.json")
    for texts in ([one, two], [f"a {two} {one} b", two], [one], [two], [f"{two} {one}"]):
        want = [np.array(e.ids, "<u4").tobytes() for e in words.tok.encode_batch(texts, add_special_tokens=False)]
        assert list(words.of(texts)) == want
        assert count.of(texts) == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_runs_are_told_apart_when_every_hash_is_equal(monkeypatch):
    monkeypatch.setattr(runs.RunMemory, "hashes", lambda self, c, starts, stops: np.ones(len(starts), np.uint64))
    texts = strange(5, 300) + ["same words same", "same"]
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    assert list(words.of(texts)) == [np.array(e.ids, "<u4").tobytes() for e in words.tok.encode_batch(texts, add_special_tokens=False)]
    count = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    for t, n in zip(texts, count.of(texts), strict=True):
        assert n == count.merged(t), t


def test_texts_longer_than_a_chunk(monkeypatch):
    tok = reference("byte_bpe_50k.json")
    texts = ["the cat, " * 500 + "end", "x" * 3000, "a  b " * 300, "word " * 200, "é" * 900 + " z"]
    monkeypatch.setattr(token_counts, "CHUNK", 200)
    count = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert count.of(texts) == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    want = [np.array(words.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    monkeypatch.setattr(packing, "CHUNK", 200)
    assert list(words.of(texts)) == want
