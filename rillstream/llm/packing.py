"""Packing by power-of-two decomposition.

Each document's token ids are cut into pieces whose lengths are the binary digits of the total, largest first and at
most max_len. A piece is a training sequence of its own, so no sequence crosses documents, and because every length is
a power of two no padding is needed: batches are formed inside a bucket of equal lengths.

Defined results: a null text is an empty one; an empty text has the end id alone and gives one piece of length 1;
repeated rows and ids are packed once per row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import batched, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstream.llm.common import sliced
from rillstream.llm.runs import CHUNK, RunMemory, grown, spread

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
MAX_LEN = 4096

WORD_END = "</w>"
#: Letters of ASCII and Latin-1, then punctuation of ASCII without the apostrophe: one or two pre-tokens.
PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+[!-&(-/:-@\[-`{-~]*")
ASCII_MARKS = frozenset(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
#: Runs encoded at once.
TOGETHER = 64
#: The length from which runs are encoded alone.
LONGEST = 256
BREAK = re.compile(rb"[\x20\x09-\x0D]")
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long, bucket int"
)


class WordIds(RunMemory):
    """Ids of texts, by the library and in numpy.

    The vocabulary's normaliser and splitter drop white space and never look across it, so a text's ids are those of
    its runs between ASCII white space, in order. The library works out each distinct run once.
    """

    most_ids = 4_000_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith(WORD_END)]] = True
        super().__init__()

    def forget(self) -> None:
        super().forget()
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def of(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit values."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            raw = text.encode()
            if size + len(raw) > CHUNK:
                yield from self.bulk(held)
                held, size = [], 0
            if len(raw) > CHUNK:
                yield b"".join(x for piece in cut(raw) for x in (self.bulk([piece]) if len(piece) <= 2 * CHUNK else self.alone([piece])))
                continue
            held.append(raw)
            size += len(raw) + 1
        yield from self.bulk(held)

    def bulk(self, raws: list[bytes]) -> list[bytes]:
        if not raws:
            return []
        text = b" ".join(raws) + b" "
        c = np.frombuffer(text, np.uint8)
        space = SPACE[c]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        starts, stops = edge[0::2], edge[1::2]
        if not len(starts):
            return [b""] * len(raws)
        distinct, first, inv, odd = self.distinct(c, starts, stops)
        short = np.flatnonzero(~odd[first])  # what is kept; longer runs are odd wherever they stand
        if self.full(len(short)) or self.used > self.most_ids:
            self.forget()
        own = first[short]
        place, other = self.look_up(distinct[short], c, starts[own], stops[own])
        new = np.flatnonzero((place < 0) & ~other)
        place[new] = self.learn(distinct[short[new]], text, c, starts[own[new]], stops[own[new]])
        places = np.full(len(distinct), -1, np.int32)
        places[short] = place
        run = np.where(odd, -1, places[inv])
        at, sizes = self.at[np.maximum(run, 0)], np.where(run >= 0, self.n[np.maximum(run, 0)], 0)
        rest = np.flatnonzero(run < 0)
        if len(rest):  # their ids stand behind those that are kept, for this once
            at[rest], sizes[rest] = self.put(self.encoded([text[a:b] for a, b in zip(starts[rest].tolist(), stops[rest].tolist(), strict=True)]))
        total = np.cumsum(sizes)
        ids = self.pool[spread(at, sizes)].astype("<u4").tobytes()
        ends = np.cumsum([len(r) + 1 for r in raws])
        bounds = np.concatenate([[0], total])[np.searchsorted(starts, np.concatenate([[0], ends]))] * 4
        return [ids[a:b] for a, b in pairwise(bounds.tolist())]

    def learn(self, h: np.ndarray, text: bytes, c: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        at, n = self.put(self.encoded([text[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]))
        self.used += int(n.sum())
        return self.keep(h, c, starts, stops, at, n)

    def put(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs into the pool, behind those in use; where each begins and how many they are."""
        n = np.array([len(x) for x in ids], np.int64)
        total = int(n.sum())
        self.pool = grown(self.pool, self.used + total)
        self.pool[self.used : self.used + total] = np.concatenate(ids) if ids else []
        return self.used + np.cumsum(n) - n, n

    def alone(self, raws: list[bytes]) -> list[bytes]:
        """Ids of texts without help of the memory."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast([r.decode() for r in raws], add_special_tokens=False)]

    def encoded(self, runs: list[bytes]) -> list[np.ndarray]:
        """Ids of each run."""
        plain = [k for k, w in enumerate(runs) if len(w) <= LONGEST and PLAIN.fullmatch(w)]
        out: list = [None] * len(runs)
        groups = list(batched(plain, TOGETHER))
        texts = [b" ".join([runs[k] for k in g]).decode() for g in groups]
        for own, e in zip(groups, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            last = np.cumsum([1 + (runs[k][-1] in ASCII_MARKS) for k in own]) - 1
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == last[-1] + 1:  # else they are encoded one by one
                start = 0
                for k, stop in zip(own, (ends[last] + 1).tolist(), strict=True):
                    out[k] = ids[start:stop]
                    start = stop
        rest = [k for k, x in enumerate(out) if x is None]
        for k, e in zip(rest, self.tok.encode_batch_fast([runs[k].decode() for k in rest], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, np.uint32)
        return out


def cut(raw: bytes) -> Iterator[bytes]:
    """Pieces of about CHUNK bytes that end where white space follows."""
    at = 0
    while len(raw) - at > CHUNK:
        m = BREAK.search(raw, at + CHUNK)
        if m is None:
            break
        yield raw[at : m.start()]
        at = m.start()
    yield raw[at:]


@functools.lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def piece_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """n as whole max_len pieces and then its remaining binary digits, largest first."""
    out = [max_len] * (n // max_len)
    rest = n % max_len
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def tokenizer_path(path: str | None, name: str) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    max_len: int = MAX_LEN,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of every document; with_ids adds their token ids. Narrow: one pass over the input, no shuffle."""
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(tokenizer_path(tokenizer, TOKENIZER))
        for batch in sliced(batches):
            rows: list[tuple] = []
            ids_out: list[np.ndarray] = []
            texts = (t.as_py() or "" for t in batch[1])
            for doc, own in zip(batch[0].to_pylist(), known.of(texts), strict=True):
                ids = own + end
                n = len(ids) // 4
                start = 0
                for length in piece_lengths(n, max_len):
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, start, length, zlib.crc32(piece), n, 0, length.bit_length() - 1))
                    if with_ids:
                        ids_out.append(np.frombuffer(piece, "<u4").astype(np.int32))
                    start += length
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            arrays = [pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(cols[6], pa.int32())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset", "bucket"]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    pieces = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).select(
        *cols, *(["ids"] if with_ids else [])
    )
