"""Token counts with a whole-token shortcut.

Before any text is read, every vocabulary string is put to the proof once, on the driver: if it is one pre-token and the
library encodes it alone as one id, a pre-token equal to it counts 1 without any merging. The proved strings are sent to
the workers. Only other pre-tokens are merged, by the library, and distinct pieces of text are worked out once.

Defined results: a null text is an empty one with 0 bytes and 0 tokens; special strings inside a text count one token
each, as the library's default has it; repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstream.llm.common import sliced
from rillstream.llm.packing import tokenizer_path
from rillstream.llm.runs import CHUNK, RunMemory

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: The pre-token pattern of this vocabulary (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on which any two regular expression libraries agree; other pieces go to the library whole.
PLAIN = r"[\t\n\r\x20-\x7EÀ-ÖØ-öø-ſ]*"
#: More than any text has tokens.
UNSURE = -(1 << 40)


def _byte_strings() -> dict[str, int]:
    """The printable stand-ins of the 256 byte values in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter(RunMemory):
    """Counts tokens of texts. A text is cut before spaces; each piece, with the space before it, is worked out once.

    The library, too, cuts before a space that has no white space next to it, so counts of pieces add up. Where white
    space meets a cut the text is counted whole.
    """

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.pre = regex.compile(PRE_TOKEN)
        self.plain = regex.compile(PLAIN)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.whole = self.proved() if whole is None else whole
        super().__init__()

    def proved(self) -> frozenset[str]:
        """Vocabulary strings that are one pre-token and that the library encodes alone as one token."""
        back = _byte_strings()
        special = set(self.special)
        found: list[tuple[str, int]] = []
        for s, i in self.tok.get_vocab(with_added_tokens=False).items():
            try:
                t = bytes(back[c] for c in s).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if t not in special and self.plain.fullmatch(t) and self.pre.fullmatch(t) and len(self.pre.findall(t)) == 1:
                found.append((t, i))
        ids = self.tok.encode_batch([t for t, _ in found], add_special_tokens=False)
        return frozenset(t for (t, i), e in zip(found, ids, strict=True) if e.ids == [i])

    def merged(self, s: str) -> int:
        return len(self.tok.encode(s, add_special_tokens=False).ids)

    def pretokens(self, s: str) -> int:
        return self.work_out([s])[0]

    def work_out(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece: whole tokens count 1, other pre-tokens are merged by the library, all at once."""
        out, at, rest = [0] * len(pieces), [], []
        for k, s in enumerate(pieces):
            for p in self.pre.findall(s) if self.plain.fullmatch(s) else (s,):
                if p in self.whole:
                    out[k] += 1
                else:
                    at.append(k)
                    rest.append(p)
        for k, e in zip(at, self.tok.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            out[k] += len(e)
        return out

    @staticmethod
    def unsure(piece: bytes) -> bool:
        """Whether white space meets the cut."""
        s = piece.decode()
        return s[0].isspace() or s[-1].isspace()

    def of(self, texts: list[str]) -> list[int]:
        out: list[int | None] = [self.merged(t) if any(s in t for s in self.special) else None for t in texts]
        held: list[int] = []
        size = 0
        for k, t in enumerate(texts):
            if out[k] is None and len(t) > CHUNK:
                n = self.long(t.encode())
                out[k] = n if n >= 0 else self.pretokens(t)
            elif out[k] is None:
                held.append(k)
                size += len(t)
            if held and (size > CHUNK // 2 or k == len(texts) - 1):
                for i, n in zip(held, self.bulk([texts[i].encode() for i in held]), strict=True):
                    out[i] = n if n >= 0 else self.pretokens(texts[i])
                held, size = [], 0
        return out

    def long(self, raw: bytes) -> int:
        """The count of a text of any length, a stretch after the other; below 0 if it must be counted whole."""
        total, at = 0, 0
        while at <= len(raw):
            end = raw.find(b" ", at + CHUNK)
            end = len(raw) if end < 0 else end
            total += self.bulk([raw[at:end]], continued=at > 0)[0]
            at = end + 1
        return total

    def bulk(self, raws: list[bytes], continued: bool = False) -> list[int]:
        """Counts of texts, below 0 for those that must be counted whole; continued: a space stands before the first."""
        ends = np.cumsum([len(r) + 1 for r in raws])
        text = b" ".join(raws) + b" "
        c = np.frombuffer(text, np.uint8)
        stops = np.flatnonzero(c == 32)  # the end of every piece; those of texts among them
        starts = np.concatenate([[0], stops[:-1] + 1])
        owner = np.searchsorted(ends, stops, side="right")
        first = np.ones(len(stops), bool)
        first[1:] = owner[1:] != owner[:-1]
        first[0] = not continued
        counts = np.zeros(len(stops), np.int64)
        empty = starts == stops
        counts[empty & ~first] = UNSURE
        some = np.flatnonzero(~empty)
        if len(some):
            begin, end, tags = starts[some], stops[some], first[some].astype(np.int64)
            distinct, at, inv, odd = self.distinct(c, begin, end, tags)
            short = np.flatnonzero(~odd[at])  # what is kept; longer pieces are odd wherever they stand
            if self.full(len(short)):
                self.forget()
            own = at[short]
            place, other = self.look_up(distinct[short], c, begin[own], end[own], tags[own])
            new = np.flatnonzero((place < 0) & ~other)
            fresh = own[new]
            place[new] = self.keep(distinct[short[new]], c, begin[fresh], end[fresh], np.zeros(len(new), np.int64), self.piece_counts(text, begin[fresh], end[fresh], tags[fresh]), tags[fresh])
            places = np.full(len(distinct), -1, np.int32)
            places[short] = place
            piece = np.where(odd, -1, places[inv])
            found = np.where(piece >= 0, self.n[np.maximum(piece, 0)], 0)
            rest = np.flatnonzero(piece < 0)
            found[rest] = self.piece_counts(text, begin[rest], end[rest], tags[rest])
            counts[some] = found
        return np.bincount(owner, counts, len(raws)).astype(np.int64).tolist() if len(owner) else [0] * len(raws)

    def piece_counts(self, text: bytes, starts: np.ndarray, stops: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tokens of pieces, with the space before all but a text's first one; UNSURE where white space meets the cut."""
        pieces = [text[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        sure = [k for k, p in enumerate(pieces) if not self.unsure(p)]
        found = np.full(len(pieces), UNSURE)
        found[sure] = self.work_out([("" if first[k] else " ") + pieces[k].decode() for k in sure])
        return found


@functools.lru_cache(maxsize=2)
def proved_words(path: str) -> frozenset[str]:
    """The proof, made once in a process: on the driver, which hands the result to all workers."""
    return Counter(path).whole


_counters: dict[str, Counter] = {}


def counter(path: str, whole: Callable[[], frozenset[str]]) -> Counter:
    """One counter a worker and vocabulary."""
    if path not in _counters:
        _counters[path] = Counter(path, whole())
    return _counters[path]


def count_tokens(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    limit: int = LIMIT,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; one narrow pass."""
    held = docs.sparkSession.sparkContext.broadcast(proved_words(tokenizer_path(tokenizer, TOKENIZER)))  # strings of the vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path(tokenizer, TOKENIZER), lambda: held.value)
        for batch in sliced(batches):
            texts = [t.as_py() or "" for t in batch[1]]
            sizes = [len(t.encode()) for t in texts]
            counts = count.of(texts)
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
