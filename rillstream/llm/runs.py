"""Runs of bytes inside texts: hashed in bulk, with what was worked out for each distinct run kept in flat arrays.

A hash only says where to look: the bytes of a run are compared with those that were kept, so that runs of equal hash
are never taken for each other, however they were made.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of text worked on at once.
CHUNK = 1 << 19
#: Longer runs are not kept: they are worked out wherever they stand.
LONG = 2048
POWER = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Known:
    """Sorted hashes with the place of each."""

    h: np.ndarray
    place: np.ndarray

    @staticmethod
    def none() -> Known:
        return Known(np.zeros(0, np.uint64), np.zeros(0, np.int32))

    def with_(self, h: np.ndarray, place: np.ndarray) -> Known:
        h, place = np.concatenate([self.h, h]), np.concatenate([self.place, place])
        order = h.argsort()
        return Known(h[order], place[order])


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """x, or a copy of it with room for n."""
    if n <= len(x):
        return x
    out = np.zeros(max(n, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of stretches, one after the other."""
    total = np.cumsum(sizes)
    return np.repeat(starts - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)


def same_bytes(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each stretch whether x from a on equals y from b on; sizes are 1 or more."""
    if not len(sizes):
        return np.zeros(0, bool)
    equal = x[spread(a, sizes)] == y[spread(b, sizes)]
    return np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes)


class RunMemory:
    """Two numbers for each run of up to LONG bytes, found by a 64-bit hash and held against its bytes; up to `room` runs
    and `most_bytes` of them. A tag tells runs apart that have the same bytes and another meaning."""

    room = 700_000
    most_bytes = 1 << 24

    def __init__(self):
        self.values = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64)
        self.powers = np.zeros(0, np.uint64)
        self.forget()

    def forget(self) -> None:
        self.most, self.recent = Known.none(), Known.none()
        self.at, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.begin, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.kept, self.bytes, self.filled = 0, np.zeros(1 << 16, np.uint8), 0

    def full(self, more: int) -> bool:
        return self.kept + more > self.room or self.filled > self.most_bytes

    def hashes(self, c: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """For runs c[starts:stops] that are not empty: a polynomial in random values of the bytes, modulo 2^64."""
        n = len(c)
        with np.errstate(over="ignore"):
            if len(self.powers) < n:
                self.powers = np.cumprod(np.full(max(n, 2 * CHUNK), POWER, np.uint64))
            falling = self.powers[len(self.powers) - n :][::-1]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[c] * falling)])
            h = (total[stops] - total[starts]) * self.powers[stops - 1]  # wherever a run ends, its last byte has one power
            h ^= (stops - starts).astype(np.uint64) * MIX
            h = (h ^ (h >> np.uint64(31))) * MIX
            h ^= self.values[c[starts]] + (self.values[c[stops - 1]] << np.uint64(1))
        return h

    def distinct(self, c: np.ndarray, starts: np.ndarray, stops: np.ndarray, tags: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each distinct run, where it stands first, for every run its number, whether the run is odd): odd runs
        are longer than LONG or differ from the run of their hash and must be worked out by themselves."""
        sizes = stops - starts
        h = self.hashes(c, starts, stops)
        if tags is not None:
            h = h ^ tags.astype(np.uint64)
        own, first, inv = np.unique(h, return_index=True, return_inverse=True)
        odd = (sizes > LONG) | (sizes[first] > LONG)[inv]
        like = first[inv]
        odd |= sizes[like] != sizes
        if tags is not None:
            odd |= tags[like] != tags
        ask = np.flatnonzero(~odd & (like != np.arange(len(like))))
        odd[ask] = ~same_bytes(c, starts[ask], c, starts[like[ask]], sizes[ask])
        return own, first, inv, odd

    def look_up(self, h: np.ndarray, c: np.ndarray, starts: np.ndarray, stops: np.ndarray, tags: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The place of each run, -1 where it is not known; and where another run is kept under its hash."""
        place = np.full(len(h), -1, np.int32)
        for k in (self.most, self.recent):
            if len(k.h):
                i = np.minimum(np.searchsorted(k.h, h), len(k.h) - 1)
                hit = k.h[i] == h
                place[hit] = k.place[i[hit]]
        found = np.flatnonzero(place >= 0)
        at, sizes = place[found], (stops - starts)[found]
        tagged = sizes if tags is None else 2 * sizes + tags[found]
        good = self.size[at] == tagged
        other = np.zeros(len(h), bool)
        other[found[~good]] = True
        found, at, sizes = found[good], at[good], sizes[good]
        other[found] = ~same_bytes(c, starts[found], self.bytes, self.begin[at], sizes)
        place[other] = -1
        return place, other

    def keep(self, h: np.ndarray, c: np.ndarray, starts: np.ndarray, stops: np.ndarray, at: np.ndarray, n: np.ndarray, tags: np.ndarray | None = None) -> np.ndarray:
        """Keeps new runs with their numbers; returns their places."""
        sizes = stops - starts
        count, total = len(h), int(sizes.sum())
        k, b = self.kept, self.filled
        self.at, self.n, self.begin, self.size = (grown(x, k + count) for x in (self.at, self.n, self.begin, self.size))
        self.bytes = grown(self.bytes, b + total)
        self.at[k : k + count], self.n[k : k + count] = at, n
        self.begin[k : k + count] = b + np.cumsum(sizes) - sizes
        self.size[k : k + count] = sizes if tags is None else 2 * sizes + tags
        self.bytes[b : b + total] = c[spread(starts, sizes)]
        self.kept, self.filled = k + count, b + total
        place = np.arange(k, k + count, dtype=np.int32)
        self.recent = self.recent.with_(h, place)
        if len(self.recent.h) > max(50_000, len(self.most.h) // 4):
            self.most, self.recent = self.most.with_(self.recent.h, self.recent.place), Known.none()
        return place
