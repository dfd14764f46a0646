"""Elias-Fano sequences in numpy, with vectorised access and search, and files of arrays to map into memory."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyarrow import fs

#: Numbers that are coded together: 64 of them fill whole words, so stretches of a multiple share none.
STRETCH = 1 << 18
_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


# By byte and rank: the place of the byte's one of that rank.
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[:8] for byte in range(256)], dtype=np.uint8)


def _in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th one (from 0) of each word: first its byte, then within that by table."""
    parts = np.ascontiguousarray(word).view(np.uint8).reshape(-1, 8)
    sums = np.cumsum(np.bitwise_count(parts), axis=1, dtype=np.uint8)
    at = (sums <= r.astype(np.uint8)[:, None]).sum(axis=1, dtype=np.int64)
    flat = np.arange(len(word)) * 8 + at
    byte = parts.reshape(-1)[flat]
    rest = r - np.where(at > 0, sums.reshape(-1)[np.maximum(flat - 1, 0)], 0)
    return at * 8 + _IN_BYTE[byte, rest]


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
    """Place of the k-th one, or zero with flip (from 0), in a bit vector; before: how many there are before each word.

    The word is found by halving, so long runs of either kind cost nothing more.
    """
    word = np.searchsorted(before, k.astype(before.dtype), side="right") - 1
    own = words[word]
    return (word << 6) + _in_word(own ^ _ALL if flip else own, k - before[word].astype(np.int64))


@dataclass
class EliasFano:
    """A non-decreasing sequence of n numbers below 2**64: low bits packed, high bits in unary."""

    n: int
    bits: int  # low bits of each
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray  # ones before each word of high
    zeros: np.ndarray  # and zeros

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64, copy=False)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits >> 6) + 2, dtype=np.uint64)
        mark = np.zeros(((top >> bits) + max(n - 1, 0)) // 64 * 64 + 128, dtype=np.uint8)
        for k in range(0, n, STRETCH):
            part = values[k : k + STRETCH]
            mark[(part >> np.uint64(bits)).astype(np.int64) + np.arange(k, k + len(part))] = 1
            if bits:
                own, part = low[k * bits >> 6 :], part & np.uint64((1 << bits) - 1)
                at = np.arange(len(part), dtype=np.uint64) * np.uint64(bits)
                word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
                starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                own[word[starts]] = np.bitwise_or.reduceat(part << shift, starts)
                over = np.flatnonzero(shift + np.uint64(bits) > 64)
                own[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])
        high = np.packbits(mark, bitorder="little").view(np.uint64)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1]))
        kind = np.uint32 if len(mark) < 1 << 32 else np.uint64
        return EliasFano(n, bits, low, high, ones.astype(kind), (np.arange(len(ones)) * 64 - ones).astype(kind))

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.meta": np.array([self.n, self.bits], dtype=np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones, f"{name}.zeros": self.zeros}

    @staticmethod
    def of(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = arrays[f"{name}.meta"].tolist()
        return EliasFano(n, bits, *(arrays[f"{name}.{x}"] for x in ("low", "high", "ones", "zeros")))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        # The next word's share; a shift by 64 isn't defined, so it goes in two steps.
        upper = (self.low[word + 1] << (np.uint64(63) - shift)) << _ONE
        return (self.low[word] >> shift | upper) & np.uint64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        i = np.asarray(i, dtype=np.int64)
        if not len(i):
            return np.zeros(0, dtype=np.uint64)
        high = (_select(self.high, self.ones, i, False) - i).astype(np.uint64)
        return high << np.uint64(self.bits) | self._low(i)

    def all(self) -> np.ndarray:
        return self.access(np.arange(self.n))

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first number that isn't below x (n if none), and whether it equals x."""
        x = np.asarray(x, dtype=np.uint64)
        if self.n and len(x) and int(x.max()) >> self.bits <= len(self.high) * 64 - self.n - 2:
            return self._search(x)
        place, same = np.full(len(x), self.n, dtype=np.int64), np.zeros(len(x), dtype=bool)
        if self.n and len(x):
            inside = np.flatnonzero(x >> np.uint64(self.bits) <= np.uint64(len(self.high) * 64 - self.n - 2))
            if len(inside):
                place[inside], same[inside] = self._search(x[inside])
        return place, same

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """successor() for numbers whose buckets the high bits reach."""
        bucket = (x >> np.uint64(self.bits)).astype(np.int64)
        want = x & np.uint64((1 << self.bits) - 1)
        # A bucket's numbers stand between the zero that ends the one before it and its own; they are searched by halving.
        at = _select(self.high, self.zeros, np.maximum(bucket - 1, 0), True) + 1
        at[bucket == 0] = 0
        low = at - bucket
        # The next zero is mostly in the same word.
        free = (self.high[at >> 6] ^ _ALL) & (_ALL << (at & 63).astype(np.uint64))
        end = (at & ~63) + np.bitwise_count((free & (~free + _ONE)) - _ONE) - bucket
        far = np.flatnonzero(free == 0)
        if len(far):
            end[far] = _select(self.high, self.zeros, bucket[far], True) - bucket[far]
        some = np.flatnonzero(low < end)
        # Those still searched: first, behind the last, and the wanted low bits.
        on, a, b, w = some, low[some], end[some], want[some]
        while len(on):
            middle = a + b >> 1
            less = self._low(middle) < w
            a, b = np.where(less, middle + 1, a), np.where(less, b, middle)
            going = a < b
            if not going.all():
                done = ~going
                low[on[done]] = a[done]
                on, a, b, w = on[going], a[going], b[going], w[going]
        same = np.zeros(len(x), dtype=bool)
        some = some[low[some] < end[some]]
        same[some] = self._low(low[some]) == want[some]
        return low, same

    def find(self, x: np.ndarray) -> np.ndarray:
        """Places of x, -1 where it isn't there."""
        place, same = self.successor(x)
        return np.where(same, place, -1)


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays into one file, aligned, behind a JSON head; path may be of any file system that pyarrow knows."""
    store, own = fs.FileSystem.from_uri(path)
    store.create_dir(own.rpartition("/")[0], recursive=True)
    at, head = 0, {}
    for k, a in arrays.items():
        head[k] = [a.dtype.str, at, len(a)]
        at += (a.nbytes + 63) // 64 * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    with store.open_output_stream(own) as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 64))


def mapped(path: str) -> bool:
    """Whether load() maps the file, rather than read it into memory."""
    return isinstance(fs.FileSystem.from_uri(path)[0], fs.LocalFileSystem)


def load(path: str) -> dict[str, np.ndarray]:
    """Arrays of a file of save(): mapped into memory, or read where the store is none that can be mapped."""
    store, own = fs.FileSystem.from_uri(path)
    if isinstance(store, fs.LocalFileSystem):
        raw = np.memmap(own, dtype=np.uint8, mode="r")
    else:
        with store.open_input_file(own) as f:
            raw = np.frombuffer(f.read_buffer(), dtype=np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + size].tobytes())
    # Plain arrays over the mapping: the subclass would make each access dearer.
    return {k: raw[8 + size + at : 8 + size + at + n * np.dtype(t).itemsize].view(t).view(np.ndarray) for k, (t, at, n) in head.items()}
