"""Sets of word shingles, as sorted 64-bit hashes, for many texts at once.

Words: A-Z lower-cased, then what stands between spaces, tabs and line ends (0x09-0x0D, 0x20). A text's set is
its distinct k-word shingles; with fewer words, the whole sequence is one shingle; without words the set is empty.
"""

from __future__ import annotations

import hashlib

import numpy as np

_RNG = np.random.default_rng(77)
#: Fixed for all time and places: equal shingles must have equal hashes everywhere.
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one: sums modulo 2 ** 64 can't tell some words of a thousand letters and more apart,
#: whatever the step (those that alternate two letters by the parity of the bits of their places).
LONG = 256
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """sets(texts): a sorted array of distinct hashes for each text."""

    def __init__(self, k: int, chunk: int = 1 << 20):
        self.k, self.chunk = k, chunk
        self.powers(1 << 16)

    def powers(self, n: int) -> None:
        """Powers of the step and of its inverse, up to n."""
        one = np.ones(n + 1, np.uint64)
        up, down = one * _STEP, one * _BACK
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up), np.cumprod(down)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        some, size = [], 0
        for text in texts:
            data = (text or "").encode("utf-8", "surrogatepass").lower()
            if some and size + len(data) > self.chunk:
                out += self._sets(some)
                some, size = [], 0
            some.append(data)
            size += len(data) + 1
        return out + (self._sets(some) if some else [])

    def _sets(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        if len(data) > len(self.up):
            self.powers(int(len(data) * 1.3))
        gap = (data == 32) | ((data >= 9) & (data <= 13))
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=sums[1:])
        words = mix((sums[ends] - sums[starts]) * self.down[starts])
        for w in np.flatnonzero(ends - starts > LONG):
            words[w] = np.frombuffer(hashlib.blake2b(data[starts[w] : ends[w]].tobytes(), digest_size=8).digest(), np.uint64)[0]
        offsets = np.cumsum([1, *(len(t) + 1 for t in texts)])
        bounds = np.searchsorted(starts, offsets)
        k = self.k
        n = len(words) - k + 1
        if n > 0:
            all_ = words[:n] * _PLACE[0]
            for j in range(1, k):
                all_ = all_ + words[j : j + n] * _PLACE[j]
            all_ = mix(all_)
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= k:
                out.append(np.unique(all_[a : b - k + 1]))
            elif b > a:
                out.append(mix((words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def overlap(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """How many numbers two sorted arrays share, by binary search of the shorter one's in the longer one, in
    blocks; -1 as soon as `need` is out of reach."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0 if need <= 0 else -1
    found = 0
    for at in range(0, len(a), 256):
        block = a[at : at + 256]
        place = np.searchsorted(b, block)
        place[place == len(b)] = 0
        found += int((b[place] == block).sum())
        if found + len(a) - at - len(block) < need:
            return -1
    return found


def min_hashes(s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least of the set's hashes under each seed."""
    return mix(s[None, :] ^ seeds[:, None]).min(axis=1)
