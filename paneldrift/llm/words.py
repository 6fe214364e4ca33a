"""Words of many texts at once: byte arrays instead of one object per word.

Words are runs of bytes other than the six ASCII white-space bytes. A word's 64-bit hash does not depend on its place: prefix
sums of byte codes times powers of an odd number, divided by the power at the word's start (all modulo 2**64), then mixed with the
length. Texts of any length are hashed in stretches of about STRETCH bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STRETCH = 1 << 20
_BASE = 0x5851F42D4C957F2D
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mix(np.arange(1, 257, dtype=np.uint64))
_FOLDED = _CODES.copy()
_FOLDED[65:91] = _CODES[97:123]


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int):
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.r_[np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)], dtype=np.uint64) for b in (_BASE, inverse))
        return self.up, self.down


_powers = _Powers()


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # where each text begins, and the end
    starts: np.ndarray  # of the words, in data
    ends: np.ndarray
    firsts: np.ndarray  # number of the first word of each text, and the number of words

    def hashes(self, fold: bool = False) -> np.ndarray:
        """64 bits for each word; `fold` takes A-Z as a-z."""
        codes, out, k = _FOLDED if fold else _CODES, np.empty(len(self.starts), np.uint64), 0
        while k < len(out):
            low = self.starts[k]
            upto = max(int(np.searchsorted(self.ends, low + STRETCH, "right")), k + 1)
            s, e = self.starts[k:upto] - low, self.ends[k:upto] - low
            up, down = _powers.of(int(e[-1]) + 1)
            sums = np.zeros(e[-1] + 1, np.uint64)
            np.cumsum(codes[self.data[low : low + e[-1]]] * up[: e[-1]], dtype=np.uint64, out=sums[1:])
            out[k:upto] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            k = upto
        return out


def words_of(texts: pa.Array) -> Words:
    """Words of an Arrow string array; null texts have none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    begin, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]  # a text ends a word
    begin[cuts[inside[1:-1][cuts]]] = True
    end[(cuts - 1)[inside[1:-1][cuts - 1]]] = True
    starts = np.flatnonzero(begin)
    return Words(data, offsets, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))
