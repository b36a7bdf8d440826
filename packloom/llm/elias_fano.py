"""Elias-Fano code of a non-decreasing list of integers, with a sampled select structure."""
from __future__ import annotations

import numpy as np

_EVERY = 256


class EliasFano:
    """``n`` values up to ``top``: ``low_bits`` low bits of each, packed, and the rest in unary."""

    def __init__(self, n: int, top: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.top = n, top
        self.low_bits = low_width(n, top)
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def build(cls, values: np.ndarray, top: int) -> "EliasFano":
        values = np.asarray(values, np.int64)
        n = len(values)
        width = low_width(n, top)
        bits = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8) if width else np.zeros((n, 0), np.uint8)
        ones = (values >> width) + np.arange(n)
        unary = np.zeros((top >> width) + n + 1, np.uint8)
        unary[ones] = 1
        return cls(
            n, top, np.packbits(bits.ravel(), bitorder="little").tobytes(),
            np.packbits(unary, bitorder="little").tobytes(), ones[::_EVERY].astype("<u4").tobytes(),
        )

    def parts(self) -> tuple[bytes, bytes, bytes]:
        return self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            out |= ((self.low[at >> 3] >> (at & 7)) & 1).astype(np.int64) << b
        return out

    def select(self, i: int) -> int:
        """The value of index ``i``: only the bytes from the sample before it to the next are read."""
        k = i // _EVERY
        start = int(self.samples[k])
        end = int(self.samples[k + 1]) // 8 + 1 if k + 1 < len(self.samples) else len(self.high)
        ones = start // 8 * 8 + np.flatnonzero(np.unpackbits(self.high[start // 8: end], bitorder="little"))
        at = int(ones[np.searchsorted(ones, start) + i % _EVERY])
        return ((at - i) << self.low_bits) | int(self._low(np.array([i]))[0])

    def all(self) -> np.ndarray:
        """Every value."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return ((ones - i) << self.low_bits) | self._low(i)


def low_width(n: int, top: int) -> int:
    return max(0, (top // n).bit_length() - 1) if n else 0
