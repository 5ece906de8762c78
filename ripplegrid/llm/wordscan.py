"""Words of many texts at once, as 64-bit hashes, by numpy on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .common import HELD

BLANKS = (0x20, *range(0x09, 0x0E))
#: Bytes of words parted by blanks, and of words made of letters alone.
FILLED = np.array([b not in BLANKS for b in range(256)])
LETTERS = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)]) & FILLED
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


HELD["words"] = lambda: _POWERS.__setitem__(slice(None), [np.ones(1, np.uint64)] * 2)


def mixed(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit numbers (in place)."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_BASE, _BACK)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    out = [p[:n] for p in _POWERS]
    if n > 1 << 24:  # don't keep what a huge text has needed
        _POWERS[:] = [p[: 1 << 20].copy() for p in _POWERS]
    return out


class Words:
    """Words of texts: bytes of all texts (parted by a newline), starts and ends in them, and first[i], the number of words before text i."""

    def __init__(self, texts: Sequence[str], letters: np.ndarray = FILLED, lower: bool = True):
        coded = [x.encode("utf-8", "surrogatepass") for x in texts]
        raw = np.frombuffer(b"\n".join([*coded, b""]), np.uint8)
        self.bytes = LOWER[raw] if lower else raw
        inside = letters[self.bytes]
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
        self.starts, self.ends = edges[::2], edges[1::2]
        size = np.array([len(x) + 1 for x in coded], np.int64)
        self.text_starts = np.concatenate([[0], np.cumsum(size)])
        self.first = np.searchsorted(self.starts, self.text_starts)
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def of_text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first `most` bytes."""
        up, back = _powers(len(self.bytes))
        if self._sums is None:
            self._sums = np.zeros(len(self.bytes) + 1, np.uint64)
            np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up, out=self._sums[1:])
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        return mixed((self._sums[ends] - self._sums[self.starts]) * back[self.starts])

    def strings(self) -> list[str]:
        data = self.bytes.tobytes()
        return [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]
