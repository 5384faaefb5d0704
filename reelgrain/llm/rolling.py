"""Hashes of all substrings of a length at once, on arrays of code points (NumPy, arithmetic modulo 2**64)."""

from __future__ import annotations

import numpy as np

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit numbers; different numbers stay different."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 + seed)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers_of(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, at least n of each."""
    if which not in _powers or len(_powers[which][0]) < n:
        n = max(n, 1 << 16)
        base = int(_BASES[which]) | 1
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, np.uint64(b & (2**64 - 1)), np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                made.append(np.multiply.accumulate(p))
        _powers[which] = (made[0], made[1])
    return _powers[which]


class Hashes:
    """Polynomial hashes of any substring in constant time."""

    def __init__(self, codes: np.ndarray, which: int = 0) -> None:
        up, self.down = _powers_of(which, len(codes) + 1)
        self.which = which
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(codes, which + 1) * up[: len(codes)], dtype=np.uint64)])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
            return mixed(raw + (ends - starts).astype(np.uint64), 7)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Of every run of `width` values, the place of the leftmost least one: range minima by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, span = np.arange(len(values), dtype=np.int64), 1

    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[a] <= values[b], a, b)

    while span * 2 <= width:
        at = lesser(at[:-span], at[span:])
        span *= 2
    return lesser(at[:n], at[width - span : width - span + n]) if span < width else at[:n]
