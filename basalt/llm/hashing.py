"""Word hashes and window hashes in numpy, 64 bits each, equal on every machine."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Odd bases of the two independent window hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher: every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i up to n."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) <= n:
        size = 1 << max(12, n.bit_length())
        up, down = np.full(size, U(base)), np.full(size, U(pow(base, -1, 1 << 64)))
        up[0] = down[0] = U(1)
        got = _POWERS[base] = (np.cumprod(up, dtype=U), np.cumprod(down, dtype=U))
    return got


def windows(h: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of each run of ``width`` word hashes; empty if there are fewer."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, U)
    up, down = powers(base, len(h))
    total = np.concatenate([[U(0)], np.cumsum(h * up[: len(h)], dtype=U)])
    return mix((total[width:] - total[:n]) * down[:n])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
