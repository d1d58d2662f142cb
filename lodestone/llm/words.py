"""Vectorised tokenisation: words of many texts at once as positions and 64-bit hashes, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased bytes.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
#: Bytes whose sums are held at once, so that a long text takes no more memory than many short ones.
PIECE = 1 << 20
#: The hash of the end token, which no word has but by chance.
END = U(0x5851F42D4C957F2D)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the usual shift and multiply rounds)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([[U(1)], np.full(n - 1, U(b), U)]), dtype=U) for b in (_BASE, inverse))


def words(texts: list[bytes], kind: np.ndarray = SPACED, lower: bool = True, hashes: bool = True):
    """(document index, start and end in the joined bytes, hash) of every word, in order, and the joined bytes.

    Texts are joined by a space, so no word spans two of them; A-Z are lower-cased.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    data = _LOWER[data] if lower else data
    is_word = kind[data]
    edges = np.flatnonzero(np.diff(is_word.view(np.int8), prepend=0))
    start, end = edges[::2], edges[1::2]
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    doc = np.searchsorted(first, start, "right") - 1
    if not hashes:
        return doc, start, end, None, data
    h = np.empty(len(start), U)
    cut = np.searchsorted(start, np.arange(0, len(data) + PIECE, PIECE))
    with np.errstate(over="ignore"):
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if a < b:  # the words that start in one piece; their hashes don't depend on the place
                lo, hi = int(start[a]), int(end[b - 1])
                power, inverse = _powers(1 << max(21, (hi - lo).bit_length()))
                total = np.concatenate([[U(0)], np.cumsum(_TABLE[data[lo:hi]] * power[: hi - lo], dtype=U)])
                s, e = start[a:b] - lo, end[a:b] - lo
                h[a:b] = mix((total[e] - total[s]) * inverse[s] + U(1))
    return doc, start, end, h, data


MASK48 = U((1 << 48) - 1)


def put48(x: np.ndarray) -> bytes:
    """Numbers below 2^48, six bytes each."""
    return (x >> U(16)).astype(np.uint32).tobytes() + (x & U(0xFFFF)).astype(np.uint16).tobytes()


def get48(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, np.uint32, n).astype(U) << U(16) | np.frombuffer(data, np.uint16, n, 4 * n).astype(U)
