"""Batches of strings as flat numpy arrays of code points.

All per-character work of the operators here runs over one array per Arrow batch, with the row
boundaries kept as offsets, instead of Python loops over characters.
"""

from __future__ import annotations

import numpy as np

MAX_CP = 0x110000


def flatten(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the n + 1 offsets of the rows. Null counts as empty."""
    texts = ["" if t is None else t for t in texts]
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lens, out=offsets[1:])
    return flat, offsets


def row_of(offsets: np.ndarray) -> np.ndarray:
    """For every code point the number of its row."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values per row; rows without a value give 0."""
    total = np.zeros(len(values) + 1, dtype=values.dtype if values.dtype.kind in "uif" and values.dtype.itemsize == 8 else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
