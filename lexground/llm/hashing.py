"""Vectorised 64-bit mixing, the same on every machine."""

from __future__ import annotations

import numpy as np

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers with well-spread bits (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=False) + _STEP * np.uint64((salt + 1) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """In (0, 1], from the upper 53 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) / 2.0**53


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order matters."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(3) + mix(b, 1), 2)
