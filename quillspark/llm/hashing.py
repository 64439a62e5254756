"""Rolling hashes over byte arrays in numpy: polynomials modulo 2**64 with random byte values, then mixed."""

from __future__ import annotations

import numpy as np

# Odd bases, their inverses are derived; multipliers of the splitmix64 finalizer.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
BYTES = [np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1) for seed in (5, 6)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(base**i, base**-i) for i below n at least."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1024, 0 if have is None else 2 * len(have[0]))
        base = int(BASES[which])
        both = []
        for b in (base, pow(base, -1, 2**64)):
            row = np.full(size, b, dtype=np.uint64)
            row[0] = 1
            both.append(np.cumprod(row, dtype=np.uint64))
        _powers[which] = have = (both[0], both[1])
    return have[0][:n], have[1][:n]


def prefix_hash(raw: np.ndarray, which: int = 0) -> np.ndarray:
    """p with p[j] - p[i] = sum of value(raw[k]) * base**k for i <= k < j."""
    up, _ = powers(len(raw), which)
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(BYTES[which][raw] * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Unmixed hash of raw[start:end]; equal bytes give equal hashes wherever they lie."""
    _, down = powers(len(prefix), which)
    return (prefix[end] - prefix[start]) * down[start]


def gram_hash(prefix: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Mixed hash of every run of ``size`` bytes."""
    n = max(0, len(prefix) - size)
    _, down = powers(max(n, 1), which)
    return mix((prefix[size : size + n] - prefix[:n]) * down[:n])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    if len(a) < width:
        return a[:0]
    span = 1
    while 2 * span <= width:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    if span < width:
        a = np.minimum(a[: -(width - span)], a[width - span :])
    return a
