"""Orthogonal wavelets: taps by spectral factorisation, transforms, thresholds."""

from __future__ import annotations

from functools import cache
from itertools import product
from math import comb

import numpy as np


@cache
def scaling_taps(name: str) -> np.ndarray:
    """Reconstruction low-pass taps of dbN (extremal phase) or symN (least
    asymmetric), out of the roots of Daubechies' polynomial."""
    n = int("".join(c for c in name if c.isdigit()))
    y = np.roots([comb(n - 1 + k, k) for k in range(n - 1, -1, -1)]) if n > 1 else np.zeros(0)
    groups = []
    for r in y[y.imag >= -1e-12]:
        z = np.roots([1, 4 * r - 2, 1])
        inner, outer = z[np.abs(z) < 1], z[np.abs(z) >= 1]
        pair = lambda q: np.concatenate([q, q.conj()]) if abs(r.imag) > 1e-12 else q.real.astype(complex)  # noqa: E731, B023
        groups.append((pair(inner), pair(outer)))
    best = None
    for choice in product(*([(0, 1)] * len(groups))) if name.startswith("sym") else [(0,) * len(groups)]:
        roots = np.concatenate([g[c] for g, c in zip(groups, choice, strict=True)]) if groups else np.zeros(0)
        h = np.poly(np.concatenate([-np.ones(n), roots])).real
        h = h / h.sum() * np.sqrt(2)
        w = np.linspace(0.05, np.pi * 0.6, 64)
        phase = np.unwrap(np.angle(np.exp(-1j * np.outer(w, np.arange(len(h)))) @ h))
        bent = np.std(phase - np.polyval(np.polyfit(w, phase, 1), w))
        if best is None or bent < best[0]:
            best = (bent, h)
    return best[1]


@cache
def filters(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Decomposition low and high, reconstruction low and high."""
    low = scaling_taps(name)
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    return low[::-1], high[::-1], low, high


def dwt(x: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """One level, half-point symmetric extension."""
    lo, hi, _, _ = filters(name)
    wide = np.pad(x, len(lo) - 1, mode="symmetric")
    return tuple(np.convolve(wide, f, "valid")[1::2] for f in (lo, hi))


def idwt(a: np.ndarray, d: np.ndarray, name: str) -> np.ndarray:
    _, _, lo, hi = filters(name)
    m, k = len(d), len(lo)
    out = np.zeros(2 * m - 1 + k - 1)
    for c, f in ((a[:m], lo), (d, hi)):
        up = np.zeros(2 * m - 1)
        up[::2] = c
        out += np.convolve(up, f)
    return out[k - 2 : k - 2 + 2 * m - k + 2]


def wavedec(x: np.ndarray, name: str, level: int) -> list[np.ndarray]:
    """[approximation, coarsest detail, ..., finest detail]."""
    out = []
    for _ in range(level):
        x, d = dwt(x, name)
        out.append(d)
    return [x, *out[::-1]]


def waverec(coefficients: list[np.ndarray], name: str) -> np.ndarray:
    a = coefficients[0]
    for d in coefficients[1:]:
        a = idwt(a[: len(d)], d, name)
    return a


def max_level(n: int, name: str) -> int:
    k = len(scaling_taps(name))
    return max(0, int(np.floor(np.log2(n / (k - 1))))) if n >= k - 1 else 0


def shrink(c: np.ndarray, t: float, mode: str = "soft") -> np.ndarray:
    if mode == "soft":
        return np.sign(c) * np.maximum(np.abs(c) - t, 0)
    if mode == "hard":
        return np.where(np.abs(c) >= t, c, 0.0)
    if mode == "garrote":
        return np.where(np.abs(c) > t, c - t * t / np.where(c == 0, 1, c), 0.0)
    if mode == "greater":
        return np.where(c >= t, c, 0.0)
    if mode == "less":
        return np.where(c <= t, c, 0.0)
    raise ValueError(f"unknown threshold mode {mode!r}")


def robust_sigma(c: np.ndarray) -> float:
    return float(np.median(np.abs(c)) / 0.6745)


def universal(n: int, sigma: float) -> float:
    return sigma * np.sqrt(2 * np.log(n))


def shrunk(x: np.ndarray, name: str, level: int, threshold, mode: str = "soft") -> np.ndarray:
    """Decompose, shrink every detail by ``threshold`` (a number, or a function
    of the coefficient list that returns one per detail), rebuild."""
    c = wavedec(x, name, level)
    t = threshold(c) if callable(threshold) else threshold
    t = np.broadcast_to(t, len(c) - 1)
    return waverec([c[0], *(shrink(d, s, mode) for d, s in zip(c[1:], t, strict=True))], name)[: len(x)]


def packet(x: np.ndarray, name: str, level: int, treat) -> np.ndarray:
    """Full packet tree to ``level``; ``treat`` maps each leaf."""
    if level == 0:
        return treat(x)
    parts = [packet(c, name, level - 1, treat) for c in dwt(x, name)]
    return idwt(*parts, name)[: len(x)]


def best_basis(x: np.ndarray, name: str, level: int, treat, energy: float | None = None) -> tuple[float, np.ndarray]:
    """The packet basis of least Shannon entropy (of the squared coefficients'
    shares of the whole energy): its cost, and x rebuilt with every leaf treated."""
    energy = float(np.sum(x * x)) + 1e-300 if energy is None else energy
    share = x * x / energy
    cost, here = -float(np.sum(share * np.log2(share + 1e-300))), treat(x)
    if level == 0 or len(x) < 2:
        return cost, here
    parts = [best_basis(c, name, level - 1, treat, energy) for c in dwt(x, name)]
    if parts[0][0] + parts[1][0] >= cost:
        return cost, here
    return parts[0][0] + parts[1][0], idwt(parts[0][1], parts[1][1], name)[: len(x)]


def swt_shrunk(x: np.ndarray, name: str, level: int, treat) -> np.ndarray:
    """Undecimated transform with periodic ends; ``treat`` maps the list of
    details, coarsest first."""
    lo, hi, _, _ = filters(name)
    n, a, details = len(x), x, []
    shift = np.arange(len(lo)) - len(lo) // 2

    def apply(c, f, step, sign):
        return sum(t * np.roll(c, sign * step * s) for t, s in zip(f, shift, strict=True))

    for j in range(level):
        details.append(apply(a, hi, 2**j, 1))
        a = apply(a, lo, 2**j, 1)
    details = treat(details[::-1], n)
    for j, d in zip(range(level - 1, -1, -1), details, strict=True):
        a = (apply(a, lo, 2**j, -1) + apply(d, hi, 2**j, -1)) / 2
    return a
