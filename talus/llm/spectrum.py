"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The inertia of A - s I, read off the pivots of an LDL' factorisation, counts
the eigenvalues above s. Bisection on these counts isolates each wanted
eigenvalue. Rayleigh quotient iteration then converges cubically from within
its interval, and counts on either side of the result certify its number.
Eigenvalues that no shift tells apart at double precision share an interval;
an orthonormal basis of their space is found by inverse iteration.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_GROWTH = (1 + np.sqrt(17)) / 8
EPS = np.finfo(float).eps
# An interval narrower than this share of the matrix norm counts as one point.
POINT = 64 * EPS
ROUNDS = 30


def count_above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``a`` exceed ``shift``: positive pivots of a pivoted LDL' factorisation.

    Pivots are single diagonal entries or 2 x 2 blocks, chosen by the partial
    search of Bunch and Kaufman; a block has one positive and one negative value.
    """
    m = a - shift * np.eye(len(a))
    above = 0
    while len(m):
        column = np.abs(m[1:, 0])
        width = 1
        if len(column) and column.max() > 0:
            r = int(column.argmax()) + 1
            most, own = column[r - 1], abs(m[0, 0])
            if own < _GROWTH * most:
                others = np.abs(np.delete(m[r], r)).max()
                if own * others < _GROWTH * most * most:
                    to = 0 if abs(m[r, r]) >= _GROWTH * others else 1
                    width = 1 + to
                    if to != r:
                        m[[to, r]] = m[[r, to]]
                        m[:, [to, r]] = m[:, [r, to]]
        pivot, side, rest = m[:width, :width], m[width:, :width], m[width:, width:]
        if width == 2:
            above += int((np.linalg.eigvalsh(pivot) > 0).sum())
            m = rest - side @ np.linalg.solve(pivot, side.T)
        else:
            above += int(pivot[0, 0] > 0)
            m = rest - np.outer(side[:, 0], side[:, 0] / pivot[0, 0]) if pivot[0, 0] else rest.copy()
    return above


@dataclass
class Slice:
    """An interval (low, high] that holds the eigenvalues numbered first+1 .. last, by falling value."""

    low: float
    high: float
    first: int
    last: int


def isolate(a: np.ndarray, wanted: int, scale: float) -> list[Slice]:
    """Intervals of one eigenvalue each, or of several that are one point, for the ``wanted`` largest."""
    reach = scale * (1 + 1e-8)
    open_, done = [Slice(-reach, reach, 0, len(a))], []
    while open_:
        s = open_.pop()
        if s.first >= wanted or s.first == s.last:
            continue
        if s.last - s.first == 1 or s.high - s.low <= POINT * scale:
            done.append(s)
            continue
        middle = (s.low + s.high) / 2
        cut = min(max(count_above(a, middle), s.first), s.last)
        open_ += [Slice(s.low, middle, cut, s.last), Slice(middle, s.high, s.first, cut)]
    return sorted(done, key=lambda s: s.first)


def _solve(a: np.ndarray, shift: float, right: np.ndarray, scale: float) -> np.ndarray:
    """(a - shift I)^-1 right, with the shift moved off an eigenvalue it hits exactly."""
    for step in range(8):
        try:
            found = np.linalg.solve(a - (shift + step * EPS * scale) * np.eye(len(a)), right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all():
            return found
    raise ArithmeticError("no shift near the eigenvalue gives a solution")


def _residual(a: np.ndarray, v: np.ndarray) -> tuple[float, float]:
    value = float(v @ a @ v)
    return value, float(np.linalg.norm(a @ v - value * v))


def _refined(a: np.ndarray, s: Slice, scale: float, rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """The one eigenpair within a slice; the slice is halved as long as the iteration leaves it."""
    low, high = s.low, s.high
    while True:
        v = rng.standard_normal(len(a))
        for _ in range(2):
            v = _solve(a, (low + high) / 2, v, scale)
            v /= np.linalg.norm(v)
        value, left = _residual(a, v)
        best = value, left, v
        for _ in range(ROUNDS):
            if not low < value <= high:
                break
            v = _solve(a, value, v, scale)
            v /= np.linalg.norm(v)
            value, left = _residual(a, v)
            if low < value <= high and left < best[1]:
                best = value, left, v
            elif best[1] <= 1e-12 * scale:
                break
        value, left, v = best
        if low < value <= high and left <= 1e-12 * scale and _certified(a, value, left, s, scale):
            return value, v
        if high - low <= POINT * scale:
            return float(v @ a @ v), v
        middle = (low + high) / 2
        low, high = (low, middle) if count_above(a, middle) <= s.first else (middle, high)


def _certified(a: np.ndarray, value: float, left: float, s: Slice, scale: float) -> bool:
    """Counts just above and just below say that this is eigenvalue number ``s.last``."""
    off = 4 * left + POINT * scale
    return count_above(a, value + off) <= s.first and count_above(a, value - off) >= s.last


def leading(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as rows) of the ``wanted`` largest eigenvalues, largest first."""
    wanted = min(wanted, len(a))
    scale = float(np.linalg.norm(a))
    if scale == 0:
        return np.zeros(wanted), np.eye(len(a))[:wanted]
    rng = np.random.default_rng(12)
    values, vectors = [], np.zeros((0, len(a)))
    for s in isolate(a, wanted, scale):
        if s.last - s.first == 1:
            value, v = _refined(a, s, scale, rng)
            values.append(value)
            vectors = np.vstack([vectors, v])
            continue
        block = rng.standard_normal((len(a), s.last - s.first))
        for _ in range(4):
            block = np.linalg.qr(_solve(a, (s.low + s.high) / 2, block, scale))[0]
            block = np.linalg.qr(block - vectors.T @ (vectors @ block))[0]
        own = np.einsum("ij,ij->j", block, a @ block)
        order = np.argsort(-own, kind="stable")
        values += own[order].tolist()
        vectors = np.vstack([vectors, block.T[order]])
    # Vectors of close eigenvalues are made orthogonal; those of distant ones are so already.
    for i in range(1, wanted):
        vectors[i] -= vectors[:i].T @ (vectors[:i] @ vectors[i])
        vectors[i] /= np.linalg.norm(vectors[i])
    return np.array(values[:wanted]), vectors[:wanted]
