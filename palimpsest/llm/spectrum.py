"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

Sylvester's law: in a factorisation ``A - s I = P L D L' P'`` the blocks of D have as many negative eigenvalues as A has
eigenvalues below s. Such inertia counts bisect the axis until every leading eigenvalue lies alone in an interval (or
within a cluster narrower than the rounding of the matrix). Inside its interval an eigenvalue is polished by Rayleigh
quotient iteration, which converges cubically, and two more counts, just below and just above the value found,
certify its number. The matrix is dim x dim: its size does not depend on how many rows it was made from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bunch and Kaufman's bound on the growth of the pivots.
_ALPHA = (1 + 17**0.5) / 8


def inertia_below(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``matrix`` are below ``shift``: the negative eigenvalues of D in an
    LDL' factorisation with Bunch-Kaufman pivoting (blocks of one or two rows). A pivot of exactly zero counts as above."""
    a = np.array(matrix, np.float64)
    n = len(a)
    a[np.diag_indices(n)] -= shift
    below, k = 0, 0
    while k < n:
        column = np.abs(a[k + 1:, k])
        r = k + 1 + int(column.argmax()) if len(column) else k
        largest = column[r - k - 1] if len(column) else 0.0
        size = 1
        if max(abs(a[k, k]), largest) == 0.0:
            k += 1  # the rest of this row is zero: an eigenvalue at the shift itself
            continue
        if abs(a[k, k]) < _ALPHA * largest:
            other = np.abs(a[r, k:])
            other[r - k] = 0.0
            sigma = other.max()
            if abs(a[k, k]) * sigma >= _ALPHA * largest * largest:
                p = k
            elif abs(a[r, r]) >= _ALPHA * sigma:
                p = r
            else:
                p, size = r, 2
            at = k + size - 1
            if p != at:
                a[[at, p], k:] = a[[p, at], k:]
                a[k:, [at, p]] = a[k:, [p, at]]
        if size == 1:
            pivot = a[k, k]
            below += pivot < 0
            low = a[k + 1:, k] / pivot
            a[k + 1:, k + 1:] -= np.outer(low, a[k, k + 1:])
        else:
            block = a[k: k + 2, k: k + 2]
            det = block[0, 0] * block[1, 1] - block[0, 1] * block[1, 0]
            below += 1 if det < 0 else 2 * (block[0, 0] + block[1, 1] < 0)
            inverse = np.array([[block[1, 1], -block[0, 1]], [-block[1, 0], block[0, 0]]]) / det
            low = a[k + 2:, k: k + 2]
            a[k + 2:, k + 2:] -= low @ inverse @ low.T
        k += size
    return int(below)


@dataclass
class Eigenpairs:
    """Eigenvalues from the largest down, their unit vectors as columns, and the counts that certify the numbers:
    ``above[i]`` eigenvalues lie above the upper end of value i's bracket, ``upto[i]`` above its lower end."""

    values: np.ndarray
    vectors: np.ndarray
    above: np.ndarray
    upto: np.ndarray


def _slices(matrix: np.ndarray, k: int, width: float) -> list[tuple[float, float, int, int]]:
    """(low, high, eigenvalues above high, eigenvalues above low) of disjoint intervals from the top down that hold the
    k largest eigenvalues: each holds one, or is no wider than ``width``."""
    n = len(matrix)
    radius = np.abs(matrix).sum(axis=1) - np.abs(np.diag(matrix))
    low, high = float((np.diag(matrix) - radius).min()) - width, float((np.diag(matrix) + radius).max()) + width
    open_, out = [(low, high, 0, n)], []
    while open_:
        low, high, above, upto = open_.pop()
        if above >= k or above == upto:
            continue
        if upto - above == 1 or high - low <= width:
            out.append((low, high, above, upto))
            continue
        middle = (low + high) / 2
        at = n - inertia_below(matrix, middle)
        open_ += [(low, middle, at, upto), (middle, high, above, at)]  # the upper half is looked at first
    return out


def _rayleigh(matrix: np.ndarray, rho: float, still: int, others: np.ndarray, scale: float, seed: int) -> tuple[float, np.ndarray] | None:
    """An eigenpair orthogonal to the columns of ``others``: ``still`` turns of inverse iteration at ``rho``, then the
    Rayleigh quotient as shift. None where the iteration does not settle."""
    n = len(matrix)
    x = np.random.default_rng(seed).standard_normal(n)
    tiny = 4 * np.finfo(float).eps * scale
    identity = np.eye(n)
    best = np.inf
    for turn in range(still + 40):
        try:
            y = np.linalg.solve(matrix - rho * identity, x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(matrix - (rho + tiny) * identity, x)
        y -= others @ (others.T @ y)
        x = y / np.linalg.norm(y)
        x -= others @ (others.T @ x)
        x /= np.linalg.norm(x)
        value = float(x @ matrix @ x)
        residual = float(np.linalg.norm(matrix @ x - value * x))
        if turn >= still and residual >= best / 2 and residual <= 64 * tiny * n**0.5:
            return value, x
        best = min(best, residual)
        if turn >= still:
            rho = value
    return None


def leading(matrix: np.ndarray, k: int) -> Eigenpairs:
    """The ``k`` largest eigenvalues of a symmetric matrix (all, if it has fewer) with orthonormal vectors.

    Equal eigenvalues share one bracket; any orthonormal vectors of their space are given. A matrix without rows has
    no pairs. Raises ArithmeticError if the counts do not bear out a value's number."""
    matrix = (matrix + matrix.T) / 2
    n = len(matrix)
    k = min(k, n)
    scale = float(np.abs(matrix).sum(axis=1).max()) if n else 0.0
    values, vectors = np.zeros(k), np.zeros((n, k))
    above, upto = np.zeros(k, np.int64), np.zeros(k, np.int64)
    if scale == 0.0:
        vectors[np.arange(k), np.arange(k)] = 1.0
        return Eigenpairs(values, vectors, above, upto + n)
    width = 256 * n * np.finfo(float).eps * scale
    for low, high, over, under in _slices(matrix, k, width):
        for at in range(over, min(under, k)):
            a, b, still = low, high, 2
            while True:
                pair = _rayleigh(matrix, (a + b) / 2, still, vectors[:, :at], scale, at)
                if pair is not None:
                    ends = n - inertia_below(matrix, pair[0] + width), n - inertia_below(matrix, pair[0] - width)
                    if ends[0] <= at < ends[1]:
                        break  # certified: at most ``at`` eigenvalues lie above it, at least ``at + 1`` above or at it
                if still > 60:
                    raise ArithmeticError(f"the counts do not certify eigenvalue {at + 1} between {low} and {high}")
                middle = (a + b) / 2
                a, b = (middle, b) if n - inertia_below(matrix, middle) > at else (a, middle)
                still += 1  # a narrower start, and more turns before the shift may move
            values[at], vectors[:, at] = pair
            above[at], upto[at] = ends
    order = np.argsort(-values, kind="stable")
    return Eigenpairs(values[order], vectors[:, order], above[order], upto[order])
