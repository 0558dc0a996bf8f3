"""Singular values and right singular vectors of a small triangular matrix, by a bidiagonal qd solver.

The matrix has as many rows as the data has dimensions, whatever the number of data rows.
Householder reflections from both sides make it upper bidiagonal; dqds with shifts finds
the squares of all singular values without subtractions that lose digits; each wanted
vector comes from the twisted factorisation of B'B - s I, joined where the remainder is
smallest, and is made orthogonal to those found before it, so equal values get a basis.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit u and value a with (I - 2 u u') x = a e1."""
    norm = float(np.linalg.norm(x))
    if norm == 0.0:
        return np.zeros(len(x)), 0.0
    a = -norm if x[0] > 0 else norm
    u = x.copy()
    u[0] -= a
    return u / np.linalg.norm(u), a


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, W): r = U B W' with U, W orthogonal and B upper bidiagonal."""
    b = np.array(r, float)
    n = len(b)
    w = np.eye(n)
    for k in range(n):
        u, _ = _reflector(b[k:, k])
        b[k:, k:] -= 2.0 * np.outer(u, u @ b[k:, k:])
        if k < n - 2:
            u, _ = _reflector(b[k, k + 1:])
            b[k:, k + 1:] -= 2.0 * np.outer(b[k:, k + 1:] @ u, u)
            w[:, k + 1:] -= 2.0 * np.outer(w[:, k + 1:] @ u, u)
    return np.diag(b).copy(), np.diag(b, 1).copy(), w


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One transform of the qd array less a shift, and the smallest d met."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = least = q[0] - shift
    for i in range(n - 1):
        new_q[i] = d + e[i]
        if new_q[i] == 0.0:
            new_q[i] = EPS * EPS * (abs(d) + abs(e[i]) + 1e-300)
        ratio = q[i + 1] / new_q[i]
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
        least = min(least, d)
    new_q[n - 1] = d
    return new_q, new_e, least


def squares(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The squared singular values of the bidiagonal matrix, largest first.

    A transform whose d turns negative was shifted too far and is tried again with a quarter of the shift, at last
    with none, which never fails. Values leave at the bottom once what couples them is below rounding.
    """
    q, e = [float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above]
    total = sum(q) + sum(e)
    floor = EPS * EPS * total
    found: list[float] = []
    parts = [(q, e, 0.0)]
    while parts:
        q, e, moved = parts.pop()
        steps = 0
        while q:
            n = len(q)
            if n == 1:
                found.append(q[0] + moved)
                break
            small = EPS * EPS
            split = next((i for i in range(n - 2, -1, -1) if e[i] <= small * (q[i] + q[i + 1] + moved) + floor * EPS), None)
            if split is not None:
                if split == n - 2:
                    found.append(q.pop() + moved)
                    e.pop()
                else:
                    parts.append((q[:split + 1], e[:split], moved))
                    q, e = q[split + 1:], e[split + 1:]
                steps = 0
                continue
            if n == 2:
                # of [[q1 + e1, .], [., q2]]: the sum and the product are known without subtraction
                half, product = (q[0] + q[1] + e[0]) / 2.0, q[0] * q[1]
                large = half + np.sqrt(max(half * half - product, 0.0))
                found += [float(large) + moved, (product / float(large) if large else 0.0) + moved]
                break
            # the smallest value is below every q met; the transform without shift tells how far below
            new_q, new_e, least = _dqds(q, e, 0.0)
            shift = 0.0 if steps > 60 * n else max(0.0, least - e[-1]) if e[-1] < least else least / (2.0 * n)
            q, e = new_q, new_e
            while shift > EPS * least:
                new_q, new_e, smallest = _dqds(q, e, shift)
                if smallest >= 0.0:
                    q, e, moved = new_q, new_e, moved + shift
                    break
                shift /= 4.0
            steps += 1
            if steps > 400 * n:
                raise ArithmeticError("the qd iteration does not converge")
    return np.sort(np.array(found))[::-1]


def _twisted(diagonal: np.ndarray, above: np.ndarray, value: float, at: int | None) -> tuple[np.ndarray, int, np.ndarray]:
    """The vector of the twisted factorisation of B'B - value I at the smallest remainder, or at a given twist."""
    n = len(diagonal)
    main = diagonal * diagonal
    main[1:] += above * above
    side = diagonal[:-1] * above
    tiny = EPS * (float(np.abs(main).max()) + 1e-300)
    down, up = np.empty(n), np.empty(n)
    down[0] = main[0] - value
    for i in range(1, n):
        if abs(down[i - 1]) < tiny * EPS:
            down[i - 1] = tiny * EPS
        down[i] = main[i] - value - side[i - 1] * side[i - 1] / down[i - 1]
    up[n - 1] = main[n - 1] - value
    for i in range(n - 2, -1, -1):
        if abs(up[i + 1]) < tiny * EPS:
            up[i + 1] = tiny * EPS
        up[i] = main[i] - value - side[i] * side[i] / up[i + 1]
    gamma = np.abs(down + up - (main - value))
    k = int(np.argmin(gamma)) if at is None else at
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -side[i] * z[i + 1] / down[i]
    for i in range(k + 1, n):
        z[i] = -side[i - 1] * z[i - 1] / up[i]
        if not np.isfinite(z[i]):
            break
    z[~np.isfinite(z)] = 0.0
    return z / np.linalg.norm(z), k, gamma


def vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of B'B, one column for each of ``values`` (descending)."""
    n = len(diagonal)
    out = np.zeros((n, len(values)))
    for j, value in enumerate(values):
        z, k, gamma = _twisted(diagonal, above, float(value), None)
        before = out[:, :j]
        order = [int(i) for i in np.argsort(gamma, kind="stable") if i != k]
        while True:
            rest = z - before @ (before.T @ z)
            rest -= before @ (before.T @ rest)
            # in a group of equal values another twist gives a vector that the ones before do not hold
            if np.linalg.norm(rest) > 0.1 or not order:
                break
            z, _, _ = _twisted(diagonal, above, float(value), order.pop(0))
        out[:, j] = rest / np.linalg.norm(rest)
    return out


def right_vectors(r: np.ndarray, count: int, tolerance: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(squares, directions): all squared singular values of ``r``, and the directions of the ``count`` largest.

    Fewer directions come back where the matrix has a smaller rank: values below ``tolerance`` of the largest, as
    large as rounding in ``r`` itself, have none.
    """
    n = len(r)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    scale = float(np.abs(r).max())
    if scale == 0.0 or not np.isfinite(scale):
        return np.zeros(n), np.zeros((n, 0))
    diagonal, above, w = bidiagonal(r / scale)
    found = np.maximum(squares(diagonal, above), 0.0)
    least = (n * EPS) ** 2 * 16 if tolerance is None else tolerance
    count = min(count, int((found > least * found[0]).sum()))
    return found * scale * scale, w @ vectors(diagonal, above, found[:count])
