"""Eigenvectors of a symmetric matrix by spectral divide and conquer with polar decompositions (QDWH)."""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a by the QR-based dynamically weighted Halley iteration.

    Every step maps the singular values by a rational function whose weights follow their lower bound, so that
    all of them reach 1 in about six steps whatever the condition is.
    """
    n = len(a)
    norm = np.linalg.norm(a)
    if norm == 0:
        return np.zeros_like(a)
    x = a / norm
    bound = _EPS
    for _ in range(40):
        square = bound * bound
        root = np.cbrt(4.0 * (1.0 - square) / square**2)
        first = np.sqrt(1.0 + root) + 0.5 * np.sqrt(8.0 - 4.0 * root + 8.0 * (2.0 - square) / (square * np.sqrt(1.0 + root)))
        second = (first - 1.0) ** 2 / 4.0
        third = first + second - 1.0
        q, _ = np.linalg.qr(np.vstack([np.sqrt(third) * x, np.eye(n)]))
        step = (second / third) * x + (first - second / third) / np.sqrt(third) * (q[:n] @ q[n:].T)
        step = (step + step.T) / 2.0
        moved = np.linalg.norm(step - x)
        x = step
        bound = min(1.0, bound * (first + second * square) / (1.0 + third * square))
        if moved < np.cbrt(_EPS) * 1e-3 and bound > 1.0 - 10 * _EPS:
            break
    return x


def _shifts(a: np.ndarray) -> list[float]:
    """Candidate shifts between the least and the greatest eigenvalue: around the middle of the diagonal first."""
    diagonal = np.sort(np.diag(a))
    half = len(a) // 2
    gaps = np.argsort(-np.diff(diagonal), kind="stable")[:8]
    wide = [(diagonal[i] + diagonal[i + 1]) / 2.0 for i in gaps]
    off = np.abs(a - np.diag(np.diag(a))).sum(axis=1).max()
    return [(diagonal[half - 1] + diagonal[half]) / 2.0, float(diagonal.mean()), *wide, *(diagonal.mean() + off * np.array([0.1, -0.1, 0.3, -0.3]))]


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, int]:
    """An orthogonal basis whose first columns span the eigenvectors above the shift, and how many they are."""
    n = len(a)
    projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2.0
    k = int(round(float(np.trace(projector))))
    if not 0 < k < n:
        return np.eye(n), 0
    # Columns of the projector with the largest norms first, then one more multiplication for a clean range.
    order = np.argsort(-np.einsum("ij,ij->j", projector, projector), kind="stable")
    basis, _ = np.linalg.qr(projector[:, order[:k]])
    basis, _ = np.linalg.qr(projector @ basis)
    full, _ = np.linalg.qr(np.hstack([basis, np.eye(n) - projector]), mode="complete")
    full[:, :k] = basis
    return full, k


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns), values falling.

    The polar factor of the shifted matrix is the sign of its eigenvalues on their own vectors; half of it plus half the identity
    projects on the eigenvectors above the shift. Both invariant subspaces are divided again, down to single vectors.
    A shift that hits an eigenvalue leaves the two blocks coupled and is replaced by another.
    """
    a = (a + a.T) / 2.0
    scale = np.linalg.norm(a)
    values, vectors = _divide(a, scale)
    if np.abs(a @ vectors - vectors * values).max(initial=0.0) > 1e-12 * max(scale, np.finfo(float).tiny) * max(1, len(a)):
        raise ArithmeticError("the invariant subspaces could not be told apart")
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _divide(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    n = len(a)
    level = float(np.trace(a)) / n
    if n == 1 or np.linalg.norm(a - level * np.eye(n)) <= n * _EPS * scale:
        return np.diag(a).copy(), np.eye(n)
    best = None
    for shift in _shifts(a):
        basis, k = _split(a, shift)
        if not k:
            continue
        turned = basis.T @ a @ basis
        coupled = np.linalg.norm(turned[k:, :k])
        if best is None or coupled < best[0]:
            best = coupled, basis, k, turned
        if coupled <= 4 * n * _EPS * scale:
            break
    if best is None:
        return np.diag(a).copy(), np.eye(n)
    _, basis, k, turned = best
    turned = (turned + turned.T) / 2.0
    upper, lower = _divide(turned[:k, :k], scale), _divide(turned[k:, k:], scale)
    vectors = np.hstack([basis[:, :k] @ upper[1], basis[:, k:] @ lower[1]])
    return np.concatenate([upper[0], lower[0]]), vectors
