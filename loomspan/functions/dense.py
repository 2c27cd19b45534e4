"""Dense algebra for one cross-section: projections, constrained least squares, robust fits, spectra.

These run inside grouped functions, one group (a date, a window) at a time; a group holds a cross-section, whose size
does not grow with history.
"""

from __future__ import annotations

import numpy as np


def residualize(y: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """y less its weighted projection on x's columns; rank-deficient columns do no harm."""
    root = np.sqrt(w)
    beta = np.linalg.lstsq(x * root[:, None], y * root, rcond=1e-12)[0]
    return y - x @ beta


def null_space(c: np.ndarray) -> np.ndarray:
    """An orthonormal basis, in columns, of the x with c @ x = 0."""
    _, s, vt = np.linalg.svd(c, full_matrices=True)
    return vt[int((s > 1e-12 * max(1.0, s.max(initial=0.0))).sum()) :].T


def constrained_wls(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Coefficients of least weighted squares with c @ beta = 0, solved in the constraint's null space with columns
    scaled to unit length."""
    scale = np.sqrt((w[:, None] * x * x).sum(axis=0))
    scale[scale == 0] = 1.0
    basis = null_space(c / scale)
    root = np.sqrt(w)
    z = np.linalg.lstsq((x / scale) @ basis * root[:, None], y * root, rcond=1e-12)[0]
    return basis @ z / scale


def huber(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: np.ndarray, k: float = 1.345, steps: int = 25, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Constrained fit with Huber weights on whitened residuals; the scale is their median absolute value / 0.67449."""
    down = np.ones(len(y))
    beta = constrained_wls(x, y, w, c)
    for _ in range(steps):
        white = np.sqrt(w) * (y - x @ beta)
        scale = np.median(np.abs(white)) / 0.67449
        if scale <= 0:
            break
        down = np.minimum(1.0, k * scale / np.maximum(np.abs(white), 1e-300))
        new = constrained_wls(x, y, w * down, c)
        if np.max(np.abs(new - beta)) <= tolerance * max(1.0, np.max(np.abs(beta))):
            beta = new
            break
        beta = new
    return beta, down


def scaled_rank(x: np.ndarray) -> int:
    norm = np.linalg.norm(x, axis=0)
    s = np.linalg.svd(x / np.where(norm > 0, norm, 1.0), compute_uv=False)
    return int((s > s.max(initial=0.0) * max(x.shape) * np.finfo(float).eps).sum())


def spectrum(residuals: np.ndarray) -> tuple[np.ndarray, float]:
    """Eigenvalues, descending, of the correlation of columns (assets) over rows (days), and the noise edge
    (1 + sqrt(assets / days)) ** 2."""
    z = residuals - residuals.mean(axis=0)
    sd = z.std(axis=0)
    z = z[:, sd > 0] / sd[sd > 0]
    t, n = z.shape
    values = np.linalg.eigvalsh(z.T @ z / t if n <= t else z @ z.T / t)[::-1]
    return values, float((1 + np.sqrt(n / t)) ** 2)


def principal_angle(a: np.ndarray, b: np.ndarray) -> float:
    """Largest angle, in radians, between the column spaces."""
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    return float(np.arccos(np.clip(np.linalg.svd(qa.T @ qb, compute_uv=False).min(initial=1.0), -1, 1)))


def newey_west(values: np.ndarray, lag: int) -> tuple[float, float]:
    """Mean and its standard error under Bartlett weights."""
    v = values - values.mean()
    total = (v * v).mean() + 2 * sum((1 - k / (lag + 1)) * (v[k:] * v[:-k]).sum() / len(v) for k in range(1, min(lag, len(v) - 1) + 1))
    return float(values.mean()), float(np.sqrt(max(total, 0.0) / len(v)))


def wilson(passed: int, n: int, z: float = 1.959963984540054) -> tuple[float, float]:
    p, d = passed / n, 1 + z * z / n
    half = z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return float((p + z * z / (2 * n)) / d - half), float((p + z * z / (2 * n)) / d + half)
