"""Smoothing kernels as closed forms."""

from __future__ import annotations

import numpy as np

# Cosine-sum coefficients per kernel: w(k) = a0 - a1 cos(x) + a2 cos(2x), x = 2 pi k / (n-1).
# Fixed values.
COSINE_SUMS = {
    "hanning": (0.5, 0.5, 0.0),
    "hamming": (0.54, 0.46, 0.0),
    "blackman": (0.42, 0.5, 0.08),
}

KERNELS = ["flat", "hanning", "hamming", "bartlett", "blackman"]


def kernel(name: str, length: int) -> np.ndarray:
    """The kernel's weights, scaled to sum 1."""
    k = np.arange(length)
    if name == "flat":
        weights = np.ones(length)
    elif name == "bartlett":
        weights = 1 - np.abs(2 * k / (length - 1) - 1)
    elif name in COSINE_SUMS:
        a0, a1, a2 = COSINE_SUMS[name]
        x = 2 * np.pi * k / (length - 1)
        weights = a0 - a1 * np.cos(x) + a2 * np.cos(2 * x)
    else:
        raise ValueError(f"kernel must be one of {KERNELS}: {name!r}")
    return weights / weights.sum()
