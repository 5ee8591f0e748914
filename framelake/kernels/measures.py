"""Measures of images in numpy, for stacks of images of one size at once; no Spark here.

luma is (n, h, w) int64, rgb (n, h, w, 3) int64; each function gives one value for each image.
"""

from __future__ import annotations

import numpy as np


def laplacian(luma: np.ndarray) -> np.ndarray:
    """The mean square of the 4-neighbour Laplacian over inner pixels, 0 without one."""
    n, h, w = luma.shape
    if h < 3 or w < 3:
        return np.zeros(n)
    value = luma[:, 1:-1, :-2] + luma[:, 1:-1, 2:] + luma[:, :-2, 1:-1] + luma[:, 2:, 1:-1] - 4 * luma[:, 1:-1, 1:-1]
    return (value * value).sum((1, 2)) / ((h - 2) * (w - 2))


def edge_density(luma: np.ndarray) -> np.ndarray:
    """The share of inner pixels that differ by over 30 from the right or lower one; NaN without any."""
    n, h, w = luma.shape
    if h < 3 or w < 3:
        return np.full(n, np.nan)
    inner = luma[:, 1:-1, 1:-1]
    hit = (np.abs(inner - luma[:, 1:-1, 2:]) > 30) | (np.abs(inner - luma[:, 2:, 1:-1]) > 30)
    return hit.sum((1, 2)) / ((h - 2) * (w - 2))


def noise(luma: np.ndarray) -> np.ndarray:
    """From the least variance of 8x8 blocks that begin before size - 8: 10 times its root, 100 at most or without a block."""
    n, h, w = luma.shape
    rows, columns = len(range(0, h - 8, 8)), len(range(0, w - 8, 8))
    if not rows or not columns:
        return np.full(n, 100.0)
    blocks = luma[:, : 8 * rows, : 8 * columns].reshape(n, rows, 8, columns, 8)
    mean = blocks.sum((2, 4)) / 64
    least = ((blocks * blocks).sum((2, 4)) / 64 - mean * mean).min((1, 2))
    return np.minimum(100.0, np.sqrt(np.maximum(0.0, least)) * 10)


def artifacts(luma: np.ndarray) -> np.ndarray:
    """Whether steps across the 8-pixel grid are over 1.3 times as large as others, in images of 32 pixels and more."""
    n, h, w = luma.shape
    if h < 32 or w < 32:
        return np.zeros(n, bool)
    dx, dy = np.abs(np.diff(luma, axis=2)), np.abs(np.diff(luma, axis=1))
    on_x, on_y = np.arange(1, w) % 8 == 0, np.arange(1, h) % 8 == 0
    share = lambda x, y: (dx[:, :, x].sum((1, 2)) + dy[:, y].sum((1, 2))) / (h * x.sum() + w * y.sum())
    return share(on_x, on_y) > share(~on_x, ~on_y) * 1.3


def histograms(luma: np.ndarray) -> np.ndarray:
    """(n, 256) counts."""
    n = len(luma)
    places = (np.arange(n)[:, None] * 256 + luma.reshape(n, -1)).ravel()
    return np.bincount(places, minlength=256 * n).reshape(n, 256)


def entropy(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(1, keepdims=True)
    p = counts / np.maximum(1, total)
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(1)


def tone(luma: np.ndarray) -> dict[str, np.ndarray]:
    """Entropy, median bin (the first with at least total div 2 up to it), first and last bin, mean, deviation."""
    counts = histograms(luma)
    total, bins = counts.sum(1), np.arange(256)
    p = counts / total[:, None]
    mean = (p * bins).sum(1)
    deviation = np.sqrt(np.maximum(0.0, (p * bins * bins).sum(1) - mean * mean))
    median = ((np.cumsum(counts, 1) >= (total // 2)[:, None]) & (counts > 0)).argmax(1)
    return {"entropy": entropy(counts), "median_brightness": median, "low": (counts > 0).argmax(1), "high": 255 - (counts[:, ::-1] > 0).argmax(1), "mean": mean, "deviation": deviation}


def colors(rgb: np.ndarray) -> dict[str, np.ndarray]:
    """Mean HSV saturation in percent, and the entropy of hues (whole degrees of coloured pixels) over 8.5 in percent."""
    n = len(rgb)
    r, g, b = (rgb[..., k].reshape(n, -1) for k in range(3))
    top, span = np.maximum(np.maximum(r, g), b), 0
    span = (top - np.minimum(np.minimum(r, g), b)).astype(float)
    some = np.where(span > 0, span, 1.0)
    saturation = np.where(top > 0, span / np.maximum(1, top), 0.0).sum(1) / r.shape[1] * 100
    hue = np.where(r == top, (g - b) / some, np.where(g == top, 2 + (b - r) / some, 4 + (r - g) / some)) * 60
    hue = np.floor(np.where(hue < 0, hue + 360, hue) + 1e-9).astype(np.int64)
    places = (np.arange(n)[:, None] * 361 + hue)[span > 0]
    counts = np.bincount(places, minlength=361 * n).reshape(n, 361)
    return {"saturation": saturation, "hue_variety": np.minimum(100.0, entropy(counts) / 8.5 * 100)}


def means(rgb: np.ndarray) -> np.ndarray:
    """(n, 3) means of the channels."""
    return rgb.sum((1, 2)) / (rgb.shape[1] * rgb.shape[2])


def luma(rgb: np.ndarray) -> np.ndarray:
    return np.floor(rgb[..., 0] * 0.2126 + rgb[..., 1] * 0.7152 + rgb[..., 2] * 0.0722 + 0.5).astype(np.int64)


def hough(hit: np.ndarray, step: int = 1) -> tuple[int, int, int]:
    """Of one image's edge pixels: the angle from -90 to 89 whose line gathers most, its votes, and all pixels.

    Of equal angles the one nearest to 0 counts, then the lesser.
    """
    y, x = np.nonzero(hit)
    best = (0, 0, 0)
    for theta in sorted(range(-90, 90, step), key=lambda t: (abs(t), t)):
        turn = np.radians(float(theta))
        rho = np.floor(y * np.cos(turn) - x * np.sin(turn) + (0.5 + 1e-9)).astype(np.int64)
        votes = int(np.bincount(rho - rho.min()).max()) if len(rho) else 0
        if votes > best[1]:
            best = (theta, votes, len(x))
    return best


def differences(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Sum of squares, differing pixels and greatest difference of two (channels, pixels) arrays."""
    d = np.abs(a - b)
    most = d.max(0) if d.size else np.zeros(0, np.int64)
    return int((d * d).sum()), int((most > 0).sum()), int(most.max(initial=0))


def ssim(a: np.ndarray, b: np.ndarray) -> float | None:
    """SSIM of whole images in one window, with sample variances."""
    n = a.size
    if n < 2:
        return None
    ma, mb = a.sum() / n, b.sum() / n
    va, vb = ((a - ma) ** 2).sum() / (n - 1), ((b - mb) ** 2).sum() / (n - 1)
    cov = ((a - ma) * (b - mb)).sum() / (n - 1)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float(((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2)))
