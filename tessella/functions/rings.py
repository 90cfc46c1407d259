"""Frequency rings of an image in numpy, for kernels that hold one image: the same rings as ``operators.imaging``."""

from __future__ import annotations

import math

import numpy as np

CORNER = math.sqrt(2) / 2


def axis(bins: int) -> np.ndarray:
    return np.arange(bins) * CORNER / (bins - 1)


def radii(h: int, w: int) -> np.ndarray:
    """Of the half spectrum of an (h, w) image, in cycles per pixel."""
    return np.hypot(np.fft.fftfreq(h)[:, None], np.fft.rfftfreq(w)[None, :])


class Rings:
    """Each cell is split linearly between its two rings, by Hermitian weight over the image's size."""

    def __init__(self, h: int, w: int, bins: int):
        step, radius = CORNER / (bins - 1), radii(h, w)
        right = np.ceil(np.round(radius / step, 9)).astype(int)
        self.bins, self.hi, self.lo = bins, np.minimum(right, bins - 1).ravel(), np.clip(right - 1, 0, bins - 1).ravel()
        t = np.where(self.lo == self.hi, 0.0, (radius.ravel() - self.lo * step) / step)
        ends = [0, w // 2] if w % 2 == 0 else [0]
        once = np.isin(np.arange(w // 2 + 1), ends)
        scale = (np.where(radius < CORNER + step, np.where(once, 1.0, 2.0)[None, :], 0.0) / (h * w)).ravel()
        self.low, self.high = (1 - t) * scale, t * scale
        self.counts = self.sum(np.ones(radius.shape))

    def sum(self, values: np.ndarray) -> np.ndarray:
        v = np.asarray(values, float).ravel()
        return np.bincount(self.lo, v * self.low, self.bins) + np.bincount(self.hi, v * self.high, self.bins)

    def mean(self, values: np.ndarray) -> np.ndarray:
        """Of every ring; an empty ring is refused."""
        if not (self.counts > 0).all():
            raise ValueError("a ring of the table's axis is empty on this image")
        return self.sum(values) / self.counts


def amplitude(data: np.ndarray, rings: Rings) -> np.ndarray:
    """RMS amplitude on rings, without the constant."""
    power = np.abs(np.fft.rfft2(data)) ** 2
    power[0, 0] = 0
    return np.sqrt(rings.mean(power))


def on_grid(curve: np.ndarray, h: int, w: int) -> np.ndarray:
    """A curve on its axis, linear between its points, on the half spectrum."""
    return np.interp(radii(h, w), axis(len(curve)), curve)


def band(h: int, w: int, cutoff: float, falloff: float) -> np.ndarray:
    """The low-pass with a half-cosine edge of width ``falloff`` about the cutoff, on the half spectrum."""
    r, lo, hi = radii(h, w), cutoff - falloff / 2, cutoff + falloff / 2
    return np.where(r <= lo, 1.0, np.where(r >= hi, 0.0, 0.5 * (1 + np.cos(np.pi * (r - lo) / falloff))))


def disk(radius: int) -> np.ndarray:
    i = np.arange(-radius, radius + 1)
    return i[:, None] ** 2 + i[None, :] ** 2 <= radius * radius


def disk_mean(image: np.ndarray, radius: int) -> np.ndarray:
    """The mean over the disk about each pixel, of what of it lies in the image: a running sum for each row of the disk."""
    h, w = image.shape
    total, count = np.zeros((h, w)), np.zeros((h, w))
    run = np.concatenate([np.zeros((h, 1)), np.cumsum(image, 1, dtype=float)], 1)
    col = np.arange(w)
    for d in range(-min(radius, h - 1), min(radius, h - 1) + 1):
        half = math.isqrt(radius * radius - d * d)
        hi, lo = np.minimum(col + half + 1, w), np.maximum(col - half, 0)
        src = slice(max(0, d), h + min(0, d))
        dst = slice(max(0, -d), h + min(0, -d))
        total[dst] += run[src][:, hi] - run[src][:, lo]
        count[dst] += hi - lo
    return total / count
