"""Cardinal B-splines in numpy: basis values, prefilter and interpolation at arbitrary points (zero outside)."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def bspline(order: int, x: np.ndarray) -> np.ndarray:
    """The centered cardinal B-spline of degree ``order``, by its truncated powers."""
    x = np.asarray(x, float)
    if order == 0:
        return ((x >= -0.5) & (x < 0.5)).astype(float)
    out = np.zeros_like(x)
    for k in range(order + 2):
        out += (-1) ** k * math.comb(order + 1, k) * np.maximum(x + (order + 1) / 2 - k, 0) ** order
    return np.where(np.abs(x) < (order + 1) / 2, out / math.factorial(order), 0.0)


@lru_cache(maxsize=64)
def _inverse(order: int, n: int) -> np.ndarray:
    """Of the banded matrix of basis values at integers: samples to coefficients, with nothing outside. The matrix is
    diagonally dominant enough to be eliminated within its band, without pivots."""
    d = np.arange(n)
    a, out, band = bspline(order, (d[:, None] - d[None, :]).astype(float)), np.eye(n), order // 2
    for i in range(n):  # to an upper triangle
        for j in range(i + 1, min(n, i + band + 1)):
            f = a[j, i] / a[i, i]
            a[j, i : i + band + 1] -= f * a[i, i : i + band + 1]
            out[j] -= f * out[i]
    for i in range(n - 1, -1, -1):
        out[i] /= a[i, i]
        for j in range(max(0, i - band), i):
            out[j] -= a[j, i] * out[i]
    return out


def prefilter(image: np.ndarray, order: int, pad: int = 12) -> np.ndarray:
    """Coefficients whose spline passes through the samples; ``pad`` zeros on each side keep the edges exact."""
    if order < 2:
        return np.pad(image, pad)
    out = np.pad(np.asarray(image, complex if np.iscomplexobj(image) else float), pad)
    return _inverse(order, out.shape[0]) @ out @ _inverse(order, out.shape[1]).T


def sample(image: np.ndarray, rows: np.ndarray, cols: np.ndarray, order: int = 5, pad: int = 12) -> np.ndarray:
    """The spline through ``image`` at (rows, cols); 0 outside of the image."""
    coef = prefilter(image, order, pad)
    inside = (rows >= 0) & (rows <= image.shape[0] - 1) & (cols >= 0) & (cols <= image.shape[1] - 1)
    r, c = np.where(inside, rows, 0.0), np.where(inside, cols, 0.0)
    lo_r, lo_c = np.floor(r - (order - 1) / 2).astype(int), np.floor(c - (order - 1) / 2).astype(int)
    out = np.zeros(r.shape, coef.dtype)
    for i in range(order + 1):
        wr = bspline(order, r - (lo_r + i))
        for j in range(order + 1):
            out += wr * bspline(order, c - (lo_c + j)) * coef[lo_r + i + pad, lo_c + j + pad]
    return np.where(inside, out, 0)


def taps(points: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(first index, weights) of the order + 1 coefficients that each point reads along an axis."""
    lo = np.floor(points - (order - 1) / 2).astype(int)
    return lo, np.stack([bspline(order, points - (lo + i)) for i in range(order + 1)], -1)


def warp_to_polar(image: np.ndarray, grid, order: int = 5, preserve_energy: bool = True) -> np.ndarray:
    """(angle, radius) of an image on a polar grid, times the root of each sample's area."""
    from .polar import ARRAYS

    a, r = np.indices((grid.num_angle, grid.num_radius)).astype(float)
    out = sample(image, *grid.to_image(r, a, ARRAYS), order)
    return out * np.sqrt(grid.areas()) if preserve_energy else out


def warp_to_image(polar: np.ndarray, grid, order: int = 5, preserve_energy: bool = True) -> np.ndarray:
    """The image of a polar array: areas undone, rings continued, angles wrapped by 4 * order rows, 0 beyond the last ring."""
    from .polar import ARRAYS

    work = polar / np.sqrt(grid.areas()) if preserve_energy else polar
    if np.iscomplexobj(work):
        return warp_to_image(work.real, grid, order, False) + 1j * warp_to_image(work.imag, grid, order, False)
    work, front = grid.pad_radial(work)
    wrap = 4 * order
    work = np.pad(work, ((wrap, wrap), (0, 0)), mode="wrap")
    row, col = np.indices((grid.height, grid.width)).astype(float)
    r, a = grid.to_polar(row, col, ARRAYS)
    out = sample(work, a + wrap, np.maximum(r + front, 0), order)
    return np.where(r <= grid.num_radius - 1, out, 0)


class WarpAdjoint:
    """The transpose of ``warp_to_image`` as a sparse table (pixel, coefficient, weight): what an image says of each
    polar sample. Features of a box then need a sparse product and small dense ones instead of a warped kernel per cell."""

    def __init__(self, grid, order: int = 5, pad: int = 12):
        from .polar import ARRAYS

        self.grid, self.order, self.pad, self.wrap = grid, order, pad, 4 * order
        probe, self.front = grid.pad_radial(np.zeros((grid.num_angle, grid.num_radius)))
        self.rows, self.cols = grid.num_angle + 2 * self.wrap + 2 * pad, probe.shape[1] + 2 * pad
        row, col = np.indices((grid.height, grid.width)).astype(float)
        r, a = grid.to_polar(row.ravel(), col.ravel(), ARRAYS)
        inside = (r <= grid.num_radius - 1) & (a + self.wrap <= grid.num_angle + 2 * self.wrap - 1)
        lo_a, wa = taps(a + self.wrap, order)
        lo_r, wr = taps(np.maximum(r + self.front, 0), order)
        k = np.arange(order + 1)
        coefficient = (lo_a[:, None, None] + k[:, None] + pad) * self.cols + lo_r[:, None, None] + k[None, :] + pad
        weight = wa[:, :, None] * wr[:, None, :] * inside[:, None, None]
        pixel = np.broadcast_to(np.arange(len(r))[:, None, None], weight.shape)
        keep = weight != 0
        self.pixel, self.coefficient, self.weight = pixel[keep], coefficient[keep], weight[keep]

    def table(self, spark):
        """(pixel, coefficient, weight) as a DataFrame, for the product as a join."""
        import pandas as pd

        return spark.createDataFrame(pd.DataFrame({"pixel": self.pixel, "coefficient": self.coefficient, "weight": self.weight}))

    def scatter(self, image: np.ndarray) -> np.ndarray:
        """Spline coefficients' share of an image: (rows, cols)."""
        return np.bincount(self.coefficient, self.weight * image.ravel()[self.pixel], self.rows * self.cols).reshape(self.rows, self.cols)

    def apply(self, image: np.ndarray) -> np.ndarray:
        """(angle, radius): the transpose of the whole warp, prefilter, wrapping, continuation and areas included."""
        g = self.grid
        c = self.scatter(image)
        if self.order > 1:
            c = _inverse(self.order, self.rows).T @ c @ _inverse(self.order, self.cols)
        c = c[self.pad : self.rows - self.pad, self.pad : self.cols - self.pad]
        out = c[self.wrap : -self.wrap].copy()
        reps = -(-self.wrap // g.num_angle)
        for i in range(1, reps + 1):  # wrapped rows fold back
            n = min(g.num_angle, self.wrap - (i - 1) * g.num_angle)
            at = self.wrap - (i - 1) * g.num_angle
            out[-n:] += c[at - n : at]
            out[:n] += c[self.wrap + i * g.num_angle : self.wrap + i * g.num_angle + n]
        body = out[:, self.front : self.front + g.num_radius].copy()
        tail = out[:, self.front + g.num_radius :]
        for j in range(tail.shape[1]):  # mirrored rings
            body[:, g.num_radius - 2 - j] += tail[:, j]
        if self.front:
            op, _ = g.continuation()
            front = out[:, : self.front][:, ::-1]
            eye = np.fft.rfft(np.eye(g.num_angle), axis=0)
            for i in range(len(op)):
                for ring in np.flatnonzero(np.abs(op[i]).max(1)):
                    m = np.fft.irfft(op[i, ring][:, None] * eye, n=g.num_angle, axis=0)
                    body[:, ring] += m.T @ front[:, i]
        return body / np.sqrt(g.areas())
