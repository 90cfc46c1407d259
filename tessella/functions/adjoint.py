"""Features of boxes by the transpose of the warp: one sparse product a box and small dense ones, instead of a warped
kernel for each cell."""

from __future__ import annotations

import numpy as np

from .polar import PolarGrid
from .spline import WarpAdjoint

ORDERS = range(1, 6)


def unsupported_reason(grid, order: int = 5) -> str | None:
    """Why the transpose cannot stand for the warp of this grid; None if it can."""
    if order not in ORDERS:
        return f"splines of degree {order} have no transpose here"
    if not isinstance(grid, PolarGrid):
        return "only grids given by a formula know their radial continuation"
    if np.ndim(grid.areas()) != 1:
        return "areas vary along a ring"
    return None


def box_contraction(grid, cells: int, order: int = 5, asked: str | None = None) -> str:
    """"adjoint" or "planar". Without a wish: the transpose where it works and there are more cells than spline taps."""
    reason = unsupported_reason(grid, order)
    if asked == "adjoint" and reason:
        raise ValueError(f"no adjoint contraction: {reason}")
    if asked not in (None, "adjoint", "planar"):
        raise ValueError(f"unknown contraction {asked!r}")
    return asked or ("planar" if reason or cells < (order + 1) ** 2 else "adjoint")


class AdjointBases:
    """The radial vectors (K, M, R) of a rectangle's cells, against boxes: y = sum of box times conjugate warped kernel."""

    def __init__(self, grid: PolarGrid, radial: np.ndarray, order: int = 5):
        reason = unsupported_reason(grid, order)
        if reason:
            raise ValueError(f"no adjoint contraction: {reason}")
        if radial.shape[0] > grid.num_angle // 2 + 1 or radial.shape[2] != grid.num_radius:
            raise ValueError(f"radial vectors {radial.shape} do not fit the grid")
        self.grid, self.conj = grid, np.conj(radial)
        self.adjoint = WarpAdjoint(grid, order)

    def polar(self, boxes: np.ndarray) -> np.ndarray:
        """(P, A, R): the transpose of the warp of every box."""
        return np.stack([self.adjoint.apply(b) for b in boxes]) if len(boxes) else np.zeros((0, self.grid.num_angle, self.grid.num_radius))

    def contract(self, polar: np.ndarray) -> np.ndarray:
        """(P, K, M): the angular transform, then the radial product."""
        z = np.fft.rfft(polar, axis=1)[:, : self.conj.shape[0]] / np.sqrt(self.grid.num_angle)
        return np.einsum("pkr,kmr->pkm", z, self.conj, optimize=True)

    def features(self, boxes: np.ndarray) -> np.ndarray:
        return self.contract(self.polar(boxes))
