"""Polar coordinate systems: standard, offset (odd rings turned by half a step) and spiral (uneven radii, twisted).

Each mapping is written once over a small set of operations, which either Spark Columns or numpy arrays supply, so that
a query and a kernel cannot differ. Radial index 0 is the innermost ring; angles run from 0 to a full turn.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, replace
from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN = 2 * math.pi
COLUMNS = SimpleNamespace(sqrt=F.sqrt, sin=F.sin, cos=F.cos, floor=F.floor, atan2=F.atan2, mod=lambda a, b: F.pmod(a, F.lit(b)))
ARRAYS = SimpleNamespace(sqrt=np.sqrt, sin=np.sin, cos=np.cos, floor=np.floor, atan2=np.arctan2, mod=np.mod)


@dataclass(frozen=True)
class PolarGrid:
    """``kind`` is standard, offset or spiral. The image is (height, width), its center (row, col)."""

    kind: str
    height: int
    width: int
    num_angle: int
    num_radius: int
    radius: float
    center: tuple[float, float]
    c: float = 0.3
    arc: float = 0.322

    def __post_init__(self):
        if self.kind not in ("standard", "offset", "spiral"):
            raise ValueError(f"unknown polar grid {self.kind!r}")
        if self.kind == "spiral" and self.c <= 0:
            raise ValueError(f"c must be positive, got {self.c}")
        if min(self.num_angle, self.num_radius) < 1 or self.radius <= 0:
            raise ValueError("a grid has angles, rings and a positive radius")

    @classmethod
    def of_image(cls, kind: str, shape: tuple[int, int], num_radius: int, num_angle: int | None = None, center=None, radius=None, **more) -> PolarGrid:
        h, w = shape
        center = (h // 2, w // 2) if center is None else tuple(center)
        return cls(kind, h, w, round(h * w / num_radius) if num_angle is None else num_angle, num_radius, float(h / 2 if radius is None else radius), center, **more)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> PolarGrid:
        return cls(**{**d, "center": tuple(d["center"])})

    @property
    def step(self) -> float:
        """Of the spiral's radial parameter."""
        return 0.5 * (1 + 2 * self.c) / self.num_radius

    @property
    def twist(self) -> float:
        """Radians per unit of the spiral's parameter."""
        return self.arc * TURN / (self.num_angle * self.step)

    def to_polar(self, row, col, ops=COLUMNS):
        """(radius index, angle index) of image coordinates."""
        y, x = row - self.center[0], col - self.center[1]
        r, angle = ops.sqrt(y * y + x * x), ops.mod(ops.atan2(y, x), TURN)
        if self.kind == "spiral":
            t = ((r / self.radius + self.c) * (r / self.radius + self.c) - self.c**2) / 2
            return t / self.step - 1, ops.mod(angle - self.twist * t, TURN) / TURN * self.num_angle
        at = r / self.radius * self.num_radius
        if self.kind == "offset":
            angle = ops.mod(angle - ops.mod(ops.floor(at), 2) * (TURN / self.num_angle / 2), TURN)
        return at, angle / TURN * self.num_angle

    def to_image(self, radius_index, angle_index, ops=COLUMNS):
        """(row, col) of polar indices."""
        angle = angle_index / self.num_angle * TURN
        if self.kind == "spiral":
            t = (radius_index + 1) * self.step
            r, angle = self.radius * (ops.sqrt(self.c**2 + 2 * t) - self.c), angle + self.twist * t
        else:
            r = radius_index / self.num_radius * self.radius
            if self.kind == "offset":
                angle = angle + ops.mod(ops.floor(radius_index), 2) * (TURN / self.num_angle / 2)
        return r * ops.sin(angle) + self.center[0], r * ops.cos(angle) + self.center[1]

    def areas(self) -> np.ndarray:
        """The image area of a polar sample of each ring."""
        i = np.arange(self.num_radius)
        if self.kind == "spiral":
            radii = self.radius * (np.sqrt(self.c**2 + 2 * (i + 1) * self.step) - self.c)
            edges = np.concatenate([[0.0], (radii[1:] + radii[:-1]) / 2, radii[-1:]])
        else:
            edges = np.arange(self.num_radius + 1) * (self.radius / self.num_radius)
        return 0.5 * np.diff(edges**2) * TURN / self.num_angle

    def area_table(self, spark: SparkSession) -> DataFrame:
        """(r, area): the same as a query; the rings' edges are midpoints that a window looks up."""
        rings = spark.range(self.num_radius).select(F.col("id").cast("int").alias("r"))
        if self.kind == "spiral":
            rings = rings.withColumn("radius", self.radius * (F.sqrt(F.lit(self.c**2) + 2 * (F.col("r") + 1) * self.step) - self.c))
            w = Window.orderBy("r")  # a row per ring
            inner = F.coalesce((F.col("radius") + F.lag("radius").over(w)) / 2, F.lit(0.0))
            outer = F.coalesce((F.col("radius") + F.lead("radius").over(w)) / 2, F.col("radius"))
        else:
            d = self.radius / self.num_radius
            inner, outer = F.col("r") * d, (F.col("r") + 1) * d
        return rings.select("r", (0.5 * (outer * outer - inner * inner) * TURN / self.num_angle).alias("area"))

    def polar_table(self, spark: SparkSession) -> DataFrame:
        """(a, r, row, col, jacobian): where each polar sample lies in the image."""
        n = self.num_angle * self.num_radius
        cells = spark.range(n).select(F.floor(F.col("id") / self.num_radius).cast("int").alias("a"), F.pmod("id", F.lit(self.num_radius)).cast("int").alias("r"))
        row, col = self.to_image(F.col("r").cast("double"), F.col("a").cast("double"))
        return cells.withColumn("row", row).withColumn("col", col).join(self.area_table(spark).select("r", F.sqrt("area").alias("jacobian")), "r").select("a", "r", "row", "col", "jacobian")

    def image_table(self, spark: SparkSession) -> DataFrame:
        """(row, col, radius_index, angle_index) of every image pixel."""
        cells = spark.range(self.height * self.width).select(F.floor(F.col("id") / self.width).cast("int").alias("row"), F.pmod("id", F.lit(self.width)).cast("int").alias("col"))
        r, a = self.to_polar(F.col("row").cast("double"), F.col("col").cast("double"))
        return cells.withColumn("radius_index", r).withColumn("angle_index", a)

    def continuation(self, rows: int = 10) -> tuple[np.ndarray, np.ndarray]:
        """(rows, rings, frequencies) complex operator: rings continued through the origin, and how many rows there are.

        A row below the first ring lies at a negative radius, which is the positive one half a turn on: its angular
        spectrum is interpolated from the rings about that radius, untwisted, and turned. At the origin only the
        constant is left, extrapolated as an even function of the radius.
        """
        if self.kind != "spiral" or self.num_radius < 4:
            return np.zeros((0, self.num_radius, self.num_angle // 2 + 1), complex), np.zeros(0)
        have = min(rows, math.ceil(self.c**2 / (2 * self.step)))
        k = np.arange(self.num_angle // 2 + 1)
        ring_t = (np.arange(self.num_radius) + 1) * self.step
        radii = self.radius * (np.sqrt(self.c**2 + 2 * ring_t) - self.c)
        out = np.zeros((have, self.num_radius, len(k)), complex)
        for i in range(have):
            if i == 0:
                out[0, :3, 0] = lagrange(radii[:3] ** 2, 0.0)
                continue
            t = -i * self.step
            mirrored = -(math.sqrt(self.c**2 + 2 * t) - self.c)
            at = ((mirrored + self.c) ** 2 - self.c**2) / 2 / self.step - 1
            lo = min(max(math.floor(at) - 1, 0), self.num_radius - 4)
            weights = lagrange(np.arange(lo, lo + 4, dtype=float), at)
            turn = (-1.0) ** k * np.exp(1j * k * self.twist * t)
            for j, w in zip(range(lo, lo + 4), weights, strict=True):
                out[i, j] = w * turn * np.exp(-1j * k * self.twist * ring_t[j])
        return out, -np.arange(have) * self.step

    def radial_continuation(self, ks) -> np.ndarray:
        """(frequencies, rows, rings): the operator of ``continuation`` for each angular frequency asked for; a negative
        one has the conjugate of its positive's."""
        op, _ = self.continuation()
        ks = np.asarray(ks, int)
        if len(ks) and np.abs(ks).max() > self.num_angle // 2:
            raise ValueError(f"the grid has the frequencies 0 to {self.num_angle // 2}")
        out = np.moveaxis(op[:, :, np.abs(ks)], 2, 0)
        return np.where((ks < 0)[:, None, None], out.conj(), out)

    def pad_radial(self, polar: np.ndarray, outer: int = 10) -> tuple[np.ndarray, int]:
        """(angle, radius) continued inwards through the origin and mirrored outwards; and the rows put in front."""
        op, _ = self.continuation()
        tail = polar[:, -2 : -outer - 2 : -1]
        if not len(op):
            return np.concatenate([polar, tail], 1), 0
        front = np.fft.irfft(np.einsum("ijk,kj->ki", op, np.fft.rfft(polar, axis=0)), n=self.num_angle, axis=0)
        return np.concatenate([front[:, ::-1], polar, tail], 1), len(op)


def lagrange(nodes: np.ndarray, x: float) -> np.ndarray:
    """Weights of the polynomial through the nodes at x."""
    return np.array([np.prod([(x - nodes[j]) / (nodes[i] - nodes[j]) for j in range(len(nodes)) if j != i]) for i in range(len(nodes))])


#: Transform classes by name: an extension point.
REGISTRY: dict[str, type] = {}


def register_transform(name: str):
    """Class decorator: make a grid class known by name, for grids that are rebuilt from their parameters."""

    def put(cls: type) -> type:
        if name in REGISTRY and REGISTRY[name] is not cls:
            raise ValueError(f"{name!r} is registered already")
        REGISTRY[name] = cls
        return cls

    return put


register_transform("polar")(PolarGrid)


@register_transform("arrays")
class ArrayGrid:
    """A grid that is given by its coordinates: (row, col) of each polar sample and (radius, angle) of each pixel, with
    the root of each sample's area. It has no formula, so rings are not continued through the origin."""

    kind = "arrays"

    def __init__(self, polar_rows, polar_cols, pixel_radius, pixel_angle, jacobian, center=None):
        self.polar_at = np.asarray(polar_rows, float), np.asarray(polar_cols, float)
        self.pixel_at = np.asarray(pixel_radius, float), np.asarray(pixel_angle, float)
        self.jacobian = np.asarray(jacobian, float)
        if self.polar_at[0].shape != self.polar_at[1].shape or self.polar_at[0].ndim != 2:
            raise ValueError("rows and columns of the samples are two arrays (angle, radius) of one shape")
        if self.pixel_at[0].shape != self.pixel_at[1].shape or self.pixel_at[0].ndim != 2:
            raise ValueError("radii and angles of the pixels are two arrays (row, col) of one shape")
        self.num_angle, self.num_radius = self.polar_at[0].shape
        self.height, self.width = self.pixel_at[0].shape
        if self.jacobian.shape not in ((self.num_radius,), self.polar_at[0].shape) or not (self.jacobian > 0).all():
            raise ValueError("the jacobian is positive, one value a ring or a sample")
        self.center = (self.height // 2, self.width // 2) if center is None else tuple(center)

    @classmethod
    def from_transform(cls, grid: PolarGrid) -> ArrayGrid:
        """The coordinates of a grid that has a formula."""
        a, r = np.indices((grid.num_angle, grid.num_radius)).astype(float)
        row, col = np.indices((grid.height, grid.width)).astype(float)
        return cls(*grid.to_image(r, a, ARRAYS), *grid.to_polar(row, col, ARRAYS), np.sqrt(grid.areas()), grid.center)

    def to_dict(self) -> dict:
        rows, radii = self.polar_at, self.pixel_at
        return {"polar_rows": rows[0].tolist(), "polar_cols": rows[1].tolist(), "pixel_radius": radii[0].tolist(), "pixel_angle": radii[1].tolist(), "jacobian": self.jacobian.tolist(), "center": list(self.center)}

    @classmethod
    def from_dict(cls, d: dict) -> ArrayGrid:
        return cls(**d)

    def areas(self) -> np.ndarray:
        return self.jacobian**2

    def to_image(self, radius_index, angle_index, ops=ARRAYS):
        """(row, col) of whole polar indices."""
        r, a = np.asarray(radius_index).astype(int), np.asarray(angle_index).astype(int) % self.num_angle
        return self.polar_at[0][a, r], self.polar_at[1][a, r]

    def to_polar(self, row, col, ops=ARRAYS):
        """(radius index, angle index) of whole pixels."""
        at = np.asarray(row).astype(int), np.asarray(col).astype(int)
        return self.pixel_at[0][at], self.pixel_at[1][at]

    def pad_radial(self, polar: np.ndarray, outer: int = 10) -> tuple[np.ndarray, int]:
        tail = polar[:, -2 : -outer - 2 : -1]
        return np.concatenate([polar, tail], 1), 0


def get_transform(name: str, **params):
    if name not in REGISTRY:
        raise KeyError(f"no transform {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name].from_dict(params)


def resized(grid: PolarGrid, shape: tuple[int, int]) -> PolarGrid:
    return replace(grid, height=shape[0], width=shape[1], center=(shape[0] // 2, shape[1] // 2), radius=shape[0] / 2)
