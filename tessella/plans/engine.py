"""A stage by bands: its templates, its plan, and the kernels and weights that its tasks get."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import healpix
from tessella.functions.adjoint import AdjointBases, box_contraction
from tessella.functions.polar import PolarGrid
from tessella.functions.spline import warp_to_image
from tessella.operators import bands as B
from tessella.operators import correlate as C
from tessella.operators import hypotheses as H
from tessella.operators import tables as T
from tessella.plans import planning


def radial_vectors(vh: DataFrame, grid: PolarGrid, k_max: int, eig_max: int) -> np.ndarray:
    """(k, m, r) complex of the cells below the given ones."""
    out = np.zeros((k_max, eig_max, grid.num_radius), complex)
    rows = vh.where((F.col("k") < k_max) & (F.col("m") < eig_max)).toPandas()
    out[rows["k"].to_numpy(int), rows["m"].to_numpy(int), rows["r"].to_numpy(int)] = rows["re"].to_numpy() + 1j * rows["im"].to_numpy()
    return out


def cell_kernels(radial: np.ndarray, grid: PolarGrid, cells) -> np.ndarray:
    """(cells, h, w): each cell's radial vector with its angular phase, warped to the image."""
    a = np.arange(grid.num_angle) / grid.num_angle
    return np.stack([warp_to_image(np.outer(np.exp(2j * np.pi * k * a), radial[k, m]) / np.sqrt(grid.num_angle), grid) for k, m in cells])


@dataclass
class Engine:
    """``bands`` is ``operators.bands.plane_bands`` of the images; ``stored`` the (k, m) extent of the decomposition."""

    bands: DataFrame
    band_rows: int
    image: tuple[int, int]
    out: tuple[int, int]
    grid: PolarGrid
    vh: DataFrame
    weights: DataFrame
    orientations: DataFrame  # (orientation, ipix)
    nside: int
    n_planes: int
    n_filters: int
    n_orientations: int
    stored: tuple[int, int]
    cut: Callable[[DataFrame, str], DataFrame]
    execution: planning.Execution = field(default_factory=planning.Execution)
    base: int = 0  # the level that the seeds of the next local stage were found on

    @property
    def n_templates(self) -> int:
        return self.n_filters * self.n_orientations

    def selected(self, stage) -> DataFrame:
        """(n): template rows of a stage: of all orientations, of a level, or of the ids it names."""
        chosen = self.orientations
        if stage.level is not None:
            if self.nside >> stage.level < 1 or self.nside & (self.nside - 1):
                raise ValueError(f"a grid of nside {self.nside} has no level {stage.level}")
            chosen = chosen.where(H.at_level(F.col("ipix"), stage.level))
        if stage.orientations is not None:
            ids = H.sorted_unique_ids(chosen.sparkSession.createDataFrame([(int(i),) for i in stage.orientations], "id long"), self.n_orientations)
            chosen = chosen.join(ids.withColumnRenamed("id", "orientation"), "orientation", "left_semi")
        return H.template_rows(chosen, range(self.n_filters), self.n_orientations).select("n")

    def plan(self, stage) -> planning.StagePlan:
        return planning.plan_stage(stage, self.n_planes, self.selected(stage).count(), self.execution)

    def cells(self, stage) -> B.Cells:
        index = T.cells_of(stage.rectangles, *self.stored)
        size = len(index) * self.grid.height * self.grid.width * 16
        if size > 16 * self.execution.broadcast:
            raise ValueError(f"the kernels of {len(index)} cells take {size} bytes in every task")
        radial = radial_vectors(self.vh, self.grid, max(k for k, _ in index) + 1, max(m for _, m in index) + 1)
        adjoint = box_contraction(self.grid, len(index), asked=self.execution.contraction) == "adjoint"
        return B.Cells(tuple(index), cell_kernels(radial, self.grid, index), AdjointBases(self.grid, radial) if adjoint else None)

    def neighborhoods(self, stage) -> dict[int, np.ndarray]:
        """Template rows by seed cell. Cells are those of the stage before, which is no finer than this one."""
        level = stage.level or 0
        if level > self.base:
            raise ValueError(f"a local stage of level {level} follows seeds of the finer level {self.base}")
        near = healpix.neighbors(self.bands.sparkSession, self.nside >> level)
        table = H.neighborhoods(near, self.orientations, level, self.base, stage.rings, range(self.n_filters), self.n_orientations)
        if table.count() * 16 > self.execution.broadcast:
            raise ValueError("the neighborhoods are larger than a broadcast may be")
        rows = table.toPandas()
        return {int(c): np.sort(part["n"].to_numpy()) for c, part in rows.groupby("cell")}

    def block(self, stage, rows: np.ndarray, extent: tuple[int, int], near: dict[int, np.ndarray] | None) -> B.Block:
        got = self.weights.where(C.in_rectangles(stage.rectangles) & F.col("n").between(int(rows[0]), int(rows[-1]))).toPandas()
        at = np.searchsorted(rows, got["n"].to_numpy())
        ok = rows[np.minimum(at, len(rows) - 1)] == got["n"].to_numpy()
        w = np.zeros((len(rows), *extent), complex)
        w[at[ok], got["k"].to_numpy(int)[ok], got["m"].to_numpy(int)[ok]] = got["re"].to_numpy()[ok] + 1j * got["im"].to_numpy()[ok]
        if near is None:
            return B.Block(rows, w)
        inside = {c: np.searchsorted(rows, n[np.isin(n, rows)]) for c, n in near.items()}
        return B.Block(rows, w, inside, B.Forms(w, stage.n_psi))

    def seeded(self, pixels: DataFrame) -> DataFrame:
        """``pixels`` with the cell of their best orientation; one that was never searched fails the query."""
        missing = F.raise_error(F.lit("a pixel of a local stage has no seed")).cast("long")
        seed = pixels.withColumn("orientation", F.when(F.col("best_index").isNull(), missing).otherwise(F.pmod("best_index", F.lit(self.n_orientations))))
        cell = self.orientations.select("orientation", F.floor(F.col("ipix") / 4**self.base).cast("long").alias("cell"))
        return seed.join(cell, "orientation")

    def maps(self, pixels: DataFrame, stage) -> DataFrame:
        """(image_id, pixel_id, mip, mean, variance, zscore, best_index, best_psi) of a stage."""
        rows = np.sort(np.array([r[0] for r in self.selected(stage).collect()], np.int64))  # eight bytes a template row
        plan = planning.plan_stage(stage, self.n_planes, len(rows), self.execution)
        cells = self.cells(stage)
        near = self.neighborhoods(stage) if plan.local else None
        pixels = self.seeded(pixels) if plan.local else pixels
        tiles = plan.memory.pixels
        if plan.local:
            tiles = min(tiles, planning.choose_tile([r[0] for r in pixels.groupBy("cell").count().select("count").collect()] or [1], n_planes=len(plan.planes), width=max(map(len, near.values())), cells=plan.cells, n_freq=cells.extent[0], n_psi=stage.n_psi))
        part = self.bands.where(F.col("plane").isin(list(plan.planes)))
        stats = None
        for i, (lo, hi) in enumerate(plan.blocks):
            one = B.stage_stats(part, pixels, cells, self.block(stage, rows[lo:hi], cells.extent, near), stage.n_psi, self.band_rows, plan.memory.positions, tiles, plan.memory.templates, plan.mode, self.out, self.image)
            one = one if len(plan.blocks) == 1 else self.cut(one, f"block-{i}")  # so that one block is sent at a time
            stats = one if stats is None else stats.unionByName(one)
        merged = C.merge_stage_maps(B.merged_blocks(stats, len(rows) * stage.n_psi).where(F.col("mip") > float("-inf")), ["image_id", "pixel_id"])
        self.base = stage.level or 0
        return merged.withColumn("best_index", (F.col("plane") * self.n_templates + F.col("best_virtual")).cast("long")).drop("plane", "best_virtual")
