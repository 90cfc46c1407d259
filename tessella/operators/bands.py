"""A stage's work on bands of positions: features and correlation of one band, plane and block of templates in one kernel.

An image under each plane's filter is cut once into bands of rows that overlap by the box, a written table of
(image_id, plane, band, w, data). A stage joins its pixels, gathered by band, and reduces each band to a row per pixel: the
features of a band exist in one task only, the correlogram only for a few positions and templates at a time, and
neither is ever shuffled. Pixels outside a stage's selection cost nothing but the transforms of their region.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.adjoint import AdjointBases

from . import correlate as C
from .imaging import merged
from .prepared import Optics, ctf_planes, per_row

BANDS = "plane int, band int, w int, data array<float>"


def plane_bands(images: DataFrame, planes: DataFrame | None, optics: Optics, box: tuple[int, int], rows: int) -> DataFrame:
    """(image_id, plane, band, w, data): ``images`` (image_id, h, w, data) under the filters of ``planes`` (image_id, planes),
    in bands of ``rows`` rows of positions. Without planes there is one, unfiltered."""
    both = images.select("image_id", "h", "w", "data")
    both = both.withColumn("planes", F.lit(None).cast("array<struct<defocus:double,astigmatism:double,angle:double>>")) if planes is None else both.join(planes, "image_id")

    def kernel(r: dict) -> dict:
        h, w = r["h"], r["w"]
        image = np.asarray(r["data"], float).reshape(h, w)
        if r["planes"] is None:
            filtered = image[None]
        else:
            bank = ctf_planes(h, w, [(p["defocus"], p["astigmatism"], p["angle"]) for p in r["planes"]], optics)
            filtered = np.fft.irfft2(np.fft.rfft2(image) * bank, s=(h, w))
        parts = [(d, i, w, x[lo : lo + rows + box[0] - 1].ravel().astype(np.float32)) for d, x in enumerate(filtered) for i, lo in enumerate(range(0, h - box[0] + 1, rows))]
        return {"parts": [dict(zip(("plane", "band", "w", "data"), p, strict=True)) for p in parts]}

    out = per_row(both, kernel, f"parts array<struct<{', '.join(f.replace(' ', ':', 1) for f in BANDS.split(', '))}>>")
    return out.select("image_id", F.explode("parts").alias("x")).select("image_id", "x.*")


def check_complete(bands: DataFrame, images: DataFrame, n_planes: int, out_h: int, rows: int) -> None:
    """Refuse a table that lacks a band of some image and plane, or holds one twice."""
    want = images.count() * n_planes * -(-out_h // rows)
    got = bands.agg(F.count("*").alias("n"), F.count_distinct("image_id", "plane", "band").alias("d")).first()
    if got["n"] != want or got["d"] != want:
        raise ValueError(f"the bands of the images are {got['n']} rows, {got['d']} of them distinct, instead of {want}")


def fast_length(n: int) -> int:
    """The smallest product of 2, 3 and 5 that is n or more."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def region(rows: np.ndarray, cols: np.ndarray, box: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int], tuple[int, int]]:
    """(origin, output shape, transform shape) of the part of an image that the boxes at these positions cover."""
    origin = int(rows.min()), int(cols.min())
    out = int(rows.max()) - origin[0] + 1, int(cols.max()) - origin[1] + 1
    return origin, out, (fast_length(out[0] + box[0] - 1), fast_length(out[1] + box[1] - 1))


def validate(rows: np.ndarray, cols: np.ndarray, shape: tuple[int, int], box: tuple[int, int]) -> None:
    """Refuse positions whose box leaves the image, or that are not pairs."""
    if rows.shape != cols.shape or rows.ndim != 1:
        raise ValueError("rows and columns of positions are two lists of one length")
    if len(rows) and (rows.min() < 0 or cols.min() < 0 or rows.max() > shape[0] - box[0] or cols.max() > shape[1] - box[1]):
        raise ValueError(f"a {box} box at one of the positions leaves the {shape} image")


@dataclass(frozen=True)
class Cells:
    """What positions are featurised with: (k, m) of each cell, its kernel (cells, kh, kw), and the bases of the transpose
    where that is the contraction of direct features."""

    index: tuple[tuple[int, int], ...]
    kernels: np.ndarray
    bases: AdjointBases | None = None

    @property
    def extent(self) -> tuple[int, int]:
        return max(k for k, _ in self.index) + 1, max(m for _, m in self.index) + 1


def features(image: np.ndarray, rows: np.ndarray, cols: np.ndarray, cells: Cells, mode: str) -> np.ndarray:
    """(P, cells): each position's box against the conjugate kernels."""
    box = cells.kernels.shape[1:]
    validate(rows, cols, image.shape, box)
    if not len(rows):
        return np.zeros((0, len(cells.index)), complex)
    (r0, c0), out, shape = region(rows, cols, box)
    part = image[r0 : r0 + out[0] + box[0] - 1, c0 : c0 + out[1] + box[1] - 1]
    if mode == "direct":
        boxes = sliding_window_view(part, box)[rows - r0, cols - c0]
        if cells.bases is not None:
            k, m = np.array(cells.index).T
            return cells.bases.features(boxes)[:, k, m]
        return boxes.reshape(len(rows), -1) @ cells.kernels.reshape(len(cells.index), -1).conj().T
    spectrum = np.fft.fft2(part, shape)
    y = np.empty((len(rows), len(cells.index)), complex)
    for i, kernel in enumerate(cells.kernels):
        y[:, i] = np.fft.ifft2(spectrum * np.fft.fft2(kernel, shape).conj())[rows - r0, cols - c0]
    return y


def spread(y: np.ndarray, cells: Cells) -> np.ndarray:
    """(P, K, M) of (P, cells), zero outside of the cells."""
    out = np.zeros((len(y), *cells.extent), complex)
    k, m = np.array(cells.index).T
    out[:, k, m] = y
    return out


def real_columns(w: np.ndarray) -> np.ndarray:
    """(.., 2 M) real pairs of complex columns: Re C is their product with (Re y, Im y)."""
    return np.concatenate([w.real, w.imag], -1)


class Forms:
    """Sums over all templates of a block as quadratic forms of the features, so that a local stage knows the mean and
    variance of all templates while it evaluates few."""

    def __init__(self, weights: np.ndarray, n_psi: int):
        self.n_psi, self.count = n_psi, len(weights)
        a, b = real_columns(weights), np.concatenate([-weights.imag, weights.real], -1)
        self.re, self.im = np.einsum("nki,nkj->kij", a, a), np.einsum("nki,nkj->kij", b, b)
        k = np.arange(weights.shape[1])
        once = (k == 0) | (k == C.nyquist(n_psi))
        self.form = np.where(once[:, None, None], self.re, 2 * (self.re + self.im))
        self.first = a[:, 0].sum(0)

    def sums(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = real_columns(y)
        return self.n_psi * (x[:, 0] @ self.first), self.n_psi * np.einsum("pki,kij,pkj->p", x, self.form, x, optimize=True)


@dataclass(frozen=True)
class Block:
    """Templates of a task: their row ids, weights (N, K, M) and, for a local stage, the members of each neighborhood as
    positions in the block, and the forms of all."""

    rows: np.ndarray
    weights: np.ndarray
    near: dict[int, np.ndarray] | None = None
    forms: Forms | None = None


STATS = "pixel_id long, mip double, best_virtual long, best_psi int, s1 double, s2 double"


def reduce_band(y: np.ndarray, group: np.ndarray | None, block: Block, n_psi: int, pixels: int, templates: int, digits: int | None = None) -> dict[str, np.ndarray]:
    """Maximum, its template row and angle, and the sums of all correlations and their squares, of (P, K, M) features. With
    ``digits`` the maximum is that of rounded correlations."""
    out = {"mip": np.full(len(y), -np.inf), "best_virtual": np.zeros(len(y), np.int64), "best_psi": np.zeros(len(y), np.int32), "s1": np.zeros(len(y)), "s2": np.zeros(len(y))}
    if group is None:
        parts = [(slice(lo, lo + pixels), slice(None)) for lo in range(0, len(y), pixels)]
    else:
        parts = []
        for cell in np.unique(group):
            at = np.flatnonzero(group == cell)
            members = block.near.get(int(cell), np.zeros(0, np.int64))
            parts += [(at[lo : lo + pixels], members) for lo in range(0, len(at), pixels)]
    for at, members in parts:
        rows = block.rows[members]
        if len(rows):
            got = C.reduce_block(y[at], block.weights[members], n_psi, templates, sums=True, digits=digits)
            out["mip"][at], out["best_virtual"][at], out["best_psi"][at] = got["mip"], rows[got["best_virtual"]], got["best_psi"]
            out["s1"][at], out["s2"][at] = got["s1"], got["s2"]
        if group is not None:
            out["s1"][at], out["s2"][at] = block.forms.sums(y[at])
    return out


def gathered(pixels: DataFrame, rows: int) -> DataFrame:
    """(image_id, band, at): a stage's pixels by band, in order; a band's pixels are bounded by its positions."""
    cell = F.col("cell") if "cell" in pixels.columns else F.lit(-1).cast("long")
    px = pixels.select("image_id", F.floor(F.col("row") / rows).cast("int").alias("band"), F.struct("row", "col", "pixel_id", cell.alias("cell")).alias("x"))
    return px.groupBy("image_id", "band").agg(F.array_sort(F.collect_list("x")).alias("at"))


def stage_stats(bands: DataFrame, pixels: DataFrame, cells: Cells, block: Block, n_psi: int, band_rows: int, positions: int, memory_pixels: int, templates: int, mode: str | None, out: tuple[int, int], image: tuple[int, int], digits: int | None = None) -> DataFrame:
    """(image_id, plane, STATS) of a stage's ``pixels`` (image_id, pixel_id, row, col and, for a local stage, cell)."""
    from tessella.plans.planning import choose_mode

    sent = bands.sparkSession.sparkContext.broadcast((cells, block))
    rows = bands.join(gathered(pixels, band_rows), ["image_id", "band"])
    kind = dict(bands.dtypes)["image_id"]
    fields = [f.split() for f in STATS.split(", ")]
    arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, block = sent.value
        box = cells.kernels.shape[1:]
        for b in batches:
            for i in range(b.num_rows):
                image_id, plane, band, w = (b.column(c)[i] for c in range(4))
                at = b.column(5)[i].values
                row, col, pixel, cell = (at.field(f).to_numpy(zero_copy_only=False) for f in ("row", "col", "pixel_id", "cell"))
                data = b.column(4)[i].values.to_numpy(zero_copy_only=False).reshape(-1, w.as_py()).astype(float)
                row = row - band.as_py() * band_rows
                how = mode or choose_mode(band_rows * out[1], len(row), image, box)
                for lo in range(0, len(row), positions):
                    part = slice(lo, lo + positions)
                    y = spread(features(data, row[part], col[part], cells, how), cells)
                    got = reduce_band(y, None if block.near is None else cell[part], block, n_psi, memory_pixels, templates, digits) | {"pixel_id": pixel[part]}
                    n = len(y)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([image_id.as_py()] * n, image_id.type), pa.array([plane.as_py()] * n, pa.int32()), *(pa.array(got[f], arrow[t]) for f, t in fields)], names=["image_id", "plane", *(f for f, _ in fields)]
                    )

    return rows.select("image_id", "plane", "band", "w", "data", "at").mapInArrow(lambda batches: merged(run(batches)), f"image_id {kind}, plane int, {STATS}")


def merged_blocks(parts: DataFrame, n_evaluated: int) -> DataFrame:
    """(image_id, pixel_id, plane, mip, best_virtual, best_psi, mean, variance, zscore): the blocks of templates of a plane
    put together. Of equal maxima the smallest template row wins."""
    keys = ["image_id", "pixel_id", "plane"]
    best = F.max(F.struct("mip", (-F.col("best_virtual")).alias("n"), "best_psi")).alias("x")
    one = parts.groupBy(*keys).agg(best, F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    return C.finalize(one.select(*keys, "x.mip", (-F.col("x.n")).alias("best_virtual"), "x.best_psi", "s1", "s2"), n_evaluated)
