"""Prepared micrographs: one kernel for an image, which is checked, whitened, normalised, and measured for the noise model.

A prepared micrograph is a row (image_id, h, w, data, noise, signal, level): the filtered image, for each plane the ring
means of its power and of the squared plane times correction, and the map of relative noise levels.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import rings as R
from tessella.sources import store

from . import imaging as I
from .micrograph import flatten_filter

SCHEMA = "h int, w int, data array<float>, noise array<array<double>>, signal array<array<double>>, level array<float>"
TOLERANCE = 1e-3  # of a spectrum against the recorded one


@dataclass(frozen=True)
class Optics:
    pixel_size: float = 1.0
    voltage: float = 300.0
    cs_mm: float = 2.7
    amplitude_contrast: float = 0.07
    phase_shift: float = 0.0


def ctf_planes(h: int, w: int, planes: Sequence[tuple[float, float, float]], optics: Optics) -> np.ndarray:
    """(D, h, w // 2 + 1) of planes (defocus in um, astigmatism in um, angle in degrees): ``imaging.ctf`` for a kernel."""
    fy, fx = np.fft.fftfreq(h)[:, None], np.fft.rfftfreq(w)[None, :]
    g2, turn = (fy * fy + fx * fx) / optics.pixel_size**2, np.arctan2(fy, fx)
    lam, cs = I.wavelength(optics.voltage), optics.cs_mm * 1e7
    rest = -0.5 * np.pi * cs * lam**3 * g2 * g2 + np.radians(optics.phase_shift) + np.arctan(optics.amplitude_contrast / np.sqrt(1 - optics.amplitude_contrast**2))
    out = []
    for defocus, astigmatism, angle in planes:
        local = 1e4 * (defocus + abs(astigmatism) * np.cos(2 * (turn - np.radians(angle + 90.0 * (astigmatism < 0)))))
        out.append(-np.sin(np.pi * lam * local * g2 + rest))
    return np.stack(out)


def template_filter(average: np.ndarray, h: int, w: int, cutoff: float, falloff: float) -> np.ndarray:
    """The average whitening times the band, on the half spectrum of a template's box."""
    return R.on_grid(average, h, w) * R.band(h, w, cutoff, falloff)


def average_curve(spectra: DataFrame, max_freq: float | None) -> np.ndarray:
    """The whitening curve of all images' mean spectrum: a value a ring."""
    mean = I.average_spectrum(spectra).withColumn("image_id", F.lit(0))
    return np.array([r["curve"] for r in I.whitening_curve(mean, max_freq).select("f", "curve").orderBy("f").collect()])


def curves_of(spectra: DataFrame, max_freq: float | None) -> DataFrame:
    """(image_id, recorded, correction): each image's recorded amplitudes and its correction, by ring."""
    by_ring = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("f", c))), lambda x: x[c]).alias(c)
    both = I.correction_curve(spectra, max_freq).select("image_id", "f", "correction").join(spectra.select("image_id", "f", F.col("amplitude").alias("recorded")), ["image_id", "f"])
    return both.groupBy("image_id").agg(by_ring("recorded"), by_ring("correction"))


def prepare(images: DataFrame, spectra: DataFrame, planes: DataFrame, optics: Optics, *, max_freq: float | None = 0.5, cutoff: float = 0.45, falloff: float = 0.05, table_bins: int | None = None, radius: int = 1) -> DataFrame:
    """Rows of SCHEMA by image_id: ``images`` (image_id, h, w, data), the whitening's ``spectra`` (image_id, f, freq,
    amplitude) and ``planes`` (image_id, planes array<struct<defocus, astigmatism, angle>>).

    An image whose spectrum is not the recorded one, or that has none, fails the query. ``table_bins`` is the number of
    rings of the error tables (that of the whitening, if not given), ``radius`` that of the template's support.
    """
    average = average_curve(spectra, max_freq)
    bins = table_bins or len(average)
    rows = images.join(curves_of(spectra, max_freq), "image_id", "left").join(planes, "image_id", "left")

    def kernel(r: dict) -> dict:
        name, h, w = r["image_id"], r["h"], r["w"]
        if r["recorded"] is None:
            raise ValueError(f"the whitening holds no spectrum of image {name!r}")
        raw = np.asarray(r["data"], float).reshape(h, w)
        recorded = np.asarray(r["recorded"], float)
        distance = np.linalg.norm(R.amplitude(raw, R.Rings(h, w, len(recorded))) - recorded) / max(np.linalg.norm(recorded), 1e-30)
        if not distance <= TOLERANCE:
            raise ValueError(f"the spectrum of image {name!r} is {distance:.2g} away from the recorded one")
        own = R.on_grid(np.asarray(r["correction"], float), h, w) ** 2
        image = np.fft.irfft2(np.fft.rfft2(raw) * R.on_grid(average, h, w) * own, s=(h, w))
        sd = image.std(ddof=1)
        image = (image - image.mean()) / sd if sd > 0 else image * 0
        spectrum = np.fft.rfft2(image)
        ring, power = R.Rings(h, w, bins), np.abs(spectrum) ** 2
        squares = ctf_planes(h, w, [(p["defocus"], p["astigmatism"], p["angle"]) for p in r["planes"]], optics) ** 2
        curve = ring.mean(power) / (h * w)
        flat = np.fft.irfft2(spectrum * flatten_filter(R.on_grid(curve, h, w), R.band(h, w, cutoff, falloff)), s=(h, w))
        level = np.maximum(R.disk_mean(flat * flat, radius), 1e-37)
        return {"h": h, "w": w, "data": image.ravel().astype(np.float32), "noise": [ring.mean(power * s) / (h * w) for s in squares], "signal": [ring.mean(s * own) for s in squares], "level": (level / level.mean()).ravel().astype(np.float32)}

    return per_row(rows.select("image_id", "h", "w", "data", "recorded", "correction", "planes"), kernel, SCHEMA)


def normalised(images: DataFrame) -> DataFrame:
    """(image_id, h, w, data) with mean 0 and unbiased variance 1, where no whitening is asked for."""

    def kernel(r: dict) -> dict:
        x = np.asarray(r["data"], float)
        sd = x.std(ddof=1) if len(x) > 1 else 0.0
        return {"h": r["h"], "w": r["w"], "data": ((x - x.mean()) / sd if sd > 0 else x * 0).astype(np.float32)}

    return per_row(images.select("image_id", "h", "w", "data"), kernel, "h int, w int, data array<float>")


def per_row(rows: DataFrame, kernel, schema: str) -> DataFrame:
    """(image_id, schema) of one row an image: a task holds one image at a time."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = f"image_id {dict(rows.dtypes)['image_id']}, {schema}"
    want = to_arrow_schema(StructType.fromDDL(full))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = {n: v for n, v in zip(b.schema.names, (c[i] for c in b.columns), strict=True)}
                r = {n: v.values.to_numpy(zero_copy_only=False) if n in ("data", "recorded", "correction") and v.is_valid else v.as_py() for n, v in r.items()}
                out = {"image_id": r["image_id"], **kernel(r)}
                cols = []
                for f in want:
                    v = out[f.name]
                    cols.append(pa.array([[x.tolist() for x in v]] if f.name in ("noise", "signal") else [v], f.type))
                yield pa.RecordBatch.from_arrays(cols, schema=want)

    return rows.mapInArrow(run, full)


def save(spark: SparkSession, path: str, prepared: DataFrame, config: dict | None = None) -> None:
    store.save(spark, path, "micrograph", {"images": prepared}, config, "search")


def load(spark: SparkSession, path: str, config: dict | None = None) -> DataFrame | None:
    """The prepared micrographs of ``path``; None where there are none, or where they were made under another configuration."""
    if not store.exists(spark, path):
        return None
    meta = store.read_meta(spark, path)
    store.check_format(meta, "micrograph", path)
    if config is not None and meta["config"] != config:
        return None
    return store.load(spark, path, "micrograph")["images"]


def curve_table(prepared: DataFrame, bins: int) -> DataFrame:
    """(image_id, plane, f, freq, noise, signal) of prepared micrographs."""
    planes = prepared.select("image_id", F.posexplode(F.arrays_zip("noise", "signal")).alias("plane", "x"))
    cells = planes.select("image_id", "plane", F.posexplode(F.arrays_zip(F.col("x.noise").alias("noise"), F.col("x.signal").alias("signal"))).alias("f", "y"))
    return cells.select("image_id", "plane", "f", (F.col("f") * R.CORNER / (bins - 1)).alias("freq"), "y.noise", "y.signal")


def level_table(prepared: DataFrame) -> DataFrame:
    """(image_id, row, col, level) of prepared micrographs."""
    cells = prepared.select("image_id", "w", F.posexplode("level").alias("i", "level"))
    return cells.select("image_id", F.floor(F.col("i") / F.col("w")).cast("int").alias("row"), F.pmod("i", "w").cast("int").alias("col"), F.col("level").cast("double").alias("level"))
