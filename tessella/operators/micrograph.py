"""Preparing micrographs for the noise model: whitening, curves per plane, and the map of local noise levels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import imaging as I

IN_BAND, FLOOR = 0.5, 0.05


def image_filter(average: DataFrame, correction: DataFrame, h: int, w: int, bins: int) -> DataFrame:
    """(image_id, ky, kx, value): the average whitening times the square of the image's own correction."""
    own = I.curve_to_grid(correction, h, w, bins, ("image_id",), "correction").withColumnRenamed("value", "own")
    avg = I.curve_to_grid(average, h, w, bins, (), "curve").select("ky", "kx", F.col("value").alias("avg"))
    return own.join(avg, ["ky", "kx"]).select("image_id", "ky", "kx", (F.col("avg") * F.col("own") * F.col("own")).alias("value"))


def whiten(images: DataFrame, filters: DataFrame, h: int, w: int) -> DataFrame:
    """(image_id, row, col, value) with mean 0 and unbiased variance 1: images (image_id, data) under their own filters."""
    cell = F.col("ky") * (w // 2 + 1) + F.col("kx")
    packed = filters.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(cell.alias("c"), "value"))), lambda x: x["value"]).alias("f"))
    both = images.join(packed, "image_id").select("image_id", F.concat("data", "f").alias("data"))

    def kernel(image_id, data):
        data = data.ravel()
        x, f = data[: h * w].reshape(h, w), data[h * w :].reshape(h, w // 2 + 1)
        y = np.fft.irfft2(np.fft.rfft2(x) * f, s=(h, w))
        sd = y.std(ddof=1)
        y = (y - y.mean()) / sd if sd > 0 else y * 0
        r, c = np.indices((h, w))
        return {"image_id": [image_id] * (h * w), "row": r.ravel().astype(np.int32), "col": c.ravel().astype(np.int32), "value": y.ravel()}

    kind = dict(images.dtypes)["image_id"]
    return I.per_image(both, kernel, 1, h * w + h * (w // 2 + 1), f"image_id {kind}, row int, col int, value double")


def curves(spectrum: DataFrame, ctf: DataFrame, correction: DataFrame, h: int, w: int, bins: int) -> DataFrame:
    """(image_id, plane, f, freq, noise, signal): ring means of power under each plane, and of plane times correction, squared."""
    rings = I.radial_bins(spectrum.sparkSession, h, w, bins)
    c = F.col
    power = spectrum.select("image_id", "ky", "kx", (c("re") * c("re") + c("im") * c("im")).alias("p"))
    grid = I.curve_to_grid(correction, h, w, bins, ("image_id",), "correction").withColumnRenamed("value", "own")
    j = power.join(grid, ["image_id", "ky", "kx"]).join(ctf.select("plane", "ky", "kx", (c("value") * c("value")).alias("c2")), ["ky", "kx"]).join(rings, ["ky", "kx"])
    out = j.groupBy("image_id", "plane", "f").agg(F.sum(c("p") * c("c2") * c("weight")).alias("n"), F.sum(c("c2") * c("own") * c("own") * c("weight")).alias("s"), F.sum("weight").alias("w"))
    return out.select("image_id", "plane", "f", (c("f") * I.CORNER / (bins - 1)).alias("freq"), (c("n") / c("w") / (h * w)).alias("noise"), (c("s") / c("w")).alias("signal"))


def level_map(flat: DataFrame, radius: int) -> DataFrame:
    """(image_id, row, col, level): the mean square over the disk about each pixel, relative to the image's mean of it."""
    from pyspark.sql import Window

    local = I.disk_mean(flat.withColumn("value", F.col("value") * F.col("value")), radius)
    low = F.greatest("value", F.lit(1e-37))
    return local.select("image_id", "row", "col", (low / F.avg(low).over(Window.partitionBy("image_id"))).alias("level"))


def flatten_filter(noise: np.ndarray, band: np.ndarray) -> np.ndarray:
    """The band over the root of the noise on the grid, which is held at FLOOR of its mean in the band or more."""
    inside = band > IN_BAND
    mean = noise[inside].mean() if inside.any() else 1.0
    return band / np.sqrt(np.maximum(noise, FLOOR * mean))
