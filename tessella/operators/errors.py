"""What a truncated decomposition loses, ring by ring: error tables of the noise model, exact errors, and guards."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .energies import ratio
from .imaging import ring_sum


def exact_and_signal(projection: np.ndarray, exact_filter: np.ndarray | None, signal_filter: np.ndarray | None, support: np.ndarray, normalise: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(template: filtered, normalised, within the support; signal: filtered) of one projection."""
    spectrum = np.fft.rfft2(projection)
    exact = projection if exact_filter is None else np.fft.irfft2(spectrum * exact_filter, s=projection.shape)
    if normalise:
        exact = (exact - exact.mean()) / np.sqrt(exact.var(ddof=1) + 1e-8)
    return exact * support, None if signal_filter is None else np.fft.irfft2(spectrum * signal_filter, s=projection.shape)


def cross(a: DataFrame, b: DataFrame, keys: list[str], name: str = "value") -> DataFrame:
    """(keys, ky, kx, name): the real part of conj(a) * b of two spectra."""
    j = a.join(b.select(*keys, "ky", "kx", F.col("re").alias("br"), F.col("im").alias("bi")), [*keys, "ky", "kx"])
    return j.select(*keys, "ky", "kx", (F.col("re") * F.col("br") + F.col("im") * F.col("bi")).alias(name))


def error_profiles(reconstruction: DataFrame, exact: DataFrame, signal: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, f, rec_auto, res_auto, rec_res, sig_rec, sig_res) from spectra (keys, ky, kx, re, im): one join, one aggregate."""
    c, on = F.col, [*keys, "ky", "kx"]
    e = exact.select(*on, c("re").alias("er"), c("im").alias("ei"))
    s = signal.select(*on, c("re").alias("sr"), c("im").alias("si"))
    j = reconstruction.join(e, on).join(s, on).withColumn("dr", c("er") - c("re")).withColumn("di", c("ei") - c("im")).join(bins, ["ky", "kx"])
    dot = lambda p, q, r, t: F.sum((c(p) * c(r) + c(q) * c(t)) * c("weight"))
    return j.groupBy(*keys, "f").agg(
        dot("re", "im", "re", "im").alias("rec_auto"), dot("dr", "di", "dr", "di").alias("res_auto"), dot("re", "im", "dr", "di").alias("rec_res"), dot("sr", "si", "re", "im").alias("sig_rec"), dot("sr", "si", "dr", "di").alias("sig_res")
    )


def residual_energy(exact: DataFrame, reconstruction: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, f, residual, template): ring energies of what is lost and of the template."""
    on = [*keys, "ky", "kx"]
    j = exact.join(reconstruction.select(*on, F.col("re").alias("rr"), F.col("im").alias("ri")), on)
    lost = F.pow(F.col("re") - F.col("rr"), 2) + F.pow(F.col("im") - F.col("ri"), 2)
    own = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    a = ring_sum(j.select(*on, lost.alias("value")), bins, keys).select(*keys, "f", F.col("total").alias("residual"))
    b = ring_sum(j.select(*on, own.alias("value")), bins, keys).select(*keys, "f", F.col("total").alias("template"))
    return a.join(b, [*keys, "f"])


def summaries(energies: DataFrame) -> DataFrame:
    """(n, f, error): relative errors by template row, by ring, and in total (both null), from one pass: grouping sets."""
    return energies.groupingSets([["n"], ["f"], []], "n", "f").agg(ratio(F.sum("residual"), F.sum("template")).alias("error"))


def annulus(row: Column, col: Column, box: tuple[int, int]) -> Column:
    """The one-pixel ring about the box's center that a pixel lies in."""
    return F.floor(F.hypot(row - box[0] // 2, col - box[1] // 2)).cast("int")


def by_radius(pixels: DataFrame, box: tuple[int, int]) -> DataFrame:
    """(r, error) of pixels (row, col, exact, reconstruction)."""
    return pixels.groupBy(annulus(F.col("row"), F.col("col"), box).alias("r")).agg(ratio(F.sum(F.pow(F.col("exact") - F.col("reconstruction"), 2)), F.sum(F.pow("exact", F.lit(2)))).alias("error"))


def check_filter(recorded: DataFrame, wanted: DataFrame, rtol: float = 1e-4, atol: float = 1e-6) -> DataFrame:
    """(cells, worst) of two filters (ky, kx, value); the query fails where they differ by more than the tolerances or
    do not cover the same cells."""
    j = recorded.join(wanted.select("ky", "kx", F.col("value").alias("want")), ["ky", "kx"], "full")
    over = F.coalesce(F.abs(F.col("value") - F.col("want")) - (atol + rtol * F.abs("want")), F.lit(math.inf))
    worst = j.agg(F.count("*").alias("cells"), F.max(over).alias("worst"))
    return worst.where(F.assert_true((F.col("cells") > 0) & (F.col("worst") <= 0), F.lit("the decomposition was made under another filter")).isNull())


def check_bins(bins: DataFrame, n_bins: int) -> DataFrame:
    """(f, weight) of every ring; the query fails when a ring of an image's grid is empty."""
    got = bins.groupBy("f").agg(F.sum("weight").alias("weight"))
    grid = bins.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("f"))
    all_rings = grid.join(got, "f", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return all_rings.where(F.assert_true(F.col("weight") > 0, F.lit("a ring of the table's axis is empty on this image")).isNull())
