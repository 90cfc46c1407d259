"""The index build: projections of a volume, polar spectra, and a singular value decomposition per angular frequency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.polar import PolarGrid
from tessella.functions.spline import warp_to_polar


def rotation_zyz(phi: Column, theta: Column, psi: Column) -> list[list[Column]]:
    """The matrix of the ZYZ Euler angles in degrees: Rz(phi) Ry(theta) Rz(psi)."""
    a, b, c = F.radians(phi), F.radians(theta), F.radians(psi)
    ca, sa, cb, sb, cc, sc = F.cos(a), F.sin(a), F.cos(b), F.sin(b), F.cos(c), F.sin(c)
    return [[ca * cb * cc - sa * sc, -ca * cb * sc - sa * cc, ca * sb], [sa * cb * cc + ca * sc, -sa * cb * sc + ca * cc, sa * sb], [-sb * cc, sb * sc, cb]]


def rotation_array(phi: float, theta: float, psi: float) -> np.ndarray:
    a, b, c = np.radians([phi, theta, psi])
    rz = lambda t: np.array([[np.cos(t), -np.sin(t), 0], [np.sin(t), np.cos(t), 0], [0, 0, 1]])
    ry = np.array([[np.cos(b), 0, np.sin(b)], [0, 1, 0], [-np.sin(b), 0, np.cos(b)]])
    return rz(a) @ ry @ rz(c)


def volume_spectrum(volume: np.ndarray, pad: float = 2.0) -> tuple[np.ndarray, float, int]:
    """(centered spectrum, edge value times size, padding): edges brought to 0, padded, corrected for linear slicing."""
    d = volume.shape[0]
    if volume.shape != (d, d, d):
        raise ValueError(f"a volume is a cube, got {volume.shape}")
    shell = np.ones(volume.shape, bool)
    n = min(4, d // 2)
    shell[n:-n, n:-n, n:-n] = False
    edge = float(volume[shell].mean())
    width = int(d * (pad - 1.0) // 2) if pad > 1 else 0
    v = np.pad(volume - edge, width)
    s = np.sinc((np.arange(v.shape[0]) - v.shape[0] // 2) / v.shape[0]) ** 2
    v = v / (s[:, None, None] * s[None, :, None] * s[None, None, :])
    return np.fft.fftshift(np.fft.fftn(np.fft.ifftshift(v))), edge * d, width


def project(spectrum: np.ndarray, edge: float, width: int, rotation: np.ndarray) -> np.ndarray:
    """The projection along the rotated z axis: a central slice, read off linearly, and its inverse transform."""
    n = spectrum.shape[0]
    c = n // 2
    ky, kx = np.indices((n, n)) - c
    p = np.stack([kx, ky, np.zeros_like(kx)], -1) @ rotation.T  # x, y, z
    x, y, z = p[..., 0] + c, p[..., 1] + c, p[..., 2] + c
    inside = (np.minimum(np.minimum(x, y), z) >= 0) & (np.maximum(np.maximum(x, y), z) <= n - 1) & (kx**2 + ky**2 <= (n / 2) ** 2)
    x, y, z = (np.where(inside, v, 0.0) for v in (x, y, z))
    lo = [np.minimum(np.floor(v).astype(int), n - 2) for v in (z, y, x)]
    t = [v - i for v, i in zip((z, y, x), lo, strict=True)]
    out = np.zeros((n, n), complex)
    for i in (0, 1):
        for j in (0, 1):
            for k in (0, 1):
                w = (t[0] if i else 1 - t[0]) * (t[1] if j else 1 - t[1]) * (t[2] if k else 1 - t[2])
                out += w * spectrum[lo[0] + i, lo[1] + j, lo[2] + k]
    image = np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(np.where(inside, out, 0)))).real
    return (image[width:-width, width:-width] if width else image) + edge


def projections(orientations: DataFrame, volume: np.ndarray, pad: float = 2.0) -> DataFrame:
    """(orientation, data): orientations (orientation, phi_deg, theta_deg) of a volume that fits a task's memory."""
    sent = orientations.sparkSession.sparkContext.broadcast(volume_spectrum(volume, pad))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"orientation": b["orientation"], "data": [project(*sent.value, rotation_array(p, t, 0.0)).ravel() for p, t in zip(b["phi_deg"], b["theta_deg"], strict=True)]})

    return orientations.select("orientation", "phi_deg", "theta_deg").mapInPandas(run, "orientation long, data array<double>")


def polar_spectra(images: DataFrame, grid: PolarGrid, filters: np.ndarray | None = None, normalise: bool = True, order: int = 5) -> DataFrame:
    """(n, k, re, im arrays over rings): images (orientation, data) under each filter, normalised, warped, transformed."""
    h, w = grid.height, grid.width
    bank = np.ones((1, h, w // 2 + 1)) if filters is None else filters
    count = images.select(F.max("orientation")).first()[0]
    total = 0 if count is None else count + 1
    sent = images.sparkSession.sparkContext.broadcast(bank)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for o, data in zip(b["orientation"], b["data"], strict=True):
                s = np.fft.rfft2(np.asarray(data).reshape(h, w))
                for f, bank_f in enumerate(sent.value):
                    x = np.fft.irfft2(s * bank_f, s=(h, w))
                    if normalise:
                        x = (x - x.mean()) / np.sqrt(x.var(ddof=1) + 1e-8)
                    p = np.fft.rfft(warp_to_polar(x, grid, order), axis=0, norm="ortho")
                    yield pd.DataFrame({"n": f * total + o, "k": np.arange(len(p), dtype=np.int32), "re": list(p.real), "im": list(p.imag)})

    return images.select("orientation", "data").mapInPandas(run, "n long, k int, re array<double>, im array<double>")


def randomised_svd(x: np.ndarray, rank: int, oversample: int = 20, rounds: int = 2, seed: int = 0):
    """Leading singular triplets by a random range finder with power iterations."""
    q = min(rank + oversample, *x.shape)
    y = x @ np.random.default_rng(seed).normal(size=(x.shape[1], q))
    for _ in range(rounds):
        y, _ = np.linalg.qr(y)
        y = x @ (x.conj().T @ y)
    q_, _ = np.linalg.qr(y)
    u, s, vh = np.linalg.svd(q_.conj().T @ x, full_matrices=False)
    return (q_ @ u)[:, :rank], s[:rank], vh[:rank]


def svd_per_frequency(spectra: DataFrame, eig_max: int, k_max: int | None = None, low_rank: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """u (n, k, m, re, im), s (k, m, s), vh (k, m, r, re, im). Frequencies are the groups: one is a task's work, of the
    templates' number times the rings', which the decomposition needs in one place."""
    rows = spectra if k_max is None else spectra.where(F.col("k") < k_max)

    def factor(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        x = np.stack(pdf["re"].to_numpy()) + 1j * np.stack(pdf["im"].to_numpy())
        u, s, vh = randomised_svd(x, eig_max) if low_rank else np.linalg.svd(x, full_matrices=False)
        e = min(eig_max, len(s))
        k, parts = int(pdf["k"].iloc[0]), []
        for m in range(e):
            parts.append(pd.DataFrame({"part": "u", "n": pdf["n"].to_numpy(), "m": m, "re": u[:, m].real, "im": u[:, m].imag}))
            parts.append(pd.DataFrame({"part": "vh", "n": np.arange(vh.shape[1]), "m": m, "re": vh[m].real, "im": vh[m].imag}))
        parts.append(pd.DataFrame({"part": "s", "n": 0, "m": np.arange(e), "re": s[:e], "im": 0.0}))
        return pd.concat(parts).assign(k=k)[["part", "n", "k", "m", "re", "im"]]

    out = rows.groupBy("k").applyInPandas(factor, "part string, n long, k int, m int, re double, im double")
    return out.where("part = 'u'").drop("part"), out.where("part = 's'").select("k", "m", F.col("re").alias("s")), out.where("part = 'vh'").select("k", "m", F.col("n").alias("r"), "re", "im")


def block_energies(spectra: DataFrame, num_angle: int) -> DataFrame:
    """(n, k, energy) before any truncation."""
    from .energies import parseval_weight

    square = F.aggregate(F.zip_with("re", "im", lambda a, b: a * a + b * b), F.lit(0.0), lambda s, x: s + x)
    return spectra.select("n", "k", (parseval_weight(F.col("k"), num_angle) * square).alias("energy"))


def random_decomposition(spark: SparkSession, rows: int, k_max: int, eig_max: int, radii: int, seed: int = 0) -> dict[str, DataFrame]:
    """A seeded decomposition for tests and examples: tables u, s and vh."""
    rng = np.random.default_rng(seed)
    i = np.indices((rows, k_max, eig_max)).reshape(3, -1)
    u = pd.DataFrame({"n": i[0], "k": i[1].astype(np.int32), "m": i[2].astype(np.int32), "re": rng.normal(size=i.shape[1]), "im": rng.normal(size=i.shape[1])})
    j = np.indices((k_max, eig_max)).reshape(2, -1)
    s = pd.DataFrame({"k": j[0].astype(np.int32), "m": j[1].astype(np.int32), "s": np.sort(rng.random((k_max, eig_max)), 1)[:, ::-1].ravel()})
    v = np.indices((k_max, eig_max, radii)).reshape(3, -1)
    vh = pd.DataFrame({"k": v[0].astype(np.int32), "m": v[1].astype(np.int32), "r": v[2], "re": rng.normal(size=v.shape[1]), "im": rng.normal(size=v.shape[1])})
    return {name: spark.createDataFrame(t) for name, t in (("u", u), ("s", s), ("vh", vh))}
