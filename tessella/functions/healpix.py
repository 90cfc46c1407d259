"""HEALPix in the nested scheme, from the published definition (Gorski et al. 2005): centers, indices and neighbors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: rings and longitudes of the twelve faces
FACE_RING = np.array([2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4])
FACE_PHI = np.array([1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7])


def _split(pix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x and y of interleaved bits."""
    x, y = np.zeros_like(pix), np.zeros_like(pix)
    for b in range(29):
        x |= ((pix >> (2 * b)) & 1) << b
        y |= ((pix >> (2 * b + 1)) & 1) << b
    return x, y


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for b in range(29):
        out |= ((x >> b) & 1) << (2 * b) | ((y >> b) & 1) << (2 * b + 1)
    return out


def pix2ang(nside: int, ipix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(theta, phi) in radians of the pixels' centers."""
    ipix = np.asarray(ipix, np.int64)
    face, within = ipix // nside**2, ipix % nside**2
    x, y = _split(within)
    ring = FACE_RING[face] * nside - x - y - 1
    north, south = ring < nside, ring > 3 * nside
    n = np.where(north, ring, np.where(south, 4 * nside - ring, nside))
    cap = n.astype(float) ** 2 / (3.0 * nside**2)
    z = np.where(north, 1 - cap, np.where(south, cap - 1, (2 * nside - ring) * 2.0 / (3 * nside)))
    shift = np.where(north | south, 0, (ring - nside) & 1)
    j = (FACE_PHI[face] * n + x - y + 1 + shift) // 2
    j = np.where(j > 4 * nside, j - 4 * nside, np.where(j < 1, j + 4 * nside, j))
    return np.arccos(z), (j - (shift + 1) * 0.5) * (np.pi / 2) / n


def ang2pix(nside: int, theta: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """The pixels of directions in radians, by the plane projection of the sphere (Calabretta and Roukema 2007).

    There, in units of a quarter turn, the twelve faces are equal squares on their corners. Coordinates along their sides
    are sums and differences of longitude and height: whole parts tell the face, the rest the place in it.
    """
    z, quarters = np.cos(theta), np.mod(phi, 2 * np.pi) * 2 / np.pi
    middle = np.minimum(np.floor(quarters), 3) + 0.5  # of the quarter, to which longitudes draw near the poles
    narrow = np.minimum(np.sqrt(3 * np.maximum(1 - np.abs(z), 0)), 1.0)  # 1 in the belt
    along = middle + (quarters - middle) * narrow
    height = np.where(np.abs(z) <= 2 / 3, 0.75 * z, np.sign(z) * (1 - narrow / 2))
    rise, fall = along + height + 0.5, along - height + 0.5
    rises, falls = np.floor(rise), np.floor(fall)
    rises, falls = np.minimum(rises, falls + 1), np.minimum(falls, rises + 1)  # a pole is the corner of its faces
    row = np.where(rises == falls, 4, np.where(rises > falls, 0, 8))
    face = row + np.mod(np.minimum(rises, falls), 4).astype(np.int64)
    x = np.clip(np.floor((rise - rises) * nside), 0, nside - 1).astype(np.int64)
    y = nside - 1 - np.clip(np.floor((fall - falls) * nside), 0, nside - 1).astype(np.int64)
    return face * nside**2 + _join(x, y)


def unit_vectors(theta: Column, phi: Column) -> tuple[Column, Column, Column]:
    """x, y, z of degrees."""
    t, p = F.radians(theta), F.radians(phi)
    return F.sin(t) * F.cos(p), F.sin(t) * F.sin(p), F.cos(t)


def orientations(spark: SparkSession, nside: int) -> DataFrame:
    """(orientation, ipix, theta_deg, phi_deg) of all pixel centers."""

    def run(batches):
        for pdf in batches:
            t, p = pix2ang(nside, pdf["id"].to_numpy())
            yield pdf.assign(orientation=pdf["id"], ipix=pdf["id"], theta_deg=np.degrees(t), phi_deg=np.degrees(p))[["orientation", "ipix", "theta_deg", "phi_deg"]]

    return spark.range(12 * nside**2).mapInPandas(run, "orientation long, ipix long, theta_deg double, phi_deg double")


def match_grid(theta_deg: np.ndarray, phi_deg: np.ndarray, tol_deg: float = 0.01, max_nside: int = 1024) -> tuple[int, np.ndarray]:
    """(nside, ipix): the coarsest grid whose centers are the orientations, within ``tol_deg``."""
    t, p = np.radians(theta_deg), np.radians(phi_deg)
    v = np.stack([np.sin(t) * np.cos(p), np.sin(t) * np.sin(p), np.cos(t)], -1)
    nside = 1
    while nside <= max_nside:
        ipix = ang2pix(nside, t, p)
        ct, cp = pix2ang(nside, ipix)
        c = np.stack([np.sin(ct) * np.cos(cp), np.sin(ct) * np.sin(cp), np.cos(ct)], -1)
        if np.degrees(2 * np.arcsin(np.minimum(np.linalg.norm(v - c, axis=-1) / 2, 1))).max() <= tol_deg and len(np.unique(ipix)) == len(ipix):
            return nside, ipix
        nside *= 2
    raise ValueError("the orientations are no HEALPix centers")


def neighbors(spark: SparkSession, nside: int) -> DataFrame:
    """(pixel, neighbor): pixels that share an edge or corner, found by stepping off each pixel's rim.

    Points just outside the pixel, in the eight directions of its face coordinates, are looked up; at the few corners
    where only seven pixels meet one of them repeats another.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            pix = pdf["id"].to_numpy()
            pairs = set()
            for p in pix:
                t, ph = pix2ang(nside, np.array([p]))
                ct = np.array([np.sin(t) * np.cos(ph), np.sin(t) * np.sin(ph), np.cos(t)])[:, 0]
                # a fine ring of points about the center, of one and a half pixel sizes and less
                e1 = np.cross(ct, [0.0, 0.0, 1.0]) if abs(ct[2]) < 0.99 else np.cross(ct, [1.0, 0.0, 0.0])
                e1 /= np.linalg.norm(e1)
                e2 = np.cross(ct, e1)
                # sub-pixels of this pixel, moved outwards by a tenth of a pixel
                sub = 16
                kids = p * sub * sub + np.arange(sub * sub)
                kt, kp = pix2ang(nside * sub, kids)
                kv = np.stack([np.sin(kt) * np.cos(kp), np.sin(kt) * np.sin(kp), np.cos(kt)], -1)
                size = np.sqrt(4 * np.pi / (12 * nside**2)) / sub
                for ang in np.arange(16) * (np.pi / 8):
                    moved = kv + 1.6 * size * (np.cos(ang) * e1 + np.sin(ang) * e2)
                    moved /= np.linalg.norm(moved, axis=-1, keepdims=True)
                    for n in np.unique(ang2pix(nside, np.arccos(np.clip(moved[:, 2], -1, 1)), np.arctan2(moved[:, 1], moved[:, 0]))):
                        if n != p:
                            pairs.add((int(p), int(n)))
            yield pd.DataFrame(sorted(pairs), columns=["pixel", "neighbor"])

    return spark.range(12 * nside**2).mapInPandas(run, "pixel long, neighbor long")
