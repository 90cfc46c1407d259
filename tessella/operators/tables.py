"""Template rows against what a truncated decomposition keeps of them: error tables of the noise model and exact errors.

A template row is (filter, orientation). Its projection is filtered, normalised and masked to the support; its
reconstruction is the sum of its kept cells. Rows are independent, so they are one pass over the orientations, joined
with their weights by template row; rings are summed where both are in memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import rings as R
from tessella.functions.spline import warp_to_image

from . import correlate as C
from .errors import exact_and_signal

PROFILES = ("rec_auto", "res_auto", "rec_res", "sig_rec", "sig_res")


def support(grid) -> np.ndarray:
    """Pixels that the grid's rings cover: where the warp of ones is above one half."""
    return warp_to_image(np.ones((grid.num_angle, grid.num_radius)), grid, preserve_energy=False) > 0.5


def support_radius(mask: np.ndarray) -> int:
    return max(1, int(np.sqrt(mask.sum() / np.pi)))


def tag_of(rectangles: Sequence[Sequence[int]]) -> str:
    """How a table of error profiles is named: by its rectangles, in order."""
    return "+".join("-".join(map(str, r)) for r in sorted(map(C.as_rectangle, rectangles)))


def cells_of(rectangles: Sequence[Sequence[int]], k_max: int, eig_max: int) -> list[tuple[int, int]]:
    """The (k, m) of the rectangles; one that leaves what is stored is refused."""
    out = set()
    for k0, m0, ke, me in map(C.as_rectangle, rectangles):
        if k0 + ke > k_max or m0 + me > eig_max:
            raise ValueError(f"rectangle {(k0, m0, ke, me)} leaves the stored {k_max} x {eig_max} cells")
        out |= {(k, m) for k in range(k0, k0 + ke) for m in range(m0, m0 + me)}
    return sorted(out)


def reconstruction(weights: np.ndarray, kernels: np.ndarray, num_angle: int) -> np.ndarray:
    """The image of (cells,) weights over (cells, h, w) kernels whose k are ``weights``' first axis: real data stores
    k >= 0, and each k but 0 and Nyquist brings its conjugate."""
    return np.tensordot(weights.real, kernels.real, 1) - np.tensordot(weights.imag, kernels.imag, 1)


def doubled(cells: Sequence[tuple[int, int]], num_angle: int) -> np.ndarray:
    k = np.array([c[0] for c in cells])
    return np.where((k == 0) | (2 * k == num_angle), 1.0, 2.0)


def packed_weights(weights: DataFrame, cells: Sequence[tuple[int, int]]) -> DataFrame:
    """(n, re, im): the weights of each template row as arrays over the cells, 0 where one is missing."""
    k_of, m_of = max(c[0] for c in cells) + 1, max(c[1] for c in cells) + 1
    index = {c: i for i, c in enumerate(cells)}
    pick = F.lit([index.get((k, m), -1) for k in range(k_of) for m in range(m_of)])
    inside = weights.where((F.col("k") < k_of) & (F.col("m") < m_of)).withColumn("c", F.get(pick, F.col("k") * m_of + F.col("m"))).where("c >= 0")
    one = inside.groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct("re", "im")))).alias("x"))  # of one template row
    part = lambda name: F.transform(F.sequence(F.lit(0), F.lit(len(cells) - 1)), lambda i: F.coalesce(F.try_element_at("x", i)[name], F.lit(0.0))).alias(name)
    return one.select("n", part("re"), part("im"))


def template_rows(projections: DataFrame, weights: DataFrame, cells: Sequence[tuple[int, int]], n_orientations: int) -> DataFrame:
    """(n, data, re, im): the projection and the weights of each template row of ``projections`` (orientation, data)."""
    rows = packed_weights(weights, cells).withColumn("orientation", F.pmod("n", F.lit(n_orientations)))
    return rows.join(projections, "orientation").select("n", "data", "re", "im")


def profiles(rows: DataFrame, kernels: np.ndarray, cells: Sequence[tuple[int, int]], grid, bins: int, n_orientations: int, *, exact_filters: np.ndarray | None = None, signal_filter: np.ndarray | None = None, normalise: bool = True) -> DataFrame:
    """(n, f, freq, the five PROFILES, template) of ``template_rows``: ring sums of the spectra's products. ``kernels`` are
    (cells, h, w); ``exact_filters`` (filters, h, w // 2 + 1) are those of the decomposition, by the row's filter."""
    h, w = grid.height, grid.width
    sent = rows.sparkSession.sparkContext.broadcast((kernels * doubled(cells, grid.num_angle)[:, None, None], exact_filters, signal_filter, support(grid)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kern, exact_filters, signal_filter, mask = sent.value
        ring = R.Rings(h, w, bins)
        for b in batches:
            for n, data, re, im in zip(b["n"], b["data"], b["re"], b["im"], strict=True):
                own = None if exact_filters is None else exact_filters[n // n_orientations]
                exact, signal = exact_and_signal(np.asarray(data, float).reshape(h, w), own, signal_filter, mask, normalise)
                rec = np.fft.rfft2(reconstruction(np.asarray(re) + 1j * np.asarray(im), kern, grid.num_angle) * mask)
                full = np.fft.rfft2(exact)
                lost, sig = full - rec, full if signal is None else np.fft.rfft2(signal)
                dot = lambda a, c: ring.sum((a.conj() * c).real)
                yield pd.DataFrame({"n": n, "f": np.arange(bins, dtype=np.int32), "freq": R.axis(bins), "rec_auto": dot(rec, rec), "res_auto": dot(lost, lost), "rec_res": dot(rec, lost), "sig_rec": dot(sig, rec), "sig_res": dot(sig, lost), "template": dot(full, full)})

    return rows.select("n", "data", "re", "im").mapInPandas(run, "n long, f int, freq double, " + ", ".join(f"{c} double" for c in PROFILES) + ", template double")


def reconstruct_images(queries: DataFrame, weights: DataFrame, kernels: np.ndarray, cells: Sequence[tuple[int, int]], num_angle: int) -> DataFrame:
    """(q, data array): queries (q, n, psi in radians) as images: the sum of each template's cells, turned in the plane by a
    phase of k psi. Leaving cells out is the truncation to fewer components."""
    k = np.array([c[0] for c in cells])
    sent = queries.sparkSession.sparkContext.broadcast(kernels * doubled(cells, num_angle)[:, None, None])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            turned = [(np.asarray(re) + 1j * np.asarray(im)) * np.exp(1j * k * psi) for re, im, psi in zip(b["re"], b["im"], b["psi"], strict=True)]
            yield pd.DataFrame({"q": b["q"], "data": [reconstruction(w, sent.value, num_angle).ravel() for w in turned]})

    return queries.join(packed_weights(weights, cells), "n").select("q", "psi", "re", "im").mapInPandas(run, "q long, data array<double>")


def exact_errors(table: DataFrame) -> DataFrame:
    """(n, f, error): relative errors of ``profiles`` by template row, by ring, and in total, from one pass."""
    from .errors import summaries

    return summaries(table.select("n", "f", F.col("res_auto").alias("residual"), "template"))


def check_table(meta: dict, decomposition: dict, n_templates: int, table_rows: int) -> None:
    """Refuse error tables that were made of another decomposition: its grid, box, filter or number of template rows."""
    for key in ("grid", "box", "filter"):
        if meta.get(key) != decomposition.get(key):
            raise ValueError(f"the error tables were made under another {key} than the decomposition")
    if table_rows != n_templates:
        raise ValueError(f"the error tables hold {table_rows} template rows, the decomposition {n_templates}")
