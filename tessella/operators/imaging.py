"""Images as (image_id, row, col, value): geometry, masks, spectra, whitening, optics and features."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import rings

CORNER = math.sqrt(2) / 2  # of the frequency square, in cycles per pixel


def positions(flat: Column, out_h: int, out_w: int, offset: tuple[int, int] = (0, 0)) -> dict[str, Column]:
    """image, row and col of a flat position."""
    per = out_h * out_w
    return {"image": F.floor(flat / per).cast("long"), "row": (F.floor(F.pmod(flat, F.lit(per)) / out_w) + offset[0]).cast("int"), "col": (F.pmod(flat, F.lit(out_w)) + offset[1]).cast("int")}


def search_grid(image: tuple[int, int], box: tuple[int, int], center_only: bool | None = None) -> tuple[tuple[int, int], tuple[int, int]]:
    """((out_h, out_w), offset): valid positions of a box, or the one central position."""
    h, w = image[0] - box[0] + 1, image[1] - box[1] + 1
    if h < 1 or w < 1:
        raise ValueError(f"a {box} box does not fit into a {image} image")
    if center_only or (center_only is None and image == box):
        return (1, 1), ((image[0] - box[0]) // 2, (image[1] - box[1]) // 2)
    return (h, w), (0, 0)


def grid_mask(mask: DataFrame, box: tuple[int, int], out: tuple[int, int]) -> DataFrame:
    """Positions whose box center is set in the mask (image_id, row, col): center at h // 2, w // 2 from the corner."""
    r, c = F.col("row") - box[0] // 2, F.col("col") - box[1] // 2
    moved = mask.select(*(x for x in mask.columns if x not in ("row", "col")), r.alias("row"), c.alias("col"))
    return moved.where(F.col("row").between(0, out[0] - 1) & F.col("col").between(0, out[1] - 1))


def scatter(grid: DataFrame, values: DataFrame, keys: list[str], column: str, fill: float) -> DataFrame:
    return grid.join(values.select(*keys, column), keys, "left").withColumn(column, F.coalesce(column, F.lit(fill)))


def frequency_axis(spark: SparkSession, bins: int) -> DataFrame:
    """(f, freq): ``bins`` frequencies from 0 to the corner of the square."""
    return spark.range(bins).select(F.col("id").cast("int").alias("f"), (F.col("id") * CORNER / (bins - 1)).alias("freq"))


def rfft_grid(spark: SparkSession, h: int, w: int) -> DataFrame:
    """(ky, kx, fy, fx, radius, hermitian) of the half spectrum of an (h, w) image."""
    cells = spark.range(h * (w // 2 + 1)).select(F.floor(F.col("id") / (w // 2 + 1)).cast("int").alias("ky"), F.pmod("id", F.lit(w // 2 + 1)).cast("int").alias("kx"))
    fy = F.when(F.col("ky") < (h + 1) // 2, F.col("ky")).otherwise(F.col("ky") - h) / h
    ends = (0, w // 2) if w % 2 == 0 else (0,)
    out = cells.withColumn("fy", fy).withColumn("fx", F.col("kx") / w)
    return out.withColumn("radius", F.hypot("fy", "fx")).withColumn("hermitian", F.when(F.col("kx").isin(*ends), 1.0).otherwise(2.0))


def radial_bins(spark: SparkSession, h: int, w: int, bins: int) -> DataFrame:
    """(ky, kx, f, weight): each cell split linearly between its two rings, by Hermitian weight over the image's size."""
    step = CORNER / (bins - 1)
    c = F.col
    right = F.ceil(F.round(c("radius") / step, 9)).cast("int")  # on a ring, that ring
    g = rfft_grid(spark, h, w).withColumn("hi", F.least(right, F.lit(bins - 1))).withColumn("lo", F.greatest(F.least(right - 1, F.lit(bins - 1)), F.lit(0)))
    t = F.when(c("lo") == c("hi"), F.lit(0.0)).otherwise((c("radius") - c("lo") * step) / step)
    scale = F.when(c("radius") < CORNER + step, c("hermitian")).otherwise(0.0) / (h * w)
    parts = F.explode(F.array(F.struct(c("lo").alias("f"), ((1 - t) * scale).alias("weight")), F.struct(c("hi").alias("f"), (t * scale).alias("weight")))).alias("x")
    return g.select("ky", "kx", parts).select("ky", "kx", "x.f", "x.weight").groupBy("ky", "kx", "f").agg(F.sum("weight").alias("weight")).where("weight <> 0")


def ring_sum(values: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, f, total, count) of (keys, ky, kx, value); every cell of the grid is in ``values``."""
    return values.join(bins, ["ky", "kx"]).groupBy(*keys, "f").agg(F.sum(F.col("value") * F.col("weight")).alias("total"), F.sum("weight").alias("count"))


def ring_mean(values: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    return ring_sum(values, bins, keys).select(*keys, "f", (F.col("total") / F.col("count")).alias("value"))


def naive_dft(pixels: DataFrame, h: int, w: int, keys: list[str]) -> DataFrame:
    """(keys, ky, kx, re, im): the half spectrum as a join-free sum of cosines; for small images and as the kernel's check."""
    cells = F.explode(F.sequence(F.lit(0), F.lit(h * (w // 2 + 1) - 1))).alias("_c")
    x = pixels.select(*keys, "row", "col", "value", cells)
    ky, kx = F.floor(F.col("_c") / (w // 2 + 1)).cast("int"), F.pmod("_c", F.lit(w // 2 + 1)).cast("int")
    x = x.withColumn("ky", ky).withColumn("kx", kx)
    turn = 2 * math.pi * (F.pmod(F.col("ky") * F.col("row"), F.lit(h)) / h + F.pmod(F.col("kx") * F.col("col"), F.lit(w)) / w)
    return x.groupBy(*keys, "ky", "kx").agg(F.sum(F.col("value") * F.cos(turn)).alias("re"), F.sum(-F.col("value") * F.sin(turn)).alias("im"))


def image_rows(pixels: DataFrame, h: int, w: int) -> DataFrame:
    """(image_id, data): each image's values in row order; one image is one row, as the kernels take it."""
    at = F.col("row") * w + F.col("col")
    cells = pixels.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct(at.alias("k"), F.col("value").cast("double").alias("v")))).alias("m"))
    return cells.select("image_id", F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("data"))


def merged(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches: small images give small ones."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def per_image(images: DataFrame, kernel, h: int, w: int, schema: str) -> DataFrame:
    """Rows that ``kernel(image_id, array)`` yields as tuples, for each image; an image at a time is in memory."""

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    want = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = np.asarray(b.column(1)[i].values.to_numpy(zero_copy_only=False)).reshape(h, w)
                got = kernel(b.column(0)[i].as_py(), data)
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in want], schema=want)

    return images.select("image_id", "data").mapInArrow(lambda batches: merged(run(batches)), schema)


def fft_kernel(image_id, data: np.ndarray) -> dict:
    s = np.fft.rfft2(data)
    ky, kx = np.indices(s.shape)
    n = s.size
    return {"image_id": [image_id] * n, "ky": ky.ravel().astype(np.int32), "kx": kx.ravel().astype(np.int32), "re": s.real.ravel(), "im": s.imag.ravel()}


def spectra(images: DataFrame, h: int, w: int) -> DataFrame:
    """(image_id, ky, kx, re, im) by the Arrow kernel."""
    kind = dict(images.dtypes)["image_id"]
    return per_image(images, fft_kernel, h, w, f"image_id {kind}, ky int, kx int, re double, im double")


def amplitude_spectrum(spectrum: DataFrame, h: int, w: int, bins: int) -> DataFrame:
    """(image_id, f, freq, amplitude): RMS amplitude on rings, without the constant."""
    power = F.when((F.col("ky") == 0) & (F.col("kx") == 0), 0.0).otherwise(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    rings = ring_mean(spectrum.select("image_id", "ky", "kx", power.alias("value")), radial_bins(spectrum.sparkSession, h, w, bins), ["image_id"])
    return rings.select("image_id", "f", (F.col("f") * CORNER / (bins - 1)).alias("freq"), F.sqrt("value").alias("amplitude"))


def whitening_curve(spectrum: DataFrame, max_freq: float | None = 0.5, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """``spectrum`` (keys, f, freq, amplitude) with curve: 1 / amplitude (0 where that is 0) over its largest value up to
    ``max_freq``, and 1 above."""
    inv = F.when(F.col("amplitude") == 0, F.lit(0.0)).otherwise(F.try_divide(F.lit(1.0), F.col("amplitude")))
    above = F.lit(False) if max_freq is None else F.col("freq") > max_freq
    top = F.max(F.when(~above, inv)).over(Window.partitionBy(*keys))
    return spectrum.withColumn("curve", F.when(above, F.lit(1.0)).otherwise(F.try_divide(inv, top)))


def average_spectrum(spectrum: DataFrame) -> DataFrame:
    """(f, freq, amplitude): RMS over images."""
    return spectrum.groupBy("f").agg(F.min("freq").alias("freq"), F.sqrt(F.avg(F.col("amplitude") * F.col("amplitude"))).alias("amplitude"))


def correction_curve(spectrum: DataFrame, max_freq: float | None = 0.5) -> DataFrame:
    """(image_id, f, freq, correction): the image's whitening over the average one, 1 where that is 0."""
    own = whitening_curve(spectrum, max_freq)
    avg = whitening_curve(average_spectrum(spectrum).withColumn("image_id", F.lit(0)), max_freq).select("f", F.col("curve").alias("avg"))
    return own.join(avg, "f").select("image_id", "f", "freq", F.when(F.col("avg") == 0, F.lit(1.0)).otherwise(F.try_divide("curve", "avg")).alias("correction"))


def curve_to_grid(curve: DataFrame, h: int, w: int, bins: int, keys: tuple[str, ...] = ("image_id",), column: str = "curve") -> DataFrame:
    """(keys, ky, kx, value): the curve on the half spectrum, linear between its points, 1 where it has none. A curve is a
    row, and the grid is made where it is."""
    one = curve.groupBy(*keys).agg(F.collect_list(F.struct(F.col("f").cast("int").alias("f"), F.col(column).cast("double").alias("v"))).alias("x"))  # a ring each
    cells = np.arange(h * (w // 2 + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = rings.radii(h, w).ravel() * (bins - 1) / CORNER
        lo = np.floor(np.round(at, 9)).astype(int)
        t = np.maximum(at - lo, 0.0)
        size = max(bins, lo.max() + 1) + 1
        ky, kx = pa.array(cells // (w // 2 + 1), pa.int32()), pa.array(cells % (w // 2 + 1), pa.int32())
        for b in batches:
            for i in range(b.num_rows):
                x = b.column(b.num_columns - 1)[i].values
                f, v = x.field("f").to_numpy(zero_copy_only=False), x.field("v").to_numpy(zero_copy_only=False)
                points = np.full(size, np.nan)
                ok = (f >= 0) & (f < size)
                points[f[ok]] = v[ok]
                high = np.where((t < 1e-9) & np.isnan(points[lo + 1]), points[lo], points[lo + 1])
                value = points[lo] + t * (high - points[lo])
                own = [pa.repeat(b.column(j)[i], len(cells)) for j in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, ky, kx, pa.array(np.where(np.isnan(value), 1.0, value))], names=[*keys, "ky", "kx", "value"])

    kinds = dict(curve.dtypes)
    return one.mapInArrow(lambda batches: merged(run(batches)), ", ".join([*(f"{k} {kinds[k]}" for k in keys), "ky int", "kx int", "value double"]))


def band(radius: Column, cutoff: float, falloff: float) -> Column:
    """A low-pass with a half-cosine edge of width ``falloff`` about the cutoff."""
    lo, hi = cutoff - falloff / 2, cutoff + falloff / 2
    return F.when(radius <= lo, 1.0).when(radius >= hi, 0.0).otherwise(0.5 * (1 + F.cos(math.pi * (radius - lo) / falloff)))


def wavelength(voltage_kv: float) -> float:
    """Of electrons, in Angstrom: the relativistic formula. Constants are fixed values."""
    v = voltage_kv * 1e3
    return 12.2642596588 / math.sqrt(v * (1 + 0.978466746e-6 * v))


def ctf(grid: DataFrame, planes: DataFrame, pixel_size: float, voltage: float = 300.0, cs_mm: float = 2.7, amplitude_contrast: float = 0.07, phase_shift: float = 0.0) -> DataFrame:
    """(plane, ky, kx, value): planes (plane, defocus in um, astigmatism in um, angle in degrees) on the half spectrum.

    A negative astigmatism is its magnitude a quarter turn on.
    """
    lam, cs = wavelength(voltage), cs_mm * 1e7
    c = F.col
    p = planes.select("plane", "defocus", F.abs("astigmatism").alias("ast"), (c("angle") + F.when(c("astigmatism") < 0, 90.0).otherwise(0.0)).alias("angle"))
    g2 = (c("fy") * c("fy") + c("fx") * c("fx")) / pixel_size**2
    local = 1e4 * (c("defocus") + c("ast") * F.cos(2 * (F.atan2("fy", "fx") - F.radians("angle"))))
    chi = math.pi * lam * local * g2 - 0.5 * math.pi * cs * lam**3 * g2 * g2 + math.radians(phase_shift) + math.atan(amplitude_contrast / math.sqrt(1 - amplitude_contrast**2))
    return grid.join(p, F.lit(True)).select("plane", "ky", "kx", (-F.sin(chi)).alias("value"))  # a few planes


def normalise(pixels: DataFrame) -> DataFrame:
    """Each image with mean 0 and unbiased variance 1; a constant image is 0."""
    w = Window.partitionBy("image_id")
    return pixels.withColumn("value", F.coalesce(F.try_divide(F.col("value") - F.avg("value").over(w), F.nullif(F.stddev_samp("value").over(w), F.lit(0.0))), F.lit(0.0)))


def disk_mean(pixels: DataFrame, radius: int) -> DataFrame:
    """(image_id, row, col, value): the mean over the disk about each pixel, of what of it lies in the image. An image at a
    time, by running sums."""
    kind = dict(pixels.dtypes)["image_id"]
    one = pixels.groupBy("image_id").agg(F.collect_list(F.struct(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = b.column(1)[i].values
                r, c, v = (x.field(f).to_numpy(zero_copy_only=False) for f in ("row", "col", "value"))
                values, there = np.zeros((r.max() + 1, c.max() + 1)), np.zeros((r.max() + 1, c.max() + 1))
                values[r, c], there[r, c] = v, 1.0
                mean = rings.disk_mean(values, radius)[r, c] / rings.disk_mean(there, radius)[r, c]
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[i], len(r)), pa.array(r), pa.array(c), pa.array(mean)], names=["image_id", "row", "col", "value"])

    return one.mapInArrow(lambda batches: merged(run(batches)), f"image_id {kind}, row int, col int, value double")


def featurize(pixels: DataFrame, kernels: DataFrame, box: tuple[int, int], out: tuple[int, int]) -> DataFrame:
    """(image_id, row, col, k, m, re, im): each position's box against kernels (k, m, dr, dc, re, im), conjugated.

    Kernels are few (they are checked to fit a broadcast); boxes are views of an image, multiplied with all kernels at once.
    """
    from .correlate import fits

    if not fits(kernels, 64):
        raise ValueError("these kernels are larger than a broadcast may be")
    rows = kernels.toPandas()
    index = sorted(set(zip(rows["k"], rows["m"], strict=True)))
    bank = np.zeros((len(index), *box), complex)
    bank[[index.index(c) for c in zip(rows["k"], rows["m"], strict=True)], rows["dr"], rows["dc"]] = rows["re"] + 1j * rows["im"]
    k, m = (np.array(x, np.int32) for x in zip(*index, strict=True))
    h, w = out[0] + box[0] - 1, out[1] + box[1] - 1

    def kernel(image_id, data):
        boxes = np.lib.stride_tricks.sliding_window_view(data, box).reshape(-1, box[0] * box[1])
        y = boxes @ bank.reshape(len(index), -1).conj().T
        at = np.repeat(np.arange(len(y)), len(index))
        return {"image_id": [image_id] * y.size, "row": (at // out[1]).astype(np.int32), "col": (at % out[1]).astype(np.int32), "k": np.tile(k, len(y)), "m": np.tile(m, len(y)), "re": y.real.ravel(), "im": y.imag.ravel()}

    inside = pixels.where((F.col("row") < h) & (F.col("col") < w))
    kind = dict(pixels.dtypes)["image_id"]
    return per_image(image_rows(inside, h, w), kernel, h, w, f"image_id {kind}, row int, col int, k int, m int, re double, im double")


def featurize_fft(images: DataFrame, kernels: np.ndarray, h: int, w: int) -> DataFrame:
    """The same by transforms: kernels (K, M, kh, kw) complex, of a size the caller has checked; one image at a time."""
    k, m, kh, kw = kernels.shape
    sent = images.sparkSession.sparkContext.broadcast(kernels)

    def kernel(image_id, data):
        spec = np.fft.fft2(data)
        out = {c: [] for c in ("row", "col", "k", "m", "re", "im")}
        rows, cols = np.indices((h - kh + 1, w - kw + 1))
        for i in range(k):
            for j in range(m):
                y = np.fft.ifft2(spec * np.fft.fft2(sent.value[i, j], (h, w)).conj())[: h - kh + 1, : w - kw + 1]
                for name, v in (("row", rows), ("col", cols), ("k", np.full(rows.shape, i)), ("m", np.full(rows.shape, j))):
                    out[name].append(v.ravel().astype(np.int32))
                out["re"].append(y.real.ravel())
                out["im"].append(y.imag.ravel())
        cols_ = {c: np.concatenate(v) for c, v in out.items()}
        return {"image_id": [image_id] * len(cols_["row"]), **cols_}

    kind = dict(images.dtypes)["image_id"]
    return per_image(images, kernel, h, w, f"image_id {kind}, row int, col int, k int, m int, re double, im double")


def filtered(images: DataFrame, filters: np.ndarray, h: int, w: int) -> DataFrame:
    """(image_id, plane, row, col, value): images under each of the (D, H, W // 2 + 1) filters."""
    sent = images.sparkSession.sparkContext.broadcast(filters)

    def kernel(image_id, data):
        s = np.fft.rfft2(data)
        out = np.stack([np.fft.irfft2(s * f, s=(h, w)) for f in sent.value])
        d, r, c = np.indices(out.shape)
        return {"image_id": [image_id] * out.size, "plane": d.ravel().astype(np.int32), "row": r.ravel().astype(np.int32), "col": c.ravel().astype(np.int32), "value": out.ravel()}

    kind = dict(images.dtypes)["image_id"]
    return per_image(images, kernel, h, w, f"image_id {kind}, plane int, row int, col int, value double")
