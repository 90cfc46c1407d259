"""MRC images and volumes, and masks, from any store that Spark reads.

``read`` takes files through Spark's binaryFile source and decodes them in Arrow batches; ``MrcDataSource`` serves
spark.read.format("mrc") with a partition per file, for paths that pyarrow's file systems reach.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values of the MRC2014 format
MODES = {0: "i1", 1: "i2", 2: "f4", 6: "u2", 12: "f2"}
HEADER = 1024


def decode_mrc(content: bytes) -> tuple[np.ndarray, float]:
    """((nz, ny, nx) float32, pixel size in Angstrom)."""
    if len(content) < HEADER:
        raise ValueError("shorter than an MRC header")
    order = ">" if content[212:214] == b"\x11\x11" else "<"
    nx, ny, nz, mode = struct.unpack(order + "4i", content[:16])
    mx = struct.unpack(order + "i", content[28:32])[0]
    cell = struct.unpack(order + "f", content[40:44])[0]
    extra = struct.unpack(order + "i", content[92:96])[0]
    if mode not in MODES:
        raise ValueError(f"MRC mode {mode} is not read")
    data = np.frombuffer(content, np.dtype(order + MODES[mode]), nx * ny * nz, HEADER + extra)
    return data.reshape(nz, ny, nx).astype(np.float32), cell / mx if mx else 1.0


def encode_mrc(data: np.ndarray, pixel_size: float = 1.0) -> bytes:
    data = np.asarray(data, "<f4")
    data = data[None] if data.ndim == 2 else data
    nz, ny, nx = data.shape
    head = bytearray(HEADER)
    struct.pack_into("<10i", head, 0, nx, ny, nz, 2, 0, 0, 0, nx, ny, nz)
    struct.pack_into("<6f", head, 40, nx * pixel_size, ny * pixel_size, nz * pixel_size, 90, 90, 90)
    struct.pack_into("<3i", head, 64, 1, 2, 3)
    struct.pack_into("<3f", head, 76, float(data.min()), float(data.max()), float(data.mean()))
    head[208:212], head[212:216] = b"MAP ", b"\x44\x44\0\0"
    struct.pack_into("<i", head, 108, 20140)
    return bytes(head) + data.tobytes()


def micrograph(content: bytes) -> np.ndarray:
    """One image, its mean taken off; a stack of one is that image, other ranks are refused."""
    data, _ = decode_mrc(content)
    if data.shape[0] != 1:
        raise ValueError(f"a micrograph is one image, got {data.shape}")
    return data[0] - data[0].mean(dtype=np.float64)


def volume(content: bytes) -> np.ndarray:
    data, _ = decode_mrc(content)
    if len(set(data.shape)) != 1:
        raise ValueError(f"a volume is a cube, got {data.shape}")
    return data


IMAGES = "path string, image_id string, h int, w int, pixel_size double, data array<double>"


def image_name(path: str) -> str:
    return path.rsplit("/", 1)[-1].split(".")[0]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, image_id, h, w, pixel_size, data): micrographs of a file, folder or pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                p, content = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                x = micrograph(content)
                yield pa.RecordBatch.from_pylist([{"path": p, "image_id": image_name(p), "h": x.shape[0], "w": x.shape[1], "pixel_size": decode_mrc(content)[1], "data": x.ravel().astype(float)}], schema=pa.schema([("path", pa.string()), ("image_id", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("pixel_size", pa.float64()), ("data", pa.list_(pa.float64()))]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, IMAGES)


def read_volume(spark: SparkSession, path: str) -> np.ndarray:
    """A cube, which the caller's memory holds."""
    rows = spark.read.format("binaryFile").load(path).select("content").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one file")
    return volume(rows[0]["content"])


def pixels(images: DataFrame) -> DataFrame:
    """(image_id, row, col, value) of (image_id, w, data)."""
    flat = images.select("image_id", "w", F.posexplode("data").alias("at", "value"))
    return flat.select("image_id", F.floor(F.col("at") / F.col("w")).cast("int").alias("row"), F.pmod("at", "w").cast("int").alias("col"), "value")


# fixed values of the PNG format
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(content: bytes) -> np.ndarray:
    """8-bit luminance of a non-interlaced PNG of any depth and colour type."""
    if content[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, palette = 8, b"", None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        data = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += data
        at += 12 + size
    if lace:
        raise ValueError("interlaced PNG masks are not read")
    n = _CHANNELS[colour]
    stride, bpp = (w * n * depth + 7) // 8, max(1, n * depth // 8)
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, stride + 1)
    out = np.zeros((h, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].copy()
        if kind == 2:
            line += above
        elif kind:
            for x in range(stride):
                left = int(line[x - bpp]) if x >= bpp else 0
                up = int(above[x])
                corner = int(above[x - bpp]) if x >= bpp else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((left, up, corner), key=lambda v, p=p: abs(p - v))
                line[x] = (int(line[x]) + guess) & 255
        out[y] = above = line
    if depth == 16:
        values = out.reshape(h, -1, 2)[:, :, 0].astype(float)
    elif depth == 8:
        values = out.astype(float)
    else:
        values = np.unpackbits(out, axis=1).reshape(h, -1, depth)
        values = (values * (1 << np.arange(depth - 1, -1, -1))).sum(-1)[:, : w * n].astype(float)
        if colour != 3:
            values *= 255 / ((1 << depth) - 1)
    values = values[:, : w * n].reshape(h, w, n)
    if colour == 3:
        values = palette[values[..., 0].astype(int)].astype(float)
    if values.shape[2] >= 3:
        return (values[..., :3] @ [0.299, 0.587, 0.114]).round().astype(np.uint8)
    return values[..., 0].round().astype(np.uint8)


def decode_mask(path: str, content: bytes, shape: tuple[int, int] | None = None) -> np.ndarray:
    """A boolean mask of .mrc, .npy, .png or .png.gz: what is not 0 is set."""
    name = path.lower()
    if name.endswith(".png.gz"):
        mask = decode_png(gzip.decompress(content)) != 0
    elif name.endswith(".png"):
        mask = decode_png(content) != 0
    elif name.endswith(".npy"):
        mask = np.load(io.BytesIO(content), allow_pickle=False) != 0
    elif name.endswith(".mrc"):
        data, _ = decode_mrc(content)
        mask = data[0] != 0 if len(data) == 1 else data != 0
    else:
        raise ValueError(f"no mask format is known for {path}")
    if mask.ndim != 2 or (shape is not None and mask.shape != tuple(shape)):
        raise ValueError(f"the mask is {mask.shape}, the image {shape}")
    return mask


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, row, col) of the set pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                p = b.column(0)[i].as_py()
                r, c = np.nonzero(decode_mask(p, b.column(1)[i].as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([image_name(p)] * len(r), pa.string()), pa.array(r, pa.int32()), pa.array(c, pa.int32())], names=["image_id", "row", "col"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "image_id string, row int, col int")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(top)
        if info.type == fs.FileType.Directory:
            return [_File(f.path) for f in sorted(store.get_file_info(fs.FileSelector(top)), key=lambda f: f.path) if f.path.endswith(".mrc")]
        return [_File(top)]

    def read(self, partition):
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with store.open_input_file(partition.path) as f:
            content = f.read()
        x = micrograph(content)
        yield partition.path, image_name(partition.path), x.shape[0], x.shape[1], float(decode_mrc(content)[1]), x.ravel().astype(float).tolist()


class MrcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mrc"

    def schema(self) -> str:
        return IMAGES

    def reader(self, schema):
        return _Reader(self.options["path"])
