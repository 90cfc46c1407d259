"""What the corpus operators share: the shared folder, written cut points and byte-level text kernels.

The kernels work on the UTF-8 buffer of an Arrow string column with numpy, so that no Python object is made for a
word. They take a column in pieces of about ``PIECE`` bytes; a longer text is a piece of its own and is cut again,
at bytes that belong to no word, where per-byte arrays are needed. Memory follows the piece (for a text longer than
that, its number of words), never the partition.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# memory of a batch goes back to the system when the batch is done, not into a pool of the worker
pa.set_memory_pool(pa.system_memory_pool())

_LIBC = ctypes.CDLL(None)


def trim() -> None:
    """Give the memory of a finished batch back to the system, where the C library can: workers outlive their tasks."""
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


PIECE = 1 << 18
ROWS = 1000  # of texts in an Arrow batch
MASK = (1 << 64) - 1
_BASE, _GRAM = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: that of ``spark.checkpoint.dir``, or else one in the session's warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/_steps"
    return where.rstrip("/")


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the time of one job."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut and lost executors cost nothing.

    Python workers get at most ROWS rows at a time, and the job's shuffle files go when it ends.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with settings(df.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(ROWS), spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def free(spark: SparkSession) -> None:
    """Let Spark drop the broadcasts of finished steps, each stage's code among them, from the executors' memory.

    It does so when the driver has collected what named them, which a driver with room to spare may not do for hours.
    Called once a round of an operator that runs many jobs, not for each of them. The driver's own memory follows: what its
    threads and compilers have freed stays in pools of the C library otherwise, which grow with the number of jobs.
    """
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()
    trim_jvm(spark)


def trim_jvm(spark: SparkSession) -> str | None:
    """``trim`` for the driver's JVM, by its diagnostic command; its answer, or None where it has no such command."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    types, values = gateway.new_array(jvm.java.lang.Class, len(kinds)), gateway.new_array(jvm.java.lang.Object, len(kinds))
    try:
        for i, kind in enumerate(kinds):
            types[i] = jvm.java.lang.Class.forName(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface: the server's own class is hidden in its module
        command = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types)
        return command.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return None


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and nothing reads any more."""
    for table in tables:
        path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table._written)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def doc_key(docs: DataFrame, *keep: str) -> DataFrame:
    """(k1, k2, text, *keep): a key that a document has in every scan. Null text is empty.

    Rows that repeat both the id and the text share their key, so what is found for one of them holds for each.
    """
    return docs.select(*(v.alias(k) for k, v in key_columns().items()), F.coalesce("text", F.lit("")).alias("text"), *keep)


def key_columns() -> dict[str, Column]:
    """The key of ``doc_key`` as columns."""
    return {"k1": F.coalesce("doc_id", F.lit(-(1 << 62))), "k2": F.xxhash64("doc_id", F.coalesce("text", F.lit("")))}


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts; offsets[0] is 0."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, PIECE + 2)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS[base] = have = tuple(made)
    return have


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _GRAM) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span: equal runs have equal hashes wherever they stand."""
    up, down = powers(base, len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def lut(chars: str) -> np.ndarray:
    """Which bytes belong to a word: all but those of ``chars``; bytes of 0x80 and more always do."""
    table = np.ones(256, bool)
    table[[ord(c) for c in chars]] = False
    return table


#: [^\x20\x09-\x0D]+
SPACED = lut(" \t\n\x0b\x0c\r")
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, of text whose A-Z are lower-cased first
ALNUM = lut("".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Words of a piece: byte ``start`` and ``end``, ``row`` and 64-bit ``hash``; ``first[r]`` is row r's first word."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = False):
        self.raw, n = LOWER[raw] if lower else raw, len(offsets) - 1
        inside = table[self.raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(raw) + 1, bool)
        before[0], before[1:] = False, inside
        after = np.empty(len(raw) + 1, bool)
        after[-1], after[:-1] = False, inside
        self.start = np.flatnonzero(after & (~before | edge))
        self.end = np.flatnonzero(before & (~after | edge))
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.rows = n
        self.hash = np.empty(len(self.start), np.uint64)
        lo = 0
        while lo < len(self.start):  # per-byte arrays cover about a piece at a time
            a = self.start[lo]
            hi = max(lo + 1, int(np.searchsorted(self.end, a + PIECE, "right")))
            b = self.end[hi - 1]
            self.hash[lo:hi] = span_hash(self.raw[a:b].astype(np.uint64), self.start[lo:hi] - a, self.end[lo:hi] - a, _BASE)
            lo = hi

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of k words of one row."""
        if len(self.start) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[: len(self.row) - k + 1] == self.row[k - 1 :])
        acc = np.zeros(len(self.start) - k + 1, np.uint64)
        for j in range(k):
            acc = acc * np.uint64(_GRAM) + self.hash[j : len(self.hash) - k + 1 + j] + np.uint64(1)
        return at, mix(acc[at])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values."""
    if len(x) < w:
        return x[:0]
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def words_of(column: pa.Array, table: np.ndarray, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, their words) for each piece of a column."""
    raw, offsets = string_parts(column)
    for lo, hi in pieces(offsets):
        yield lo, hi, Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], table, lower)
    trim()


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


BLOOM = 1 << 25  # bits


def bloom_slots(h: np.ndarray) -> np.ndarray:
    return np.stack([(mix(h + np.uint64(i)) % np.uint64(BLOOM)).astype(np.int64) for i in range(2)])


def bloom_of(keys: DataFrame) -> bytes:
    """A filter of fixed size over the column of ``keys``, put together from the bytes that are not zero."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM // 8, np.uint8)
        for b in batches:
            s = bloom_slots(b.column(0).to_numpy().view(np.uint64)).ravel()
            np.bitwise_or.at(bits, s >> 3, (1 << (s & 7)).astype(np.uint8))
        for i in np.flatnonzero(bits.reshape(64, -1).any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(bits.reshape(64, -1)[i].tobytes(), 1)], pa.binary())], names=["block", "bits"])

    def merge(pdf):
        import pandas as pd

        out = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), np.uint8) for x in pdf["bits"]])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "bits": [zlib.compress(out.tobytes(), 1)]})

    whole = np.zeros((64, BLOOM // 8 // 64), np.uint8)
    for r in keys.mapInArrow(slots, "block int, bits binary").groupBy("block").applyInPandas(merge, "block int, bits binary").collect():
        whole[r["block"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return whole.tobytes()


def in_bloom(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Which of the keys may be in the filter: all that are, few that are not while it is sparse."""
    s, table = bloom_slots(np.asarray(keys).view(np.uint64)), np.frombuffer(bits, np.uint8)
    return ((table[s >> 3] >> (s & 7).astype(np.uint8)) & 1).all(0)
