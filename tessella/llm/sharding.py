"""Shards along a Hilbert curve: documents close in several metadata dimensions share a shard and sit close in it.

Each dimension is quantised to ``bits`` bits: numbers on a logarithmic scale, categories by hash (an equality
predicate then picks one slice of 2**bits). The curve index of the cell is the first sort key; the text's crc32 and
the document's id settle the order within a cell, so that equal texts of a cell are neighbours and a hot cell still
spreads over many partitions. Only these narrow keys are shuffled. Ranks come from counts of the written, sorted
partitions; runs of equal rank count are the shards (law `rows`).

Null text has no bytes; null metadata is a category of its own; repeated rows each get a slot; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

BITS = 8
SHARDS = 8


def hilbert_index(coords: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """The index on the Hilbert curve of points with ``bits``-bit coordinates (Skilling's transform, vectorised)."""
    x = [np.asarray(c, np.int64).copy() for c in coords]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(x[0])
    for i in range(n):
        x[i] ^= t
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index([a.to_numpy(), b.to_numpy(), c.to_numpy()], BITS))


def category(column: str) -> Column:
    """A place on the scale for each value; null is one of its own."""
    return F.pmod(F.xxhash64(F.col(column).isNull(), F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(1 << BITS))


def magnitude(value: Column) -> Column:
    """log2 in steps of an eighth: 2**32 fills the scale of eight bits."""
    return F.least(F.floor(F.log2(F.greatest(value, F.lit(1)).cast("double")) * 8), F.lit((1 << BITS) - 1)).cast("long")


def order_on_curve(docs: DataFrame, shards: int = SHARDS, whole: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, cell, rank, n) of all documents, ranked from 0 along the curve; with ``whole`` the row
    itself too, as ``doc``."""
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    size = F.octet_length(text).cast("long") + 1
    keyed = docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.pandas_udf(_curve, "long")(category("lang"), category("source"), magnitude(size)).alias("cell"), *([F.struct("*").alias("doc")] if whole else []))
    keys = ["cell", "text_crc32", "doc_id"]
    spark = docs.sparkSession
    parts = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = materialise(keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "curve")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ordered.groupBy(part.alias("part")).count()  # a row per partition
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"), F.sum("count").over(Window.partitionBy()).alias("n"))
    return ordered.withColumn("part", part).join(before, "part").select("doc_id", "size", "text_crc32", "cell", (F.col("before") + within).alias("rank"), "n", *(["doc"] if whole else []))


def assign(docs: DataFrame, shards: int = SHARDS, whole: bool = False) -> DataFrame:
    """Each document's shard and gapless slot: counts of shards are at most one apart."""
    n = F.col("n")
    extra = F.pmod(n, F.lit(shards))
    low = ((n - extra) / shards).cast("long")
    wide = extra * (low + 1)  # rows in the shards that hold one more
    rank = F.col("rank")
    shard = F.when(rank < wide, F.floor(rank / (low + 1))).otherwise(extra + F.floor((rank - wide) / F.greatest(low, F.lit(1)))).cast("int")
    first = F.when(F.col("shard") <= extra, F.col("shard") * (low + 1)).otherwise(wide + (F.col("shard") - extra) * low)
    return order_on_curve(docs, shards, whole).withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (rank - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("cell").alias("curve_cell"), *(["doc"] if whole else [])
    )


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Documents as Parquet along the curve, a folder per shard: files then cover small boxes of every dimension. Every row
    is written once, in its own slot, whatever its id; a column of its own named ``shard`` leaves that name to ``_shard``."""
    name = "_shard" if "shard" in docs.columns else "shard"
    placed = assign(docs, shards, whole=True).repartitionByRange(shards * 4, "shard", "slot").sortWithinPartitions("shard", "slot")
    placed.select("doc.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
