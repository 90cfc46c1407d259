"""Named sets of tables with their kind, version and provenance; what was written whole can be read.

A set is a folder of Parquet tables and a table ``meta``, to which a row is added last that names the folder: a set
without it is not there, and one that is written again is the old one until then. Kinds: decomposition, whitening, error_tables, micrograph, result.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = 1
PARTITIONS = {"u": "k", "vh": "k", "error_tables": "tag", "ledger": "image_id", "images": "image_id", "stage_results": "stage"}


def save(spark: SparkSession, path: str, kind: str, tables: dict[str, DataFrame], config: dict | None = None, program: str = "") -> None:
    """Write the tables into a folder of their own, then a row of ``meta`` that names it. A set that is written again is
    the old one until that row is committed, so tables may be made from those they replace; then older folders go."""
    number = (read_meta(spark, path)["number"] + 1) if exists(spark, path) else 0
    folder = f"tables-{number}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        by = PARTITIONS.get(name)
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by and by in df.columns else writer).parquet(f"{path}/{folder}/{name}")
    meta = spark.createDataFrame([(kind, VERSION, program, json.dumps(config or {}, default=str), sorted(tables), folder, number, json.dumps({n: df.schema.jsonValue() for n, df in tables.items()}))], META)
    meta.coalesce(1).write.mode("append").parquet(f"{path}/meta")
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("tables-") and name != folder:
            fs.delete(status.getPath(), True)


META = "kind string, version int, program string, config string, tables array<string>, folder string, number int, schemas string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a set was written whole at ``path``."""
    meta = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
    return meta.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(meta)


def read_meta(spark: SparkSession, path: str) -> dict:
    """The newest row of ``meta``."""
    rows = spark.read.schema(META).parquet(f"{path}/meta").collect()  # one a write
    row = max(rows, key=lambda r: r["number"] or 0)
    return {**row.asDict(), "number": row["number"] or 0, "config": json.loads(row["config"]), "schemas": json.loads(row["schemas"] or "{}")}


def read_attr(spark: SparkSession, path: str, key: str):
    """One value of the recorded configuration; None where it was not recorded."""
    return read_meta(spark, path)["config"].get(key)


def _read(spark: SparkSession, path: str, meta: dict, name: str) -> DataFrame:
    """A table with the types it was written with, those of partition columns included."""
    reader = spark.read.schema(StructType.fromJson(meta["schemas"][name])) if name in meta["schemas"] else spark.read
    return reader.parquet(f"{path}/{meta['folder']}/{name}" if meta["folder"] else f"{path}/{name}")


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return _read(spark, path, read_meta(spark, path), name)


def check_format(meta: dict, kind: str, path: str = "") -> None:
    """Refuse another kind, or a version this code does not know. No version counts as 0."""
    if meta.get("kind") != kind:
        raise ValueError(f"{path} holds {meta.get('kind')!r}, not {kind!r}")
    if (meta.get("version") or 0) > VERSION:
        raise ValueError(f"{path} has version {meta['version']}; this is {VERSION}")


def load(spark: SparkSession, path: str, kind: str) -> dict[str, DataFrame]:
    """The tables, lazily: Spark reads the columns and partitions that a query needs."""
    meta = read_meta(spark, path)
    check_format(meta, kind, path)
    return {name: _read(spark, path, meta, name) for name in meta["tables"]}


def read_config(spark: SparkSession, path: str, program: str) -> dict | None:
    """The configuration recorded by ``program``; None when another wrote the set."""
    meta = read_meta(spark, path)
    return meta["config"] if meta["program"] == program else None


def save_decomposition(spark: SparkSession, path: str, u: DataFrame, s: DataFrame, vh: DataFrame, grid: dict | None, top: int | None = None, blocks: DataFrame | None = None) -> None:
    """Dense, or with ``top`` only the rows of the largest components. A decomposition without its grid is refused."""
    from tessella.operators.energies import to_sparse

    if grid is None:
        raise ValueError("a decomposition is saved with its coordinate grid")
    tables = {"u": u, "s": s, "vh": vh} if top is None else {"u": to_sparse(u, s, top), "s": to_sparse(s, s, top), "vh": to_sparse(vh, s, top)}
    if blocks is not None:
        tables["blocks"] = blocks
    save(spark, path, "decomposition", tables, {"grid": grid, "sparse": top is not None}, "decompose")


def load_decomposition(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables u, s, vh; older sets without a volume column hold volume 0."""
    tables = load(spark, path, "decomposition")
    if "volume" not in tables["u"].columns:
        tables["u"] = tables["u"].withColumn("volume", F.lit(0))
    return tables


def load_result(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a result; older stage results without virtual ids fall back on global ones."""
    tables = load(spark, path, "result")
    stages = tables.get("stage_results")
    if stages is not None and "best_virtual" not in stages.columns:
        tables["stage_results"] = stages.withColumn("best_virtual", F.col("best_index"))
    return tables


def append_maps(path: str, maps: DataFrame) -> None:
    """The exchange maps beside a result, replacing those of the same images only."""
    maps.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("image_id").parquet(f"{path}/maps")


def error_table(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """The profiles of one set of rectangles; a set without them is refused."""
    meta = read_meta(spark, path)
    if tag not in meta["config"].get("tags", []):
        raise ValueError(f"{path} holds no error table of the rectangles {tag}; known: {', '.join(meta['config'].get('tags', []))}")
    return load(spark, path, "error_tables")["error_tables"].where(F.col("tag") == tag)
