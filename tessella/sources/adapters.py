"""Views of the driver tables in the shapes that the operators take, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K, M = 4, 8  # an embedding of 64 numbers is 4 frequencies of 8 complex components
SIDE = 48  # of the images that line items make up
BOX = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p, label, k, m, re, im) of embeddings."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(K * M - 1)), lambda i: F.struct(F.floor(i / M).cast("int").alias("k"), F.pmod(i, F.lit(M)).cast("int").alias("m"), F.get("embedding", 2 * i).cast("double").alias("re"), F.get("embedding", 2 * i + 1).cast("double").alias("im")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("p"), "label", F.explode(cells).alias("c")).select("p", "label", "c.*")


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, k, m, re, im): a template per label, the mean of its embeddings."""
    return features(spark, sf_dir).groupBy(F.col("label").cast("long").alias("n"), "k", "m").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))


def singular_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, m, s) for the energies' queries."""
    return features(spark, sf_dir).groupBy("k", "m").agg((F.avg(F.abs("re")) + 1.0 / (1 + F.first("k") + F.first("m"))).alias("s"))


def tiny_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, row, col, value): embeddings as 8 x 8 images."""
    cells = F.posexplode("embedding").alias("at", "v")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), cells).select("image_id", F.floor(F.col("at") / BOX).cast("int").alias("row"), F.pmod("at", F.lit(BOX)).cast("int").alias("col"), F.col("v").cast("double").alias("value"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, pixel_id, row, col, mip, mean, variance, zscore, best_index, value): line items by return flag as 48 x 48 images."""
    li = table(spark, sf_dir, "lineitem")
    c = F.col
    agg = li.groupBy(c("l_returnflag").alias("image_id"), F.pmod("l_orderkey", F.lit(SIDE)).cast("int").alias("row"), F.pmod("l_partkey", F.lit(SIDE)).cast("int").alias("col")).agg(
        F.max("l_extendedprice").alias("mip"), F.avg("l_extendedprice").alias("mean"), F.avg(c("l_extendedprice") * c("l_extendedprice")).alias("m2"), F.sum("l_suppkey").alias("supp"), F.sum("l_quantity").alias("value"), F.count("*").alias("n")
    )
    var = F.greatest(c("m2") - c("mean") * c("mean"), F.lit(0.0))
    out = agg.withColumn("variance", var).withColumn("zscore", (c("mip") - c("mean")) / F.greatest(F.sqrt("variance"), F.lit(1e-12)))
    return out.select("image_id", (c("row") * SIDE + c("col")).cast("long").alias("pixel_id"), "row", "col", "mip", "mean", "variance", F.when(c("n") > 1, c("zscore")).alias("zscore"), F.pmod("supp", F.lit(36)).alias("best_index"), F.pmod("supp", F.lit(16)).cast("int").alias("best_psi"), "value")
