"""Documents to training sequences: five stages, each working on all that the one before it kept.

toxicity          documents that the classifier rejects go
near_duplicates   of each component of the Jaccard join (five words, 0.8) the document with the smallest id stays (rows without one come last)
decontamination   documents that share a window with a benchmark item go
pii               personal data in the texts is replaced by its kind
packing           the texts' tokens in sequences of at most 1024

All stages but the last return the columns of their input. A row is removed for its own id and text, so that rows that
repeat an id with other texts, or have none, are documents each. Of rows that repeat an id and a text the one with the
smallest other columns stays; texts without words repeat nothing where they have no id. Stages that send texts to Python
write their table themselves, in small batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, packing, pii, setjoin, toxicity
from tessella.llm.common import free, key_columns, materialise

KEY = ["_k1", "_k2"]
NEAR = setjoin.Law(words=5, num=80, den=100)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    free(spark)  # the rows that it learnt from
    return materialise(toxicity.keep_clean(docs, model), "toxicity")


def with_key(docs: DataFrame) -> DataFrame:
    return docs.select("*", *(v.alias(f"_{k}") for k, v in key_columns().items()))


def keys_of(found: DataFrame) -> DataFrame:
    return found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    grouped = materialise(setjoin.members(docs, NEAR), "groups")
    free(spark)
    kept = with_key(docs).join(keys_of(grouped.where("not stays")), KEY, "left_anti")
    again = keys_of(grouped.where("stays and (n_shingles > 0 or doc_id is not null)").groupBy("k1", "k2").count().where("count > 1"))
    if again.isEmpty():
        return kept.select(*docs.columns)
    marked = kept.join(again.withColumn("_again", F.lit(True)), KEY, "left")
    one = marked.where("_again").groupBy(*KEY).agg(F.min(F.struct(*docs.columns)).alias("one")).select("one.*")
    return marked.where("_again is null").select(*docs.columns).unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("lo is not null")
    return with_key(docs).join(materialise(keys_of(found), "contaminated"), KEY, "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return materialise(pii.redact(docs), "pii")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return materialise(packing.pack(docs), "packing")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]
#: A trained classifier, a packing and transitive links have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if hasattr(out, "_written") else materialise(out, name)
    return docs
