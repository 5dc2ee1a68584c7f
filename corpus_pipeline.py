"""From raw documents to packed training sequences, stage by stage.

What holds for every stage: a null text counts as empty; very long texts are used whole; repeated rows and rows without
doc_id are rows like others; columns beside doc_id and text pass through, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.llm import packing, quality, secrets, similar
from gridspan.llm.common import shared_folder
from gridspan.llm.queries import bad_labels, packed_digests


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained classifier keeps, all of their rows and columns as they were.

    Rows of equal text are judged alike. Without labels, or with labels of one kind only, the heuristic labellers decide.
    """
    judged = quality.classify(docs.withColumn("__row", F.struct(*docs.columns)).select("__row", "doc_id", "text"), bad_labels(spark, sf_dir))
    return judged.where("keep").select("__row.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, linked by SimHash or by prefixes and verified: word 5-shingles alike to 0.8 or more.

    The row with the smallest doc_id of a group stays, one without doc_id only if none has any; of rows that tie, one. Rows of
    one doc_id with unlike texts all stay. Texts without words are one group.
    """
    return similar.drop_similar(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret and n_chars counted anew for the changed ones; a null text stays null."""
    found = secrets.scan_secrets(docs.select(F.struct(*docs.columns).alias("__row"), "text"))
    # In a step of its own: beside a new column called text, lambdas would read that one.
    found = found.withColumn("__text", secrets.redact(F.col("text"), F.col("secrets")))
    old = {c: F.col(f"__row.`{c}`") for c in docs.columns}
    new = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("secrets") > 0, F.length("__text")).otherwise(old["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return found.select(*((new.get(c, old[c])).alias(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences of 4096 ids along the curve; an empty document is its end id alone."""
    import public_tokenizers

    return packed_digests(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality classifier", quality_classifier), ("SimHash near-dedup", simhash_near_dedup), ("secret scans", secret_scans), ("packing", packing_stage)]

#: Training, fingerprints and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage keeps is written below the shared folder, read again, and removed with the application."""
    folder = f"{shared_folder(spark)}/corpus_pipeline-{uuid.uuid4()}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
