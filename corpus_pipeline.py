"""The corpus pipeline: toxic documents go, one document of each group of near copies stays, personal data is replaced, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between stages the rows are written and read again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.llm import packing, pii, toxicity
from verdictflow.llm.chosen_path import jaccard_join
from verdictflow.llm.common import cut, ensure_checkpoint_dir, remove

SCORE, SPANS = "_pipeline_score", "_pipeline_spans"  # the stages' own columns; no document has them
TOXIC = 0.7  # documents of this score or more are rejected


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; null texts and those without words stay, and so do repeated rows."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, keep=True, score_col=SCORE, spans_col=SPANS)
    return scored.where(F.col(SCORE) < TOXIC).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 0.8 on five-word shingles connect, the document of least id; repeated rows of an id and text are one row. Texts that share an id are documents of their own.

    Rows without id and texts without words belong to no group and stay.
    """
    named = docs.where(F.col("doc_id").isNotNull()).withColumn("_key", F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")))
    keys = cut(named.select("doc_id", "_key").distinct())
    if keys.groupBy("doc_id").count().where("count > 1").isEmpty():
        numbers = keys.withColumn("_node", F.col("doc_id").cast("long"))
        joined = jaccard_join(docs, n=5, threshold=0.8)
    else:  # an id stands for several texts: they are told apart by numbers in the order of id and key
        numbers = cut(keys.sort("doc_id", "_key").withColumn("_node", F.monotonically_increasing_id()))
        joined = jaccard_join(named.join(numbers, ["doc_id", "_key"]).select(F.col("_node").alias("doc_id"), "text"), n=5, threshold=0.8)
    kept = joined.where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").cast("long").alias("_node")).distinct()
    kept = numbers.join(kept, "_node", "left_semi").drop("_node")
    named = named.join(kept, ["doc_id", "_key"], "left_semi").dropDuplicates(["doc_id", "_key"])
    return named.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(F.col("doc_id").isNull()))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind, in texts of any length; n_chars is that of the new text. All rows stay; null texts stay null."""
    found = pii.find(docs, pii.fit(docs), spans_col=SPANS)
    text = F.when(F.col("text").isNotNull(), pii.redact(F.col("text"), F.col(SPANS)))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens; null and empty texts are the end id alone, and repeated rows are documents of their own."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

#: No stage can be written in SQL: a trained field, a randomized join, estimated reliabilities and a tokenizer. Tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written to the shared checkpoint folder and read again as the next one's input. What a later stage has taken over is removed."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
