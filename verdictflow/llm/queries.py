"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, packing, pii, toxicity, transport_stream
from .chosen_path import jaccard_join
from .cover_tree import near_pairs
from .histogram_sort import histogram_shards
from .prefix_counts import prefix_token_counts

TOKEN_LIMIT = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    crc = F.crc32("token_ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset", "sequence_tokens", "tier", "step_group")


def op2_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = transport_stream.decode(transport_stream.encode(table(spark, sf_dir, "documents")))
    access = F.filter("units", lambda u: u["random_access"])
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("packets="), "packets"),
        F.concat(F.lit("programs="), "programs"),
        F.concat(F.lit("streams="), "streams"),
        F.concat(F.lit("errors="), F.col("continuity_errors") + F.col("sync_errors") + F.col("table_errors") + F.col("packet_errors")),
        F.concat(F.lit("pts="), F.array_join(F.transform("units", lambda u: u["pts"].cast("string")), ",")),
        F.concat(F.lit("access="), F.array_join(F.transform(access, lambda u: F.concat(u["pts"].cast("string"), F.lit("@"), u["packet"].cast("string"))), ",")),
    )
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


HARD_TURN = "\\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TURN).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(hard)
    done = chat_format.format_conversations(turns).select("*", chat_format.formatted(F.col("segments")).alias("whole"), chat_format.loss_text(F.col("segments")).alias("learnt"))
    read = done.select("*", chat_format.read_turns(F.col("whole")).alias("turns"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("whole").cast("long").alias("formatted_chars"),
        "valid",
    )


OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), seen AS (
  SELECT *, row_number() OVER w AS place, lag(role) OVER w AS before,
    replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>') AS escaped,
    CASE WHEN role IN ('system', 'user', 'assistant') THEN role
      ELSE '?' || replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), ':', '\:') END AS label
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(label) + length(escaped) + 14) AS BIGINT) AS formatted_chars,
  bool_and(coalesce((role = 'user' AND (place = 1 OR before IN ('system', 'assistant'))) OR (role = 'system' AND place = 1)
    OR (role = 'assistant' AND before = 'user'), FALSE)) AS valid
FROM seen GROUP BY conv_id
"""


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(table(spark, sf_dir, "embeddings"), cosine=0.98).select("*", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op5_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_key"))
    placed = histogram_shards(rows, ["text_key"], ["doc_id"], "size", shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join(table(spark, sf_dir, "documents"), n=5, threshold=0.8)
    return joined.select("doc_id", "class_id", "rep_id", "n_links", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(documents, pii.fit(documents))
    base = F.filter("pii_spans", lambda s: s["base"])
    of_kind = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *[of_kind(k) for k in pii.BASE_KINDS],
        F.sha2(said(base).cast("binary"), 256).alias("base_sha256"),
        said(F.col("pii_spans")).alias("spans"),
    )


TOXIC = 0.7


def op8_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, model)
    said = F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), said.alias("offending"))


def op9_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hierarchical_packing": op1_hierarchical_packing,
        "op2_transport_stream": op2_transport_stream,
        "op3_chat_format": op3_chat_format,
        "op4_cover_tree": op4_cover_tree,
        "op5_histogram_sort": op5_histogram_sort,
        "op6_chosen_path": op6_chosen_path,
        "op7_weak_supervision": op7_weak_supervision,
        "op8_crf_toxicity": op8_crf_toxicity,
        "op10_byte_bpe": op10_byte_bpe,
        "op9_prefix_counts": op9_prefix_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat_format": OP3_SQL,
    }
