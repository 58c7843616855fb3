"""Telemetry, audit log and batch gate over assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SIGNATURES

LATENCIES = 2000  # of the latest calls, for percentiles
AUDIT = 500  # newest records kept


def summary(assessed: DataFrame) -> DataFrame:
    """One row: total, counts by verdict, block rate in percent."""
    blocked = F.count_if(F.col("verdict") == "BLOCK")
    return assessed.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("verdict") == "ALLOW").alias("allowed"),
        blocked.alias("blocked"),
        F.count_if(F.col("verdict") == "CONFIRM_REQUIRED").alias("confirm_required"),
        F.coalesce(F.round(100 * blocked / F.nullif(F.count(F.lit(1)), F.lit(0)), 1), F.lit(0.0)).alias("block_rate"),
    )


def at_rank(sorted_values: Column, p: float) -> Column:
    """The element at floor(n * p), counted from 0."""
    return F.get(sorted_values, F.floor(F.size(sorted_values) * F.lit(p)).cast("int"))


def latencies(assessed: DataFrame, latency: str = "latency_ms", seq: str = "seq") -> DataFrame:
    """One row over the latest LATENCIES calls (a top-k report: only that many rows meet in one task)."""
    last = assessed.select(F.col(latency).alias("x"), F.col(seq).alias("s")).orderBy(F.col("s").desc()).limit(LATENCIES)
    all_ = last.agg(F.sort_array(F.collect_list("x")).alias("v"), F.round(F.avg("x"), 3).alias("avg_ms"))
    return all_.select(F.array_min("v").alias("min_ms"), "avg_ms", F.array_max("v").alias("max_ms"), *[at_rank(F.col("v"), p / 100).alias(f"p{p}_ms") for p in (50, 90, 95, 99)])


def by_type(assessed: DataFrame) -> DataFrame:
    """(type, n): violations by type."""
    return assessed.select(F.explode("violations").alias("v")).groupBy(F.col("v.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


def by_signature(assessed: DataFrame) -> DataFrame:
    """(signature, n): violations by signature; the known ones are there with 0."""
    seeds = assessed.sparkSession.createDataFrame([(s,) for s in SIGNATURES], "signature string").select("signature", F.lit(0).cast("long").alias("one"))
    seen = assessed.select(F.explode("violations").alias("v")).select(F.col("v.signature").alias("signature"), F.lit(1).cast("long").alias("one"))
    return seen.unionByName(seeds).groupBy("signature").agg(F.sum("one").alias("n"))


def audit_log(assessed: DataFrame, k: int = 50, seq: str = "seq") -> DataFrame:
    """The `k` newest records, at most AUDIT."""
    return assessed.orderBy(F.col(seq).desc()).limit(min(k, AUDIT)).select(seq, "tool_name", "raw_args", "verdict", "risk_score", F.size("violations").alias("n_violations"), F.array_distinct(F.transform("violations", lambda v: v["type"])).alias("types"))


def gate_batches(assessed: DataFrame) -> DataFrame:
    """`assessed` (batch_id, pos) with `forwarded` and `reply_order`: a blocked item holds its whole batch back, and blocked items are answered first. Calls outside a batch stand alone."""
    own = F.col("verdict") != "ALLOW"
    batch = Window.partitionBy("batch_id")
    return assessed.withColumn("forwarded", F.when(F.col("batch_id").isNull(), ~own).otherwise(~F.bool_or(own).over(batch))).withColumn("reply_order", F.when(F.col("batch_id").isNotNull(), F.row_number().over(batch.orderBy(F.col("verdict") == "ALLOW", "pos"))))


def activity(assessed: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: first and last call, whole seconds between them, calls a second over these (null where there are none)."""
    span = assessed.agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("total"))
    seconds = F.floor(F.unix_micros(F.col("last").cast("timestamp")) / 1_000_000 - F.unix_micros(F.col("first").cast("timestamp")) / 1_000_000)
    return span.select("first", "last", "total", seconds.cast("long").alias("uptime_s")).withColumn("calls_per_s", F.round(F.col("total") / F.nullif("uptime_s", F.lit(0)), 3))
