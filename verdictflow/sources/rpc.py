"""Line-delimited JSON-RPC as calls, from files or streams, and mandate files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import JSON_NAMES, MANDATE_FIELDS

MARK = "struct<params: string>"  # params of any form
MESSAGE = "struct<id: string, method: string, params: struct<name: string, arguments: string>>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_line_stream(spark: SparkSession, path: str, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_a_trigger).text(path)


def parse(lines: DataFrame, col: str = "value", identity: list[str] | None = None) -> DataFrame:
    """`lines` with batch_id, pos, rpc_id, method, tool_name, raw_args, has_params, is_json: a row per message. Lines that aren't JSON objects or arrays give one row of nulls.

    A batch is a line, told apart by the columns `identity`; without them every line is one of its own, whatever its text.
    """
    text = F.trim(F.col(col))
    is_batch = text.startswith("[")
    read = lambda kind: F.when(is_batch, F.from_json(text, f"array<{kind}>")).otherwise(F.array(F.from_json(text, kind)))
    items = F.arrays_zip(read(MESSAGE).alias("m"), read(MARK).alias("mark"))
    batch = F.sha2(F.to_json(F.struct(*identity)), 256) if identity else F.expr("uuid()")
    known = lines.withColumn("batch_id", F.when(is_batch, batch)).withColumn("is_json", F.try_parse_json(text).isNotNull())
    told = known.select("*", F.posexplode_outer(items).alias("pos", "_i")).withColumn("_m", F.col("_i.m"))
    return told.select(*lines.columns, "batch_id", "pos", F.col("_m.id").alias("rpc_id"), F.col("_m.method").alias("method"), F.col("_m.params.name").alias("tool_name"), F.col("_m.params.arguments").alias("raw_args"), F.col("_i.mark.params").isNotNull().alias("has_params"), "is_json")


def unread(messages: DataFrame) -> DataFrame:
    """The messages that are no JSON at all: nothing in them was judged."""
    return messages.where(~F.col("is_json"))


def tool_calls(messages: DataFrame) -> DataFrame:
    """The calls among `messages`: those with params. A missing name is the empty one."""
    return messages.where((F.col("method") == "tools/call") & F.col("has_params")).withColumn("tool_name", F.coalesce("tool_name", F.lit(""))).drop("has_params", "is_json")


def read_mandates(spark: SparkSession, path: str) -> DataFrame:
    """A JSON mandate per file, with the schema stated."""
    schema = ", ".join(f"{name} {MANDATE_FIELDS[field]}" for name, field in JSON_NAMES.items())
    read = spark.read.schema(schema).option("multiLine", True).json(path)
    return read.select(F.struct(*[F.col(name).alias(field) for name, field in JSON_NAMES.items()]).alias("mandate"))
