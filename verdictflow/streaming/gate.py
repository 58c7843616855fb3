"""A stream of message lines judged as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.verdicts import assess
from ..sources.rpc import parse, read_line_stream, tool_calls


def assessed_stream(spark: SparkSession, path: str, secret: str | None = None) -> DataFrame:
    return assess(tool_calls(parse(read_line_stream(spark, path))), secret)


def write_audit(assessed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every assessment to Parquet; a restart goes on where the checkpoint ends. Handles all lines that are there, then stops."""
    return assessed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
