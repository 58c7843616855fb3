"""Mandates over time: changes fold in order, and every call is judged under the version of its time."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.evaluate import loosens, requested
from ..schema import MANDATE, default_mandate


def step(now: dict[str, Any], request: str | None, own: str | None, secret: str | None, cwd: str) -> tuple[dict[str, Any], str]:
    """A mandate after a request, or a reset if there is none, and the request's status. `own` is the secret that comes with the request."""
    if request is None:
        return default_mandate(cwd), "mandate_reset"
    wanted, expected = requested(request), now.get("operator_secret") or secret
    if loosens(now, wanted, cwd) and now.get("is_locked") and not (expected and own == expected):
        return now, "ESCALATION_BLOCKED"
    return now | wanted, "mandate_updated"


def history(changes: DataFrame, secret: str | None = None, cwd: str = "/workspace") -> DataFrame:
    """(session_id, seq, status, mandate) per row of `changes` (session_id, seq, request JSON, secret; a null request resets).

    Rows without session_id are one session of their own.

    Rows of a session are taken in order from a sorted partition; one mandate is held in memory, whatever a session's length.
    """
    schema = f"session_id {changes.schema['session_id'].dataType.simpleString()}, seq long, status string, mandate string"

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, now = object(), {}
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if r.session_id != last:
                    last, now = r.session_id, default_mandate(cwd)
                now, status = step(now, r.request, r.secret, secret, cwd)
                out.append((r.session_id, r.seq, status, json.dumps(now)))
            yield pd.DataFrame(out, columns=["session_id", "seq", "status", "mandate"])

    rows = changes.select("session_id", F.col("seq").cast("long").alias("seq"), "request", "secret")
    # apart, since a column of numbers with nulls reaches pandas as floats
    known, other = rows.where("session_id is not null"), rows.where("session_id is null").withColumn("session_id", F.lit(""))
    folded = known.repartition("session_id").sortWithinPartitions("session_id", "seq").mapInPandas(fold, schema)
    nameless = other.repartition("session_id").sortWithinPartitions("seq").mapInPandas(fold, "session_id string, seq long, status string, mandate string")
    nameless = nameless.withColumn("session_id", F.lit(None).cast(changes.schema["session_id"].dataType))
    return folded.unionByName(nameless).withColumn("mandate", F.from_json("mandate", MANDATE))


def as_of(calls: DataFrame, versions: DataFrame) -> DataFrame:
    """`calls` with the latest `mandate` of their session at or before their seq; null before the first, and from a version on whose mandate is null. Columns of `calls` named mandate give way."""
    order = Window.partitionBy("session_id").orderBy("seq", F.col("_call").asc())
    kept = calls.drop("mandate")
    both = kept.withColumn("_call", F.lit(True)).unionByName(versions.select("session_id", "seq", F.struct("mandate").alias("_version")).withColumn("_call", F.lit(False)), allowMissingColumns=True)
    seen = both.withColumn("_last", F.last("_version", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return seen.where("_call").select(*[F.col(f"`{c}`") for c in kept.columns], F.col("_last.mandate").alias("mandate"))


def current(calls: DataFrame, mandates: DataFrame) -> DataFrame:
    """`calls` with the mandate of their session, from a table with one row per session; null without one. Calls without session_id meet the row without one."""
    own = mandates.select(F.col("session_id").alias("_session"), "mandate")
    return calls.drop("mandate").join(own, F.col("session_id").eqNullSafe(F.col("_session")), "left").drop("_session")


def redacted(mandates: DataFrame) -> DataFrame:
    """Mandates as readers may see them: without secrets."""
    return mandates.withColumn("mandate", F.col("mandate").withField("operator_secret", F.lit(None).cast("string")))
