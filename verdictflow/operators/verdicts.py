"""Assessments of calls: findings by the analyzers in Arrow batches; severity, score, verdict and explanation as column expressions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evaluate import evaluate
from ..schema import MANDATE, SEVERITIES, VIOLATIONS

_FIELDS = ("signature", "type", "severity", "description", "evidence", "remediation")
FOUND = f"struct<violations: {VIOLATIONS}, is_write: boolean, is_network: boolean, targets: array<string>, risk_tolerance: string, coverage_gap: boolean, failed: boolean>"
_VIOLATION = pa.struct([(f, pa.string()) for f in _FIELDS])
_FOUND = pa.struct([("violations", pa.list_(_VIOLATION)), ("is_write", pa.bool_()), ("is_network", pa.bool_()), ("targets", pa.list_(pa.string())), ("risk_tolerance", pa.string()), ("coverage_gap", pa.bool_()), ("failed", pa.bool_())])


def _judged(tool, args, mandate, override, secret, cwd, strict_parity) -> dict:
    """A call that can't be evaluated is blocked."""
    try:
        got = evaluate(tool, args, mandate, override, secret, cwd, strict_parity)
        return got | {"violations": [dict(zip(_FIELDS, v)) for v in got["violations"]], "failed": False}
    except Exception as error:  # fail closed
        wrong = ("S3", "EVALUATOR_INTERNAL_ERROR", "CRITICAL", "The call could not be evaluated", type(error).__name__, "Report the call.")
        return {"violations": [dict(zip(_FIELDS, wrong))], "is_write": False, "is_network": False, "targets": [], "risk_tolerance": "low", "coverage_gap": False, "failed": True}


def severity(violations: Column) -> Column:
    """The highest severity, NONE without violations."""
    rank = lambda v: F.array_position(F.array(*map(F.lit, SEVERITIES)), v["severity"])
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.greatest(F.coalesce(F.array_max(F.transform(violations, rank)), F.lit(1)), F.lit(1)).cast("int"))


def risk_score(level: Column, n: Column) -> Column:
    steps = (
        F.when(level == "CRITICAL", F.least(F.lit(1.0), 0.9 + 0.02 * n))
        .when(level == "HIGH", F.least(F.lit(0.89), 0.7 + 0.05 * n))
        .when(level == "MEDIUM", F.least(F.lit(0.69), 0.4 + 0.05 * n))
        .when(level == "LOW", 0.25)
        .otherwise(0.05)
    )
    return F.round(steps, 3)


def verdict(level: Column, tolerance: Column) -> Column:
    asks = ((level == "HIGH") & (tolerance == "high")) | ((level == "MEDIUM") & (tolerance == "low"))
    return F.when(asks, "CONFIRM_REQUIRED").when(level.isin("CRITICAL", "HIGH"), "BLOCK").otherwise("ALLOW")


def assess(calls: DataFrame, secret: str | None = None, cwd: str = "/workspace", strict_parity: bool = False) -> DataFrame:
    """`calls` (tool_name, raw_args; mandate struct and override JSON where present) with the columns of an assessment.

    One pass without a shuffle; only the four inputs travel to the workers. Nulls: no tool name is the empty name, no arguments none,
    no mandate the default one. `strict_parity` keeps the ways around the scans that are closed by default (README).
    """

    @F.arrow_udf(FOUND)
    def judge(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            numbers: dict[tuple, int] = {}
            order = pa.array([numbers.setdefault(row, len(numbers)) for row in zip(*(c.to_pylist() for c in columns))], pa.int32())
            # equal calls of a batch are judged once
            found = pa.array([_judged(t, a, json.loads(m) if m else None, o, secret, cwd, strict_parity) for t, a, m, o in numbers], _FOUND)
            yield found.take(order)

    own = F.to_json("mandate") if "mandate" in calls.columns else F.lit(None).cast("string")
    override = F.col("override").cast("string") if "override" in calls.columns else F.lit(None).cast("string")
    found = calls.withColumn("_f", judge(F.col("tool_name"), F.col("raw_args"), own, override))
    level, n = severity(F.col("_f.violations")), F.size("_f.violations")
    kept = [c for c in calls.columns if c not in ("violations", "is_write", "is_network", "targets", "coverage_gap", "risk_tolerance", "severity", "risk_score", "verdict", "passed", "explanation")]
    said = found.select(*kept, "_f", level.alias("severity"), F.when(F.col("_f.failed"), 1.0).otherwise(risk_score(level, n)).alias("risk_score"), verdict(level, F.col("_f.risk_tolerance")).alias("verdict"))
    text = F.array_join(F.transform("_f.violations", lambda v: v["description"]), "; ")
    return said.select(
        *kept,
        F.col("_f.violations").alias("violations"),
        F.col("_f.is_write").alias("is_write"),
        F.col("_f.is_network").alias("is_network"),
        F.col("_f.targets").alias("targets"),
        F.col("_f.coverage_gap").alias("coverage_gap"),
        F.col("_f.risk_tolerance").alias("risk_tolerance"),
        "severity",
        "risk_score",
        "verdict",
        (F.col("verdict") == "ALLOW").alias("passed"),
        F.when(F.col("verdict") == "ALLOW", "The call is within its mandate").otherwise(F.concat(F.col("verdict"), F.lit(": "), text)).alias("explanation"),
    )


def as_mandate(json_col: str) -> Column:
    """A JSON mandate as a struct."""
    return F.from_json(json_col, MANDATE)
