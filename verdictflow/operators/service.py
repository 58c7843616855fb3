"""The engine's requests as tables: set and read mandates, judge calls, commands and statements, report. Nothing is run: an allowed command has the status that it may be."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import JSON_NAMES, TOLERANCES
from . import mandates, telemetry
from .verdicts import assess

#: Fields that a request may set, with their types; all others are dropped. A task is required.
SETTABLE: dict[str, type | tuple] = {"taskDescription": str, "allowedTools": list, "disallowedTools": list, "allowedPaths": list, "allowWrite": bool, "allowDestructive": bool, "allowNetwork": bool, "allowSubshells": bool, "riskTolerance": TOLERANCES, "operatorSecret": str}
DEFAULT_LIMIT, MOST = 20, 200


def faults(request: str | None) -> tuple[list[str], str | None]:
    """What is wrong with a request for a mandate, and the fields of it that count."""
    try:
        value = json.loads(request or "")
    except ValueError:
        return ["no JSON"], None
    if not isinstance(value, dict):
        return ["no object"], None
    wrong = [] if "taskDescription" in value else ["taskDescription"]
    for name, kind in SETTABLE.items():
        if name in value:
            x = value[name]
            right = x in kind if isinstance(kind, tuple) else isinstance(x, kind) and (kind is not list or all(isinstance(y, str) for y in x)) and x != "" if kind is not bool else isinstance(x, bool)
            if not right:
                wrong.append(name)
    return wrong, json.dumps({k: v for k, v in value.items() if k in SETTABLE and k in JSON_NAMES})


def set_mandate(requests: DataFrame, secret: str | None = None, cwd: str = "/workspace") -> DataFrame:
    """(session_id, seq, status, mandate, faults) for `requests` (session_id, seq, request JSON, secret): mandate_updated, ESCALATION_BLOCKED or VALIDATION_ERROR.

    Requests of a session take effect in the order of seq; faulty ones change nothing, and their mandate is null. The secret may stand in the request. Mandates are without secrets.
    """

    @F.arrow_udf("struct<faults: array<string>, clean: string>")
    def checked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([dict(zip(("faults", "clean"), faults(t))) for t in texts.to_pylist()], pa.struct([("faults", pa.list_(pa.string())), ("clean", pa.string())]))

    seen = requests.withColumn("_c", checked(F.coalesce("request", F.lit(""))))
    good = seen.where(F.size("_c.faults") == 0).select("session_id", "seq", F.col("_c.clean").alias("request"), F.coalesce("secret", F.get_json_object("request", "$.operatorSecret")).alias("secret"))
    done = mandates.redacted(mandates.history(good, secret, cwd)).withColumn("faults", F.array().cast("array<string>"))
    bad = seen.where(F.size("_c.faults") > 0).select("session_id", F.col("seq").cast("long").alias("seq"), F.lit("VALIDATION_ERROR").alias("status"), F.lit(None).cast(done.schema["mandate"].dataType).alias("mandate"), F.col("_c.faults").alias("faults"))
    return done.unionByName(bad)


def get_mandate(calls: DataFrame, versions: DataFrame) -> DataFrame:
    """`calls` (session_id, seq) with the mandate that holds for each, without its secret."""
    return mandates.redacted(mandates.as_of(calls, versions))


def intercept(calls: DataFrame, secret: str | None = None) -> DataFrame:
    """Assessments with `status`: the verdict, or VALIDATION_ERROR where the tool has no name or the arguments are no object. Those are blocked."""
    right = (F.coalesce("tool_name", F.lit("")) != "") & F.coalesce(F.schema_of_variant(F.try_parse_json("raw_args")).startswith("OBJECT"), F.lit(False))
    return assess(calls.withColumn("_right", right), secret).withColumn("status", F.when(F.col("_right"), F.col("verdict")).otherwise("VALIDATION_ERROR")).withColumn("passed", F.col("passed") & F.col("_right")).drop("_right")


def _single(texts: DataFrame, col: str, tool: str, secret: str | None) -> DataFrame:
    return assess(texts.withColumn("tool_name", F.lit(tool)).withColumn("raw_args", F.to_json(F.struct(F.col(col)))), secret)


def shell_status(commands: DataFrame, col: str = "command", secret: str | None = None) -> DataFrame:
    """Assessments with `status` of a command: BLOCKED, CONFIRMATION_REQUIRED, ALLOWED or VALIDATION_ERROR (null or empty)."""
    status = F.when(F.coalesce(col, F.lit("")) == "", "VALIDATION_ERROR").when(F.col("verdict") == "BLOCK", "BLOCKED").when(F.col("verdict") == "CONFIRM_REQUIRED", "CONFIRMATION_REQUIRED").otherwise("ALLOWED")
    return _single(commands, col, "bash", secret).withColumn("status", status)


def sql_status(statements: DataFrame, col: str = "query", secret: str | None = None) -> DataFrame:
    """Assessments with `status` of a statement: its verdict or VALIDATION_ERROR (null or empty)."""
    return _single(statements, col, "sql", secret).withColumn("status", F.when(F.coalesce(col, F.lit("")) == "", "VALIDATION_ERROR").otherwise(F.col("verdict")))


def report(assessed: DataFrame, limit: object = None, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Telemetry, and the newest records: `limit` of them if it is a whole number from 1 to MOST, else DEFAULT_LIMIT."""
    valid = isinstance(limit, int) and not isinstance(limit, bool) and 1 <= limit <= MOST
    return telemetry.summary(assessed), telemetry.audit_log(assessed, limit if valid else DEFAULT_LIMIT, seq)


def views(assessed: DataFrame, mandate: DataFrame, seq: str = "seq") -> None:
    """Temporary views that readers may query: telemetry_summary, audit_log (the newest 50), current_mandate (without secrets)."""
    telemetry.summary(assessed).createOrReplaceTempView("telemetry_summary")
    telemetry.audit_log(assessed, 50, seq).createOrReplaceTempView("audit_log")
    mandates.redacted(mandate).createOrReplaceTempView("current_mandate")


def briefing(task: Column, root: Column, allow_write: Column) -> Column:
    """What an agent under a mandate is to be told, from its task, its folder and whether it may write; nulls take the defaults."""
    said = F.format_string(
        "Task: %s\nFolder: %s\nFiles may be changed: %s\nAsk before anything that deletes, writes, reaches the network or reads credentials; a blocked call is final.",
        F.coalesce(task, F.lit("Tool calls within safe bounds")),
        F.coalesce(root, F.lit("/workspace")),
        F.when(F.coalesce(allow_write, F.lit(False)), "within the folder").otherwise("no"),
    )
    return said
