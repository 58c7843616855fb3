"""What a gateway between clients and a downstream server does with lines, as tables: forward, answer, and complete replies to list requests."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.rpc import parse, tool_calls
from .verdicts import assess

#: Requests whose replies are completed -> the list in the reply; fixed values.
LISTS = {"tools/list": "tools", "resources/list": "resources", "prompts/list": "prompts"}
INITIALIZE = "initialize"


def gate(lines: DataFrame, secret: str | None = None, strict_parity: bool = False) -> DataFrame:
    """(conn_id, seq, line, forwarded, reply) for `lines` (conn_id, seq, line; session columns of assess where present).

    A line with a blocked call isn't forwarded; its client gets a reply for a single call, and for a batch an array of replies: blocked calls first, then every other message that
    has an id. Lines that are no JSON are held back without a reply, as nothing in them can be judged; `strict_parity` forwards them. Empty lines go nowhere.
    """
    messages = parse(lines.withColumn("_line", F.struct("conn_id", "seq")), "line", ["conn_id", "seq"])
    judged = assess(tool_calls(messages).select("_line", "pos", "tool_name", "raw_args", *[c for c in ("mandate", "override") if c in lines.columns]), secret, strict_parity=strict_parity)
    told = judged.select("_line", "pos", (F.col("verdict") != "ALLOW").alias("blocked"), F.to_json(F.struct(F.lit("BLOCKED").alias("status"), "verdict", F.col("risk_score").alias("riskScore"), "violations", "explanation")).alias("said"))
    rest = F.lit('{"status":"BLOCKED","verdict":"BLOCK","riskScore":1.0,"explanation":"The batch holds a blocked call"}')
    rows = messages.join(told, ["_line", "pos"], "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    number = F.when(F.col("rpc_id").try_cast("double").isNotNull(), F.col("rpc_id")).otherwise(F.to_json(F.struct(F.col("rpc_id").alias("x"))).substr(F.lit(6), F.length("rpc_id") + 2))
    text = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.when(F.col("blocked"), F.col("said")).otherwise(rest).alias("text"))))
    answer = F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.coalesce(number, F.lit("null")), F.lit(',"result":{"isError":true,"content":'), text, F.lit("}}"))
    answered = F.when(F.col("blocked") | (F.col("batch_id").isNotNull() & F.col("rpc_id").isNotNull()), F.struct(~F.col("blocked"), "pos", answer.alias("answer")))
    per_line = rows.groupBy("_line").agg(F.bool_or("blocked").alias("held"), F.first("is_json").alias("is_json"), F.bool_or(F.col("batch_id").isNotNull()).alias("many"), F.first("line").alias("line"), F.array_sort(F.collect_list(answered)).alias("a"))
    answers = F.transform("a", lambda x: x["answer"])
    reply = F.when(F.col("held"), F.when(F.col("many"), F.concat(F.lit("["), F.array_join(answers, ","), F.lit("]"))).otherwise(F.get(answers, 0)))
    empty = F.trim("line") == ""
    return per_line.select("_line.conn_id", "_line.seq", "line", (~F.col("held") & ~empty & (F.col("is_json") | F.lit(strict_parity))).alias("forwarded"), reply.alias("reply"))


def downstream(gated: DataFrame) -> DataFrame:
    """The lines that go on to the server, unchanged."""
    return gated.where("forwarded").select("conn_id", "seq", "line")


def client(gated: DataFrame) -> DataFrame:
    """The replies that go back to the clients."""
    return gated.where("reply IS NOT NULL").select("conn_id", "seq", F.col("reply").alias("line"))


def complete_replies(requests: DataFrame, responses: DataFrame, own: dict[str, list]) -> DataFrame:
    """(conn_id, seq, line): the server's `responses` with the entries `own` (tools, resources, prompts) added to replies to list requests of `requests`. Both hold conn_id, seq, line.

    A reply is told by its connection and id; the first one uses a request up, later ones of that id pass unchanged, as do replies to other requests. A server that answers a list request with an
    error gets a list of the own entries put in its place; a reply to initialize names all three capabilities.
    """
    asked = parse(requests, "line", ["conn_id", "seq"]).where(F.col("batch_id").isNull() & F.col("rpc_id").isNotNull() & F.col("method").isin(INITIALIZE, *LISTS))
    asked = asked.groupBy("conn_id", "rpc_id").agg(F.max_by("method", "seq").alias("method"))
    told = responses.withColumn("rpc_id", F.get_json_object("line", "$.id"))
    first = Window.partitionBy("conn_id", "rpc_id").orderBy("seq")
    both = told.withColumn("_n", F.row_number().over(first)).join(asked, ["conn_id", "rpc_id"], "left")

    @F.arrow_udf("string")
    def merged(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lines, methods in batches:
            yield pa.array([merge(x, m, own) for x, m in zip(lines.to_pylist(), methods.to_pylist())], pa.string())

    method = F.when(F.col("_n") == 1, F.col("method"))
    return both.select("conn_id", "seq", F.when(method.isNotNull(), merged("line", method)).otherwise(F.col("line")).alias("line"))


def merge(line: str, method: str | None, own: dict[str, list]) -> str:
    """One reply, completed."""
    try:
        reply = json.loads(line)
    except ValueError:
        return line
    result = reply.get("result") if isinstance(reply, dict) else None
    if method == INITIALIZE and isinstance(result, dict):
        capabilities = result.get("capabilities") or {}
        result["capabilities"] = capabilities | {k: capabilities.get(k) or {} for k in LISTS.values()}
    elif method in LISTS and isinstance(result, dict):
        name = LISTS[method]
        result[name] = [*(result.get(name) or []), *own.get(name, [])]
    elif method in LISTS and reply.get("error"):
        reply = {"jsonrpc": "2.0", "id": reply.get("id"), "result": {LISTS[method]: own.get(LISTS[method], [])}}
    else:
        return line
    return json.dumps(reply, ensure_ascii=False, separators=(",", ":"))
