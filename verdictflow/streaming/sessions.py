"""Mandates as keyed state of a stream: requests change them, and every call is judged under the mandate of its session at its place."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.mandates import step
from ..operators.verdicts import as_mandate, assess
from ..schema import default_mandate

#: A row of a session's stream: a request or a reset where `kind` says so, else a call.
EVENT = "session_id string, seq long, kind string, request string, secret string, tool_name string, raw_args string"
_OUT = EVENT + ", status string, _mandate string"


def under_mandates(events: DataFrame, secret: str | None = None, cwd: str = "/workspace", start: dict[str, Any] | None = None) -> DataFrame:
    """Events (EVENT; kind is request, reset or call) with `status` of requests and `mandate` behind each event, without its secret in readers' hands: see assessed_sessions.

    A session's mandate is its state, which survives restarts by the stream's checkpoint. Within a micro-batch the events of a session take effect in the order of seq; across micro-batches, in
    the order of arrival. Rows without session_id are one session.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else start or default_mandate(cwd)
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")  # one session's events of a micro-batch
        statuses, seen = [], []
        for kind, request, own in zip(rows["kind"], rows["request"], rows["secret"]):
            status = None
            if kind == "reset" or kind == "request":
                now, status = step(now, None if kind == "reset" else request, own, secret, cwd)
            statuses.append(status)
            seen.append(json.dumps(now))
        state.update((json.dumps(now),))
        yield rows.assign(status=statuses, _mandate=seen)

    keyed = events.withColumn("_key", F.coalesce("session_id", F.lit("")))
    names = [f.split()[0] for f in EVENT.split(", ")]
    told = keyed.groupBy("_key").applyInPandasWithState(fold, _OUT + ", _key string", "mandate string", "append", GroupStateTimeout.NoTimeout)
    return told.select(*names, "status", as_mandate("_mandate").alias("mandate"))


def assessed_sessions(events: DataFrame, secret: str | None = None, cwd: str = "/workspace") -> DataFrame:
    """The calls of a stream of events, judged under the mandates of their sessions."""
    calls = under_mandates(events, secret, cwd).where("kind = 'call'").select("session_id", "seq", "tool_name", "raw_args", "mandate")
    return assess(calls, secret, cwd).drop("mandate")
