"""Single analyzers over a column of texts, in Arrow batches; routes of tools as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import analyzers as A
from ..functions import evaluate as E
from ..functions import phrases, shell, sqltext

_TYPES = {"string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _facts(judge: Callable[[str], tuple], **fields: str) -> Callable[[Column], Column]:
    """A function of a text column: struct of `fields`, null for null."""
    kind = pa.struct([(n, _TYPES[t]) for n, t in fields.items()])

    @F.arrow_udf("struct<" + ", ".join(f"{n}: {t}" for n, t in fields.items()) + ">")
    def facts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            numbers: dict[str | None, int] = {}
            order = pa.array([numbers.setdefault(t, len(numbers)) for t in texts.to_pylist()], pa.int32())
            yield pa.array([None if t is None else dict(zip(fields, judge(t))) for t in numbers], kind).take(order)

    return facts


def sql_facts(text: Column) -> Column:
    """kind of statement, whether it writes, has a condition, and one that is always true; tables in order."""

    def judge(t: str) -> tuple:
        r = sqltext.sql(t, A.Flags())
        return r.kind, r.write, r.where, r.tautology, r.tables

    return _facts(judge, kind="string", writes="boolean", has_where="boolean", always_true="boolean", tables="array<string>")(text)


def shell_facts(text: Column) -> Column:
    """What a shell would make of a command, whether it writes, connects and substitutes, its paths, and a base64 payload in plain text."""

    def judge(t: str) -> tuple:
        r = shell.shell(t, A.Flags())
        return r.normalized, r.write, r.network, r.subshell, r.paths, shell.hidden_base64(shell.Reading(t))

    return _facts(judge, normalized="string", writes="boolean", connects="boolean", substitutes="boolean", paths="array<string>", payload="string")(text)


def path_facts(text: Column, roots: tuple[str, ...] = (), cwd: str = "/workspace") -> Column:
    """A path without dots and escapes, whether it names secrets, and whether it leaves the roots."""
    flags = A.Flags(roots=roots, cwd=cwd)

    def judge(t: str) -> tuple:
        r = A.path(t, flags)
        return r.path, r.sensitive, r.escaping

    return _facts(judge, path="string", sensitive="boolean", escaping="boolean")(text)


def url_facts(text: Column) -> Column:
    """The canonical host of a URL and its class: metadata, private, loopback, public, or none if there is no valid host."""

    def judge(t: str) -> tuple:
        if not t:
            return None, "none"
        seen = {f[3].partition(" (")[0].partition(":")[0] for f in A.url(t, A.Flags(network=True)).findings}
        names = {"Cloud metadata service addressed": "metadata", "Private network addressed": "private", "Local service addressed": "loopback"}
        host = A.host_in(t)
        return host, next((names[s] for s in names if s in seen), "public" if host else "none")

    return _facts(judge, host="string", host_class="string")(text)


def directive(text: Column) -> Column:
    """The kind of directive against a system's instructions in a text, as it stands or without disguise; null without one."""

    def judge(t: str) -> tuple:
        return (phrases.directive(A.plain(t)) or phrases.directive(t),)

    return _facts(judge, found="string")(text)["found"]


def routes(tool: Column) -> Column:
    """struct<shell, sql, file, network>: the analyzers that a tool's name calls for. Null is the empty name."""
    name = F.lower(F.coalesce(tool, F.lit("")))
    some = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(name, w))
    lists: dict[str, Any] = {E.SHELL: E.SHELL_TOOLS, E.SQL: E.SQL_TOOLS, E.FILE: E.FILE_TOOLS, E.NETWORK: E.NETWORK_TOOLS}
    return F.struct(*[(some(words) | (name == "run_command") if route == E.SHELL else some(words)).alias(route) for route, words in lists.items()])
