"""Settings, requests as tables, the gateway, replies to list requests, and mandates as state of a stream."""

import json
import time

import pytest

from verdictflow.functions import analyzers, shell, sqltext
from verdictflow.functions.evaluate import evaluate
from verdictflow.operators import gateway, mandates, service, telemetry, verdicts
from verdictflow.plans import payloads
from verdictflow.sources import rpc
from verdictflow.sources.settings import settings
from verdictflow.streaming.sessions import EVENT, assessed_sessions


def call(id_, command, name="bash"):
    return {"jsonrpc": "2.0", "id": id_, "method": "tools/call", "params": {"name": name, "arguments": {"command": command}}}


def test_golden_cases_one_by_one():
    """A row alone has the outcome that it has in a table (see the query events_assessed)."""
    for tool, args, key, _, severity, kinds in payloads.CASES:
        found = evaluate(tool, args, payloads.MANDATES[key])["violations"]
        want = sorted(k.removeprefix("S2b:") for p in kinds.split() for k in [p.partition("*")[0]] * int(p.partition("*")[2] or 1))
        assert (sorted(v[1] for v in found), any(v[2] == severity for v in found) or severity == "NONE") == (want, True), (tool, args)


HARD = ["a", "rm ", "/rm -r ", "curl -o f ;", "curl -s http://a -o f && ", "X=a;$X ", "${a:-", "{a,b}", "{", "'", "'a'+'b' ", "'a' \"", "python -c 'os.system(1)' ", "`", "$(", "a(){ ", "a|a&", "echo aaaaaaaa | base64 -d | sh ", "\\", "NODE_OPTIONS=a ", "http://a ", "/dev/tcp/a/1 ", "[::ffff:", "git push a ", "nc a ", "$a$", "$a$ $b$ ", "/*", "/*a*/", "DO $$ ", "EXECUTE 'x' ", "UPDATE a ", "WHERE (", "a;", "'\\'", "ignore ", "for testing purposes ", "<"]


@pytest.mark.parametrize("unit", HARD)
def test_long_texts_take_linear_time(unit):
    text = (unit * (100_000 // len(unit) + 1))[:100_000]
    for judge in (lambda t: shell.shell(t, analyzers.Flags()), lambda t: sqltext.sql(t, analyzers.Flags()), analyzers.injection, lambda t: analyzers.path(t, analyzers.Flags()), lambda t: analyzers.url(t, analyzers.Flags())):
        start = time.process_time()
        judge(text)
        assert time.process_time() - start < 1.5


def test_variables_that_grow_fail_closed():
    bomb = "A=" + "x" * 5000 + ";" + "echo $A;" * 2000
    assert any(f[1] == "OBFUSCATION_BYPASS" and "grow" in f[3] for f in shell.shell(bomb, analyzers.Flags()).findings)


def test_strict_parity_keeps_the_gap():
    args = '{"payload": "rm -rf /"}'
    assert evaluate("bash", args)["coverage_gap"] and evaluate("bash", args)["violations"]
    assert not evaluate("bash", args, strict_parity=True)["violations"] and not evaluate("bash", '{"command": "ls"}')["coverage_gap"]


def test_settings():
    env = {"VERDICTFLOW_ALLOW_NETWORK": "true", "VERDICTFLOW_OPERATOR_SECRET": "e", "VERDICTFLOW_ALLOW_WRITE": "1"}
    s = settings(["--secret", "f", "--allowed-paths", "/a, /b", "--proxy", "x", "--allow-write"], env)
    assert (s.secret, s.mandate["allow_network"], s.mandate["allow_write"], s.mandate["allowed_paths"]) == ("f", True, False, ["/a", "/b"])
    assert settings(["--proxy", "x", "--allow-write"], strict_parity=True).mandate["allow_write"]
    s = settings(["--allow-write"], env, '{"allowWrite": false, "operatorSecret": "m", "unknown": 1}')
    assert (s.mandate["allow_write"], s.secret) == (False, "m") and settings(mandate_file="[").mandate["is_locked"] and settings().secret is None


def test_set_and_get_mandate(spark):
    ask = lambda **k: json.dumps({"taskDescription": "t"} | k)
    rows = [(1, 1, ask(allowWrite=True), None), (1, 2, ask(allowWrite=True, operatorSecret="key"), None), (1, 3, ask(riskTolerance="extreme"), None), (1, 4, '{"allowWrite": false}', None), (1, 5, ask(isLocked=False, allowLoopback=True), None), (2, 1, "[1]", None), (2, 2, None, None), (2, 3, ask(allowedTools=["a", 1]), None)]
    done = service.set_mandate(spark.createDataFrame(rows, "session_id int, seq int, request string, secret string"), "key")
    got = {(r.session_id, r.seq): r for r in done.collect()}
    assert {k: r.status for k, r in got.items()} == {(1, 1): "ESCALATION_BLOCKED", (1, 2): "mandate_updated", (1, 3): "VALIDATION_ERROR", (1, 4): "VALIDATION_ERROR", (1, 5): "mandate_updated", (2, 1): "VALIDATION_ERROR", (2, 2): "VALIDATION_ERROR", (2, 3): "VALIDATION_ERROR"}
    assert got[1, 5].mandate.allow_write and got[1, 5].mandate.is_locked and not got[1, 5].mandate.allow_loopback and got[1, 5].mandate.operator_secret is None
    assert got[1, 3].faults == ["riskTolerance"] and got[1, 4].faults == ["taskDescription"] and got[2, 3].faults == ["allowedTools"]
    read = service.get_mandate(spark.createDataFrame([(1, 1), (1, 9), (3, 1)], "session_id int, seq long"), done.where("mandate is not null"))
    assert {(r.session_id, r.seq): r.mandate and r.mandate.allow_write for r in read.collect()} == {(1, 1): False, (1, 9): True, (3, 1): None}


def test_mandates_end_and_meet_their_sessions(spark):
    versions = spark.createDataFrame([(1, 1, "a"), (1, 3, None)], "session_id int, seq long, mandate string")
    calls = spark.createDataFrame([(1, 0), (1, 2), (1, 4)], "session_id int, seq long")
    assert [r.mandate for r in mandates.as_of(calls, versions).orderBy("seq").collect()] == [None, "a", None]
    own = spark.createDataFrame([(1, "x"), (None, "y")], "session_id int, mandate string")
    calls = spark.createDataFrame([(1, 0), (None, 1), (2, 2)], "session_id int, seq long")
    assert {r.seq: r.mandate for r in mandates.current(calls, own).collect()} == {0: "x", 1: "y", 2: None}


def test_statuses(spark):
    commands = spark.createDataFrame([(0, "ls"), (1, "rm -rf /"), (2, "echo $(date)"), (3, ""), (4, None)], "n int, command string")
    assert {r.n: r.status for r in service.shell_status(commands).collect()} == {0: "ALLOWED", 1: "BLOCKED", 2: "CONFIRMATION_REQUIRED", 3: "VALIDATION_ERROR", 4: "VALIDATION_ERROR"}
    statements = spark.createDataFrame([(0, "SELECT 1"), (1, "DROP TABLE t"), (2, None)], "n int, query string")
    assert {r.n: r.status for r in service.sql_status(statements).collect()} == {0: "ALLOW", 1: "BLOCK", 2: "VALIDATION_ERROR"}
    calls = spark.createDataFrame([(0, "bash", '{"command": "ls"}'), (1, "", "{}"), (2, "bash", '"ls"'), (3, "bash", "x"), (4, "bash", None)], "seq int, tool_name string, raw_args string")
    assert {r.seq: (r.status, r.passed) for r in service.intercept(calls).collect()} == {0: ("ALLOW", True), **{k: ("VALIDATION_ERROR", False) for k in (1, 2, 3, 4)}}


def test_reports_and_views(spark):
    rows = [(k, "bash", '{"command": "ls"}', f"2024-01-01 00:00:{k % 60:02d}") for k in range(300)]
    assessed = verdicts.assess(spark.createDataFrame(rows, "seq int, tool_name string, raw_args string, ts string").selectExpr("* except (ts)", "timestamp(ts) ts"))
    assert [service.report(assessed, n)[1].count() for n in (None, 5, 200, 201, 0, "x", True)] == [20, 5, 200, 20, 20, 20, 20]
    service.views(assessed, spark.createDataFrame([('{"operator_secret": "s"}',)], "m string").select(verdicts.as_mandate("m").alias("mandate")))
    assert spark.table("audit_log").count() == 50 and spark.table("telemetry_summary").collect()[0].total == 300
    assert spark.table("current_mandate").collect()[0].mandate.operator_secret is None
    r = telemetry.activity(assessed).collect()[0]
    assert (r.total, r.uptime_s, r.calls_per_s) == (300, 59, 5.085)
    assert telemetry.activity(assessed.limit(0)).collect()[0].calls_per_s is None
    text = spark.range(1).select(service.briefing(*[verdicts.F.lit(x) for x in (None, "/a", True)]).alias("t")).collect()[0].t
    assert "/a" in text and "within the folder" in text


LINES = [
    (1, 1, json.dumps([call(1, "rm -rf /"), call(2, "git status"), {"method": "note"}])),
    (1, 2, json.dumps([call(10, "git status"), call("x\"y", "git log -n 1")])),
    (1, 3, json.dumps(call("a", "rm -rf /"))),
    (1, 4, json.dumps(call(5, "ls"))),
    (2, 1, json.dumps([call(1, "rm -rf /"), call(2, "git status"), {"method": "note"}])),
    (2, 2, "no json"),
    (2, 3, " "),
    (2, 4, json.dumps({"id": 1, "method": "ping"})),
    (2, 5, json.dumps([{"id": 7, "method": "ping"}, call(None, "rm -rf /")])),
]


def test_gateway(spark):
    lines = spark.createDataFrame(LINES, "conn_id int, seq int, line string")
    gated = gateway.gate(lines)
    got = {(r.conn_id, r.seq): r for r in gated.collect()}
    assert {k for k, r in got.items() if r.forwarded} == {(1, 2), (1, 4), (2, 4)}
    assert {(r.conn_id, r.seq) for r in gateway.downstream(gateway.gate(lines, strict_parity=True)).collect()} == {(1, 2), (1, 4), (2, 4), (2, 2)}
    replies = {(r.conn_id, r.seq): json.loads(r.line) for r in gateway.client(gated).collect()}
    assert set(replies) == {(1, 1), (1, 3), (2, 1), (2, 5)}
    assert [r["id"] for r in replies[1, 1]] == [1, 2] == [r["id"] for r in replies[2, 1]] and replies[1, 3]["id"] == "a"
    assert [r["id"] for r in replies[2, 5]] == [None, 7]
    said = json.loads(replies[1, 3]["result"]["content"][0]["text"])
    assert replies[1, 3]["result"]["isError"] and said["status"] == "BLOCKED" and said["violations"][0]["type"] == "DESTRUCTIVE_FS_COMMAND"
    assert gateway.gate(lines.limit(0)).count() == 0


def test_equal_batches_are_two(spark):
    line = json.dumps([call(1, "rm -rf /"), call(2, "ls")])
    parsed = rpc.parse(spark.createDataFrame([(line,), (line,), ("no",)], "value string"))
    assert parsed.select("batch_id").where("batch_id is not null").distinct().count() == 2 and rpc.unread(parsed).count() == 1


def test_replies_to_lists_are_completed(spark):
    asked = [(1, 1, {"id": 1, "method": "initialize"}), (1, 2, {"id": 2, "method": "tools/list"}), (1, 3, {"id": "p", "method": "prompts/list"}), (1, 4, {"id": 4, "method": "ping"}), (2, 1, {"id": 2, "method": "resources/list"})]
    told = [(1, 1, {"id": 1, "result": {"capabilities": {"tools": {"x": 1}}}}), (1, 2, {"id": 2, "result": {"tools": [{"name": "a"}], "next": 3}}), (1, 3, {"id": 2, "result": {"tools": []}}), (1, 4, {"id": "p", "error": {"code": -1}}), (1, 5, {"id": 4, "result": {}}), (2, 9, {"id": 2, "result": {}}), (2, 10, {"id": 1, "result": {}})]
    table = lambda rows: spark.createDataFrame([(c, s, json.dumps(m)) for c, s, m in rows] + [(3, 1, "no json")], "conn_id int, seq int, line string")
    done = gateway.complete_replies(table(asked), table(told), {"tools": [{"name": "own"}], "prompts": [{"name": "p"}], "resources": []})
    got = {(r.conn_id, r.seq): r.line for r in done.collect()}
    assert got.pop((3, 1)) == "no json"
    got = {k: json.loads(v) for k, v in got.items()}
    assert got[1, 1]["result"]["capabilities"] == {"tools": {"x": 1}, "resources": {}, "prompts": {}}
    assert got[1, 2]["result"] == {"tools": [{"name": "a"}, {"name": "own"}], "next": 3} and got[1, 3]["result"] == {"tools": []}
    assert got[1, 4] == {"jsonrpc": "2.0", "id": "p", "result": {"prompts": [{"name": "p"}]}} and got[1, 5] == told[4][2]
    assert got[2, 9]["result"] == {"resources": []} and got[2, 10]["result"] == {}


def test_mandates_as_state_of_a_stream(spark, tmp_path):
    """Two runs of a stream: the mandate that the first leaves holds in the second, and results equal the fold over a table."""
    touch = '{"command": "touch a"}'
    first = [("s", 1, "call", None, None, "bash", touch), ("s", 2, "request", '{"allowWrite": true}', None, None, None), ("s", 3, "call", None, None, "bash", touch), ("s", 4, "request", '{"allowWrite": true}', "key", None, None), ("t", 1, "call", None, None, "bash", touch), (None, 1, "call", None, None, "bash", "not json")]
    second = [("s", 5, "call", None, None, "bash", touch), ("s", 6, "reset", None, None, None, None), ("s", 7, "call", None, None, "bash", touch), ("t", 2, "call", None, None, "bash", '{"command": "ls"}')]
    got = {}
    for rows in (first, second):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = assessed_sessions(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), "key")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = {(r.session_id, r.seq): r.verdict for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("s", 1): "BLOCK", ("s", 3): "BLOCK", ("t", 1): "BLOCK", (None, 1): got[None, 1], ("s", 5): "ALLOW", ("s", 7): "BLOCK", ("t", 2): "ALLOW"}
