import json

import pytest
from pyspark.sql import functions as F

from tracewright.sources import readers as S
from tracewright.sources import writers as W
from tracewright.streaming import events as E


def test_golden_round_trip(spark, tmp_path):
    rows = [("exam", "查詢_GET", None, "s", "GET", ["api", "x"], 200, '{"a":[1,null]}'), ("exam", "b", "t", "s", "POST", None, None, None)]
    for m, c, at, src, method, path, status, body in rows:
        (tmp_path / m).mkdir(exist_ok=True)
        doc = {"_meta": {"recorded_at": at, "source": src}, "request": {"method": method, "path": path}, "response": {"status_code": status, "body": None if body is None else json.loads(body)}}
        (tmp_path / m / f"{c}.json").write_text(json.dumps(doc), encoding="utf-8")
    (tmp_path / "_metadata.json").write_text("{}")
    assert sorted(map(tuple, S.golden(spark, str(tmp_path)).collect()), key=repr) == sorted(rows, key=repr)


def test_payloads(spark, tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "t1.md").write_text("## Prompt\n\nfind me\n\n## Response\n\nyes\n")
    (tmp_path / "run" / "t2.md").write_text("## Prompt\n\nother")
    assert [(r.stem, r.prompt, r.response) for r in S.payloads(spark, str(tmp_path)).orderBy("stem").collect()] == [("t1", "find me", "yes"), ("t2", "other", None)]
    assert [r.stem for r in S.payload_hits(spark, str(tmp_path), "find me").collect()] == ["t1"]


def test_metadata_missing_and_present(spark, tmp_path):
    assert S.recording_metadata(spark, str(tmp_path / "none.json")).collect() == []
    p = tmp_path / "_metadata.json"
    p.write_text(json.dumps({"recorded_at": "x", "total_cases": 1, "cases": ["a"], "skipped": ["b"], "tainted_folders": [{"folder": "f", "anomalies": [], "excluded_case_ids": ["c"]}]}))
    assert sorted(map(tuple, S.excluded_cases(S.recording_metadata(spark, str(p))).collect())) == [("b", "skipped"), ("c", "tainted")]


def test_executions_and_recording(spark, tmp_path):
    def execution(code, kind, body):
        stream = None if body is None else {"type": "Buffer", "data": list(body.encode())}
        return {"item": {"name": "n", "request": {"method": "GET", "url": {"path": ["api"]}}}, "response": {"code": code, "header": [{"key": "Content-Type", "value": kind}], "stream": stream}}

    p = tmp_path / "r.json"
    p.write_text(json.dumps({"run": {"executions": [execution(200, "application/json; x", '{"é":1}'), execution(500, "application/json", " "), execution(200, "text/html", "<p>"), execution(200, "application/json", "{")]}}))
    got = S.recorded(S.executions(spark, str(p)), F.lit(True)).orderBy("pos").collect()
    assert [(r.body, r.kept, r.anomaly) for r in got] == [('{"é":1}', True, False), (None, True, True), ("<p>", False, False), ("{", False, False)]


def test_properties(spark, tmp_path):
    p = tmp_path / "a.properties"
    p.write_text("# c\n! d\na=b=c\nk: v\nx = y:z\n\nflag\n")
    assert [(r.key, r.value) for r in S.properties(spark, str(p)).orderBy("line").collect()] == [("a", "b=c"), ("k", "v"), ("x", "y:z"), ("flag", "")]
    vals = spark.createDataFrame([("${X:/api}",), ("${X:${Y:z}}",), ("${X}",), ("/p",)], "v string").select(S.resolved_property(F.col("v")).alias("r"))
    assert [r.r for r in vals.collect()] == ["/api", "", "", "/p"]


def test_fills_and_skips(spark, tmp_path):
    (tmp_path / "c1.json").write_text(json.dumps([{"endpoint": "e1", "fill_mode": "raw_body", "raw_body": "{}", "decision": "fill"}, {"endpoint": "e2", "fill_mode": "fields", "values": {"a": "1"}, "decision": "fill"}, {"endpoint": "e3", "decision": "skip"}]))
    got = S.manual_fills(spark, str(tmp_path)).withColumn("ok", S.resolved_fill()).orderBy("endpoint").collect()
    assert [(r.controller, r.endpoint, r.ok) for r in got] == [("c1", "e1", False), ("c1", "e2", True), ("c1", "e3", True)]
    assert S.skip_list(spark, str(tmp_path / "none.json")).collect() == []


def test_writers(spark, tmp_path):
    g = spark.createDataFrame([("m", "a", "{}"), ("n", "b", None)], "module string, case_id string, body string")
    W.write_golden(g, str(tmp_path / "g"))
    assert sorted(p.name for p in (tmp_path / "g").iterdir() if p.is_dir()) == ["module=m", "module=n"]
    reports = spark.createDataFrame([("20310102_030405_ab", 4, 3, 1, 0.75, "fail")], "run_id string, total bigint, passed bigint, failed bigint, pass_rate double, status string")
    W.write_reports(reports, str(tmp_path / "r"))
    assert (tmp_path / "r" / "run_date=20310102").is_dir()
    assert reports.select(W.report_text()).first()[0] == "run: 20310102_030405_ab\nstatus: fail\ncases: 4, passed 3, failed 1\npass rate: 75.0 %"
    old, new = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    assert sorted(map(tuple, W.inserted_if_absent(old, new, "k").collect())) == [("a", 1), ("b", 3)]
    e = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "k string, last_apply_error string")
    res = spark.createDataFrame([("a", None), ("b", "y")], "k string, error string")
    assert sorted(map(tuple, W.apply_results(e, res, "k").select("k", "last_apply_error", "changed").collect()), key=repr) == [("a", None, True), ("b", "y", False), ("c", None, False)]
    t = spark.createDataFrame([("r", "t", "éé", "b")], "run_id string, trace_id string, prompt string, response string")
    assert [tuple(x) for x in W.spilled_payloads(t, 4).collect()] == [("r/t.md", "## Prompt\n\néé\n\n")]


SCHEMA = "trace_id string, id bigint, run_id string, ts string, status string, latency_ms bigint, issue_tag string, model string"


def test_streamed_fold_matches_events(spark, tmp_path):
    src = tmp_path / "in"
    events = [("a", 1, "r", "2031-01-01T00:00:00Z", "running", None, "bad", "m"), ("b", 2, "r", "2031-01-01T00:10:00Z", "ok", 5, None, "m"), ("a", 3, "r", "2031-01-01T02:00:00Z", "error", 7, None, "m")]
    spark.createDataFrame(events[:2], SCHEMA).coalesce(1).write.parquet(str(src))
    spark.createDataFrame(events[2:], SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    # batches without data would run on for as long as a timeout is pending
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = E.fold_traces(E.read_traces(spark, str(src), SCHEMA, 1)).writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
        got = {r.trace_id: r for r in spark.table("folded").collect()}
        assert (got["a"].ts, got["a"].status, got["a"].issue_tag, got["a"].events, got["a"].outcome) == ("2031-01-01T00:00:00Z", "error", "bad", 2, "finished")
        assert got["b"].latency_ms == 5
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_late_start_does_not_open_a_finished_trace(spark, tmp_path):
    src = tmp_path / "in"
    events = [("a", 2, "r", "2031-01-01T02:00:00Z", "ok", 7, None, "m"), ("a", 1, "r", "2031-01-01T00:00:00Z", "running", None, None, "m"), ("a", 3, "r", "2031-01-01T03:00:00Z", "ok", 7, None, "m")]
    for e in events:
        spark.createDataFrame([e], SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = E.fold_traces(E.read_traces(spark, str(src), SCHEMA, 1)).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
        assert [(r.status, r.outcome) for r in spark.table("late").collect()] == [("ok", "finished")]
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_windowed_rates(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("a", 1, "r", "2031-01-01T00:10:00Z", "ok", 10, None, "m"), ("b", 2, "r", "2031-01-01T08:50:00+08:00", "error", 30, None, "m"), ("c", 3, "r", "bad", "ok", 1, None, "m")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(src))
    q = E.call_rates(E.read_traces(spark, str(src), SCHEMA)).writeStream.outputMode("complete").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
        assert [(r.calls, r.errors, r.mean_latency) for r in spark.table("rates").collect()] == [(2, 1, 20.0)]
    finally:
        q.stop()


def test_drained_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("a", 1, "r", "2031-01-01T00:10:00Z", "ok", 10, None, "m"), ("b", 2, "r", "2031-01-01T01:10:00Z", "timeout", 30, None, "m")]
    for r in rows:
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    out = E.drained(E.call_rates(E.read_traces(spark, str(src), SCHEMA, 1)), str(tmp_path / "out"))
    assert sorted((r.calls, r.errors) for r in out.collect()) == [(1, 0), (1, 1)]
