"""Queries of readers and writers: tables written to the checkpoint folder and read back, with their SQL.

Each query writes a folder of its own below the folder all executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewright.functions import scalars as X
from tracewright.operators import diffing as D
from tracewright.operators import nested
from tracewright.operators import relational as R
from tracewright.plans import core
from tracewright.session import ensure_checkpoint_dir, read_table
from tracewright.sources import readers, writers


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _traces(spark, sf_dir):
    return read_table(spark, sf_dir, "llm_traces")


@core.add("src01_trace_scan", "SELECT id, trace_id, status FROM llm_traces WHERE run_id = (SELECT max(run_id) FROM llm_traces)")
def src01_trace_scan(spark, sf_dir):
    """Written by run, read for one run: only its folder is opened."""
    folder = _folder(spark, "traces")
    t = _traces(spark, sf_dir).where("run_id is not null")
    t.select("id", "trace_id", "status", "run_id").repartition("run_id").write.partitionBy("run_id").parquet(folder)
    return readers.traces(spark, folder, t.agg(F.max("run_id")).first()[0]).select("id", "trace_id", "status")


_PAYLOADS = "SELECT DISTINCT run_id || '/' || trace_id || '.md' AS key FROM llm_traces WHERE strlen(prompt) >= 3500 OR strlen(response) >= 3500"


@core.add("src02_payload_keys", "SELECT id, run_id || '/' || trace_id || '.md' AS key, CASE WHEN strlen(prompt) >= 1200 THEN length(prompt) END AS prompt_chars, CASE WHEN strlen(response) >= 1200 THEN length(response) END AS response_chars FROM llm_traces WHERE strlen(prompt) >= 1200 OR strlen(response) >= 1200")
def src02_payload_keys(spark, sf_dir):
    """Texts above a size as payload texts, and their sections read back (SRC02, SRC03, SNK04)."""
    t = _traces(spark, sf_dir)
    folder = _folder(spark, "payloads")
    writers.spilled_payloads(t, 1200, keep=("id",)).write.parquet(folder)
    p = spark.read.parquet(folder)
    return p.select("id", "key", F.char_length(X.section(F.col("text"), "Prompt")).cast("bigint").alias("prompt_chars"), F.char_length(X.section(F.col("text"), "Response")).cast("bigint").alias("response_chars"))


@core.add("snk05_golden_files", "SELECT module, case_id, response.body AS body, response.status_code AS status_code FROM golden")
def snk05_golden_files(spark, sf_dir):
    """Golden records as JSON files by module, read back (SNK05, SRC04)."""
    g = read_table(spark, sf_dir, "golden").select("module", "case_id", F.col("response.body").alias("body"), F.col("response.status_code").alias("status_code"))
    folder = _folder(spark, "golden")
    writers.write_golden(g, folder)
    return spark.read.schema("module string, case_id string, body string, status_code int").json(folder).select("module", "case_id", "body", "status_code")


@core.add(
    "src05_recording_metadata",
    "SELECT case_id, 'skipped' AS reason FROM golden WHERE response.status_code >= 500 AND case_id IS NOT NULL UNION SELECT case_id, 'tainted' FROM golden WHERE module = 'exam' AND case_id IS NOT NULL",
)
def src05_recording_metadata(spark, sf_dir):
    """Metadata rows of several recordings as JSON, read back with the given schema: skipped and tainted cases (SRC05)."""
    g = read_table(spark, sf_dir, "golden").where("case_id is not null")
    none = F.array().cast("array<string>")
    skipped = g.where("response.status_code >= 500").select(F.lit("t").alias("recorded_at"), F.lit(1).alias("total_cases"), none.alias("cases"), F.array("case_id").alias("skipped"))
    folder = F.struct(F.col("module").alias("folder"), F.array().cast("array<struct<case_id:string,status_code:int,body_preview:string>>").alias("anomalies"), F.array("case_id").alias("excluded_case_ids"))
    tainted = g.where("module = 'exam'").select(F.lit("t").alias("recorded_at"), F.lit(1).alias("total_cases"), none.alias("cases"), none.alias("skipped"), F.array(folder).alias("tainted_folders"))
    path = _folder(spark, "metadata")
    skipped.unionByName(tainted, allowMissingColumns=True).write.json(path)
    return readers.excluded_cases(spark.read.schema(readers.METADATA).json(path))


@core.add(
    "src06_executions",
    "SELECT golden_id, request.method AS method, response.status_code AS status_code, CASE WHEN length(response.body) > 0 THEN response.body END AS body, 'application/json' AS content_type FROM golden",
)
def src06_executions(spark, sf_dir):
    """Runner reports, one document a line: bodies as lists of bytes and headers in any case (SRC06, SRC07)."""
    g = read_table(spark, sf_dir, "golden")
    raw = F.encode(F.col("response.body"), "UTF-8")
    data = F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int"))
    stream = F.when(F.length(raw) > 0, F.struct(F.lit("Buffer").alias("type"), data.alias("data")))
    item = F.struct(F.col("golden_id").cast("string").alias("name"), F.struct(F.col("request.method").alias("method"), F.struct(F.col("request.path").alias("path")).alias("url")).alias("request"))
    header = F.array(F.struct(F.lit("Content-TYPE").alias("key"), F.lit("application/json").alias("value")))
    one = F.struct(item.alias("item"), F.struct(F.col("response.status_code").alias("code"), header.alias("header"), stream.alias("stream")).alias("response"))
    folder = _folder(spark, "executions")
    g.select(F.struct(F.array(one).alias("executions")).alias("run")).write.json(folder)
    e = readers.executions(spark, folder, one_per_line=True)
    return e.select(F.col("name").cast("bigint").alias("golden_id"), "method", "status_code", "body", "content_type")


@core.add("snk08_run_reports", "SELECT run_id, split_part(run_id, '_', 1) AS run_date, count(*) AS total, count(*) FILTER (status = 'ok') AS passed FROM llm_traces WHERE run_id IS NOT NULL GROUP BY run_id")
def snk08_run_reports(spark, sf_dir):
    """Reports in folders by day, read back with the day from the folder."""
    r = _traces(spark, sf_dir).where("run_id is not null").groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ok").alias("passed"))
    folder = _folder(spark, "reports")
    writers.write_reports(r, folder)
    return spark.read.schema("run_id string, total bigint, passed bigint, run_date string").json(folder).select("run_id", "run_date", "total", "passed")


@core.add(
    "snk09_report_texts",
    """
    WITH r AS (SELECT module, count(*) AS total, count(*) FILTER (coalesce(response.status_code < 400, false)) AS passed FROM golden GROUP BY module)
    SELECT module, 'run: ' || module || chr(10) || 'status: ' || CASE WHEN total = passed THEN 'pass' ELSE 'fail' END || chr(10) || 'cases: ' || total || ', passed ' || passed || ', failed ' || (total - passed) AS text FROM r
    """,
)
def snk09_report_texts(spark, sf_dir):
    g = read_table(spark, sf_dir, "golden").withColumn("ok", F.coalesce(F.col("response.status_code") < 400, F.lit(False)))
    s = R.pass_summary(g, ["module"], F.col("ok")).withColumn("run_id", F.col("module"))
    return s.select("module", F.substring_index(writers.report_text(), "\n", 3).alias("text"))


@core.add("snk07_merged_metadata", "SELECT count(DISTINCT case_id) AS total_cases, count(DISTINCT case_id) FILTER (response.status_code >= 500) AS skipped FROM golden WHERE case_id IS NOT NULL")
def snk07_merged_metadata(spark, sf_dir):
    """Two recordings merged: each case once."""
    g = read_table(spark, sf_dir, "golden").where("case_id is not null")
    first = g.where("module < 'g'").select("case_id", "response.status_code")
    second = g.where("module >= 'g'").select("case_id", "response.status_code")
    cases = writers.merged_cases([d.select("case_id", (F.col("status_code") >= 500).alias("skipped")) for d in (first, second)])
    return cases.agg(F.count(F.lit(1)).alias("total_cases"), F.count_if("skipped").alias("skipped"))


@core.add(
    "snk11_template_merge",
    """
    WITH o AS (SELECT endpoint, max(note) AS note FROM grading_controller WHERE decision = 'fill' AND endpoint IS NOT NULL GROUP BY 1), n AS (SELECT endpoint, 'new' AS note FROM grading_controller WHERE endpoint IS NOT NULL GROUP BY 1)
    SELECT endpoint, note FROM o UNION ALL SELECT endpoint, note FROM n WHERE endpoint NOT IN (SELECT endpoint FROM o)
    """,
)
def snk11_template_merge(spark, sf_dir):
    g = read_table(spark, sf_dir, "grading_controller").where("endpoint is not null")
    old = g.where("decision = 'fill'").groupBy("endpoint").agg(F.max("note").alias("note"))
    return writers.inserted_if_absent(old, g.select("endpoint", F.lit("new").alias("note")).distinct(), "endpoint")


@core.add(
    "snk12_apply_results",
    """
    WITH r AS (SELECT entry_id, note AS error FROM grading_controller WHERE decision = 'fill')
    SELECT g.entry_id, CASE WHEN r.entry_id IS NOT NULL THEN r.error ELSE last_apply_error END AS last_apply_error, (CASE WHEN r.entry_id IS NOT NULL THEN r.error ELSE last_apply_error END) IS DISTINCT FROM last_apply_error AS changed
    FROM grading_controller g LEFT JOIN r USING (entry_id)
    """,
)
def snk12_apply_results(spark, sf_dir):
    g = read_table(spark, sf_dir, "grading_controller").select("entry_id", "last_apply_error", "decision", "note")
    done = g.where("decision = 'fill'").select("entry_id", F.col("note").alias("error"))
    return writers.apply_results(g, done, "entry_id").select("entry_id", "last_apply_error", "changed")


@core.add(
    "snk06_recording_run",
    """
    WITH e AS (SELECT golden_id, module, request.method AS method, response.body IS NULL OR trim(response.body) = '' OR json_valid(response.body) AS kept, request.method IN ('POST', 'PUT', 'PATCH', 'DELETE') AND NOT coalesce(response.status_code BETWEEN 200 AND 299, false) AS anomaly FROM golden)
    SELECT golden_id, module FROM e WHERE kept AND module NOT IN (SELECT module FROM e WHERE anomaly AND module IS NOT NULL AND method = 'DELETE')
    """,
)
def snk06_recording_run(spark, sf_dir):
    """Executions as golden records: what is no JSON and every case of a folder with an anomaly stay out (SNK06 over C06 and C07)."""
    g = read_table(spark, sf_dir, "golden")
    e = g.select("golden_id", "module", F.col("request.method").alias("method"), F.col("response.status_code").alias("status_code"), F.lit("application/json").alias("content_type"), F.col("response.body").alias("body"))
    r = readers.recorded(e, F.col("method").isin("POST", "PUT", "PATCH", "DELETE"))
    t = D.tainted(r, "module", F.col("anomaly") & (F.col("method") == "DELETE"))
    return t.where("kept and not tainted and module is not null").select("golden_id", "module")


@core.add("snk10_route_mapping", "SELECT module AS route, min(case_id) AS target, min(golden_id) AS seq FROM golden WHERE module IS NOT NULL GROUP BY module")
def snk10_route_mapping(spark, sf_dir):
    """A small mapping overwritten as a whole and read back."""
    m = read_table(spark, sf_dir, "golden").where("module is not null").groupBy(F.col("module").alias("route")).agg(F.min("case_id").alias("target"), F.min("golden_id").alias("seq"))
    folder = _folder(spark, "mapping")
    m.limit(0).write.mode("overwrite").json(folder)
    m.write.mode("overwrite").json(folder)
    return spark.read.schema("route string, target string, seq bigint").json(folder)


@core.add("snk13_reseeded", "SELECT n_nationkey, n_name FROM nation")
def snk13_reseeded(spark, sf_dir):
    """A table emptied and filled from its seed in one overwrite: what was there before is gone."""
    folder = _folder(spark, "seeded")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    n.withColumn("n_name", F.lit("old")).write.parquet(folder)
    n.write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


@core.add("src16_properties", "SELECT 'app.' || n_nationkey || '.name' AS key, n_name AS value FROM nation UNION ALL SELECT 'port.' || n_nationkey, CAST(8000 + n_nationkey AS VARCHAR) FROM nation")
def src16_properties(spark, sf_dir):
    """Properties with equals signs, colons, comments and defaults of placeholders (SRC15, SRC16)."""
    n = read_table(spark, sf_dir, "nation")
    lines = F.concat(F.lit("# of "), "n_name", F.lit("\n app."), "n_nationkey", F.lit(".name = "), "n_name", F.lit("\nport."), "n_nationkey", F.lit(": ${PORT:"), F.col("n_nationkey") + 8000, F.lit("}\n"))
    folder = _folder(spark, "properties")
    n.select(lines).coalesce(1).write.text(folder)
    p = readers.properties(spark, folder)
    return p.select("key", readers.resolved_property(F.col("value")).alias("value"))


@core.add("src20_skip_list", "SELECT DISTINCT endpoint, note AS detail FROM grading_controller WHERE decision = 'skip' AND endpoint IS NOT NULL AND note IS NOT NULL")
def src20_skip_list(spark, sf_dir):
    g = read_table(spark, sf_dir, "grading_controller").where("endpoint is not null and note is not null")
    folder = _folder(spark, "unfilled")
    g.select("endpoint", F.col("decision").alias("category"), F.col("note").alias("detail")).distinct().write.json(folder)
    return readers.skip_list(spark, folder, one_per_line=True)


@core.add("src22_manual_fills", "SELECT endpoint, decision, note, coalesce(cardinality(field_values), 0) AS n_values FROM grading_controller WHERE endpoint IS NOT NULL")
def src22_manual_fills(spark, sf_dir):
    g = read_table(spark, sf_dir, "grading_controller").where("endpoint is not null")
    folder = _folder(spark, "fills")
    g.select("endpoint", "param_schema", "note", "fill_mode", F.col("field_values").alias("values"), "raw_body", "file_paths", "decision", "last_apply_error").write.json(folder)
    f = readers.manual_fills(spark, folder, one_per_line=True)
    return f.select("endpoint", "decision", "note", F.coalesce(F.size("values"), F.lit(0)).cast("bigint").alias("n_values"))


@core.add("snk15_subset_collections", "SELECT c.col_id, count(*) AS requests FROM collection_readonly_partial c, json_tree(c.body) t WHERE t.key = 'method' AND regexp_matches(t.path, '^\\$\\.item\\[\\d+\\](\\.item\\[\\d+\\])*\\.request$') AND json_type(t.value) = 'VARCHAR' GROUP BY c.col_id")
def snk15_subset_collections(spark, sf_dir):
    """Collections without their folders' other keys: how many requests each subset keeps."""
    t = nested.flat_rows(read_table(spark, sf_dir, "collection_readonly_partial"), "col_id", "body", {"method": ("request.method", "value"), "kind": ("request.method", "kind")})
    hit = t.where(F.col("parent").rlike(r"^item(\[\d+\]\.item)*$") & (F.col("kind") == "string"))
    return hit.groupBy(F.col("rec").alias("col_id")).agg(F.count(F.lit(1)).alias("requests"))


_KIND = "CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"
_TREE = f"SELECT g.golden_id, regexp_replace(t.fullkey, '^\\$\\.?', '') AS way, {_KIND} AS kind, CASE WHEN t.type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN t.value ->> '$' END AS value FROM (SELECT golden_id, response.body AS body FROM golden WHERE json_valid(response.body)) g, json_tree(g.body) t"


@core.add("c02_paths", _TREE)
def c02_paths(spark, sf_dir):
    g = read_table(spark, sf_dir, "golden").select("golden_id", F.col("response.body").alias("body"))
    return D.paths(g, "golden_id", "body")


@core.add("f09_key_strip", f"SELECT * FROM ({_TREE}) WHERE NOT regexp_matches(way, '(^|[.])(comment|email)($|[.\\[])')")
def f09_key_strip(spark, sf_dir):
    g = read_table(spark, sf_dir, "golden").select("golden_id", F.col("response.body").alias("body"))
    return D.strip_keys(g, "golden_id", "body", ("comment", "email"))


_MASKED_KEYS = "token|id|order_id|user_id|randomId|created_at|updated_at|deleted_at|request_id|trace_id|session_id|access_token|refresh_token"


@core.add(
    "c01_mask_nested",
    rf"""
    WITH t AS ({_TREE})
    SELECT golden_id, way, CASE WHEN regexp_matches(way, '(^|[.])({_MASKED_KEYS})$') THEN '<<MASKED>>'
      WHEN kind = 'string' AND regexp_matches(value, '^(\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}|[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}|Bearer\s)') THEN '<<MASKED>>'
      WHEN kind = 'string' THEN regexp_replace(value, '[A-Za-z0-9]{{5}}(\\\d+_\d+\.\w+)$', '<<MASKED>>\1') ELSE value END AS value
    FROM t WHERE NOT regexp_matches(way, '(^|[.])({_MASKED_KEYS})[.\[]') AND (kind NOT IN ('object', 'array') OR regexp_matches(way, '(^|[.])({_MASKED_KEYS})$'))
    """,
)
def c01_mask_nested(spark, sf_dir):
    """Scalars of recorded bodies after masking as changed data."""
    g = read_table(spark, sf_dir, "golden").select("golden_id", F.col("response.body").alias("body"))
    return D.mask_json_texts(g, "golden_id", "body", "mutation")


@core.add(
    "f10_collection_leaves",
    r"SELECT c.col_id, regexp_replace(regexp_replace(t.path, '\[\d+\]\.request$', ''), '^\$\.', '') AS parent, CAST(regexp_extract(t.path, '\[(\d+)\]\.request$', 1) AS BIGINT) AS pos, t.value ->> '$' AS method FROM (SELECT * FROM collection_readonly_partial WHERE json_valid(body)) c, json_tree(c.body) t WHERE t.key = 'method' AND t.type NOT IN ('OBJECT', 'ARRAY') AND regexp_matches(t.path, '^\$\.item\[\d+\](\.item\[\d+\])*\.request$')",
)
def f10_collection_leaves(spark, sf_dir):
    """(col_id, parent, pos, method): the request nodes of each tree."""
    t = nested.triples(read_table(spark, sf_dir, "collection_readonly_partial"), "col_id", "body")
    return t.where((F.col("path") == "request.method") & ~F.col("kind").isin("object", "array") & F.col("parent").rlike(r"^item(\[\d+\]\.item)*$")).select(F.col("rec").alias("col_id"), "parent", "pos", F.col("value").alias("method"))


@core.add(
    "src08_folders",
    "SELECT c.col_id, CAST(e.key AS BIGINT) AS pos, CASE WHEN json_type(e.value, '$.name') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN e.value ->> '$.name' END AS folder FROM (SELECT * FROM collection_readonly_partial WHERE json_valid(body)) c, json_each(c.body, '$.item') e WHERE json_type(c.body, '$.item') = 'ARRAY' AND json_type(e.value, '$.item') = 'ARRAY'",
)
def src08_folders(spark, sf_dir):
    """Top-level entries that own an item list."""
    t = nested.flat_rows(read_table(spark, sf_dir, "collection_readonly_partial"), "col_id", "body", {"own": ("item", "kind"), "folder": ("name", "value")}).where("parent = 'item'")
    return t.where("own = 'array'").select(F.col("rec").alias("col_id"), "pos", "folder")


@core.add(
    "f26_schema_fields",
    """
    SELECT entry_id, p.key AS field, CASE p.value ->> '$.type' WHEN 'string' THEN 'str' WHEN 'integer' THEN 'int' WHEN 'number' THEN 'float' WHEN 'boolean' THEN 'bool' ELSE coalesce(p.value ->> '$.title', p.value ->> '$.type', 'Any') END AS type
    FROM (SELECT entry_id, param_schema FROM grading_controller WHERE json_valid(param_schema)) g, json_each(g.param_schema, '$.requestBody.content."application/json".schema.properties') p
    """,
)
def f26_schema_fields(spark, sf_dir):
    """(entry_id, field, type) of the body properties of each entry's schema; distinct schemas are read once per batch."""
    import json

    from tracewright.functions import documents as Doc

    def body_fields(text: str) -> str:
        try:
            schema = Doc.pointer(json.loads(text), "#/requestBody/content/application~1json/schema")
        except (ValueError, KeyError, TypeError):
            return "[]"
        return json.dumps([{"field": n, "type": t} for n, t, _ in Doc.schema_fields(schema)])

    g = read_table(spark, sf_dir, "grading_controller").select("entry_id", Doc.column(body_fields)(F.col("param_schema")).alias("f"))
    return g.select("entry_id", F.inline(F.from_json("f", "array<struct<field: string, type: string>>")))


@core.add("src09_mask_rules", "SELECT id, CASE WHEN regexp_matches(caller, '^debug') THEN '<<MASKED>>' ELSE caller END AS caller FROM llm_traces")
def src09_mask_rules(spark, sf_dir):
    """Mask rules read from a table and used instead of the default ones."""
    table = spark.createDataFrame([("pattern", "^debug", 1), ("field", "x", 2)], "kind string, rule string, seq int")
    folder = _folder(spark, "rules")
    table.write.json(folder)
    rules = D.load_rules(spark.read.schema(table.schema).json(folder))
    return _traces(spark, sf_dir).select("id", D.mask_text(F.col("caller"), rules.patterns, rules.mutation_parts).alias("caller"))


@core.add("src10_ignored_order", "SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'equal' ELSE 'value_mismatch' END AS body_class FROM part")
def src10_ignored_order(spark, sf_dir):
    """Ways whose arrays are compared as bags; other differences still count."""
    k = F.col("p_partkey").cast("bigint")
    odd = (k % 2).cast("string")
    p = read_table(spark, sf_dir, "part").select(k.alias("k"), F.format_string('{"a": [1, %d], "b": 0}', k).alias("golden_body"), F.concat(F.format_string('{"a": [%d, 1], "b": ', k), odd, F.lit("}")).alias("actual_body"))
    return D.diff_bodies(p, ignore_order=["root['a']"], keep=("k",)).select("k", "body_class")


@core.add("snk01_started_calls", "SELECT trace_id, arg_min(id, id) AS id, 'running' AS status FROM llm_traces WHERE status = 'running' AND trace_id IS NOT NULL GROUP BY trace_id")
def snk01_started_calls(spark, sf_dir):
    """Start events appended to a log that has some of them already: each trace starts once."""
    t = _traces(spark, sf_dir).where("status = 'running' and trace_id is not null")
    first = R.first_wins(t.select("trace_id", "id", "status", F.col("id").alias("seq")), ["trace_id"], "seq").drop("seq")
    folder = _folder(spark, "starts")
    first.where("trace_id < 'm'").write.parquet(folder)
    log = spark.read.parquet(folder)
    return writers.inserted_if_absent(log, first, "trace_id").select("trace_id", "id", "status")


@core.add(
    "snk02_finished_calls",
    """
    SELECT trace_id, arg_min_null(ts, id) AS ts, arg_max_null(status, id) AS status, arg_max(issue_tag, id) FILTER (issue_tag IS NOT NULL) AS issue_tag, count(*) AS events FROM llm_traces WHERE trace_id IS NOT NULL GROUP BY trace_id
    """,
)
def snk02_finished_calls(spark, sf_dir):
    """Finish events written after start events and folded on reading: the first time and earlier tags stay."""
    from tracewright.operators import traces as T

    t = _traces(spark, sf_dir).where("trace_id is not null")
    folder = _folder(spark, "events")
    t.where("status = 'running'").write.parquet(folder)
    t.where("status <> 'running' or status is null").write.mode("append").parquet(folder)
    return T.fold_events(spark.read.parquet(folder)).select("trace_id", "ts", "status", "issue_tag", "events")


@core.add("f05_residual_filter", "SELECT id FROM llm_traces WHERE (contains(prompt, 'status code') OR contains(response, 'status code')) AND vendor = 'northlake' AND issue_tag = 'truncated'")
def f05_residual_filter(spark, sf_dir):
    """The same predicates on what a text search found."""
    from tracewright.operators import traces as T

    return T.matching(T.containing(_traces(spark, sf_dir), ["prompt", "response"], "status code"), vendor="northlake", tag="truncated").select("id")


@core.add("c04_hints", "SELECT s.status AS failure, CASE s.status WHEN 'array_order_only' THEN 'compare the ordering' WHEN 'value_mismatch' THEN 'compare the values' WHEN 'unknown' THEN 'look at both bodies' END AS hint, count(*) AS n FROM (SELECT unnest(['array_order_only', 'value_mismatch', 'unknown', NULL]) AS status FROM nation) s GROUP BY ALL")
def c04_hints(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation").select(F.explode(F.array(*map(F.lit, ("array_order_only", "value_mismatch", "unknown", None)))).alias("failure"))
    return n.groupBy("failure").agg(F.count(F.lit(1)).alias("n")).select("failure", D.hint(F.col("failure")).alias("hint"), "n")


@core.add("f19_no_self_references", "SELECT p_partkey AS producer, p_size AS consumer FROM part WHERE p_partkey <> p_size AND p_size IN (SELECT p_partkey FROM part)")
def f19_no_self_references(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    ends = p.select(F.col("p_partkey").cast("bigint").alias("endpoint"))
    links = p.select(F.col("p_partkey").cast("bigint").alias("producer"), F.col("p_size").cast("bigint").alias("consumer"))
    return R.chained(links, ends, ends).select("producer", "consumer")


@core.add("src12_source_tree", "SELECT 'src/N' || n_nationkey || '.java' AS file, 'N' || n_nationkey AS declared, length(n_name) AS chars FROM nation WHERE n_nationkey % 5 <> 1")
def src12_source_tree(spark, sf_dir):
    """A tree of Java files written through the file system, read with their facts; files asked for that are not there are left out (SRC12, SRC23)."""
    from tracewright.operators import entities as E

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = _folder(spark, "tree")
    for r in read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():  # 25 files
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/src/N{r.n_nationkey}.java")
        out = path.getFileSystem(conf).create(path, True)
        try:
            out.write(bytearray(f"package a;\nclass N{r.n_nationkey} {{ String name = \"{r.n_name}\"; }}\n".encode()))
        finally:
            out.close()
    n = read_table(spark, sf_dir, "nation")
    wanted = n.where("n_nationkey % 5 <> 1").select(F.concat(F.lit("src/N"), "n_nationkey", F.lit(".java")).alias("file")).unionByName(spark.createDataFrame([("src/Gone.java",)], "file string"))
    src = readers.sources(spark, folder, wanted)
    d = E.scan(src, ("file", "text"), "text").where("kind = 'class'")
    return d.select("file", F.col("name").alias("declared"), F.char_length(F.regexp_extract("text", '"([^"]*)"', 1)).cast("bigint").alias("chars"))
