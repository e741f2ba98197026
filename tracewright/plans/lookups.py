"""Queries of selections, lookups, source-code facts and ordered walks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import scalars as X
from tracewright.operators import graphs as G
from tracewright.operators import relational as R
from tracewright.operators import sourcecode as J
from tracewright.plans import core
from tracewright.session import ensure_checkpoint_dir, read_table
from tracewright.sources.readers import recorded, resolved_fill

_FILES = "f AS (SELECT unit_id, pos, c.class_name AS class_name, coalesce(c.source, '') AS source FROM (SELECT unit_id, unnest(classes) AS c, unnest(range(len(classes))) AS pos FROM map_units))"


def _files(spark, sf_dir):
    return J.files(read_table(spark, sf_dir, "map_units")).withColumn("pos", F.col("pos").cast("bigint"))


@core.add(
    "src12_class_facts",
    rf"""
    WITH {_FILES} SELECT unit_id, pos, nullif(regexp_extract(source, '(?m)^\s*package\s+([\w.]+)\s*;', 1), '') AS package,
      len(regexp_extract_all(source, '(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;', 1)) AS imports,
      CASE WHEN source = '' THEN 0 ELSE len(string_split(source, chr(10))) END AS lines FROM f
    """,
)
def src12_class_facts(spark, sf_dir):
    facts = J.class_facts(_files(spark, sf_dir))
    return facts.select("unit_id", "pos", "package", F.size("imports").cast("bigint").alias("imports"), F.col("lines").cast("bigint").alias("lines"))


_SIG = r"(?m)^[ \t]+(?:public|protected|private)\s+(?:static\s+|final\s+|abstract\s+)*([\w<>\[\], ?.]+?)\s+(\w+)\s*\(([^()]*)\)"


@core.add("src17_signatures", f"WITH {_FILES} SELECT unit_id, pos, method, count(*) AS n FROM (SELECT unit_id, pos, unnest(regexp_extract_all(source, '{_SIG}', 2)) AS method FROM f) GROUP BY ALL")
def src17_signatures(spark, sf_dir):
    return J.signatures(_files(spark, sf_dir)).groupBy("unit_id", "pos", "method").agg(F.count(F.lit(1)).alias("n"))


@core.add("g13_call_sites")
def g13_call_sites(spark, sf_dir):
    return J.calls(_files(spark, sf_dir).drop("file_path"))


@core.add(
    "j17_units_without_import",
    rf"WITH {_FILES} SELECT unit_id FROM map_units WHERE unit_id NOT IN (SELECT unit_id FROM f WHERE regexp_matches(source, '(?m)^\s*import\s'))",
)
def j17_units_without_import(spark, sf_dir):
    has = _files(spark, sf_dir).where(F.col("source").rlike(r"(?m)^\s*import\s")).select("unit_id")
    return R.without(read_table(spark, sf_dir, "map_units").select("unit_id"), has, ["unit_id"])


@core.add(
    "f13_resolved_entries",
    """
    SELECT entry_id, decision = 'skip' OR (last_apply_error IS NULL AND CASE fill_mode WHEN 'raw_body' THEN lower(trim(coalesce(raw_body, ''))) NOT IN ('', 'null', '{}', '[]')
      WHEN 'file' THEN coalesce(cardinality(file_paths), 0) > 0 ELSE coalesce(cardinality(field_values), 0) > 0 END) AS resolved FROM grading_controller
    """,
)
def f13_resolved_entries(spark, sf_dir):
    g = read_table(spark, sf_dir, "grading_controller").withColumnRenamed("field_values", "values")
    return g.select("entry_id", resolved_fill().alias("resolved"))


@core.add("f07_method_split", "SELECT module, CASE WHEN request.method IN ('GET', 'HEAD') THEN 'readonly' WHEN request.method IN ('POST', 'PUT', 'PATCH', 'DELETE') THEN 'mutation' END AS kind, count(*) AS n FROM golden GROUP BY ALL")
def f07_method_split(spark, sf_dir):
    m = F.col("request.method")
    kind = F.when(m.isin("GET", "HEAD"), "readonly").when(m.isin("POST", "PUT", "PATCH", "DELETE"), "mutation")
    return read_table(spark, sf_dir, "golden").groupBy("module", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@core.add("f08_endpoint_exclusion", "SELECT golden_id FROM golden WHERE (request.method, module) NOT IN (SELECT DISTINCT request.method, module FROM golden WHERE response.status_code >= 400 AND module < 'f' AND request.method IS NOT NULL) OR request.method IS NULL")
def f08_endpoint_exclusion(spark, sf_dir):
    g = read_table(spark, sf_dir, "golden").select("golden_id", "module", F.col("request.method").alias("method"), F.col("response.status_code").alias("status_code"))
    return R.without(g, g.where("status_code >= 400 and module < 'f' and method is not null"), ["method", "module"]).select("golden_id")


@core.add("f11_select_by_token", "SELECT r.request, n_name AS name FROM (VALUES (0, '3'), (1, 'nation_0'), (2, '1')) r(request, token) JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation) n ON r.token = CAST(k AS VARCHAR) OR lower(r.token) = lower(n_name)")
def f11_select_by_token(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    return R.selected(n.withColumn("name", F.col("n_name")), "name", "n_nationkey", ["3", "nation_0", "1"], F.lit(0)).select("request", "name")


@core.add(
    "f17_excluded_members",
    "SELECT caller, coalesce(array_to_string(list_sort(list_distinct(list(model) FILTER (model NOT IN ('heron-3', 'atlas-mini-1')))), ','), '') AS members FROM llm_traces GROUP BY caller",
)
def f17_excluded_members(spark, sf_dir):
    t = read_table(spark, sf_dir, "llm_traces")
    gone = spark.createDataFrame([("heron-3",), ("atlas-mini-1",)], "model string")
    return R.emptied_kept(t, t.select("caller", "model"), gone, "caller", "model").select("caller", F.array_join("members", ",").alias("members"))


@core.add(
    "j15_blocked_reasons",
    "SELECT n.id, array_to_string(list_sort(list_distinct(list(n.needs))), ',') AS reasons FROM (SELECT p_partkey AS id, p_partkey // 2 AS needs FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0) n JOIN part f ON f.p_partkey = n.needs AND f.p_size % 5 = 3 GROUP BY n.id",
)
def j15_blocked_reasons(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    needs = p.where("p_partkey > 0").select(F.col("p_partkey").alias("id"), F.explode(F.array(F.expr("p_partkey div 2"), F.expr("p_partkey div 3"))).alias("needs"))
    return R.blocked(p.select(F.col("p_partkey").alias("id")), needs, p.where("p_size % 5 = 3").select(F.col("p_partkey").alias("id"))).select("id", F.array_join(F.transform("reasons", lambda x: x.cast("string")), ",").alias("reasons"))


@core.add("a18_name_collision", "SELECT unit_id, project_root, label FROM (SELECT *, row_number() OVER (PARTITION BY label, project_root ORDER BY unit_id) AS k FROM map_units) WHERE k = 1")
def a18_name_collision(spark, sf_dir):
    u = read_table(spark, sf_dir, "map_units").select("label", "project_root", "unit_id")
    return R.first_wins(u.withColumn("seq", F.col("unit_id")), ["label", "project_root"], "seq").select("unit_id", "project_root", "label")


@core.add("o08_first_2xx", "SELECT module, coalesce(min(CASE WHEN response.status_code BETWEEN 200 AND 299 THEN response.status_code END), arg_min(response.status_code, golden_id)) AS status_code FROM golden GROUP BY module")
def o08_first_2xx(spark, sf_dir):
    g = read_table(spark, sf_dir, "golden").select("module", "golden_id", F.col("response.status_code").alias("status_code")).where("status_code is not null")
    return R.ordered_first(g, "module", "status_code", "golden_id", F.col("status_code").between(200, 299))


@core.add("o09_truncate", "SELECT id, substring(prompt, 1, 500) AS head FROM llm_traces")
def o09_truncate(spark, sf_dir):
    return read_table(spark, sf_dir, "llm_traces").select("id", F.substring("prompt", 1, 500).alias("head"))


@core.add("o07_stable_partition", "SELECT golden_id, array_to_string(list_concat(list_filter(request.path, lambda p: NOT starts_with(p, 'a')), list_filter(request.path, lambda p: starts_with(p, 'a'))), '/') AS path FROM golden WHERE request.path IS NOT NULL")
def o07_stable_partition(spark, sf_dir):
    g = read_table(spark, sf_dir, "golden").where("request.path is not null")
    return g.select("golden_id", F.array_join(R.partitioned(F.col("request.path"), lambda p: p.startswith("a")), "/").alias("path"))


@core.add("u06_bag_union", "SELECT status, count(*) AS n FROM (SELECT status FROM llm_traces WHERE vendor = 'northlake' UNION ALL SELECT status FROM llm_traces WHERE attempt = 0) GROUP BY status")
def u06_bag_union(spark, sf_dir):
    t = read_table(spark, sf_dir, "llm_traces")
    return t.where("vendor = 'northlake'").select("status").unionAll(t.where("attempt = 0").select("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@core.add("u03_shared_starts", "SELECT task_id FROM llm_traces WHERE status = 'error' AND task_id IS NOT NULL INTERSECT SELECT task_id FROM llm_traces WHERE status = 'timeout'")
def u03_shared_starts(spark, sf_dir):
    t = read_table(spark, sf_dir, "llm_traces").where("task_id is not null")
    return R.in_both(t.where("status = 'error'").select("task_id"), t.where("status = 'timeout'").select("task_id"))


@core.add("u05_not_skipped", "SELECT case_id FROM golden EXCEPT SELECT case_id FROM golden WHERE response.status_code >= 400")
def u05_not_skipped(spark, sf_dir):
    g = read_table(spark, sf_dir, "golden")
    return R.only_in(g.select("case_id"), g.where("response.status_code >= 400").select("case_id"))


@core.add("u08_name_sets", rf"WITH {_FILES} SELECT unit_id, len(list_distinct(flatten(list(regexp_extract_all(source, '(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;', 1))))) AS names FROM f GROUP BY unit_id")
def u08_name_sets(spark, sf_dir):
    facts = J.class_facts(_files(spark, sf_dir))
    return facts.groupBy("unit_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("imports")))).cast("bigint").alias("names"))


@core.add("x27_keyword_hit", r"SELECT doc_id, regexp_matches(text, '(^|[^\p{L}\p{M}\p{N}_])diff report($|[^\p{L}\p{M}\p{N}_])') AS hit FROM documents WHERE text IS NOT NULL")
def x27_keyword_hit(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", X.keyword_hit(F.col("text"), "diff report").alias("hit"))


@core.add(
    "x28_jdbc_host",
    r"""
    WITH u AS (SELECT id, regexp_extract(prompt, 'jdbc:[a-z]+://\S+', 0) AS url FROM llm_traces WHERE contains(prompt, 'jdbc:'))
    SELECT id, nullif(regexp_extract(url, '^jdbc:[a-z0-9]+://(?:[^@/]*@)?([^:/?]+)', 1), '') AS host FROM u
    """,
)
def x28_jdbc_host(spark, sf_dir):
    t = read_table(spark, sf_dir, "llm_traces").where(F.col("prompt").contains("jdbc:"))
    return t.select("id", X.jdbc_host(F.regexp_extract("prompt", r"jdbc:[a-z]+://\S+", 0)).alias("host"))


@core.add("x25_delimited", r"SELECT id, CASE WHEN regexp_matches(response, '(?s)```python\n(.*?)\n```') THEN length(regexp_extract(response, '(?s)```python\n(.*?)\n```', 1)) END AS n FROM llm_traces WHERE response IS NOT NULL")
def x25_delimited(spark, sf_dir):
    t = read_table(spark, sf_dir, "llm_traces").where("response is not null")
    return t.select("id", F.char_length(X.between(F.col("response"), "```python\n", "\n```")).cast("bigint").alias("n"))


@core.add("g04_capped_walk")
def g04_capped_walk(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier")
    e = s.select(F.col("s_suppkey").alias("src"), F.explode(F.array(F.expr("s_suppkey div 2"), F.expr("s_suppkey div 3"), F.expr("(s_suppkey * 7) % 100"))).alias("dst"))
    e = e.withColumn("seq", F.col("dst"))
    return G.capped_walk(e, s.where("s_suppkey % 20 = 0").select("s_suppkey"), s.where("s_suppkey % 9 = 0").select("s_suppkey"))


@core.add("o06_stable_order")
def o06_stable_order(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    items = p.select("p_brand", F.col("p_partkey").alias("item"), (F.col("p_size") * 1_000_000 + F.col("p_partkey")).alias("seq"))
    needs = p.where("p_partkey > 0").select("p_brand", F.col("p_partkey").alias("item"), F.expr("p_partkey div 2").alias("needs"))
    return G.stable_order(items, needs, "p_brand")


@core.add("e18_unresolved_imports", rf"WITH {_FILES}, i AS (SELECT DISTINCT unit_id, unnest(regexp_extract_all(source, '(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;', 1)) AS name FROM f) SELECT unit_id, count(*) AS missing FROM i WHERE name NOT IN (SELECT regexp_extract(source, '(?m)^\s*package\s+([\w.]+)\s*;', 1) || '.' || class_name FROM f WHERE class_name IS NOT NULL) GROUP BY unit_id")
def e18_unresolved_imports(spark, sf_dir):
    facts = J.class_facts(_files(spark, sf_dir))
    wanted = facts.select("unit_id", F.explode("imports").alias("name")).distinct()
    known = facts.where("class_name is not null").select(F.concat(F.coalesce("package", F.lit("")), F.lit("."), "class_name").alias("name")).distinct()
    return wanted.join(known, "name", "left_anti").groupBy("unit_id").agg(F.count(F.lit(1)).alias("missing"))


@core.add("e20_candidate_names", r"SELECT id, len(list_distinct(regexp_extract_all(prompt, '\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b'))) AS names FROM llm_traces WHERE prompt IS NOT NULL")
def e20_candidate_names(spark, sf_dir):
    """Names between characters that are no ASCII word characters, in texts of any script."""
    t = read_table(spark, sf_dir, "llm_traces").where("prompt is not null")
    name = r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?:[A-Z][a-z]+)+(?![A-Za-z0-9_])"
    return t.select("id", F.size(F.array_distinct(F.regexp_extract_all("prompt", F.lit(name), F.lit(0)))).cast("bigint").alias("names"))


@core.add("e09_listing", "SELECT target_file AS file FROM llm_traces WHERE target_file IS NOT NULL UNION SELECT c.file_path FROM (SELECT unnest(classes) AS c FROM map_units) WHERE c.file_path IS NOT NULL")
def e09_listing(spark, sf_dir):
    t = read_table(spark, sf_dir, "llm_traces").select(F.col("target_file").alias("file"))
    c = read_table(spark, sf_dir, "map_units").select(F.explode("classes").alias("c")).select(F.col("c.file_path").alias("file"))
    return t.unionByName(c).where("file is not null").distinct()


@core.add("f25_parent_folder", "SELECT id FROM llm_traces WHERE string_split(target_file, '/')[-2] IN ('exam', 'audit', 'review')")
def f25_parent_folder(spark, sf_dir):
    parts = F.split("target_file", "/")
    return read_table(spark, sf_dir, "llm_traces").where(F.get(parts, F.size(parts) - 2).isin("exam", "audit", "review")).select("id")


@core.add("f24_target_files", "SELECT id, array_to_string(list_filter([target_file, CASE WHEN attempt > 0 THEN class_name END, prompt_payload_key], lambda x: x IS NOT NULL), ',') AS files FROM llm_traces")
def f24_target_files(spark, sf_dir):
    own = F.array("target_file", F.when(F.col("attempt") > 0, F.col("class_name")), "prompt_payload_key")
    return read_table(spark, sf_dir, "llm_traces").select("id", F.array_join(F.filter(own, lambda x: x.isNotNull()), ",").alias("files"))


@core.add(
    "c06_recordable",
    """
    SELECT golden_id, coalesce(response.status_code < 500, false) AND (response.body IS NULL OR trim(response.body) = '' OR json_valid(response.body)) AS kept,
      coalesce(request.method IN ('POST', 'PUT', 'PATCH', 'DELETE'), false) AND NOT coalesce(response.status_code BETWEEN 200 AND 299, false) AS anomaly FROM golden
    """,
)
def c06_recordable(spark, sf_dir):
    """Server errors answer with a page, everything else with JSON; no status has no content type."""
    g = read_table(spark, sf_dir, "golden")
    kind = F.when(F.col("response.status_code") >= 500, "text/html").when(F.col("response.status_code") < 500, "Application/JSON; charset=utf-8")
    e = g.select("golden_id", F.col("request.method").alias("method"), F.col("response.status_code").alias("status_code"), kind.alias("content_type"), F.col("response.body").alias("body"))
    return recorded(e, F.coalesce(F.col("method").isin("POST", "PUT", "PATCH", "DELETE"), F.lit(False))).select("golden_id", "kept", "anomaly")


@core.add(
    "x16_json_get",
    """
    WITH v AS (SELECT golden_id, response.body AS b FROM golden WHERE json_valid(response.body)), o AS (SELECT golden_id, b ->> '$.code' AS code, json_exists(b, '$.data') AS has_data FROM v WHERE json_type(b) = 'OBJECT')
    SELECT golden_id, code, coalesce(has_data, false) AS has_data FROM golden LEFT JOIN o USING (golden_id)
    """,
)
def x16_json_get(spark, sf_dir):
    """Read where it is there; a read of what is not is an error (a test asks for it)."""
    b = F.col("response.body")
    return read_table(spark, sf_dir, "golden").select("golden_id", F.when(X.json_has(b, "code"), X.json_get(b, "code")).alias("code"), X.json_has(b, "data").alias("has_data"))


@core.add(
    "st10_stream_rates",
    """
    WITH t AS (SELECT id, model, status, epoch_us(CAST(ts AS TIMESTAMPTZ)) AS us FROM llm_traces), m AS (SELECT (min(id) + max(id)) // 2 AS half FROM t),
    w AS (SELECT max(us) // 1000 * 1000 - 3600000000 AS mark FROM t, m WHERE id <= half)
    SELECT strftime(make_timestamp(us // 3600000000 * 3600000000), '%Y-%m-%d %H:%M') AS hour, model, count(*) AS calls, count(*) FILTER (status IN ('error', 'timeout')) AS errors FROM t, m, w
    WHERE id <= half OR (us // 3600000000 + 1) * 3600000000 > mark GROUP BY ALL
    """,
)
def st10_stream_rates(spark, sf_dir):
    """Trace files as a stream that is stopped and goes on: hourly windows in event time, an hour of lateness.

    The first half of the rows comes first; what the second half has for windows that are
    closed by then is dropped.  A row of the far future closes the last windows.
    """
    import uuid

    from tracewright.streaming import events as E

    t = read_table(spark, sf_dir, "llm_traces")
    half = t.agg(F.floor((F.min("id") + F.max("id")) / 2)).first()[0]
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = t.select("id", "ts", "model", "status", "latency_ms").schema
    last = spark.createDataFrame([(-1, "9000-01-01T00:00:00Z", "end", "ok", None)], schema)
    out = None
    for part in (t.where(F.col("id") <= half), t.where(F.col("id") > half), last):
        part.select(*schema.names).write.mode("append").parquet(f"{folder}/in")
        stream = E.read_traces(spark, f"{folder}/in", schema, files_per_trigger=1_000_000)
        out = E.drained(E.call_rates(stream, late="1 hour"), folder, "append")
    return out.where(F.col("model").isNull() | (F.col("model") != "end")).select(F.date_format("from", "yyyy-MM-dd HH:mm").alias("hour"), "model", "calls", "errors")
