"""Queries of run states, triage and layout rules, with their SQL.

A target file of the trace log stands for a module, its calls for the events of the module.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import scalars as X
from tracewright.operators import graphs as G
from tracewright.operators import layout as L
from tracewright.operators import relational as R
from tracewright.operators import runs as S
from tracewright.operators.traces import id_bucket
from tracewright.plans import core
from tracewright.session import read_table


def _traces(spark, sf_dir):
    return read_table(spark, sf_dir, "llm_traces")


@core.add(
    "a10_failure_contexts",
    """
    WITH f AS (SELECT target_file AS module, count(*) AS failures FROM llm_traces WHERE status IN ('error', 'timeout') AND target_file IS NOT NULL GROUP BY 1),
    gap AS (SELECT DISTINCT task_id FROM llm_traces WHERE status = 'timeout' AND task_id IS NOT NULL),
    t AS (SELECT module, count(*) AS n, count(gap.task_id) AS gaps FROM (SELECT DISTINCT task_id, target_file AS module FROM llm_traces WHERE task_id IS NOT NULL AND attempt > 0) k LEFT JOIN gap USING (task_id) GROUP BY module),
    b AS (SELECT DISTINCT target_file AS module FROM llm_traces WHERE issue_tag = 'refused')
    SELECT module, CASE WHEN b.module IS NOT NULL THEN 'blocked' WHEN n IS NULL THEN 'module_mismatch' WHEN n = gaps THEN 'scaffold_gap' ELSE 'root_cause' END AS origin, failures, coalesce(gaps, 0) AS gaps
    FROM f LEFT JOIN t USING (module) LEFT JOIN b USING (module)
    """,
)
def a10_failure_contexts(spark, sf_dir):
    t = _traces(spark, sf_dir).withColumn("module", F.col("target_file"))
    tasks = t.where("task_id is not null and attempt > 0").select(F.col("task_id").alias("id"), "module")
    gaps = t.where("status = 'timeout' and task_id is not null").select("task_id", F.lit(S.SCAFFOLD_SKIPPED).alias("reason"))
    return S.failure_contexts(t.where("status in ('error', 'timeout')"), tasks, gaps, t.where("issue_tag = 'refused'"))


_LAST = "SELECT run_id, arg_max(status, id) AS status, bool_or(caller LIKE 'scaffold%') AS scaffold, bool_or(coalesce(issue_tag = 'refused', false)) AS early, max(attempt) AS attempt FROM llm_traces GROUP BY run_id"


def _last(spark, sf_dir):
    return _traces(spark, sf_dir).groupBy("run_id").agg(
        F.max_by("status", "id").alias("status"), F.bool_or(F.col("caller").like("scaffold%")).alias("scaffold"), F.bool_or(F.coalesce(F.col("issue_tag") == "refused", F.lit(False))).alias("early"), F.max("attempt").alias("attempt")
    )


@core.add(
    "a11_run_outcome",
    f"SELECT run_id, CASE WHEN status = 'ok' THEN 'done' WHEN NOT scaffold THEN 'give_up_scaffold_failed' WHEN early THEN 'give_up_early' ELSE 'give_up_retry_exhausted' END AS outcome FROM ({_LAST})",
)
def a11_run_outcome(spark, sf_dir):
    passed = F.when(F.col("status") == "ok", "pass").otherwise("fail")
    return _last(spark, sf_dir).select("run_id", S.outcome(passed, F.col("scaffold"), F.col("early")).alias("outcome"))


@core.add("st07_retry_route", f"SELECT run_id, CASE WHEN status = 'ok' THEN 'done' WHEN attempt >= 1 THEN 'give_up' ELSE 'debug' END AS route FROM ({_LAST})")
def st07_retry_route(spark, sf_dir):
    return _last(spark, sf_dir).select("run_id", S.retry_route(F.when(F.col("status") == "ok", "pass").otherwise("fail"), F.col("attempt")).alias("route"))


@core.add(
    "a12_early_give_up",
    """
    SELECT run_id, attempt, count(*) FILTER (status = 'error' AND NOT (response IS NOT NULL AND NOT coalesce(issue_tag = 'logic_flaw', false))) = 0 AS give_up_early, count(*) FILTER (status = 'error') AS root_causes
    FROM llm_traces GROUP BY run_id, attempt
    """,
)
def a12_early_give_up(spark, sf_dir):
    t = _traces(spark, sf_dir).select("run_id", "attempt", F.when(F.col("status") == "error", "root_cause").otherwise("blocked").alias("origin"), F.col("response").isNotNull().alias("analyzed"), (F.col("issue_tag") == "logic_flaw").alias("fixable"))
    return S.gives_up_early(t, ["run_id", "attempt"])


_STATES = """
e AS (SELECT task_id AS module, id AS seq, CASE status WHEN 'running' THEN 'in_progress' WHEN 'ok' THEN 'verified' WHEN 'error' THEN 'failed' END AS state FROM llm_traces WHERE task_id IS NOT NULL),
l AS (SELECT module, arg_max(state, seq) FILTER (state IS NOT NULL) AS last, max(seq) FILTER (state IS NOT NULL) AS since, max(seq) FILTER (state IS NULL) AS hit FROM e GROUP BY module),
s AS (SELECT module, CASE WHEN last = 'verified' AND hit > since THEN 'needs_reverify' ELSE coalesce(last, 'pending') END AS status FROM l)
"""


def _states(spark, sf_dir):
    t = _traces(spark, sf_dir).where("task_id is not null")
    event = F.when(F.col("status") == "running", "task").when(F.col("status") == "ok", "passed").when(F.col("status") == "error", "failed").otherwise("regression")
    events = t.select(F.col("task_id").alias("module"), F.col("id").alias("seq"), event.alias("event"))
    return S.module_states(events.select("module"), events)


@core.add("st06_module_states", f"WITH {_STATES} SELECT module, status FROM s")
def st06_module_states(spark, sf_dir):
    return _states(spark, sf_dir)


@core.add("a15_all_done", f"WITH {_STATES} SELECT bool_and(status IN ('verified', 'failed')) AS all_done FROM s")
def a15_all_done(spark, sf_dir):
    return S.all_done(_states(spark, sf_dir))


@core.add(
    "st01_reduced_state",
    "SELECT caller, id, status AS value FROM llm_traces WHERE caller LIKE 'debug%' UNION ALL SELECT caller, max(id), arg_max_null(status, id) FROM llm_traces WHERE caller NOT LIKE 'debug%' GROUP BY caller",
)
def st01_reduced_state(spark, sf_dir):
    t = _traces(spark, sf_dir).where("caller is not null").select("caller", "id", F.col("status").alias("value"))
    append = [r.caller for r in t.select("caller").distinct().where("caller like 'debug%'").collect()]  # as many as there are callers in the code
    return S.reduced(t, "caller", "id", append)


@core.add(
    "st04_without_progress",
    """
    WITH t AS (SELECT id, run_id, epoch_us(CAST(ts AS TIMESTAMPTZ)) // 1000000 AS sec FROM llm_traces WHERE run_id IS NOT NULL AND regexp_matches(ts, '^\\d{4}-\\d{2}-\\d{2}T.*(Z|[+-]\\d{2}:?\\d{2})$')),
    w AS (SELECT id, run_id, sec - lag(sec) OVER (PARTITION BY run_id ORDER BY id) AS waited FROM t)
    SELECT id, run_id, waited FROM w WHERE waited >= 600
    """,
)
def st04_without_progress(spark, sf_dir):
    t = _traces(spark, sf_dir).where(F.col("run_id").isNotNull() & F.col("ts").rlike(r"^\d{4}-\d{2}-\d{2}T.*(Z|[+-]\d{2}:?\d{2})$")).select("id", "run_id", X.as_time(F.col("ts")).alias("at"))
    return S.without_progress(t, "id", ["id"], "at", 600, ["run_id"], id_bucket())


@core.add(
    "st09_modules_to_look_at",
    """
    WITH down AS (SELECT run_id FROM llm_traces GROUP BY run_id HAVING bool_or(http_code = 503))
    SELECT DISTINCT run_id, target_file AS module FROM llm_traces WHERE status = 'error' AND target_file IS NOT NULL AND run_id NOT IN (SELECT run_id FROM down)
    UNION ALL SELECT DISTINCT run_id, target_file FROM llm_traces WHERE status = 'timeout' AND target_file IS NOT NULL AND run_id IN (SELECT run_id FROM down)
    """,
)
def st09_modules_to_look_at(spark, sf_dir):
    t = _traces(spark, sf_dir).withColumn("module", F.col("target_file"))
    reports = t.groupBy("run_id").agg(F.when(F.bool_or(F.col("http_code") == 503), S.UNREACHABLE).alias("reason"))
    return S.modules_to_look_at(reports, t.where("status = 'error'"), t.where("status = 'timeout' and module is not null"))


@core.add(
    "f21_validated_fixes",
    """
    SELECT id, task_id, attempt > 0 AS retranslate, CASE WHEN NOT attempt > 0 AND length(response) > 0 THEN response END AS fixed_body FROM llm_traces
    WHERE task_id IN (SELECT task_id FROM llm_traces WHERE status = 'ok' AND task_id IS NOT NULL) AND (attempt > 0 OR length(response) > 0)
    """,
)
def f21_validated_fixes(spark, sf_dir):
    t = _traces(spark, sf_dir)
    fixes = t.select("id", "task_id", (F.col("attempt") > 0).alias("retranslate"), F.col("response").alias("fixed_body"), F.lit(0).alias("file_fixes"))
    return S.validated_fixes(fixes, t.where("status = 'ok' and task_id is not null").select(F.col("task_id").alias("id"))).drop("file_fixes")


@core.add(
    "f23_scaffold_skipped",
    """
    SELECT id FROM llm_traces t WHERE EXISTS (SELECT 1 FROM llm_traces s WHERE s.status = 'timeout' AND s.target_file IS NOT DISTINCT FROM t.target_file
      AND s.class_name IS NOT DISTINCT FROM t.class_name AND s.function_name IS NOT DISTINCT FROM t.function_name)
    """,
)
def f23_scaffold_skipped(spark, sf_dir):
    t = _traces(spark, sf_dir)
    return S.matching_any(t, ["target_file", "class_name", "function_name"], t.where("status = 'timeout'")).select("id")


@core.add(
    "f18_excluded_overloads",
    """
    WITH r AS (SELECT g.request.method || ' ' || module AS endpoint, 'f::' || module || '::' || case_id AS method_id FROM golden g WHERE g.request.method IS NOT NULL)
    SELECT DISTINCT string_split(method_id, '::')[2] AS class_name, string_split(method_id, '::')[3] AS method, upper(split_part(endpoint, ' ', 1)) AS http_method FROM r
    WHERE endpoint IN (SELECT request.method || ' ' || module FROM golden WHERE response.status_code >= 500)
    """,
)
def f18_excluded_overloads(spark, sf_dir):
    g = read_table(spark, sf_dir, "golden").where("request.method is not null")
    endpoint = F.concat("request.method", F.lit(" "), "module")
    routes = g.select(endpoint.alias("endpoint"), F.concat(F.lit("f::"), "module", F.lit("::"), "case_id").alias("method_id"))
    return S.excluded_overloads(g.where("response.status_code >= 500").select(endpoint.alias("endpoint")), routes)


@core.add(
    "e23_singleton_groups",
    """
    WITH i AS (SELECT DISTINCT controller, endpoint FROM grading_controller WHERE controller IS NOT NULL AND endpoint IS NOT NULL), g AS (SELECT controller, decision AS folder, endpoint FROM grading_controller WHERE decision IS NOT NULL AND controller IS NOT NULL AND endpoint IS NOT NULL AND note LIKE '%checked'),
    ok AS (SELECT controller FROM (SELECT controller, endpoint, count(*) AS n FROM g GROUP BY ALL) k FULL JOIN (SELECT *, true AS want FROM i) w USING (controller, endpoint) GROUP BY controller HAVING bool_and(want IS NOT NULL AND coalesce(n = 1, false)))
    SELECT controller, folder, endpoint FROM g WHERE controller IN (SELECT controller FROM ok) UNION ALL SELECT controller, endpoint, endpoint FROM i WHERE controller NOT IN (SELECT controller FROM ok)
    """,
)
def e23_singleton_groups(spark, sf_dir):
    g = read_table(spark, sf_dir, "grading_controller").where("controller is not null and endpoint is not null")
    given = g.where("decision is not null and note like '%checked'").select("controller", F.col("decision").alias("folder"), "endpoint")
    return S.singleton_groups(given, g.select("controller", "endpoint").distinct(), "controller")


@core.add(
    "e24_regrouped_folders",
    """
    WITH RECURSIVE e AS (SELECT DISTINCT 'n' || n_nationkey AS a, 'n' || (n_nationkey - n_nationkey % 4) AS b FROM nation WHERE n_regionkey < 3),
    b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS x, a AS y FROM b UNION SELECT r.x, b.b FROM r JOIN b ON b.a = r.y),
    c AS (SELECT x AS endpoint, min(y) AS component FROM r GROUP BY x), s AS (SELECT component FROM c GROUP BY component HAVING count(*) > 1)
    SELECT 0 AS rank, component AS folder, endpoint FROM c WHERE component IN (SELECT component FROM s)
    UNION ALL SELECT 1, n_name, 'n' || n_nationkey FROM nation WHERE 'n' || n_nationkey NOT IN (SELECT endpoint FROM c WHERE component IN (SELECT component FROM s))
    """,
)
def e24_regrouped_folders(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation").withColumn("endpoint", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    edges = n.where("n_regionkey < 3").select(F.col("endpoint").alias("src"), F.concat(F.lit("n"), (F.col("n_nationkey") - F.col("n_nationkey") % 4).cast("string")).alias("dst"))
    components = G.components(edges).withColumnRenamed("node", "endpoint")
    return S.regrouped(n, components, n.select("endpoint", F.col("n_name").alias("folder")))


# ---------------------------------------------------------------- layout

_CLASSES = "c AS (SELECT unit_id, pos, c.class_name AS class_name, c.stereotype AS stereotype, string_split(c.file_path, '/')[-2] AS module, nullif(regexp_extract(coalesce(c.source, ''), '(?m)^\\s*package\\s+([\\w.]+)\\s*;', 1), '') AS package FROM (SELECT unit_id, unnest(classes) AS c, unnest(range(len(classes))) AS pos FROM map_units))"
_LAYER = "CASE WHEN regexp_matches(package, '(^|[.])utils$') THEN 'utils' WHEN stereotype IN ('RestController', 'Controller') THEN 'routers' WHEN stereotype IN ('Service', 'Component') THEN 'services' WHEN stereotype = 'Repository' THEN 'repositories' END"


def _classes(spark, sf_dir):
    c = read_table(spark, sf_dir, "map_units").select("unit_id", F.posexplode("classes").alias("pos", "c"))
    package = F.regexp_extract(F.coalesce("c.source", F.lit("")), r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    parts = F.split("c.file_path", "/")
    out = c.select("unit_id", F.col("pos").cast("bigint").alias("pos"), "c.class_name", "c.stereotype", F.get(parts, F.size(parts) - 2).alias("module"), F.when(package != "", package).alias("package"))
    return out.withColumn("layer", L.layer(F.col("stereotype"), F.col("package")))


@core.add("x21_layers", f"WITH {_CLASSES} SELECT unit_id, pos, {_LAYER} AS layer, CASE WHEN ({_LAYER}) IN ('repositories', 'utils') THEN 1 WHEN ({_LAYER}) IS NOT NULL THEN 2 END AS phase FROM c")
def x21_layers(spark, sf_dir):
    return _classes(spark, sf_dir).select("unit_id", "pos", "layer", L.phase(F.col("layer")).alias("phase"))


@core.add("j26_file_module", f"WITH {_CLASSES}, l AS (SELECT *, {_LAYER} AS layer FROM c) SELECT unit_id, pos, CASE WHEN layer = 'utils' THEN '_utils' ELSE module END AS module, layer FROM l WHERE layer IS NOT NULL AND module IS NOT NULL AND class_name IS NOT NULL")
def j26_file_module(spark, sf_dir):
    """Target files of classes, and back from their names to module and layer."""
    c = _classes(spark, sf_dir).where("layer is not null and module is not null and class_name is not null")
    files = c.select("unit_id", "pos", L.layer_file(F.col("module"), F.col("layer"), F.col("class_name")).alias("file"))
    return L.classified(files, c.select("module")).select("unit_id", "pos", "module", "layer")


@core.add("f06_module_filter", f"WITH {_CLASSES} SELECT unit_id, pos FROM c WHERE {_LAYER} = 'services' AND module = 'exam' AND class_name IS NOT NULL")
def f06_module_filter(spark, sf_dir):
    c = _classes(spark, sf_dir).where("layer is not null and module is not null and class_name is not null")
    files = c.select("unit_id", "pos", L.layer_file(F.col("module"), F.col("layer"), F.col("class_name")).alias("file"))
    return L.classified(files, c.select("module")).where("module = 'exam' and layer = 'services'").select("unit_id", "pos")


@core.add("f22_schema_files", "SELECT DISTINCT module FROM golden WHERE module IN ('exam', 'grading')")
def f22_schema_files(spark, sf_dir):
    tree = "### app/schemas/exam.py\nclass A\n### app/schemas/grading.py\n### app/models/file.py"
    return L.with_schema_file(read_table(spark, sf_dir, "golden").select("module").distinct(), tree)


@core.add(
    "x23_fill_mode",
    """
    SELECT entry_id, CASE WHEN json_exists(param_schema, '$.requestBody.content."multipart/form-data"') THEN 'file' WHEN json_extract_string(param_schema, '$.requestBody.content."application/json".schema.type') = 'array' THEN 'raw_body' ELSE 'fields' END AS mode
    FROM grading_controller
    """,
)
def x23_fill_mode(spark, sf_dir):
    return read_table(spark, sf_dir, "grading_controller").select("entry_id", L.fill_mode(F.col("param_schema")).alias("mode"))


@core.add("x13_run_date", "SELECT DISTINCT run_id, split_part(run_id, '_', 1) AS run_date, starts_with(run_id, 'adhoc_') AS adhoc FROM llm_traces WHERE run_id IS NOT NULL")
def x13_run_date(spark, sf_dir):
    t = _traces(spark, sf_dir).where("run_id is not null").select("run_id").distinct()
    return t.select("run_id", F.split_part("run_id", F.lit("_"), F.lit(1)).alias("run_date"), F.startswith("run_id", F.lit("adhoc_")).alias("adhoc"))


@core.add("x07_template_key", r"SELECT DISTINCT endpoint, regexp_replace(replace(regexp_replace(split_part(endpoint, ' ', 2), '^/', ''), '/', '_'), '\{[^}]*\}', '{id}', 'g') AS path_key FROM grading_controller WHERE endpoint IS NOT NULL")
def x07_template_key(spark, sf_dir):
    e = read_table(spark, sf_dir, "grading_controller").where("endpoint is not null").select("endpoint").distinct()
    return e.select("endpoint", X.path_key_of_template(F.split_part("endpoint", F.lit(" "), F.lit(2))).alias("path_key"))


@core.add("x09_template_path", "SELECT golden_id, '/' || array_to_string(list_transform(request.path, lambda p: CASE WHEN starts_with(p, ':') AND length(p) > 1 THEN '{' || substring(p, 2) || '}' ELSE p END), '/') AS path FROM golden WHERE request.path IS NOT NULL")
def x09_template_path(spark, sf_dir):
    g = read_table(spark, sf_dir, "golden").where("request.path is not null")
    return g.select("golden_id", F.concat(F.lit("/"), F.array_join(X.template_segments(F.col("request.path")), "/")).alias("path"))


@core.add(
    "x19_method_name",
    "SELECT id, function_name AS name FROM llm_traces WHERE function_name IS NOT NULL",
)
def x19_method_name(spark, sf_dir):
    """Listed as ``name (int)``, known as ``name``."""
    t = _traces(spark, sf_dir).where("function_name is not null")
    return t.select("id", X.method_name(F.concat("function_name", F.lit(" (int)")), F.array("function_name")).alias("name"))


@core.add("src21_force_include", "SELECT DISTINCT c.class_name FROM (SELECT unnest(classes) AS c FROM map_units) WHERE c.file_path LIKE '%/exam/%' AND c.class_name IS NOT NULL")
def src21_force_include(spark, sf_dir):
    """Listed paths as class names; paths of no class are left out."""
    c = read_table(spark, sf_dir, "map_units").select(F.explode("classes").alias("c")).select("c.file_path", "c.class_name")
    listed = c.where("file_path like '%/exam/%'").select("file_path").unionByName(spark.createDataFrame([("src/gone.java",)], "file_path string"))
    return c.where("class_name is not null").join(listed.distinct(), "file_path", "left_semi").select("class_name").distinct()


@core.add(
    "src11_route_mapping",
    "SELECT route, coalesce(o.target, m.target) AS target FROM (SELECT module AS route, min(case_id) AS target FROM golden GROUP BY module) m LEFT JOIN (SELECT module AS route, max(case_id) AS target FROM golden WHERE response.status_code >= 500 GROUP BY module) o USING (route)",
)
def src11_route_mapping(spark, sf_dir):
    """A mapping with an optional override that wins."""
    g = read_table(spark, sf_dir, "golden")
    base = g.groupBy(F.col("module").alias("route")).agg(F.min("case_id").alias("value"))
    over = g.where("response.status_code >= 500").groupBy(F.col("module").alias("route")).agg(F.max("case_id").alias("value"))
    return R.overlay(base, over, "route").withColumnRenamed("value", "target")
