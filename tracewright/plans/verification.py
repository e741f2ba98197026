"""Queries of the compare pipeline and of the joins around it, with their SQL.

Golden is the first recording of a case, actual its last one if that is another.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import scalars as X
from tracewright.operators import diffing as D
from tracewright.operators import relational as R
from tracewright.plans import core
from tracewright.session import read_table

_BOTH = """
WITH g AS (SELECT module, case_id, arg_min_null(response.status_code, golden_id) AS status_code, arg_min_null(response.body, golden_id) AS body, min(golden_id) AS golden_id FROM golden GROUP BY module, case_id),
a AS (SELECT module, case_id, arg_max_null(response.status_code, golden_id) AS status_code, arg_max_null(response.body, golden_id) AS body, max(golden_id) AS golden_id FROM golden GROUP BY module, case_id HAVING max(golden_id) <> min(golden_id))
"""


def _sides(spark, sf_dir):
    g = read_table(spark, sf_dir, "golden").select("module", "case_id", "golden_id", F.col("response.status_code").alias("status_code"), F.col("response.body").alias("body"))
    s = g.withColumn("seq", F.col("golden_id"))
    first = R.first_wins(s, ["module", "case_id"], "seq")
    # a case recorded once has no second recording to compare
    again = R.last_wins(s, ["module", "case_id"], "seq").join(first.select("golden_id"), "golden_id", "left_anti")
    return first, again.select(*first.columns)


@core.add(
    "j03_golden_actual",
    _BOTH + "SELECT module, case_id, g.golden_id AS golden_id, a.golden_id AS actual_id, g.status_code IS NOT DISTINCT FROM a.status_code AS status_match FROM g LEFT JOIN a USING (module, case_id)",
)
def j03_golden_actual(spark, sf_dir):
    j = R.aligned(*_sides(spark, sf_dir), ["module", "case_id"])
    return j.select("module", "case_id", F.col("golden.golden_id").alias("golden_id"), F.col("actual.golden_id").alias("actual_id"), F.col("golden.status_code").eqNullSafe(F.col("actual.status_code")).alias("status_match"))


@core.add(
    "c05_verify_flat",
    _BOTH
    + """
    SELECT module, case_id, CASE WHEN g.status_code IS DISTINCT FROM a.status_code THEN 'status_code_mismatch' WHEN (g.body IS NULL) <> (a.body IS NULL) THEN 'body_presence_mismatch'
      WHEN g.body <> a.body THEN 'value_mismatch' END AS failure_type FROM g LEFT JOIN a USING (module, case_id)
    """,
)
def c05_verify_flat(spark, sf_dir):
    """The flat form: bodies compared as text."""
    j = R.aligned(*_sides(spark, sf_dir), ["module", "case_id"])
    gb, ab = F.col("golden.body"), F.col("actual.body")
    body = F.when(gb.isNull() != ab.isNull(), "body_presence_mismatch").when(gb != ab, "value_mismatch").otherwise("equal")
    cls = D.failure_class(F.lit(False), F.lit(False), F.col("golden.status_code").eqNullSafe(F.col("actual.status_code")), body)
    return j.select("module", "case_id", cls.alias("failure_type"))


@core.add(
    "a01_pass_summary",
    _BOTH
    + """
    , v AS (SELECT module, g.status_code IS NOT DISTINCT FROM a.status_code AND g.body IS NOT DISTINCT FROM a.body AS ok FROM g LEFT JOIN a USING (module, case_id))
    SELECT module, count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, round_even(count(*) FILTER (ok) / count(*), 3) AS pass_rate,
      CASE WHEN bool_and(ok) THEN 'pass' ELSE 'fail' END AS status FROM v GROUP BY module
    """,
)
def a01_pass_summary(spark, sf_dir):
    j = R.aligned(*_sides(spark, sf_dir), ["module", "case_id"])
    ok = F.col("golden.status_code").eqNullSafe(F.col("actual.status_code")) & F.col("golden.body").eqNullSafe(F.col("actual.body"))
    return R.pass_summary(j.select("module", ok.alias("ok")), ["module"], F.col("ok"))


@core.add(
    "c03_failure_classes",
    _BOTH
    + """
    , gg AS (SELECT * FROM g WHERE module <> 'exam'), aa AS (SELECT module, case_id, max(golden_id) AS golden_id, arg_max_null(response.status_code, golden_id) AS status_code, arg_max_null(response.body, golden_id) AS body FROM golden WHERE module <> 'file' GROUP BY module, case_id)
    SELECT module, case_id, CASE WHEN gg.golden_id IS NULL THEN 'golden_not_found' WHEN aa.body IS NOT NULL AND trim(aa.body) <> '' AND NOT json_valid(aa.body) THEN 'response_not_json'
      WHEN aa.golden_id IS NULL OR gg.status_code IS DISTINCT FROM aa.status_code THEN 'status_code_mismatch' WHEN (gg.body IS NULL) <> (aa.body IS NULL) THEN 'body_presence_mismatch' ELSE 'compared' END AS failure
    FROM gg FULL JOIN aa USING (module, case_id)
    """,
)
def c03_failure_classes(spark, sf_dir):
    """Classes up to the comparison of the bodies, which ``c02_verify_nested`` makes: one side lacks a module each."""
    g, _ = _sides(spark, sf_dir)
    again = read_table(spark, sf_dir, "golden").select("module", "case_id", "golden_id", F.col("response.status_code").alias("status_code"), F.col("response.body").alias("body"), F.col("golden_id").alias("seq"))
    v = D.verify(g.where("module <> 'exam'"), R.last_wins(again.where("module <> 'file'"), ["module", "case_id"], "seq"), ["module", "case_id"], "mutation")
    early = ("golden_not_found", "response_not_json", "status_code_mismatch", "body_presence_mismatch")
    return v.select("module", "case_id", F.when(F.col("failure_type").isin(*early), F.col("failure_type")).otherwise("compared").alias("failure"))


@core.add("c02_verify_nested")
def c02_verify_nested(spark, sf_dir):
    """Masked deep comparison with failure class and hint (no SQL states it)."""
    return D.verify(*_sides(spark, sf_dir), ["module", "case_id"], "mutation")


@core.add("c02_summary_nested")
def c02_summary_nested(spark, sf_dir):
    return R.pass_summary(c02_verify_nested(spark, sf_dir), ["module"], F.col("passed"))


@core.add(
    "c01_mask_flat",
    r"""
    SELECT id, CASE WHEN regexp_matches(ts, '^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}|Bearer\s)') THEN '<<MASKED>>' ELSE ts END AS ts,
      regexp_replace(target_file, '[a-z]+/', '<<MASKED>>', 'g') AS target_file FROM llm_traces
    """,
)
def c01_mask_flat(spark, sf_dir):
    t = read_table(spark, sf_dir, "llm_traces")
    return t.select("id", D.mask_text(F.col("ts")).alias("ts"), D.mask_text(F.col("target_file"), (), (r"[a-z]+/",)).alias("target_file"))


@core.add(
    "c07_taint",
    "SELECT golden_id, bool_or(coalesce(response.status_code >= 500, false)) OVER (PARTITION BY module, request.method) AS tainted FROM golden",
)
def c07_taint(spark, sf_dir):
    g = read_table(spark, sf_dir, "golden").withColumn("folder", F.struct("module", "request.method"))
    return D.tainted(g, "folder", F.col("response.status_code") >= 500).select("golden_id", "tainted")


_PATH = "'/' || array_to_string(request.path, '/')"
_MAP = """
r AS (SELECT p AS route, min(golden_id) AS seq FROM (SELECT '/' || array_to_string(request.path[1:2], '/') AS p, golden_id FROM golden) GROUP BY p),
m AS (SELECT route, seq, 'file_' || (seq % 7) AS target FROM r WHERE route < '/api/m' UNION ALL SELECT '/api', 1000000, 'file_root')
"""


def _routes(spark, sf_dir):
    g = read_table(spark, sf_dir, "golden")
    r = g.select(F.concat(F.lit("/"), F.array_join(F.slice("request.path", 1, 2), "/")).alias("route"), "golden_id").groupBy("route").agg(F.min("golden_id").alias("seq"))
    m = r.where("route < '/api/m'").withColumn("target", F.concat(F.lit("file_"), (F.col("seq") % 7).cast("string")))
    return g, m.unionByName(spark.createDataFrame([("/api", 1_000_000, "file_root")], "route string, seq bigint, target string"))


@core.add(
    "j04_longest_prefix",
    f"""
    WITH {_MAP}, p AS (SELECT golden_id, {_PATH} AS path FROM golden)
    SELECT golden_id, target FROM (SELECT golden_id, target, row_number() OVER (PARTITION BY golden_id ORDER BY length(route) DESC, seq) AS k FROM p LEFT JOIN m ON starts_with(path, route)) WHERE k = 1
    """,
)
def j04_longest_prefix(spark, sf_dir):
    g, m = _routes(spark, sf_dir)
    return R.longest_prefix(g.select("golden_id", F.concat(F.lit("/"), F.array_join("request.path", "/")).alias("path")), "path", m).select("golden_id", "target")


@core.add(
    "j05_route_module",
    f"""
    WITH {_MAP}, p AS (SELECT golden_id, {_PATH} AS path, list_filter(request.path, lambda x: x NOT IN ('', 'api', 'v1', 'v2')) AS parts FROM golden)
    SELECT golden_id, coalesce(target, parts[1], 'misc') AS module FROM p LEFT JOIN m ON path = route
    """,
)
def j05_route_module(spark, sf_dir):
    g, m = _routes(spark, sf_dir)
    p = g.select("golden_id", F.concat(F.lit("/"), F.array_join("request.path", "/")).alias("path"))
    return R.first_module(p, "path", m.select("route", F.col("target").alias("module"))).select("golden_id", "module")


@core.add("j08_last_wins", "SELECT module, case_id, arg_max(golden_id, golden_id) AS golden_id, arg_max_null(response.status_code, golden_id) AS status_code FROM golden GROUP BY module, case_id")
def j08_last_wins(spark, sf_dir):
    g = read_table(spark, sf_dir, "golden").select("module", "case_id", "golden_id", F.col("response.status_code").alias("status_code"), F.col("golden_id").alias("seq"))
    return R.last_wins(g, ["module", "case_id"], "seq").select("module", "case_id", "golden_id", "status_code")


@core.add("j12_inverted_index", "SELECT DISTINCT item, golden_id FROM (SELECT golden_id, unnest(request.path) AS item FROM golden)")
def j12_inverted_index(spark, sf_dir):
    g = read_table(spark, sf_dir, "golden").select("golden_id", F.col("request.path").alias("path"))
    return R.inverted(g, "golden_id", "path")


@core.add("j19_overlay", "SELECT coalesce(p.controller, b.controller) AS controller, coalesce(p.value, b.value) AS value FROM (SELECT controller, min(note) AS value FROM grading_controller WHERE decision = 'fill' GROUP BY 1) b FULL JOIN (SELECT controller, max(note) AS value FROM grading_controller WHERE decision = 'skip' GROUP BY 1) p USING (controller)")
def j19_overlay(spark, sf_dir):
    g = read_table(spark, sf_dir, "grading_controller")
    base = g.where("decision = 'fill'").groupBy("controller").agg(F.min("note").alias("value"))
    return R.overlay(base, g.where("decision = 'skip'").groupBy("controller").agg(F.max("note").alias("value")), "controller")


@core.add(
    "j21_value_fill",
    """
    WITH v AS (SELECT entry_id, note FROM grading_controller WHERE decision = 'skip')
    SELECT g.entry_id, coalesce('filled ' || v.note, g.note) AS note FROM grading_controller g LEFT JOIN v ON v.entry_id = g.entry_id
    """,
)
def j21_value_fill(spark, sf_dir):
    g = read_table(spark, sf_dir, "grading_controller").select("entry_id", "note", "decision")
    return R.filled(g.drop("decision"), g.where("decision = 'skip'").withColumn("note", F.concat(F.lit("filled "), "note")), ["entry_id"], "note")


@core.add(
    "j25_priority_merge",
    """
    WITH s AS (SELECT 0 AS prio, endpoint, controller AS value FROM grading_controller WHERE decision = 'skip' UNION ALL SELECT 1, endpoint, decision FROM grading_controller WHERE last_apply_error IS NOT NULL UNION ALL SELECT 2, endpoint, fill_mode FROM grading_controller)
    SELECT endpoint, value, prio FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY prio, value) AS k FROM s WHERE value IS NOT NULL) WHERE k = 1
    """,
)
def j25_priority_merge(spark, sf_dir):
    g = read_table(spark, sf_dir, "grading_controller")
    parts = [g.where(w).select("endpoint", F.col(c).alias("value")).where("value is not null") for w, c in (("decision = 'skip'", "controller"), ("last_apply_error is not null", "decision"), ("true", "fill_mode"))]
    return R.by_priority(parts, "endpoint")


@core.add("a06_shared_members", "SELECT l_partkey, count(DISTINCT l_suppkey) AS groups FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 2")
def a06_shared_members(spark, sf_dir):
    return R.shared_members(read_table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


@core.add("a22_unique_or_null", "SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderpriority LIKE '1%') = 1 THEN max(CASE WHEN o_orderpriority LIKE '1%' THEN o_orderkey END) END AS o_orderkey FROM orders GROUP BY o_custkey")
def a22_unique_or_null(spark, sf_dir):
    return R.unique_or_null(read_table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderpriority").like("1%"), "o_orderkey")


@core.add(
    "a19_name_tiers",
    """
    SELECT unit_id, CASE WHEN count(*) OVER (PARTITION BY label) = 1 THEN label WHEN count(*) OVER (PARTITION BY label, project_root) = 1 THEN concat_ws('_', label, project_root)
      ELSE concat_ws('_', label, project_root, CAST(unit_id AS VARCHAR)) END AS label FROM map_units
    """,
)
def a19_name_tiers(spark, sf_dir):
    u = read_table(spark, sf_dir, "map_units").withColumn("u", F.col("unit_id").cast("string"))
    return R.name_tiers(u.withColumnRenamed("label", "name"), "name", "project_root", "u").select("unit_id", "label")


@core.add(
    "f15_trivial_class",
    """
    WITH c AS (SELECT unit_id, unnest(classes) AS c, unnest(range(len(classes))) AS pos FROM map_units)
    SELECT unit_id, pos, CASE WHEN len(c.methods) IS NULL OR len(list_filter(c.methods, lambda m: m.has_body)) = 0 THEN true
      WHEN len(list_intersect(c.annotations, ['Data', 'Entity'])) > 0 AND len(list_filter(c.methods, lambda m: NOT regexp_matches(m.name, '^(get|set|is)[A-Z]'))) = 0 THEN true ELSE false END AS trivial FROM c
    """,
)
def f15_trivial_class(spark, sf_dir):
    """Classes without any body, or data classes with accessors only; empty lists are vacuously trivial."""
    u = read_table(spark, sf_dir, "map_units").select("unit_id", F.posexplode("classes").alias("pos", "c"))
    methods = F.coalesce("c.methods", F.array().cast("array<struct<name:string,return_type:string,has_body:boolean>>"))
    bodyless = F.size(F.filter(methods, lambda m: m["has_body"])) == 0
    data = F.coalesce(F.arrays_overlap("c.annotations", F.array(F.lit("Data"), F.lit("Entity"))), F.lit(False))
    accessors = F.size(F.filter(methods, lambda m: ~m["name"].rlike("^(get|set|is)[A-Z]"))) == 0
    return u.select("unit_id", F.col("pos").cast("bigint").alias("pos"), (bodyless | (data & accessors)).alias("trivial"))


@core.add("x06_path_key", r"SELECT golden_id, array_to_string(list_transform(request.path, lambda p: CASE WHEN regexp_full_match(p, '\d+') THEN '{id}' ELSE p END), '_') AS path_key FROM golden")
def x06_path_key(spark, sf_dir):
    return read_table(spark, sf_dir, "golden").select("golden_id", X.path_key_of_url(F.col("request.path")).alias("path_key"))


@core.add("x08_case_id", r"SELECT golden_id, regexp_replace(lower(module) || '_' || request.method || '_' || array_to_string(request.path, '/'), '[^\p{L}\p{N}_\-]', '_', 'g') AS case_key FROM golden")
def x08_case_id(spark, sf_dir):
    g = read_table(spark, sf_dir, "golden")
    return g.select("golden_id", X.case_id(F.col("module"), F.col("request.method"), F.array_join("request.path", "/")).alias("case_key"))


@core.add("x10_resource_name", "SELECT golden_id, coalesce(list_filter(request.path, lambda p: p NOT IN ('', 'api', 'v1', 'v2') AND NOT starts_with(p, ':') AND NOT starts_with(p, '{'))[-1], '') AS resource FROM golden")
def x10_resource_name(spark, sf_dir):
    return read_table(spark, sf_dir, "golden").select("golden_id", X.resource_name(F.array_join("request.path", "/")).alias("resource"))


@core.add("x11_slug", "SELECT doc_id, regexp_replace(regexp_replace(repo, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM documents")
def x11_slug(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", X.slug(F.col("repo")).alias("slug"))


@core.add("x20_constant", "SELECT unit_id, upper(regexp_replace(label, '[^A-Za-z0-9]+', '_', 'g')) AS constant FROM map_units")
def x20_constant(spark, sf_dir):
    return read_table(spark, sf_dir, "map_units").select("unit_id", X.constant_name(F.col("label")).alias("constant"))


@core.add(
    "x02_map_type",
    """
    WITH m AS (SELECT unit_id, pos, mpos, m.return_type AS t FROM (SELECT unit_id, pos, unnest(c.methods) AS m, unnest(range(len(c.methods))) AS mpos FROM (SELECT unit_id, unnest(classes) AS c, unnest(range(len(classes))) AS pos FROM map_units)) WHERE m.return_type IS NOT NULL AND NOT contains(m.return_type, '<')),
    s AS (SELECT *, CASE WHEN t IN ('int', 'Integer', 'long', 'Long', 'short', 'Short') THEN 'int' WHEN t = 'String' THEN 'str' WHEN t IN ('boolean', 'Boolean') THEN 'bool' WHEN t IN ('double', 'Double', 'float', 'Float') THEN 'float' WHEN t = 'BigDecimal' THEN 'Decimal' WHEN t = 'void' THEN 'None' WHEN t IN ('Date', 'Instant', 'LocalDateTime') THEN 'datetime' WHEN t = 'LocalDate' THEN 'date' WHEN t = 'LocalTime' THEN 'time' WHEN t IN ('byte[]', 'Byte[]') THEN 'bytes' ELSE t END AS p FROM m)
    SELECT unit_id, pos, mpos, unnest([p, 'dict[str, list[' || p || ']]', p || ' | None', 'Callable[[' || p || ', int], None]', 'Callable[[], ' || p || ']', 'ColumnElement | None', 'Response', 'Page[' || p || ']', 'Function[' || p || ']']) AS py_type FROM s
    """,
)
def x02_map_type(spark, sf_dir):
    """Return types by themselves and within containers, functional interfaces, framework types and unknown generics."""
    m = read_table(spark, sf_dir, "map_units").select("unit_id", F.posexplode("classes").alias("pos", "c")).select("unit_id", F.col("pos").cast("bigint").alias("pos"), F.posexplode("c.methods").alias("mpos", "m"))
    t = m.select("unit_id", "pos", F.col("mpos").cast("bigint").alias("mpos"), F.col("m.return_type").alias("t")).where("t is not null and not contains(t, '<')")
    forms = ("%s", "Map<String, List<%s>>", "Optional<%s>", "BiConsumer<%s, Integer>", "Supplier<%s>", "Specification<%s>", "ResponseEntity<List<%s>>", "Page<%s>", "Function<%s>")
    every = t.select("unit_id", "pos", "mpos", F.explode(F.array(*[F.format_string(f, F.col("t")) for f in forms])).alias("t"))
    return every.select("unit_id", "pos", "mpos", X.map_type_udf()(F.col("t")).alias("py_type"))
