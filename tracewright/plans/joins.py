"""Queries of lookups and rules on the star schema and the fill entries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import documents as Doc
from tracewright.operators import relational as R
from tracewright.operators.traces import id_bucket
from tracewright.plans import core
from tracewright.session import read_table


@core.add("j06_endpoint_methods", "SELECT DISTINCT c_nationkey, o_orderpriority FROM customer JOIN orders ON o_custkey = c_custkey")
def j06_endpoint_methods(spark, sf_dir):
    """Several matches per key, each pair once; the distinct keys are joined, not all the rows."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").distinct()
    return read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(o, "c_custkey").select("c_nationkey", "o_orderpriority").distinct()


@core.add(
    "j07_mapping",
    "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def j07_mapping(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").join(read_table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    n, r = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "n_name", "r_name")


@core.add(
    "j09_name_resolution",
    "SELECT c_custkey, coalesce('s:' || p.v, 'n:' || n_name) AS resolved FROM customer LEFT JOIN (SELECT s_suppkey, min(s_name) AS v FROM supplier WHERE s_acctbal > 0 GROUP BY 1) p ON s_suppkey = c_custkey LEFT JOIN nation ON n_nationkey = c_custkey",
)
def j09_name_resolution(spark, sf_dir):
    first = read_table(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy(F.col("s_suppkey").alias("name")).agg(F.concat(F.lit("s:"), F.min("s_name")).alias("value"))
    second = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("name"), F.concat(F.lit("n:"), "n_name").alias("value"))
    return R.resolved(read_table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", first, second).select("c_custkey", "resolved")


@core.add(
    "j11_ranked_match",
    "SELECT l_orderkey, l_partkey FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'R', l_quantity DESC, l_partkey) AS k FROM lineitem) WHERE k = 1",
)
def j11_ranked_match(spark, sf_dir):
    """The best candidate per key as an aggregate: no sort of the groups."""
    rank = F.struct((F.col("l_returnflag") != "R").alias("a"), (-F.col("l_quantity")).alias("b"), F.col("l_partkey").alias("c"))
    return read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", rank).alias("l_partkey"))


@core.add("j14_reopened", "SELECT o_orderkey, count(DISTINCT l_suppkey) AS suppliers FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND o_orderstatus = 'F' GROUP BY o_orderkey")
def j14_reopened(spark, sf_dir):
    hit = read_table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_suppkey").alias("suppliers"))
    return read_table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey").join(hit, "o_orderkey")


@core.add(
    "j16_failure_origin",
    """
    SELECT run_id, CASE WHEN bool_or(status = 'timeout') THEN 'blocked' WHEN bool_and(vendor = 'localbox' OR status <> 'error') THEN 'gap' ELSE 'own' END AS origin,
      count(*) FILTER (status = 'error') AS failures FROM llm_traces GROUP BY run_id
    """,
)
def j16_failure_origin(spark, sf_dir):
    t = read_table(spark, sf_dir, "llm_traces")
    return R.failure_origin(t, "run_id", F.col("status") == "timeout", F.col("status") == "error", F.col("vendor") == "localbox")


@core.add("j20_regression_hit", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')")
def j20_regression_hit(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("l_orderkey"))
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(o, "l_orderkey", "left_semi").select("l_partkey").distinct()


@core.add("j22_still_referenced", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 2) AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A')")
def j22_still_referenced(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey")
    gone, live = li.where("l_returnflag = 'R' and l_quantity < 2").select("s_suppkey"), li.where("l_returnflag = 'A'").select("s_suppkey")
    return s.join(gone, "s_suppkey", "left_anti").join(live, "s_suppkey", "left_semi")


@core.add("j23_first_match", "SELECT c_custkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def j23_first_match(spark, sf_dir):
    first = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by("o_totalprice", "o_orderkey").alias("o_totalprice"))
    return read_table(spark, sf_dir, "customer").select("c_custkey").join(first, "c_custkey")


@core.add(
    "j24_chain",
    "SELECT l.p AS producer, l.c AS consumer, a.s_name AS producer_name, b.s_name AS consumer_name FROM (SELECT s_suppkey AS p, (s_suppkey * 7) % 100 AS c FROM supplier) l JOIN supplier a ON a.s_suppkey = l.p JOIN supplier b ON b.s_suppkey = l.c WHERE l.p <> l.c",
)
def j24_chain(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier")
    ends = s.select(F.col("s_suppkey").alias("endpoint"), "s_name")
    links = s.select(F.col("s_suppkey").alias("producer"), ((F.col("s_suppkey") * 7) % 100).alias("consumer"))
    return R.chained(links, ends, ends).select("producer", "consumer", F.col("p.s_name").alias("producer_name"), F.col("c.s_name").alias("consumer_name"))


@core.add("f14_pending", "SELECT endpoint, count(*) AS pending FROM grading_controller WHERE decision <> 'skip' AND (raw_body IS NULL OR last_apply_error IS NOT NULL) GROUP BY endpoint")
def f14_pending(spark, sf_dir):
    return read_table(spark, sf_dir, "grading_controller").where("decision <> 'skip' and (raw_body is null or last_apply_error is not null)").groupBy("endpoint").agg(F.count(F.lit(1)).alias("pending"))


@core.add("f16_annotation_filter", "SELECT unit_id, count(*) AS n FROM (SELECT unit_id, unnest(classes) AS c FROM map_units) WHERE list_has_any(c.annotations, ['Service', 'RestController', 'Entity']) GROUP BY unit_id")
def f16_annotation_filter(spark, sf_dir):
    c = read_table(spark, sf_dir, "map_units").select("unit_id", F.explode("classes").alias("c"))
    return c.where(F.arrays_overlap("c.annotations", F.array(*map(F.lit, ("Service", "RestController", "Entity"))))).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"))


@core.add(
    "a09_module_drafts",
    "SELECT module, array_to_string(list_sort(list_distinct(list(case_id))), ',') AS cases FROM (SELECT case_id, arg_min(module, golden_id) AS module FROM golden GROUP BY case_id) GROUP BY module",
)
def a09_module_drafts(spark, sf_dir):
    """Each case belongs to the module that names it first."""
    owner = read_table(spark, sf_dir, "golden").groupBy("case_id").agg(F.min_by("module", "golden_id").alias("module"))
    return R.grouped_lists(owner, "module", "case_id").select("module", F.array_join("items", ",").alias("cases"))


@core.add("a17_smallest_owner", "SELECT label, min(project_root) AS owner FROM map_units GROUP BY label")
def a17_smallest_owner(spark, sf_dir):
    return read_table(spark, sf_dir, "map_units").groupBy("label").agg(F.min("project_root").alias("owner"))


@core.add("a21_key_value", "SELECT endpoint, arg_max(decision, entry_id) AS decision FROM grading_controller GROUP BY endpoint")
def a21_key_value(spark, sf_dir):
    g = read_table(spark, sf_dir, "grading_controller")
    return R.last_wins(g.select("endpoint", "decision", F.col("entry_id").alias("seq")), ["endpoint"], "seq").select("endpoint", "decision")


@core.add("a24_any_failed", "SELECT module, bool_or(coalesce(response.status_code >= 500, false)) AS any_failed FROM golden GROUP BY module")
def a24_any_failed(spark, sf_dir):
    return read_table(spark, sf_dir, "golden").groupBy("module").agg(F.bool_or(F.coalesce(F.col("response.status_code") >= 500, F.lit(False))).alias("any_failed"))


@core.add(
    "a25_synthesised_row",
    "SELECT module, n FROM (SELECT module, count(*) AS n FROM golden GROUP BY module) UNION ALL SELECT '_shared', count(DISTINCT case_id) FROM golden WHERE case_id LIKE '%login%' HAVING count(*) > 0",
)
def a25_synthesised_row(spark, sf_dir):
    g = read_table(spark, sf_dir, "golden")
    extra = g.where("case_id like '%login%'").agg(F.lit("_shared").alias("module"), F.countDistinct("case_id").alias("n")).where("n > 0")
    return g.groupBy("module").agg(F.count(F.lit(1)).alias("n")).unionByName(extra)


@core.add(
    "w04_backfill_chain",
    "SELECT id, lag(trace_id) OVER (PARTITION BY run_id ORDER BY id) AS previous FROM llm_traces WHERE vendor = 'localbox' AND task_id IS NULL",
)
def w04_backfill_chain(spark, sf_dir):
    t = read_table(spark, sf_dir, "llm_traces").where("vendor = 'localbox' and task_id is null")
    return R.predecessor(t, ["id"], [], "trace_id", ["run_id"], id_bucket()).select("id", "previous")


@core.add(
    "o04_total_order",
    "SELECT id, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN caller LIKE 'parse%' THEN 0 WHEN caller LIKE 'design%' THEN 1 ELSE 2 END, function_name NULLS FIRST, coalesce(class_name, ''), id) AS pos FROM llm_traces",
)
def o04_total_order(spark, sf_dir):
    t = read_table(spark, sf_dir, "llm_traces")
    rank = F.when(F.col("caller").like("parse%"), 0).when(F.col("caller").like("design%"), 1).otherwise(2)
    order = [rank, F.asc_nulls_first("function_name"), F.coalesce("class_name", F.lit("")), "id"]
    bucket = F.struct(rank.alias("r"), F.substring("function_name", 1, 4).alias("f"))  # ascends with the order
    return R.position(t, ["run_id"], order, bucket).select("id", F.col("pos").cast("bigint").alias("pos"))


@core.add("u07_unassigned", "SELECT DISTINCT case_id FROM golden WHERE case_id NOT IN (SELECT case_id FROM golden WHERE response.status_code >= 400 AND case_id IS NOT NULL)")
def u07_unassigned(spark, sf_dir):
    g = read_table(spark, sf_dir, "golden")
    return R.without(g.select("case_id"), g.where("response.status_code >= 400 and case_id is not null"), ["case_id"]).select("case_id").distinct()


_X18 = r"""
WITH n AS (SELECT unit_id, pos, c.class_name AS class_name FROM (SELECT unit_id, unnest(classes) AS c, unnest(range(len(classes))) AS pos FROM map_units)),
f AS (SELECT unit_id, pos, class_name, regexp_replace(class_name, '([a-z0-9])([A-Z])', '\1 \2', 'g') AS words FROM n WHERE class_name IS NOT NULL AND NOT regexp_matches(class_name, '[a-z0-9](And|Or)[A-Z]'))
SELECT unit_id, pos, unnest(['Spring Data 衍生查詢方法，依 ' || words || '、Age 欄位條件計數（由方法名稱依 Spring Data JPA 命名慣例機械解析，未逐一判讀運算子如 GreaterThan／Like 等）',
  'Spring Data 衍生查詢方法（方法名稱 `findTop3By' || class_name || '` 含 Top／Distinct／OrderBy 等複雜關鍵字，機械解析僅辨識出這是衍生查詢方法，實際條件請參照方法簽名，未逐一拆解欄位）', NULL]) AS text FROM f
"""


@core.add("x18_derived_query", _X18)
def x18_derived_query(spark, sf_dir):
    """Strict, loose and no derived query, of names made from the classes'."""
    c = read_table(spark, sf_dir, "map_units").select("unit_id", F.posexplode("classes").alias("pos", "c")).select("unit_id", F.col("pos").cast("bigint").alias("pos"), "c.class_name")
    c = c.where(F.col("class_name").isNotNull() & ~F.col("class_name").rlike("[a-z0-9](And|Or)[A-Z]"))
    names = F.array(F.concat(F.lit("countBy"), "class_name", F.lit("AndAge")), F.concat(F.lit("findTop3By"), "class_name"), F.concat(F.lit("load"), "class_name"))
    return c.select("unit_id", "pos", F.explode(names).alias("n")).select("unit_id", "pos", Doc.column(Doc.derived_query)(F.col("n")).alias("text"))


@core.add("x22_bean_name", "SELECT id, lower(substring(class_name, 1, 1)) || substring(class_name, 2) AS bean FROM llm_traces WHERE class_name IS NOT NULL")
def x22_bean_name(spark, sf_dir):
    from tracewright.functions.scalars import bean_name

    t = read_table(spark, sf_dir, "llm_traces").where("class_name is not null")
    return t.select("id", bean_name(F.col("class_name"), F.lit(None).cast("string")).alias("bean"))
