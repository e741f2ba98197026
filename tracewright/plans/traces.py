"""Queries of the trace operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import scalars as X
from tracewright.operators import relational as R
from tracewright.operators import traces as T
from tracewright.plans import core
from tracewright.session import read_table

AS_OF = "2031-01-15 00:00:00"
_TS = "epoch_us(CAST(ts AS TIMESTAMPTZ))"


def _traces(spark, sf_dir):
    return read_table(spark, sf_dir, "llm_traces")


@core.add("f01_point_lookup", "SELECT id, trace_id, status FROM llm_traces WHERE trace_id = (SELECT min(trace_id) FROM llm_traces)")
def f01_point_lookup(spark, sf_dir):
    t = _traces(spark, sf_dir)
    return T.point(t, t.agg(F.min("trace_id")).first()[0]).select("id", "trace_id", "status")


@core.add(
    "f02_conjunctive_filter",
    f"SELECT id, run_id, status FROM llm_traces WHERE status = 'error' AND vendor = 'northlake' AND {_TS} >= epoch_us(TIMESTAMPTZ '{AS_OF}+00')",
)
def f02_conjunctive_filter(spark, sf_dir):
    return T.matching(_traces(spark, sf_dir), status="error", vendor="northlake", since=F.lit(AS_OF).cast("timestamp")).select("id", "run_id", "status")


@core.add(
    "f03_task_filter",
    "SELECT id, task_id, row_number() OVER (PARTITION BY task_id ORDER BY id) AS pos FROM llm_traces WHERE task_id = (SELECT max(task_id) FROM llm_traces)",
)
def f03_task_filter(spark, sf_dir):
    t = _traces(spark, sf_dir)
    return T.of_task(t, t.agg(F.max("task_id")).first()[0]).select("id", "task_id", F.col("pos").cast("bigint").alias("pos"))


@core.add(
    "f04_null_safe_target",
    """
    WITH k AS (SELECT min(struct_pack(f := target_file, n := function_name)) AS k FROM llm_traces WHERE class_name IS NULL AND target_file IS NOT NULL AND function_name IS NOT NULL)
    SELECT id, target_file, function_name FROM llm_traces, k WHERE target_file = k.f AND function_name = k.n AND class_name IS NOT DISTINCT FROM NULL
    """,
)
def f04_null_safe_target(spark, sf_dir):
    t = _traces(spark, sf_dir)
    k = t.where("class_name is null and target_file is not null and function_name is not null").agg(F.min(F.struct("target_file", "function_name"))).first()[0]
    return T.of_target(t, k[0], None, k[1]).select("id", "target_file", "function_name")


_TOKENS = "list_filter(list_distinct(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+')), lambda x: x <> '')"


@core.add("j01_token_search", f"SELECT id FROM llm_traces WHERE list_has_all({_TOKENS.format(chr(39) * 2 + ' || concat_ws(' + chr(39) + ' ' + chr(39) + ', prompt, response)')}, ['please', 'answer', 'english'])")
def j01_token_search(spark, sf_dir):
    return T.with_terms(_traces(spark, sf_dir), "id", ("prompt", "response"), ("please", "answer", "English")).select("id")


@core.add("j02_substring_search", "SELECT id FROM llm_traces WHERE contains(prompt, 'after the controller') OR contains(response, 'after the controller')")
def j02_substring_search(spark, sf_dir):
    return T.containing(_traces(spark, sf_dir), ("prompt", "response"), "after the controller").select("id")


@core.add(
    "u01_search_union",
    """
    WITH a AS (SELECT id FROM llm_traces WHERE contains(response, 'controller')), b AS (SELECT id FROM llm_traces WHERE contains(prompt, 'controller'))
    SELECT id, 1 AS part FROM a UNION ALL SELECT id, 2 AS part FROM b WHERE id NOT IN (SELECT id FROM a)
    """,
)
def u01_search_union(spark, sf_dir):
    t = _traces(spark, sf_dir)
    return T.search_union(T.containing(t, ("response",), "controller").select("id"), T.containing(t, ("prompt",), "controller").select("id"), "id").select("id", "part")


@core.add("token_index", f"SELECT token, count(*) AS docs FROM (SELECT unnest({_TOKENS.format('text')}) AS token FROM documents) GROUP BY token")
def token_index(spark, sf_dir):
    return T.token_index(read_table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("token").agg(F.count(F.lit(1)).alias("docs"))


@core.add("o01_latest_run", "SELECT arg_max(run_id, id) AS run_id FROM llm_traces")
def o01_latest_run(spark, sf_dir):
    return T.latest_run(_traces(spark, sf_dir))


@core.add("o02_newest_first", "SELECT id, run_id, row_number() OVER (PARTITION BY run_id ORDER BY id DESC) AS pos FROM llm_traces")
def o02_newest_first(spark, sf_dir):
    return T.newest_first(_traces(spark, sf_dir), within=("run_id",)).select("id", "run_id", F.col("pos").cast("bigint").alias("pos"))


@core.add("o03_newest_running", f"SELECT trace_id, id, run_id FROM llm_traces WHERE status = 'running' ORDER BY {_TS} DESC, id DESC LIMIT 1")
def o03_newest_running(spark, sf_dir):
    return T.newest_running(_traces(spark, sf_dir)).select("trace_id", "id", "run_id")


@core.add(
    "st03_stalled",
    f"""
    WITH n AS (SELECT trace_id, id, {_TS} AS t FROM llm_traces WHERE status = 'running' ORDER BY t DESC, id DESC LIMIT 1)
    SELECT trace_id, CAST(floor(epoch_us(TIMESTAMPTZ '2041-01-01 00:00:00+00') / 1000000) - floor(t / 1000000) AS BIGINT) AS elapsed FROM n
    WHERE floor(epoch_us(TIMESTAMPTZ '2041-01-01 00:00:00+00') / 1000000) - floor(t / 1000000) >= 300
    """,
)
def st03_stalled(spark, sf_dir):
    return T.stalled(_traces(spark, sf_dir), F.lit("2041-01-01 00:00:00").cast("timestamp"), 300).select("trace_id", "elapsed")


@core.add(
    "st02_fold_events",
    """
    SELECT trace_id, arg_min(ts, id) AS ts, arg_max(status, id) AS status, arg_max_null(latency_ms, id) AS latency_ms,
      arg_max(issue_tag, id) AS issue_tag, count(*) AS events FROM llm_traces GROUP BY trace_id
    """,
)
def st02_fold_events(spark, sf_dir):
    return T.fold_events(_traces(spark, sf_dir)).select("trace_id", "ts", "status", "latency_ms", "issue_tag", "events")


@core.add(
    "snk03_tag_update",
    """
    WITH tags AS (SELECT trace_id, CASE WHEN status = 'timeout' THEN 'truncated' ELSE 'refused' END AS tag, id AS seq FROM llm_traces WHERE status IN ('error', 'timeout') AND trace_id IS NOT NULL),
    n AS (SELECT trace_id, arg_max(tag, seq) AS new_tag FROM tags GROUP BY trace_id)
    SELECT id, coalesce(new_tag, issue_tag) AS issue_tag FROM llm_traces LEFT JOIN n USING (trace_id)
    """,
)
def snk03_tag_update(spark, sf_dir):
    t = _traces(spark, sf_dir)
    tags = t.where("status in ('error', 'timeout') and trace_id is not null").select("trace_id", F.when(F.col("status") == "timeout", "truncated").otherwise("refused").alias("tag"), F.col("id").alias("seq"))
    return T.apply_tags(t, tags, ("hallucination", "format_error", "logic_flaw", "refused", "truncated")).select("id", "issue_tag")


@core.add(
    "snk04_threshold_spill",
    """
    SELECT id, CASE WHEN strlen(prompt) >= 1500 THEN run_id || '/' || trace_id || '.md' END AS prompt_key,
      CASE WHEN strlen(prompt) < 1500 THEN length(prompt) END AS kept FROM llm_traces
    """,
)
def snk04_threshold_spill(spark, sf_dir):
    return T.spill(_traces(spark, sf_dir), ("prompt",), 1500).select("id", "prompt_key", F.char_length("prompt").cast("bigint").alias("kept"))


@core.add(
    "snk14_orphan_payloads",
    """
    WITH files AS (SELECT DISTINCT run_id || '/' || trace_id || '.md' AS key FROM llm_traces),
    live AS (SELECT DISTINCT prompt_payload_key AS key FROM llm_traces WHERE prompt_payload_key IS NOT NULL)
    SELECT key FROM files WHERE key NOT IN (SELECT key FROM live)
    """,
)
def snk14_orphan_payloads(spark, sf_dir):
    t = _traces(spark, sf_dir)
    files = t.select(F.concat("run_id", F.lit("/"), "trace_id", F.lit(".md")).alias("key"), F.lit("2030-01-01").cast("timestamp").alias("modified")).distinct()
    keys = t.select(F.col("prompt_payload_key").alias("key"))
    return T.orphans(files, keys, F.lit("2031-01-01").cast("timestamp")).select("key")


@core.add(
    "st05_failure_streaks",
    """
    WITH f AS (SELECT id, run_id, status IN ('error', 'timeout') AS failed FROM llm_traces),
    i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY id) AS island FROM f)
    SELECT id, run_id, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, island ORDER BY id) AS BIGINT) AS streak FROM i
    """,
)
def st05_failure_streaks(spark, sf_dir):
    return T.failure_streaks(_traces(spark, sf_dir), ["run_id"], "id", F.col("status").isin("error", "timeout"), T.id_bucket()).select("id", "run_id", "streak")


@core.add(
    "a02_run_metrics",
    """
    SELECT run_id, count(*) AS calls, count(*) FILTER (status = 'ok') AS ok, count(DISTINCT task_id) AS tasks, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
      array_to_string(list_sort(list_distinct(list(model))), ',') AS models FROM llm_traces GROUP BY run_id
    """,
)
def a02_run_metrics(spark, sf_dir):
    return _traces(spark, sf_dir).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == "ok").alias("ok"), F.countDistinct("task_id").alias("tasks"),
        F.sum("input_tokens").alias("input_tokens"), F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"),
    )


@core.add(
    "a03_local_failures",
    "SELECT run_id, array_to_string(list_sort(list_distinct(list(task_id))), ',') AS tasks FROM llm_traces WHERE status = 'error' AND vendor = 'localbox' AND task_id IS NOT NULL GROUP BY run_id",
)
def a03_local_failures(spark, sf_dir):
    t = T.matching(_traces(spark, sf_dir), status="error", vendor="localbox").where("task_id is not null")
    return t.groupBy("run_id").agg(F.array_join(F.sort_array(F.collect_set("task_id")), ",").alias("tasks"))


@core.add("a04_last_status", "SELECT task_id, arg_max(status, id) AS status FROM llm_traces WHERE task_id IS NOT NULL GROUP BY task_id")
def a04_last_status(spark, sf_dir):
    return R.last_value(_traces(spark, sf_dir).where("task_id is not null"), "task_id", "status", "id")


@core.add(
    "a05_last_reason",
    "SELECT task_id, r AS error_msg FROM (SELECT task_id, arg_max_null(error_msg, id) AS r FROM llm_traces WHERE task_id IS NOT NULL GROUP BY task_id) WHERE r IS NOT NULL",
)
def a05_last_reason(spark, sf_dir):
    return R.last_with_retraction(_traces(spark, sf_dir).where("task_id is not null"), "task_id", "error_msg", "id")


@core.add(
    "a07_majority_vote",
    """
    WITH n AS (SELECT task_id, model, count(*) AS votes FROM llm_traces WHERE task_id IS NOT NULL GROUP BY task_id, model)
    SELECT task_id, model, votes FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY votes DESC, model <> 'heron-3', model) AS k FROM n) WHERE k = 1
    """,
)
def a07_majority_vote(spark, sf_dir):
    return R.majority(_traces(spark, sf_dir).where("task_id is not null"), ["task_id"], "model", "heron-3")


@core.add(
    "a08_group_by_tag",
    """
    SELECT coalesce(issue_tag, '_untagged') AS issue_tag, count(*) AS n, len(list_distinct(list(caller))) AS callers FROM llm_traces GROUP BY 1
    """,
)
def a08_group_by_tag(spark, sf_dir):
    return R.grouped_lists(_traces(spark, sf_dir), "issue_tag", "caller", "_untagged").select("issue_tag", "n", F.size("items").cast("bigint").alias("callers"))


@core.add(
    "a13_tier_barrier",
    "SELECT run_id, min(CASE WHEN status = 'running' THEN attempt END) AS open_tier, count(*) FILTER (status = 'running') AS open_rows FROM llm_traces GROUP BY run_id",
)
def a13_tier_barrier(spark, sf_dir):
    return R.barrier(_traces(spark, sf_dir), ["run_id"], "attempt", F.col("status") != "running")


@core.add("a14_group_complete", "SELECT run_id, bool_and(status <> 'running') AS done, bool_or(status = 'running') AS any_open FROM llm_traces GROUP BY run_id")
def a14_group_complete(spark, sf_dir):
    return R.complete(_traces(spark, sf_dir), "run_id", F.col("status") != "running")


@core.add("a16_duplicates", "SELECT trace_id, status, count(*) AS n FROM llm_traces GROUP BY trace_id, status HAVING count(*) > 1")
def a16_duplicates(spark, sf_dir):
    return R.duplicates(_traces(spark, sf_dir), ["trace_id", "status"])


@core.add("a20_files_by_run", "SELECT run_id, array_to_string(list_sort(list_distinct(list(target_file))), ',') AS files FROM llm_traces WHERE target_file IS NOT NULL GROUP BY run_id")
def a20_files_by_run(spark, sf_dir):
    t = _traces(spark, sf_dir).where("target_file is not null")
    return t.groupBy("run_id").agg(F.array_join(F.sort_array(F.collect_set("target_file")), ",").alias("files"))


@core.add(
    "a23_size_threshold",
    "SELECT run_id, CAST(coalesce(sum(strlen(prompt)), 0) AS BIGINT) AS bytes, coalesce(sum(strlen(prompt)), 0) > 100000 AS trim FROM llm_traces GROUP BY run_id",
)
def a23_size_threshold(spark, sf_dir):
    return R.over_budget(_traces(spark, sf_dir), "run_id", "prompt", 100_000).select("run_id", F.col("bytes").cast("bigint").alias("bytes"), "trim")


@core.add(
    "w01_predecessor",
    """
    SELECT id, lag(trace_id) OVER w AS previous FROM llm_traces
    QUALIFY true WINDOW w AS (PARTITION BY run_id, vendor ORDER BY id)
    """.replace("QUALIFY true ", ""),
)
def w01_predecessor(spark, sf_dir):
    return R.predecessor(_traces(spark, sf_dir), ["id"], ["vendor"], "trace_id", ["run_id", "vendor"], T.id_bucket()).select("id", "previous")


@core.add(
    "w01_predecessor_same_model",
    """
    SELECT id, CASE WHEN lag(model) OVER w IS NOT DISTINCT FROM model THEN lag(trace_id) OVER w END AS previous FROM llm_traces WINDOW w AS (PARTITION BY run_id ORDER BY attempt, id)
    """,
)
def w01_predecessor_same_model(spark, sf_dir):
    return R.predecessor(_traces(spark, sf_dir), ["attempt", "id"], ["model"], "trace_id", ["run_id"], F.struct("attempt", T.id_bucket().alias("b"))).select("id", "previous")


@core.add("w02_stable_numbering", "SELECT id, printf('task_%03d', row_number() OVER (ORDER BY id) - 1) AS number FROM llm_traces")
def w02_stable_numbering(spark, sf_dir):
    return R.numbered(_traces(spark, sf_dir), [F.col("id")], "task", T.id_bucket()).select("id", "number")


@core.add(
    "w03_overload_suffix",
    """
    SELECT id, CASE WHEN n = 1 THEN function_name ELSE function_name || '_' || n END AS unique_name FROM
      (SELECT id, function_name, row_number() OVER (PARTITION BY target_file, class_name, function_name ORDER BY id) AS n FROM llm_traces WHERE function_name IS NOT NULL)
    """,
)
def w03_overload_suffix(spark, sf_dir):
    t = _traces(spark, sf_dir).where("function_name is not null")
    return R.overload_suffix(t, ["target_file", "class_name"], "function_name", "id", T.id_bucket()).select("id", "unique_name")


@core.add(
    "f12_batches",
    """
    SELECT id, CAST(floor((row_number() OVER (PARTITION BY run_id ORDER BY id) - 1) / ceil(count(*) OVER (PARTITION BY run_id) / 4)) + 1 AS BIGINT) AS batch FROM llm_traces
    """,
)
def f12_batches(spark, sf_dir):
    return R.batch_of(_traces(spark, sf_dir), "id", 4, ["run_id"], T.id_bucket()).select("id", "batch")


_W05 = """
WITH RECURSIVE o AS (SELECT unit_id, pos, coalesce(length(c.source), 0) AS s, row_number() OVER (PARTITION BY unit_id ORDER BY pos) AS k
  FROM (SELECT unit_id, unnest(classes) AS c, unnest(range(len(classes))) AS pos FROM map_units)),
f AS (SELECT unit_id, k, s, s AS total, 0 AS chunk FROM o WHERE k = 1
  UNION ALL SELECT o.unit_id, o.k, o.s, CASE WHEN f.total + o.s > 8000 THEN o.s ELSE f.total + o.s END, CASE WHEN f.total + o.s > 8000 THEN f.chunk + 1 ELSE f.chunk END
  FROM f JOIN o ON o.unit_id = f.unit_id AND o.k = f.k + 1)
SELECT unit_id, CAST(chunk AS BIGINT) AS chunk, count(*) AS items, CAST(sum(s) AS BIGINT) AS size FROM f GROUP BY unit_id, chunk
"""


@core.add("w05_budget_chunks", _W05)
def w05_budget_chunks(spark, sf_dir):
    u = read_table(spark, sf_dir, "map_units").select("unit_id", F.posexplode("classes").alias("pos", "c"))
    u = u.select("unit_id", "pos", F.col("c.class_name").alias("class_name"), F.char_length("c.source").alias("s"))
    return R.budget_chunks(u, "unit_id", "pos", "class_name", "s", 8000)


@core.add(
    "w06_layer_merge",
    """
    WITH l AS (SELECT task_id, attempt, id, function_name, status FROM llm_traces WHERE task_id IS NOT NULL AND function_name IS NOT NULL)
    SELECT task_id, function_name, arg_min(attempt, (attempt, id)) AS attempt, arg_min(id, (attempt, id)) AS id, arg_max(status, (attempt, id)) AS status FROM l GROUP BY task_id, function_name
    """,
)
def w06_layer_merge(spark, sf_dir):
    t = _traces(spark, sf_dir).where("task_id is not null and function_name is not null")
    return R.merged_layers(t, "task_id", "function_name", "attempt", "id", "status")


@core.add("u09_first_seen", "SELECT target_file, min(id) AS seq FROM llm_traces GROUP BY target_file")
def u09_first_seen(spark, sf_dir):
    return R.first_seen(_traces(spark, sf_dir), "target_file", "id")


@core.add(
    "u04_fixed_and_broken",
    """
    WITH ok AS (SELECT DISTINCT task_id FROM llm_traces WHERE status = 'ok'), bad AS (SELECT DISTINCT task_id FROM llm_traces WHERE status = 'error')
    SELECT task_id, 'both' AS side FROM (SELECT * FROM ok INTERSECT SELECT * FROM bad)
    UNION ALL SELECT task_id, 'broken' FROM (SELECT * FROM bad EXCEPT SELECT * FROM ok)
    """,
)
def u04_fixed_and_broken(spark, sf_dir):
    t = _traces(spark, sf_dir)
    ok, bad = (t.where(F.col("status") == s).select("task_id") for s in ("ok", "error"))
    return R.in_both(ok, bad).withColumn("side", F.lit("both")).unionByName(R.only_in(bad, ok).withColumn("side", F.lit("broken")))


@core.add(
    "x14_short_time",
    "SELECT id, strftime(make_timestamp(epoch_us(CAST(ts AS TIMESTAMPTZ))), '%m-%d %H:%M:%S') AS at FROM llm_traces",
)
def x14_short_time(spark, sf_dir):
    return _traces(spark, sf_dir).select("id", X.short_time(F.col("ts")).alias("at"))


@core.add(
    "x15_target_label",
    """
    SELECT id, CASE WHEN target_file IS NULL THEN '-' WHEN class_name IS NULL AND function_name IS NULL THEN target_file
      ELSE target_file || '::' || CASE WHEN class_name IS NULL THEN function_name WHEN function_name IS NULL THEN class_name ELSE class_name || '.' || function_name END END AS label FROM llm_traces
    """,
)
def x15_target_label(spark, sf_dir):
    return _traces(spark, sf_dir).select("id", X.target_label(F.col("target_file"), F.col("class_name"), F.col("function_name")).alias("label"))


@core.add(
    "x01_camel_to_snake",
    r"SELECT id, lower(regexp_replace(regexp_replace(class_name, '(.)([A-Z][a-z]+)', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS snake FROM llm_traces WHERE class_name IS NOT NULL",
)
def x01_camel_to_snake(spark, sf_dir):
    return _traces(spark, sf_dir).where("class_name is not null").select("id", X.camel_to_snake(F.col("class_name")).alias("snake"))


@core.add(
    "x12_since",
    "SELECT id FROM llm_traces WHERE epoch_us(CAST(ts AS TIMESTAMPTZ)) >= epoch_us(TIMESTAMPTZ '2031-02-01 00:00:00+00' - INTERVAL 48 HOUR) AND epoch_us(CAST(ts AS TIMESTAMPTZ)) < epoch_us(TIMESTAMPTZ '2031-02-01 00:00:00+00')",
)
def x12_since(spark, sf_dir):
    now = F.lit("2031-02-01 00:00:00").cast("timestamp")
    at = X.as_time(F.col("ts"))
    return _traces(spark, sf_dir).where((at >= X.since(now, F.lit("2d"))) & (at < now)).select("id")
