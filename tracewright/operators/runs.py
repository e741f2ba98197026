"""State of runs as relations: event folds, triage of failures, outcomes, validation of fixes.

Nothing here holds a run in one row: states are aggregates over append-only events, decided
by the last event of a key, so a run of any length combines ahead of the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.relational import predecessor

#: Reason of tasks a scaffold skipped, and of a report of a run without service.
SCAFFOLD_SKIPPED = "scaffold_skipped"
UNREACHABLE = "service_unreachable"
#: Rounds of debugging before a run gives up.
MAX_RETRY = 1


def failure_contexts(failures: DataFrame, tasks: DataFrame, task_failures: DataFrame, blocked: DataFrame) -> DataFrame:
    """(module, origin, failures, gaps): why each module with failures failed, the first rule that applies.

    ``blocked``: the module waits for another; ``module_mismatch``: it has no task at all;
    ``scaffold_gap``: every task of it was skipped by the scaffold; ``root_cause``: else.
    Inputs: failures (``module``), tasks (``id``, ``module``), task_failures (``task_id``, ``reason``),
    blocked (``module``).  Failures without a module are left out; ``gaps`` counts the skipped tasks.
    """
    failing = failures.where(F.col("module").isNotNull()).groupBy("module").agg(F.count(F.lit(1)).alias("failures"))
    skipped = task_failures.where(F.col("reason") == SCAFFOLD_SKIPPED).select(F.col("task_id").alias("id"), F.lit(True).alias("_gap")).distinct()
    own = tasks.select("id", "module").distinct().join(skipped, "id", "left").groupBy("module").agg(F.count(F.lit(1)).alias("_tasks"), F.count("_gap").alias("gaps"))
    out = failing.join(own, "module", "left").join(blocked.select("module", F.lit(True).alias("_blocked")).distinct(), "module", "left")
    origin = (
        F.when(F.col("_blocked"), "blocked").when(F.col("_tasks").isNull(), "module_mismatch").when(F.col("_tasks") == F.col("gaps"), "scaffold_gap").otherwise("root_cause")
    )
    return out.select("module", origin.alias("origin"), "failures", F.coalesce("gaps", F.lit(0)).alias("gaps"))


def modules_to_look_at(reports: DataFrame, failures: DataFrame, failed_before: DataFrame) -> DataFrame:
    """(run_id, module): the modules with failures, or, for a run whose service was not reached, those that failed before."""
    down = reports.where(F.col("reason").eqNullSafe(UNREACHABLE)).select("run_id").distinct()
    now = failures.where(F.col("module").isNotNull()).select("run_id", "module").distinct().join(down, "run_id", "left_anti")
    return now.unionByName(failed_before.select("run_id", "module").distinct().join(down, "run_id", "left_semi"))


def outcome(status: Column, scaffold_done: Column, gave_up_early: Column) -> Column:
    """How a run ended: done, or why it gave up; an unknown scaffold state is no failure of it."""
    return (
        F.when(F.coalesce(status == "pass", F.lit(False)), "done")
        .when(F.coalesce(~scaffold_done, F.lit(False)), "give_up_scaffold_failed")
        .when(F.coalesce(gave_up_early, F.lit(False)), "give_up_early")
        .otherwise("give_up_retry_exhausted")
    )


def gives_up_early(rounds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per round: is there nothing left to fix?

    ``rounds``: the keys, ``origin``, ``analyzed``, ``fixable`` per module.  True when no module has
    origin ``root_cause``, or when all that have are analysed and none is fixable.
    """
    root = F.col("origin") == "root_cause"
    open_ = root & ~(F.coalesce("analyzed", F.lit(False)) & ~F.coalesce("fixable", F.lit(False)))
    return rounds.groupBy(*by).agg((F.count_if(open_) == 0).alias("give_up_early"), F.count_if(root).alias("root_causes"))


def retry_route(status: Column, retries: Column, limit: int = MAX_RETRY) -> Column:
    """What comes after a test: done, give_up or debug."""
    return F.when(F.coalesce(status == "pass", F.lit(False)), "done").when(retries >= limit, "give_up").otherwise("debug")


def module_states(modules: DataFrame, events: DataFrame) -> DataFrame:
    """(module, status): the state the last event of each module leaves it in; without events ``pending``.

    ``events``: ``module``, ``seq``, ``event``: ``task`` (in_progress), ``passed`` (verified), ``failed``
    (failed), ``regression`` (needs_reverify if it was verified, else as it was), ``reopened`` (pending).
    Any other event is an error.
    """
    known = {"task": "in_progress", "passed": "verified", "failed": "failed", "reopened": "pending"}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    named = F.when(F.col("event") == "regression", F.lit(None)).otherwise(F.coalesce(F.try_element_at(table, F.col("event")), F.raise_error(F.concat(F.lit("no such event: "), "event"))))
    states = events.withColumn("_state", named)
    base = states.groupBy("module").agg(
        F.max_by("_state", F.when(F.col("_state").isNotNull(), F.col("seq"))).alias("_last"),
        F.max(F.when(F.col("_state").isNotNull(), F.col("seq"))).alias("_at"),
        F.max(F.when(F.col("event") == "regression", F.col("seq"))).alias("_hit"),
    )
    hit = F.col("_hit").isNotNull() & (F.col("_last") == "verified") & (F.col("_hit") > F.col("_at"))
    status = F.when(F.coalesce(hit, F.lit(False)), "needs_reverify").otherwise(F.coalesce("_last", F.lit("pending")))
    return modules.select("module").distinct().join(base, "module", "left").select("module", status.alias("status"))


def all_done(states: DataFrame) -> DataFrame:
    """One row: is every module verified or failed?  So it is where there is none."""
    return states.agg(F.coalesce(F.bool_and(F.col("status").isin("verified", "failed")), F.lit(True)).alias("all_done"))


def reduced(deltas: DataFrame, key: str, order: str, append: Sequence[str]) -> DataFrame:
    """State from deltas (``key``, ``value``): every value of an append key, the last one of any other."""
    listed = F.col(key).isin(*append)
    last = deltas.where(~listed).groupBy(key).agg(F.max_by(F.struct(order, "value"), order).alias("_r")).select(key, f"_r.{order}", "_r.value")
    return deltas.where(listed).select(key, order, "value").unionByName(last)


def without_progress(events: DataFrame, key: str, order: Sequence[str], at: str, seconds: int, within: Sequence[str], bucket: Column) -> DataFrame:
    """Events before which nothing happened in their group for ``seconds`` and more; ``waited`` says how long."""
    timed = events.withColumn("_at", F.col(at))
    before = predecessor(timed, order, [], "_at", within, bucket)
    waited = F.unix_timestamp("_at") - F.unix_timestamp("previous")
    return before.withColumn("waited", waited).where(F.col("waited") >= seconds).select(key, *within, "waited")


def validated_fixes(fixes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Fixes of known tasks that do something; a new translation overrides a given body.

    ``fixes``: ``task_id``, ``retranslate``, ``fixed_body``, ``file_fixes`` (how many).
    """
    known = fixes.join(tasks.select(F.col("id").alias("task_id")).distinct(), "task_id", "left_semi")
    again = F.coalesce("retranslate", F.lit(False))
    body = F.when(~again & (F.length("fixed_body") > 0), F.col("fixed_body"))
    out = known.withColumns({"retranslate": again, "fixed_body": body})
    return out.where(F.col("retranslate") | F.col("fixed_body").isNotNull() | (F.coalesce("file_fixes", F.lit(0)) > 0))


def matching_any(df: DataFrame, keys: Sequence[str], listed: DataFrame, *, keep: bool = True) -> DataFrame:
    """Rows whose keys are listed (``keep`` false: are not), nulls being equal to nulls."""
    safe = F.struct(F.lit(0).alias("_"), *keys)
    wanted = listed.select(safe.alias("_k")).distinct()
    return df.withColumn("_k", safe).join(wanted, "_k", "left_semi" if keep else "left_anti").drop("_k")


def excluded_overloads(skip: DataFrame, routes: DataFrame) -> DataFrame:
    """(class_name, method, http_method) of the methods behind skipped endpoints (``GET /x``); ``routes``: ``endpoint``, ``method_id`` (file::class::method)."""
    hit = routes.join(skip.select("endpoint").distinct(), "endpoint", "left_semi")
    parts = F.split("method_id", "::")
    return hit.select(parts[1].alias("class_name"), parts[2].alias("method"), F.upper(F.split_part("endpoint", F.lit(" "), F.lit(1))).alias("http_method")).distinct()


def singleton_groups(given: DataFrame, items: DataFrame, by: str) -> DataFrame:
    """Per ``by`` the given groups if they hold exactly its items, each once; else one group per item.

    ``given``: by, ``folder``, ``endpoint``; ``items``: by, ``endpoint`` (distinct).
    """
    counted = given.groupBy(by, "endpoint").agg(F.count(F.lit(1)).alias("_n"))
    both = items.select(by, "endpoint", F.lit(True).alias("_want")).join(counted, [by, "endpoint"], "full_outer")
    good = both.groupBy(by).agg(F.bool_and(F.col("_want").isNotNull() & F.coalesce(F.col("_n") == 1, F.lit(False))).alias("_good"))
    kept = given.join(good.where("_good").select(by), by, "left_semi").select(by, "folder", "endpoint")
    alone = items.join(good.where("_good").select(by), by, "left_anti").select(by, F.col("endpoint").alias("folder"), "endpoint")
    return kept.unionByName(alone)


def regrouped(items: DataFrame, components: DataFrame, singles: DataFrame) -> DataFrame:
    """(rank, folder, endpoint): groups that belong together first, then the single ones.

    ``components``: ``endpoint``, ``component``; a component of one is single.  ``singles``: ``endpoint``, ``folder``.
    """
    size = components.groupBy("component").agg(F.count(F.lit(1)).alias("_n"), F.min("endpoint").alias("folder"))
    together = components.join(size.where("_n > 1"), "component").select(F.lit(0).alias("rank"), "folder", "endpoint")
    rest = items.select("endpoint").distinct().join(together.select("endpoint"), "endpoint", "left_anti")
    alone = rest.join(singles.select("endpoint", "folder"), "endpoint", "left").select(F.lit(1).alias("rank"), F.coalesce("folder", "endpoint").alias("folder"), "endpoint")
    return together.unionByName(alone)
