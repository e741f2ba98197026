"""Operators on the log of model calls: filters, search, ordering, folding of events.

Insert order is data: "newest" is the largest ``id``.  Times are compared as timestamps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.functions.scalars import as_time
from tracewright.operators.relational import position


#: Ids per bucket of the operators that number rows or look at the row before.
BUCKET_IDS = 100_000


def id_bucket(column: str = "id") -> Column:
    """Ids in ranges; ascends with the insert order."""
    return F.floor(F.col(column) / BUCKET_IDS)


def point(df: DataFrame, trace_id: str) -> DataFrame:
    """Rows of one trace; the literal reaches the scan."""
    return df.where(F.col("trace_id") == trace_id)


def matching(df: DataFrame, *, status: str | None = None, run_id: str | None = None, vendor: str | None = None, tag: str | None = None, since: Column | None = None) -> DataFrame:
    """Conjunction of the filters that are given."""
    for name, value in (("status", status), ("run_id", run_id), ("vendor", vendor), ("issue_tag", tag)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df if since is None else df.where(as_time(F.col("ts")) >= since)


def of_task(df: DataFrame, task_id: str, run_id: str | None = None) -> DataFrame:
    """Calls of a task, numbered in insert order."""
    return position(matching(df.where(F.col("task_id") == task_id), run_id=run_id), ["task_id"], ["id"], id_bucket())


def of_target(df: DataFrame, file: str, cls: str | None, fn: str) -> DataFrame:
    """Calls for one function; a null class matches null only."""
    return df.where((F.col("target_file") == file) & F.col("class_name").eqNullSafe(F.lit(cls)) & (F.col("function_name") == fn))


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens: runs of letters and digits of any script (a Chinese run is one token)."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def with_terms(df: DataFrame, key: str, texts: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """Rows whose texts hold all the terms as tokens (row-local: no token table, no shuffle)."""
    every = tokens(F.concat_ws(" ", *texts))
    return df.where(F.forall(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.array_contains(every, t)))


def token_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key): the inverted index of a text column."""
    return df.select(F.explode(tokens(F.col(text))).alias("token"), F.col(key))


def containing(df: DataFrame, texts: Sequence[str], needle: str) -> DataFrame:
    """Rows one of whose texts holds the literal substring."""
    hit = F.lit(False)
    for t in texts:
        hit = hit | F.coalesce(F.col(t).contains(needle), F.lit(False))
    return df.where(hit)


def search_union(found: DataFrame, also: DataFrame, key: str) -> DataFrame:
    """The first result, then what only the second has; one row per key."""
    extra = also.join(found.select(key), key, "left_anti")
    return found.withColumn("part", F.lit(1)).unionByName(extra.withColumn("part", F.lit(2))).dropDuplicates([key])


def latest_run(df: DataFrame) -> DataFrame:
    """One row: the run of the largest id; null for an empty table."""
    return df.agg(F.max_by("run_id", "id").alias("run_id"))


def newest_first(df: DataFrame, by: str = "id", within: Sequence[str] = ()) -> DataFrame:
    """``pos``: each row's number from the newest, within its group."""
    return position(df, within, [F.desc(by)], -id_bucket(by))


def newest_running(df: DataFrame) -> DataFrame:
    """The running call of the latest time; ties go to the larger id."""
    at = as_time(F.col("ts"))
    best = F.max_by(F.struct("trace_id", "id", "run_id"), F.struct(at.alias("t"), F.col("id"))).alias("r")
    return df.where((F.col("status") == "running") & at.isNotNull()).agg(best, F.max(at).alias("at")).where("r is not null").select("r.*", "at")


def stalled(df: DataFrame, as_of: Column, seconds: int, reported: DataFrame | None = None) -> DataFrame:
    """The newest running call when it is at least ``seconds`` old and not reported before."""
    out = newest_running(df).withColumn("elapsed", F.unix_timestamp(as_of) - F.unix_timestamp("at")).where(F.col("elapsed") >= seconds)
    return out if reported is None else out.join(reported.select("trace_id"), "trace_id", "left_anti")


def fold_events(df: DataFrame) -> DataFrame:
    """Start and finish rows of a trace as one row.

    The first row's ``ts`` stays; everything else is the last row's, whose ``issue_tag``
    and ``note`` never erase earlier ones.
    """
    def last_known(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)

    last = [F.max_by(c, "id").alias(c) for c in ("run_id", "status", "http_code", "latency_ms", "output_tokens")]
    return df.groupBy("trace_id").agg(F.min_by("ts", "id").alias("ts"), *last, last_known("issue_tag"), last_known("note"), F.count(F.lit(1)).alias("events"))


def apply_tags(df: DataFrame, tags: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Rows with tag and note of the newest tag event of their trace.

    A tag outside the domain is an error, and so is one for a trace the log does not have.
    ``tags``: ``trace_id``, ``tag``, ``seq`` and, where notes are set too, ``note``.
    """
    checked = tags.withColumn("tag", F.when(F.col("tag").isin(*allowed) | F.col("tag").isNull(), F.col("tag")).otherwise(F.raise_error(F.concat(F.lit("no such tag: "), "tag"))))
    noted = "note" in tags.columns
    newest = checked.groupBy("trace_id").agg(F.max_by("tag", "seq").alias("new_tag"), *([F.max_by("note", "seq").alias("new_note")] if noted else []))
    known = df.select(F.struct("*").alias("_row"), "trace_id")
    both = known.join(newest.withColumn("_tagged", F.lit(True)), "trace_id", "full_outer")
    there = F.when(F.col("_row").isNotNull(), F.col("_row")).otherwise(F.raise_error(F.concat(F.lit("no such trace: "), "trace_id")))
    out = both.withColumn("_row", there).select("_row.*", "new_tag", *(["new_note"] if noted else []), "_tagged")
    out = out.withColumn("issue_tag", F.coalesce("new_tag", "issue_tag"))
    if noted and "note" in df.columns:
        out = out.withColumn("note", F.when(F.col("_tagged"), F.col("new_note")).otherwise(F.col("note")))
    return out.select(*df.columns)


def spill(df: DataFrame, texts: Sequence[str], threshold: int = 100_000) -> DataFrame:
    """Texts of ``threshold`` UTF-8 bytes or more go elsewhere: the column keeps null and ``<text>_key`` the place."""
    for t in texts:
        big = F.octet_length(t) >= threshold
        df = df.withColumn(f"{t}_key", F.when(big, F.concat(F.col("run_id"), F.lit("/"), F.col("trace_id"), F.lit(".md")))).withColumn(t, F.when(big, F.lit(None)).otherwise(F.col(t)))
    return df


def orphans(files: DataFrame, keys: DataFrame, cutoff: Column) -> DataFrame:
    """Files no row refers to that are older than the cutoff (newer ones are within the grace period)."""
    return files.where(F.col("modified") < cutoff).join(keys.select("key").where("key is not null").distinct(), "key", "left_anti")


def failure_streaks(df: DataFrame, by: Sequence[str], order: str, failed: Column, bucket: Column) -> DataFrame:
    """Consecutive failures: each row's length of the failure run that ends at it (0 after a success).

    ``bucket`` must ascend with the order.  Runs are counted within (group, bucket); a run
    that reaches the beginning of its bucket goes on from the run that ends the buckets
    before, which is carried over a table of one row per group and bucket.
    """
    b = df.withColumns({"_k": F.struct(F.lit(0).alias("_"), *by), "_b": bucket, "failed": failed})
    upto = Window.partitionBy("_k", "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = b.withColumn("_island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(upto))
    run = Window.partitionBy("_k", "_b", "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = b.withColumn("_own", F.sum(F.col("failed").cast("bigint")).over(run))
    # per bucket: the run that ends it, and whether a success stands in it
    ends = b.groupBy("_k", "_b").agg(F.max_by("_own", order).alias("_tail"), F.max((~F.col("failed")).cast("int")).alias("_broken"))
    since = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.withColumn("_island", F.sum("_broken").over(since))
    within = Window.partitionBy("_k", "_island").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.withColumn("_sum", F.sum("_tail").over(within))
    carried = ends.select("_k", "_b", F.coalesce(F.lag("_sum").over(Window.partitionBy("_k").orderBy("_b")), F.lit(0)).alias("_carried"))
    streak = F.when(F.col("failed") & (F.col("_island") == 0), F.col("_own") + F.col("_carried")).otherwise(F.col("_own"))
    return b.join(carried, ["_k", "_b"]).withColumn("streak", streak).drop("_k", "_b", "_island", "_own", "_carried")
