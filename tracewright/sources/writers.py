"""Writers and the merges that precede them.

Parquet and JSON have no upsert: a merge builds the new table, the caller writes it to a
new place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_golden(df: DataFrame, path: str) -> None:
    """One folder per module.  The rows are spread by module and case, so a large module is written by many tasks."""
    df.repartition("module", "case_id").write.mode("overwrite").partitionBy("module").json(path)


def write_reports(df: DataFrame, path: str) -> None:
    """Run reports in folders by day: ``run_id`` begins with ``YYYYMMDD_``."""
    df.withColumn("run_date", F.split_part("run_id", F.lit("_"), F.lit(1))).write.mode("append").partitionBy("run_date").json(path)


def report_text() -> Column:
    """One text per summary row (``run_id``, ``total``, ``passed``, ``failed``, ``pass_rate``, ``status``)."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("run: "), "run_id"),
        F.concat(F.lit("status: "), "status"),
        F.concat(F.lit("cases: "), F.col("total").cast("string"), F.lit(", passed "), F.col("passed").cast("string"), F.lit(", failed "), F.col("failed").cast("string")),
        F.concat(F.lit("pass rate: "), F.format_number(F.col("pass_rate") * 100, 1), F.lit(" %")),
    )


def merged_cases(recordings: Sequence[DataFrame]) -> DataFrame:
    """(case_id, skipped): the cases of several recordings, each once; skipped in any of them is skipped."""
    every = recordings[0]
    for r in recordings[1:]:
        every = every.unionByName(r)
    return every.groupBy("case_id").agg(F.bool_or(F.coalesce("skipped", F.lit(False))).alias("skipped"))


def merged_metadata(recordings: Sequence[DataFrame]) -> DataFrame:
    """Case lists of several recordings as one row: ``recorded_at`` (latest), ``total_cases``, ``cases``, ``skipped``.

    The row is the metadata file of one collection, which lists its cases; see :func:`merged_cases` for any number of them.
    """
    every = recordings[0]
    for r in recordings[1:]:
        every = every.unionByName(r)
    return every.groupBy().agg(
        F.max("recorded_at").alias("recorded_at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("cases")))).alias("cases"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("skipped")))).alias("skipped"),
    ).withColumn("total_cases", F.size("cases"))


def inserted_if_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows, and the new ones whose key is not there yet."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))


def apply_results(entries: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """``last_apply_error`` set or cleared by the results; ``changed`` says where it differs from before."""
    j = entries.join(results.select(key, F.lit(True).alias("_hit"), F.col("error").alias("_error")), key, "left")
    new = F.when(F.col("_hit"), F.col("_error")).otherwise(F.col("last_apply_error"))
    return j.withColumn("changed", ~new.eqNullSafe(F.col("last_apply_error"))).withColumn("last_apply_error", new).drop("_hit", "_error")


def spilled_payloads(traces: DataFrame, threshold: int = 100_000, keep: Sequence[str] = ()) -> DataFrame:
    """(*keep, key, text) of the payload files to write: sections of the texts of ``threshold`` UTF-8 bytes and more."""

    def part(title: str, c: str) -> Column:
        return F.when(F.octet_length(c) >= threshold, F.concat(F.lit(f"## {title}\n\n"), F.col(c), F.lit("\n\n")))

    texts = F.concat_ws("", part("Prompt", "prompt"), part("Response", "response"))
    return traces.select(*keep, F.concat("run_id", F.lit("/"), "trace_id", F.lit(".md")).alias("key"), texts.alias("text")).where("text <> ''")
