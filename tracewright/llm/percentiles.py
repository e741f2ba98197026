"""Percentiles per group with bounded error and mergeable state.

The state is a KLL sketch: a hierarchy of compactors, level L holding values of weight
2**L.  A full compactor is sorted and every other value, beginning at a random one of
the first two, moves up a level; two sketches merge level by level.  A rank read from a
sketch of ``n`` values is off by at most ``rank_error(k) * n`` with 99 % probability,
whatever was merged in whatever order.

Spark's own sketch aggregates are used: they stay in the JVM, combine ahead of the
shuffle and send one bounded state (a few times ``k`` values) per group and task, so a
group with a third of all rows costs no more to move than a small one.  The sketches are
plain binary values: store them per day or run and merge later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values kept per compactor level; 8 to 65535.
DEFAULT_K = 1600
#: Reported percentiles.
DEFAULT_POINTS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def rank_error(k: int) -> float:
    """Normalised rank error of one percentile at 99 % confidence (published fit for KLL)."""
    return 2.296 / k**0.9021


def sketch(df: DataFrame, by: list[str], value: str, *, k: int = DEFAULT_K, valid: Column | None = None) -> DataFrame:
    """One row per group of ``by``: ``rows``, ``n`` (values sketched), ``low``, ``high``, ``sketch``.

    Null values are counted in ``rows`` only.  ``valid`` keeps out other values that stand
    for "unknown" (sentinels); zeros and outliers are values like any other.  Nulls in
    ``by`` form a group of their own; a group without any value has ``n`` 0 and a null
    sketch; an empty table gives no row.
    """
    narrow = df.select(*by, F.col(value).cast("bigint").alias("__value"), (F.lit(True) if valid is None else valid).alias("__valid"))
    used = F.when(F.col("__valid"), F.col("__value"))
    return narrow.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(used).alias("n"),
        F.min(used).alias("low"),
        F.max(used).alias("high"),
        F.kll_sketch_agg_bigint(used, k).alias("sketch"),
    ).withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of finer groups (runs, days, partitions) combined to those of ``by``."""
    return sketches.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        F.sum("n").alias("n"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_bigint("sketch").alias("sketch"),
    ).withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def percentiles(sketches: DataFrame, points: tuple[float, ...] = DEFAULT_POINTS, *, k: int = DEFAULT_K) -> DataFrame:
    """The sketch column replaced by ``p50`` .. and the stated ``rank_error``.

    ``rank_error_rows`` is the bound in rows of the group.  Groups of at most ``k`` values
    are exact (nothing has been compacted yet): their stated error is 0.
    """
    kept = [c for c in sketches.columns if c != "sketch"]
    error = F.when(F.col("n") <= k, F.lit(0.0)).otherwise(F.lit(rank_error(k)))
    named = [
        F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(p)))).alias(point_name(p)) for p in points
    ]
    return sketches.select(*kept, *named, error.alias("rank_error"), F.ceil(error * F.col("n")).alias("rank_error_rows"))


def point_name(p: float) -> str:
    """0.5 -> p50, 0.999 -> p99_9."""
    return "p" + f"{p * 100:.4f}".rstrip("0").rstrip(".").replace(".", "_")


def latency_percentiles(traces: DataFrame, *, k: int = DEFAULT_K, points: tuple[float, ...] = DEFAULT_POINTS) -> DataFrame:
    """``latency_ms`` per model and caller in all and per day; negative values are sentinels and left out.

    ``level`` says which: ``all`` (``day`` null) or ``day``.  Both are merged from one set of
    sketches per model, caller and day, the way stored states of single days are combined:
    the trace table is read once.  ``day`` is the UTC day of ``ts``, null where that is no time.
    """
    base = sketch(traces.withColumn("day", F.to_date(_utc(F.col("ts")))), ["model", "caller", "day"], "latency_ms", k=k, valid=F.col("latency_ms") >= 0)
    total = merge(base, ["model", "caller"]).withColumns({"day": F.lit(None).cast("date"), "level": F.lit("all")})
    return percentiles(total.unionByName(base.withColumn("level", F.lit("day"))), points, k=k)


def run_percentiles(traces: DataFrame, *, k: int = DEFAULT_K, points: tuple[float, ...] = DEFAULT_POINTS) -> DataFrame:
    """The same per model, caller and run.  Most runs have a few calls: their state is their values, and the percentiles are exact."""
    return percentiles(sketch(traces, ["model", "caller", "run_id"], "latency_ms", k=k, valid=F.col("latency_ms") >= 0), points, k=k)


def _utc(ts: Column) -> Column:
    """Timestamp of an ISO text with any spelling of its zone, null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(ts), r"([+-]\d{2}):?(\d{2})$", "$1:$2"))
