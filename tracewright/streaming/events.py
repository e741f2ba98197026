"""Structured Streaming forms of the stateful operators.

State is keyed by trace or run and bounded: a trace is forgotten when its time is up, a window
when the watermark has passed it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewright.functions.scalars import as_time

FOLDED = "trace_id string, run_id string, ts string, status string, latency_ms bigint, issue_tag string, events bigint, outcome string"
_STATE = "run_id string, ts string, status string, latency_ms bigint, issue_tag string, events bigint, last_id bigint, done boolean"


def fold_traces(stream: DataFrame, *, stall_ms: int = 300_000) -> DataFrame:
    """Start and finish events of a trace as one row, emitted when it finishes or stalls.

    The first event's ``ts`` stays, everything else is the last event's by ``id``; a later
    event without a tag does not erase one.  ``outcome``: ``finished``, or ``stalled`` when
    no finishing event came within ``stall_ms`` of processing time (reported once, then
    forgotten; a finish that comes after it is emitted on its own).  A finished trace is
    remembered for as long, so that a start that comes late does not open it again.
    """

    def step(key: tuple, batches: Iterable, state: GroupState) -> Iterator:
        import pandas as pd

        def out(s: tuple, outcome: str):
            return pd.DataFrame([(key[0], *s[:6], outcome)], columns=["trace_id", "run_id", "ts", "status", "latency_ms", "issue_tag", "events", "outcome"]).astype({"latency_ms": "Int64"})

        if state.hasTimedOut:
            if not state.get[7]:
                yield out(state.get, "stalled")
            state.remove()
            return
        s = state.get if state.exists else (None, None, None, None, None, 0, -1, False)
        events = pd.concat(list(batches)).sort_values("id")
        if s[7]:
            return  # finished already
        first, last = events.iloc[0], events.iloc[-1]
        tags = events["issue_tag"].dropna()
        newest = int(last["id"]) >= s[6]
        latency = None if pd.isna(last["latency_ms"]) else int(last["latency_ms"])
        s = (
            last["run_id"] if newest else s[0],
            s[1] if s[5] else first["ts"],
            last["status"] if newest else s[2],
            latency if newest else s[3],
            tags.iloc[-1] if len(tags) else s[4],
            s[5] + len(events),
            max(int(last["id"]), s[6]),
            False,
        )
        if s[2] != "running":
            yield out(s, "finished")
            s = (*s[:7], True)
        state.update(s)
        state.setTimeoutDuration(stall_ms)

    narrow = stream.select("trace_id", "id", "run_id", "ts", "status", "latency_ms", "issue_tag")
    return narrow.groupBy("trace_id").applyInPandasWithState(step, FOLDED, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def call_rates(stream: DataFrame, *, window: str = "1 hour", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Calls, errors and mean latency per event-time window and model; events later than ``late`` are dropped."""
    timed = stream.withColumn("at", as_time(F.col("ts"))).where("at is not null").withWatermark("at", late)
    return timed.groupBy(F.window("at", window, slide), "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("status").isin("error", "timeout")).alias("errors"),
        F.avg("latency_ms").alias("mean_latency"),
    ).select(F.col("window.start").alias("from"), F.col("window.end").alias("to"), "model", "calls", "errors", "mean_latency")


def read_traces(spark, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Trace files as a stream, so many new files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drained(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """All the input there is, run to its end, and the result so far.

    ``complete``: as the last batch left it; ``append``: the rows of all batches, each final when it was
    written.  ``folder`` is a place all executors share; the query's checkpoint and result lie in it,
    so a further call goes on where the last one ended.  A batch that is run again replaces itself.
    """

    def keep(batch: DataFrame, number: int) -> None:
        target = f"{folder}/result" if mode == "complete" else f"{folder}/result/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/result")
