"""Mixing sources to target shares of the total size.

Each source has a token budget; a source smaller than its budget is repeated whole
(complete epochs), up to its cap, and the rest of the budget is filled with a weighted
random sample of its documents.

Sampling is Efraimidis-Spirakis: the key of a document is an exponential variate divided
by its quality weight, the documents of a source are taken in ascending order of key
until their tokens fill the budget.  The variates come from a hash of the document id
and a seed, so a lost task recomputes the same sample.

The prefix sum over a source must not become one task's work: keys are mapped by their
distribution function to ``BUCKETS`` cells per source, the tokens of the cells are summed
(a table of sources x cells), a window adds them up, and only the documents of the cell in
which the budget runs out are ordered one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cells of the key range per source; the one that straddles the budget is sorted.
BUCKETS = 4096


def source_name(c: Column) -> Column:
    """Spelling variants of one source share a name: case, outer blanks, blanks and hyphens."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_]+", "_")
    return F.when(s != "", s)


def quality(text: Column) -> Column:
    """Weight 0.25 to 1: the share of letters among the visible characters, for documents without prose.

    Null and blank texts weigh 0.25 (they have no tokens to give anyway).
    """
    visible = F.regexp_replace(text, r"\s+", "")
    letters = F.regexp_replace(visible, r"\P{L}+", "")
    share = F.when(F.char_length(visible) > 0, F.char_length(letters) / F.char_length(visible))
    return F.lit(0.25) + F.lit(0.75) * F.coalesce(share, F.lit(0.0))


def uniform(key: Column, seed: int) -> Column:
    """In (0, 1), fixed by key and seed."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 12).cast("double") + 0.5) / F.lit(float(1 << 52))


def plan_budgets(stock: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target source: ``tokens`` in stock, ``budget``, ``epochs``, ``rest``.

    ``stock``: ``source``, ``docs``, ``tokens``.  Sources without any token cannot
    contribute; the shares of the others are scaled up to 1.  Without ``total_tokens`` the
    mixture is the largest in which every source keeps its share within its cap.  With a
    larger total the capped sources fall short, and the report shows it.
    """
    t = targets.select(
        source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).cast("bigint").alias("max_repeats")
    ).where(F.col("source").isNotNull() & (F.col("target_share") > 0))
    t = t.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    # as many rows as there are targets: a window over all of them is small by nature
    everything = Window.partitionBy(F.lit(0))
    b = t.join(stock, "source", "left").withColumns({"docs": F.coalesce("docs", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0))})
    capacity = F.col("tokens") * F.col("max_repeats")
    b = b.withColumn("share", F.when(capacity > 0, F.col("target_share")) / F.sum(F.when(capacity > 0, F.col("target_share"))).over(everything))
    total = F.lit(total_tokens).cast("double") if total_tokens is not None else F.min(capacity / F.col("share")).over(everything)
    b = b.withColumn("total", F.floor(total))
    budget = F.coalesce(F.least(F.floor(F.col("share") * F.col("total")), capacity), F.lit(0))
    b = b.withColumn("budget", budget)
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0))
    return b.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))


def mix(docs: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: int = 17, buckets: int = BUCKETS) -> DataFrame:
    """(``doc_id``, ``source``, ``tokens``, ``repeats``) of every document in the mixture.

    ``docs``: ``doc_id``, ``source``, ``tokens``, ``weight``.  ``repeats`` is the number of
    epochs plus one for the documents of the fractional selection, which takes whole
    documents in key order while they fit; the document at the end is left out, so a
    source misses its budget by less than one document.  Documents without tokens, without
    source or of a source without target are not in it.  Null or non-positive weights count
    as the smallest weight.
    """
    d = docs.select(
        "doc_id",
        source_name(F.col("source")).alias("source"),
        F.coalesce(F.col("tokens"), F.lit(0)).cast("bigint").alias("tokens"),
        F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(1e-6)).alias("w"),
    ).where((F.col("tokens") > 0) & F.col("source").isNotNull())
    stock = d.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"), F.max("w").alias("max_w"))
    plan = plan_budgets(stock, targets, total_tokens).where(F.col("budget") > 0).select("source", "epochs", "rest", "max_w")
    keyed = d.join(F.broadcast(plan), "source")  # as many rows as mix targets
    # weights count relative to the source's largest, so the cells fill evenly at any scale of weights
    key = -F.log(uniform(F.col("doc_id"), seed)) * F.col("max_w") / F.col("w")
    keyed = keyed.withColumn("k", key).withColumn("cell", F.floor((1 - F.exp(-F.col("k"))) * buckets).cast("int"))
    cells = keyed.groupBy("source", "cell").agg(F.sum("tokens").alias("cell_tokens"))
    run = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("cell_tokens").over(run)
    cells = cells.withColumn("upto", upto).join(F.broadcast(plan.select("source", "rest")), "source")
    before = F.col("upto") - F.col("cell_tokens")
    # 1: the whole cell is taken, 0: none of it, null: the budget runs out in it (one cell per source at most)
    cells = cells.select("source", "cell", before.alias("before"), F.when(F.col("upto") <= F.col("rest"), 1).when(before >= F.col("rest"), 0).alias("more"))
    placed = keyed.join(F.broadcast(cells), ["source", "cell"])  # at most targets x buckets rows
    whole = placed.where(F.col("more").isNotNull()).select("doc_id", "source", "tokens", (F.col("epochs") + F.col("more")).alias("repeats"))
    inside = Window.partitionBy("source").orderBy("k", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = F.col("before") + F.sum("tokens").over(inside) <= F.col("rest")
    edge = placed.where(F.col("more").isNull()).select("doc_id", "source", "tokens", (F.col("epochs") + taken.cast("int")).alias("repeats"))
    return whole.unionByName(edge).withColumn("repeats", F.col("repeats").cast("bigint")).where("repeats > 0")


def report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target and reached share, documents, tokens and the highest repeat.

    A target without documents is reported with share 0.
    """
    got = mixture.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats")
    )
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    out = t.join(got, "source", "left").na.fill(0, ["docs", "mixed_tokens", "most_repeats"])
    total = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))
    return out.withColumn("reached_share", F.when(total > 0, F.col("mixed_tokens") / total).otherwise(F.lit(0.0)))
