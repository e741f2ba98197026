"""Joins, aggregations, positional operators, ordering and set operations with fixed tie rules.

Small lookup sides are broadcast by Spark itself when they are below its threshold; no
operator here forces a broadcast of a side whose size is not bounded by its role.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# ---------------------------------------------------------------- joins


def aligned(golden: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every golden row with its actual one, if any; the sides are structs ``golden`` and ``actual``."""
    g = golden.select(*keys, F.struct(*[c for c in golden.columns if c not in keys]).alias("golden"))
    a = actual.select(*keys, F.struct(*[c for c in actual.columns if c not in keys]).alias("actual"))
    return g.join(a, list(keys), "left")


def longest_prefix(df: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """Rows with ``target`` of the equal route, else of the longest route that is a prefix; ties go to the lesser ``seq``.

    ``mapping``: ``route``, ``target``, ``seq``.  Instead of comparing every row with every
    route, a distinct key looks up its own prefixes: as many as there are route lengths,
    which are read from the mapping first (at most the longest route).  The joins are equi
    joins; rows without a match keep a null.
    """
    best = mapping.where("route is not null").groupBy("route").agg(F.min_by("target", "seq").alias("target"))
    lengths = sorted(r[0] for r in best.select(F.char_length("route")).distinct().collect())
    keys = df.select(F.col(key).alias("_key")).where("_key is not null").distinct()
    own = F.filter(F.lit(lengths).cast("array<int>") if lengths else F.array().cast("array<int>"), lambda n: n <= F.char_length("_key"))
    cands = keys.select("_key", F.explode(F.transform(own, lambda n: F.substring(F.col("_key"), F.lit(1), n))).alias("route"))
    hit = cands.join(best, "route").groupBy("_key").agg(F.max_by("target", F.char_length("route")).alias("target"))
    return df.join(hit, F.col(key) == F.col("_key"), "left").drop("_key")


def first_module(df: DataFrame, path: str, mapping: DataFrame) -> DataFrame:
    """``module`` of the equal route, else the first path segment that is not generic, else ``misc``."""
    parts = F.filter(F.split(F.col(path), "/"), lambda s: (s != "") & ~s.isin("api", "v1", "v2"))
    return df.join(mapping.select(F.col("route").alias(path), F.col("module").alias("_m")), path, "left").withColumn("module", F.coalesce("_m", F.get(parts, 0), F.lit("misc"))).drop("_m")


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: the one of the greatest ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def first_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def resolved(df: DataFrame, name: str, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """``resolved``: the value of the primary table, else of the fallback one (both ``name``, ``value``)."""
    return (
        df.join(primary.select(F.col("name").alias(name), F.col("value").alias("_p")), name, "left")
        .join(fallback.select(F.col("name").alias(name), F.col("value").alias("_f")), name, "left")
        .withColumn("resolved", F.coalesce("_p", "_f")).drop("_p", "_f")
    )


def overlay(base: DataFrame, profile: DataFrame, key: str) -> DataFrame:
    """Key-value settings with those of the profile winning."""
    return base.withColumnRenamed("value", "_b").join(profile.withColumnRenamed("value", "_p"), key, "full_outer").select(key, F.coalesce("_p", "_b").alias("value"))


def inverted(df: DataFrame, key: str, items: str) -> DataFrame:
    """(item, key): each distinct key under each list element it holds, one row each, so a common item is no single row."""
    return df.select(F.explode(items).alias("item"), key).distinct()


def by_priority(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """One row per key from the first source that has it; within a source the least value decides."""
    tagged = None
    for prio, s in enumerate(sources):
        one = s.select(key, "value", F.lit(prio).alias("prio"))
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy(key).agg(F.min(F.struct("prio", "value")).alias("_r")).select(key, "_r.value", "_r.prio")


def filled(df: DataFrame, values: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``column`` replaced where ``values`` has the key; a null there replaces nothing."""
    return df.join(values.select(*keys, F.col(column).alias("_v")), list(keys), "left").withColumn(column, F.coalesce("_v", column)).drop("_v")


# ---------------------------------------------------------------- aggregations


def pass_summary(df: DataFrame, by: Sequence[str], passed: Column) -> DataFrame:
    """total, passed, failed, pass_rate (3 places, half-even) and status per group."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(passed).alias("passed"))
    return out.withColumns(
        {
            "failed": F.col("total") - F.col("passed"),
            "pass_rate": F.when(F.col("total") > 0, F.bround(F.col("passed") / F.col("total"), 3)).otherwise(F.lit(0.0)),
            "status": F.when(F.col("total") == F.col("passed"), "pass").otherwise("fail"),
        }
    )


def last_value(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The last value per key, which may be null."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def last_with_retraction(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The last value per key; a last row without a value takes the key out."""
    return last_value(df, key, value, order).where(F.col(value).isNotNull())


def shared_members(df: DataFrame, group: str, member: str, least: int = 2) -> DataFrame:
    """Members of ``least`` and more distinct groups, with how many."""
    return df.groupBy(member).agg(F.countDistinct(group).alias("groups")).where(F.col("groups") >= least)


def majority(df: DataFrame, by: Sequence[str], value: str, favourite: str) -> DataFrame:
    """The commonest value per group; ties: the favourite first, then alphabetical."""
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("votes"))
    key = F.struct((-F.col("votes")).alias("a"), (F.col(value) != favourite).alias("b"), F.col(value).alias("c"))
    return n.groupBy(*by).agg(F.min_by(value, key).alias(value), F.max("votes").alias("votes"))


def grouped_lists(df: DataFrame, by: str, item: str, missing: str = "_none") -> DataFrame:
    """Sorted distinct items per group; rows without group go to ``missing``."""
    return df.groupBy(F.coalesce(F.col(by), F.lit(missing)).alias(by)).agg(F.sort_array(F.collect_set(item)).alias("items"), F.count(F.lit(1)).alias("n"))


def barrier(df: DataFrame, by: Sequence[str], tier: str, terminal: Column) -> DataFrame:
    """``open_tier``: the lowest tier that still has a row that is not terminal, null when all are."""
    return df.groupBy(*by).agg(F.min(F.when(~terminal, F.col(tier))).alias("open_tier"), F.count_if(~terminal).alias("open_rows"))


def complete(df: DataFrame, by: str, terminal: Column) -> DataFrame:
    """``done``: all rows terminal and at least one row."""
    return df.groupBy(by).agg((F.bool_and(terminal) & (F.count(F.lit(1)) > 0)).alias("done"), F.bool_or(~terminal).alias("any_open"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique_or_null(df: DataFrame, by: str, flag: Column, value: str) -> DataFrame:
    """The value of the one flagged row, null when none or several are flagged."""
    return df.groupBy(by).agg(F.when(F.count_if(flag) == 1, F.max(F.when(flag, F.col(value)))).alias(value))


def over_budget(df: DataFrame, by: str, text: str, budget: int) -> DataFrame:
    """UTF-8 bytes per group and whether they exceed the budget."""
    return df.groupBy(by).agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).withColumn("trim", F.col("bytes") > budget)


def with_group(df: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """Each row with aggregates of its group, nulls in the keys being a group.

    An aggregate and a join instead of a window: the aggregate combines ahead of the shuffle,
    and no task holds the rows of a group.
    """
    k = F.struct(F.lit(0).alias("_"), *by)
    agg = df.groupBy(k.alias("_k")).agg(*[a.alias(n) for n, a in aggregates.items()])
    return df.withColumn("_k", k).join(agg, "_k").drop("_k")


def name_tiers(df: DataFrame, name: str, module: str, prefix: str) -> DataFrame:
    """The shortest unique name: bare, with its module, or with its prefix too."""
    counted = with_group(with_group(df, [name], _names=F.count(F.lit(1))), [name, module], _pairs=F.count(F.lit(1)))
    label = F.when(F.col("_names") == 1, F.col(name)).when(F.col("_pairs") == 1, F.concat_ws("_", name, module)).otherwise(F.concat_ws("_", name, module, prefix))
    return counted.withColumn("label", label).drop("_names", "_pairs")


# ---------------------------------------------------------------- positional operators


def position(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], bucket: Column) -> DataFrame:
    """``pos``: the row's number within its group, from 1.

    ``bucket`` must ascend with the order.  Rows are numbered within (group, bucket) and the
    sizes of the lesser buckets are added, so a group with a third of all rows is no single
    task's work; only one row per group and bucket goes through a window of the whole group.
    """
    b = df.withColumns({"_k": F.struct(F.lit(0).alias("_"), *by), "_b": bucket})
    sizes = b.groupBy("_k", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_k", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_k", "_b").orderBy(*order))
    return b.withColumn("_own", own).join(base, ["_k", "_b"]).withColumn("pos", F.col("_base") + F.col("_own")).drop("_k", "_b", "_own", "_base")


def predecessor(df: DataFrame, order: Sequence[str], same: Sequence[str], key: str, parts: Sequence[str], bucket: Column) -> DataFrame:
    """``previous``: the key of the row before in the total order, where it agrees in ``same``, else null.

    Rows that can be neighbours share ``parts`` (the leading columns of the order).  The row
    before is looked for within (parts, bucket); the first row of a bucket takes the last one
    of the bucket before, which a table of one row per bucket holds.
    """
    row = F.struct(F.col(key).alias("key"), *[F.col(c).alias(f"s_{c}") for c in same])
    b = df.withColumns({"_k": F.struct(F.lit(0).alias("_"), *parts), "_b": bucket, "_row": row})
    lasts = b.groupBy("_k", "_b").agg(F.max_by("_row", F.struct(*order)).alias("_last"))
    carried = lasts.select("_k", "_b", F.lag("_last").over(Window.partitionBy("_k").orderBy("_b")).alias("_carried"))
    near = F.lag("_row").over(Window.partitionBy("_k", "_b").orderBy(*order))
    out = b.withColumn("_near", near).join(carried, ["_k", "_b"]).withColumn("_prev", F.coalesce("_near", "_carried"))
    agree = F.col("_prev").isNotNull()
    for c in same:
        agree = agree & F.col(f"_prev.s_{c}").eqNullSafe(F.col(c))
    return out.withColumn("previous", F.when(agree, F.col("_prev.key"))).drop("_k", "_b", "_row", "_near", "_carried", "_prev")


def numbered(df: DataFrame, order: Sequence[Column], prefix: str, bucket: Column) -> DataFrame:
    """``number``: ``<prefix>_%03d`` from zero over the total order; see :func:`position` for ``bucket``."""
    return position(df, [], order, bucket).withColumn("number", F.format_string(f"{prefix}_%03d", F.col("pos") - 1)).drop("pos")


def overload_suffix(df: DataFrame, by: Sequence[str], name: str, order: str, bucket: Column) -> DataFrame:
    """``unique_name``: the first of a name stays bare, the n-th gets ``_n``."""
    n = F.col("pos")
    numbered_rows = position(df, [*by, name], [order], bucket)
    return numbered_rows.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), n.cast("string")))).drop("pos")


def batch_of(df: DataFrame, order: str, total: int, within: Sequence[str], bucket: Column) -> DataFrame:
    """``batch`` 1..total: contiguous slices of ceil(n/total) rows (the last ones may be short or missing)."""
    sized = with_group(position(df, within, [order], bucket), within, _n=F.count(F.lit(1)))
    return sized.withColumn("batch", (F.floor((F.col("pos") - 1) / F.ceil(F.col("_n") / total)) + 1).cast("bigint")).drop("pos", "_n")


def budget_chunks(df: DataFrame, by: str, order: str, item: str, size: str, budget: int) -> DataFrame:
    """(by, chunk, items, size): greedy packing in order; an item larger than the budget is alone.

    One pass over the ordered items of a group, in Arrow batches: where a chunk ends depends
    on where the one before does, so the ids and sizes of one group go through one task, in
    linear time, a batch at a time.
    """
    kind = df.schema[by].dataType.simpleString()
    rows = df.select(F.col(by).alias("g"), F.col(order).alias("o"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("s"), F.col(item).alias("i"))
    # the group's rows meet in one partition, sorted; nothing but the running chunk is held
    sorted_rows = rows.repartition("g").sortWithinPartitions("g", "o", "i").select("g", "s")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        group, chunk, items, total = none, 0, 0, 0
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])

            def close() -> None:
                for column, v in zip(out, (group, chunk, items, total)):
                    column.append(v)

            for g, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if group is none or g != group:
                    if group is not none:
                        close()
                    group, chunk, items, total = g, 0, 0, 0
                elif items and total + s > budget:
                    close()
                    chunk, items, total = chunk + 1, 0, 0
                items, total = items + 1, total + s
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field(0).type), *(pa.array(x, pa.int64()) for x in out[1:])], ["g", "chunk", "items", "size"])
            last_type = b.schema.field(0).type
        if group is not none:
            yield pa.RecordBatch.from_arrays([pa.array([group], last_type), pa.array([chunk], pa.int64()), pa.array([items], pa.int64()), pa.array([total], pa.int64())], ["g", "chunk", "items", "size"])

    return sorted_rows.mapInArrow(pack, f"g {kind}, chunk bigint, items bigint, size bigint").withColumnRenamed("g", by)


def merged_layers(df: DataFrame, by: str, attr: str, layer: str, pos: str, value: str) -> DataFrame:
    """Attributes of a layered list: the place of the first layer that has it, the value of the last."""
    return df.groupBy(by, attr).agg(F.min(F.struct(layer, pos)).alias("first"), F.max_by(value, F.struct(layer, pos)).alias(value)).select(by, attr, F.col(f"first.{layer}").alias(layer), F.col(f"first.{pos}").alias(pos), value)


# ---------------------------------------------------------------- sets


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that are not in b."""
    return a.distinct().subtract(b)


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place they were first seen at."""
    return df.groupBy(value).agg(F.min(order).alias("seq"))


# ---------------------------------------------------------------- selections and lookups


def selected(df: DataFrame, name: str, order: str, wanted: Sequence[str], bucket: Column) -> DataFrame:
    """Rows chosen by 1-based number or by name (case aside), in the order of the request; an unknown token is an error.

    A number wins over an equal name; every row of an equal name is chosen.  The request is the
    caller's list; two equi joins look it up.  See :func:`position` for ``bucket``.
    """
    spark = df.sparkSession
    ask = spark.createDataFrame([(i, w.strip()) for i, w in enumerate(wanted)], "request int, token string")
    places = position(df, [], [order], bucket).withColumn("_token", F.col("pos").cast("string"))
    by_number = F.broadcast(ask).join(places, F.col("token") == F.col("_token")).drop("_token", "pos")
    by_name = F.broadcast(ask).join(df.withColumn("_token", F.lower(name)), F.lower("token") == F.col("_token")).drop("_token")
    hit = by_number.unionByName(by_name.join(by_number.select("request").distinct(), "request", "left_anti"))
    missing = ask.join(hit.select("request").distinct(), "request", "left_anti").select("request", "token")
    error = F.raise_error(F.concat(F.lit("no such item: "), F.col("token")))
    failed = missing.select(F.coalesce(error.cast("int"), "request").alias("request"), "token", *[error.cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return hit.unionByName(failed).drop("token")


def without(df: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not excluded."""
    return df.join(excluded.select(*keys).distinct(), list(keys), "left_anti")


def emptied_kept(groups: DataFrame, members: DataFrame, excluded: DataFrame, by: str, key: str) -> DataFrame:
    """Per group the members left after an exclusion; groups that lose all stay with none."""
    left = members.join(excluded.select(key).distinct(), key, "left_anti").groupBy(by).agg(F.sort_array(F.collect_set(key)).alias("members"))
    return groups.select(by).distinct().join(left, by, "left").withColumn("members", F.coalesce("members", F.array().cast(members.select(F.array(key)).schema[0].dataType)))


def chained(links: DataFrame, producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """Links whose both ends are known and differ: ``producer``, ``consumer`` and their rows' other columns."""
    p = producers.select(F.col("endpoint").alias("producer"), F.struct("*").alias("p"))
    c = consumers.select(F.col("endpoint").alias("consumer"), F.struct("*").alias("c"))
    return links.where("producer <> consumer").join(p, "producer").join(c, "consumer")


def blocked(tasks: DataFrame, needs: DataFrame, failed: DataFrame) -> DataFrame:
    """(id, reasons): the failed needs of each task, sorted."""
    hit = needs.join(failed.select(F.col("id").alias("needs")).distinct(), "needs", "left_semi")
    return tasks.select("id").join(hit, "id").groupBy("id").agg(F.sort_array(F.collect_set("needs")).alias("reasons"))


def failure_origin(df: DataFrame, by: str, blocked_by: Column, own: Column, gaps: Column) -> DataFrame:
    """Per group the first origin that applies: blocked, all failures in the gaps, else its own."""
    return df.groupBy(by).agg(
        F.when(F.bool_or(blocked_by), "blocked").when(F.bool_and(gaps | ~own), "gap").otherwise("own").alias("origin"), F.count_if(own).alias("failures")
    )


def ordered_first(df: DataFrame, by: str, value: str, order: str, preferred: Column) -> DataFrame:
    """The least preferred value per group, else the first listed one."""
    return df.groupBy(by).agg(F.coalesce(F.min(F.when(preferred, F.col(value))), F.min_by(value, order)).alias(value))


def partitioned(c: Column, test) -> Column:
    """The list with the elements that fail the test first, order kept on both sides."""
    return F.concat(F.filter(c, lambda x: ~test(x)), F.filter(c, test))
