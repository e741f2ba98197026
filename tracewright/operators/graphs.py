"""Reachability, closures, layers and components over edge tables ``(src, dst)``.

One fixpoint helper drives them all: the driver only sees whether a round found anything
new.  Each round's new rows are written to the checkpoint folder, so lineage stays short
and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.session import cut_lineage


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """``start`` plus everything ``step`` adds to the newest rows until a round adds nothing.

    There are as many rounds as the longest way is long; the rows are finite, so it ends.
    """
    frontier = cut_lineage(start.distinct())
    known = frontier
    rounds = 0
    while True:
        fresh = step(frontier).select(*known.columns).dropDuplicates(keys).join(known.select(*keys), keys, "left_anti")
        frontier = cut_lineage(fresh)
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)
        rounds += 1
        if rounds % 4 == 0:
            known = cut_lineage(known)


def clean(edges: DataFrame) -> DataFrame:
    """Distinct edges without nulls."""
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): the seeds and all they reach."""
    e = cut_lineage(clean(edges))
    return fixpoint(seeds.select(F.col(seeds.columns[0]).alias("node")).where("node is not null"), lambda f: f.join(e, f.node == e.src).select(F.col("dst").alias("node")), ["node"])


def distances(edges: DataFrame, seeds: DataFrame, limit: int | None = None) -> DataFrame:
    """(node, depth): fewest steps from a seed, up to ``limit`` steps."""
    e = cut_lineage(clean(edges))

    def step(f: DataFrame) -> DataFrame:
        live = f if limit is None else f.where(F.col("depth") < limit)
        return live.join(e, live.node == e.src).groupBy("dst").agg((F.min("depth") + 1).alias("depth")).withColumnRenamed("dst", "node")

    return fixpoint(seeds.select(F.col(seeds.columns[0]).alias("node"), F.lit(0).alias("depth")).where("node is not null"), step, ["node"])


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) of every path of one step and more; a node reaches itself only on a cycle.

    New pairs are joined with all known ones, so paths double each round.
    """
    known = cut_lineage(clean(edges))
    frontier = known
    while True:
        hop = known.withColumnsRenamed({"src": "via", "dst": "to"})
        back = known.withColumnsRenamed({"src": "from", "dst": "via"})
        ahead = frontier.join(hop, frontier.dst == hop.via).select("src", F.col("to").alias("dst"))
        behind = frontier.join(back, frontier.src == back.via).select(F.col("from").alias("src"), "dst")
        frontier = cut_lineage(ahead.unionByName(behind).distinct().join(known, ["src", "dst"], "left_anti"))
        if frontier.isEmpty():
            return known
        known = cut_lineage(known.unionByName(frontier))


def closure_without_start(edges: DataFrame) -> DataFrame:
    """The closure less the start itself, also on a cycle."""
    return closure(edges).where("src <> dst")


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, component): nodes of cycles with the least node of their component; others are left out.

    Colours forth and back: every node takes the least node that reaches it as its colour, and
    within a colour the least node it reaches; where that is the colour's own node too, both
    reach each other.  Edges between colours and those of found components are dropped, and the
    rest goes round again.  One row per node is all that is stored; no pairs.
    """
    e = cut_lineage(clean(edges))
    loops = e.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    e = cut_lineage(e.where("src <> dst"))
    found = None
    while not (e := _trimmed(e)).isEmpty():
        colour = _least_ancestor(e)
        inner = e.join(colour.withColumnsRenamed({"node": "src", "colour": "a"}), "src").join(colour.withColumnsRenamed({"node": "dst", "colour": "b"}), "dst").where("a = b")
        inner = cut_lineage(inner.select("src", "dst"))
        back = _least_ancestor(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        both = back.withColumnRenamed("colour", "reached").join(colour, "node").where("reached = colour")
        both = cut_lineage(both.select("node", F.col("colour").alias("component")))
        # a colour's own node that nothing comes back to is no cycle
        part = cut_lineage(both.join(both.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component"), "component").select("node", "component"))
        found = part if found is None else found.unionByName(part)
        # the component of a colour's own node is known now, be it a cycle or the node alone
        gone = cut_lineage(part.select("node").unionByName(colour.where("node = colour").select("node")).distinct())
        e = cut_lineage(inner.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    single = loops if found is None else loops.join(found.select("node"), "node", "left_anti")
    return single if found is None else found.unionByName(single)


def _least_ancestor(e: DataFrame) -> DataFrame:
    """(node, colour): the least node that reaches each node, itself included.

    Labels are pulled along the edges and from the label's own label, which doubles the way
    they come each round.
    """
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    colour = cut_lineage(nodes.withColumn("colour", F.col("node")))
    while True:
        low = e.join(colour, e.src == colour.node).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("low"))
        pulled = colour.join(low, "node", "left").select("node", F.least("colour", "low").alias("colour"), F.col("colour").alias("old"))
        jump = pulled.select(F.col("node").alias("colour"), F.col("colour").alias("further"))
        new = cut_lineage(pulled.join(jump, "colour", "left").select("node", F.coalesce("further", "colour").alias("colour"), "old"))
        if new.where("colour <> old").isEmpty():
            return new.select("node", "colour")
        colour = new.select("node", "colour")


def _trimmed(e: DataFrame) -> DataFrame:
    """The edges whose start has an edge into it and whose end has one out of it; the others lie on no cycle."""
    return cut_lineage(
        e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    )


def cycle_edges(edges: DataFrame) -> DataFrame:
    """Edges whose both ends lie on some cycle of two nodes or more; self-loops never count."""
    scc = strongly_connected(edges)
    big = scc.join(scc.groupBy("component").count().where("count > 1").select("component"), "component").select("node")
    e = clean(edges).where("src <> dst")
    return e.join(big.withColumnRenamed("node", "src"), "src", "left_semi").join(big.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node of each connected component, edges read both ways.

    Labels are pulled from the neighbours and from the label's own label, which halves long
    chains each round.
    """
    e = clean(edges)
    both = cut_lineage(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    every = both.select(F.col("src").alias("node"))
    if nodes is not None:
        every = every.unionByName(nodes.select(F.col(nodes.columns[0]).alias("node")).where("node is not null"))
    label = cut_lineage(every.distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(label, both.dst == label.node).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("low"))
        pulled = label.join(near, "node", "left").select("node", F.least("component", "low").alias("component"), F.col("component").alias("old"))
        jump = pulled.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = cut_lineage(pulled.join(jump, "component", "left").select("node", F.coalesce("further", "component").alias("component"), "old"))
        if new.where("component <> old").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")


def waves(depends: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, wave): nodes whose needs are all in earlier waves, level by level.

    ``depends``: ``(node, needs)``.  A need that is no node is an error, and so is a cycle.
    """
    all_nodes = cut_lineage(nodes.select(F.col(nodes.columns[0]).alias("node")).distinct())
    needs = cut_lineage(depends.select("node", "needs").where("needs is not null").distinct())
    unknown = needs.join(all_nodes.withColumnRenamed("node", "needs"), "needs", "left_anti").select("needs").limit(1).collect()
    if unknown:
        raise ValueError(f"unknown dependency: {unknown[0][0]}")
    done = None
    rest = all_nodes
    wave = -1
    while True:
        wave += 1
        blocked = needs.join(rest.withColumnRenamed("node", "needs"), "needs", "left_semi").select("node").distinct()
        ready = cut_lineage(rest.join(blocked, "node", "left_anti").withColumn("wave", F.lit(wave)))
        if ready.isEmpty():
            if rest.isEmpty():
                return done if done is not None else ready
            raise ValueError("the dependencies have a cycle")
        done = ready if done is None else done.unionByName(ready)
        rest = cut_lineage(rest.join(ready.select("node"), "node", "left_anti"))
        if wave % 8 == 7:
            done = cut_lineage(done)


def ready(tasks: DataFrame, needs: DataFrame, done: Column, failed: Column) -> DataFrame:
    """Tasks that may start: not done or failed themselves, and every need done (a failed need blocks)."""
    state = tasks.withColumns({"_done": done, "_over": done | failed})
    open_needs = needs.join(state.where(~F.col("_done")).select(F.col("id").alias("needs")), "needs", "left_semi")
    return state.where(~F.col("_over")).join(open_needs.select("id").distinct(), "id", "left_anti").drop("_done", "_over")


def chain_to_ancestor(parents: DataFrame, start: DataFrame, stop: DataFrame) -> DataFrame:
    """(node, ancestor, depth): the parents of each start in order, up to and without the first stop node."""
    p = cut_lineage(parents.select("child", "parent").where("parent is not null"))
    p = cut_lineage(p.join(stop.select(F.col(stop.columns[0]).alias("parent")), "parent", "left_anti").select("child", "parent"))
    first = start.select(F.col(start.columns[0]).alias("node")).join(p.withColumnRenamed("child", "node"), "node").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    return fixpoint(first.where("node <> ancestor"), lambda f: f.join(p, f.ancestor == p.child).where("parent <> node").select("node", F.col("parent").alias("ancestor"), (F.col("depth") + 1).alias("depth")), ["node", "ancestor"])


def capped_walk(edges: DataFrame, seeds: DataFrame, stop: DataFrame, cap: int = 20) -> DataFrame:
    """(seed, node, depth, stops, kept, truncated): breadth-first walk per seed that does not go on from ``stop`` nodes.

    ``edges``: ``src``, ``dst``, ``seq`` (the order of a node's edges).  A node is visited
    once per seed, at its least depth, in the order of its parent and edge.  Only the first
    ``cap`` visits of a seed are ``kept``; ``truncated`` says whether there were more.
    """
    from pyspark.sql.window import Window

    e = cut_lineage(edges.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("seq").alias("seq")))
    halt = cut_lineage(stop.select(F.col(stop.columns[0]).alias("node")).distinct())
    start = seeds.select(F.col(seeds.columns[0]).alias("seed")).where("seed is not null").distinct()
    frontier = cut_lineage(start.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("way"), F.lit(False).alias("stops")))
    seen = frontier
    while True:
        live = frontier.where(~F.col("stops"))
        nxt = live.join(e, live.node == e.src).select("seed", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("way", F.array(F.col("seq").cast("bigint"))).alias("way"))
        first = nxt.groupBy("seed", "node").agg(F.min(F.struct("depth", "way")).alias("m")).select("seed", "node", "m.depth", "m.way")
        fresh = first.join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        frontier = cut_lineage(fresh.join(halt.withColumn("_h", F.lit(True)), "node", "left").select("seed", "node", "depth", "way", F.coalesce("_h", F.lit(False)).alias("stops")))
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(frontier))
    targets = seen.where("depth > 0")
    w = Window.partitionBy("seed")
    pos = F.row_number().over(w.orderBy("depth", "way", "node"))
    return targets.select("seed", "node", "depth", "stops", (pos <= cap).alias("kept"), (F.count(F.lit(1)).over(w) > cap).alias("truncated"))


def stable_order(items: DataFrame, needs: DataFrame, group: str) -> DataFrame:
    """(group, item, pos): topological order of each group that always takes the least ready ``seq``.

    ``items``: group, ``item``, ``seq``; ``needs``: group, ``item``, ``needs`` (within the group,
    others are ignored).  This is not the order by levels.  A cycle is an error.  Groups are
    gathered one at a time: a group is one folder or module, whose items fit a task.
    """
    import heapq

    kind = items.schema[group].dataType.simpleString()
    item_kind = items.schema["item"].dataType.simpleString()
    left = items.select(F.col(group).alias("g"), "item", "seq")
    right = needs.select(F.col(group).alias("g"), "item", "needs").distinct()

    def order(key, a, b):
        import pandas as pd

        seq = dict(zip(a["item"], a["seq"]))
        waits = {i: 0 for i in seq}
        after: dict = {}
        for i, n in zip(b["item"], b["needs"]):
            if i in seq and n in seq and i != n:
                waits[i] += 1
                after.setdefault(n, []).append(i)
        heap = [(seq[i], i) for i, n in waits.items() if not n]
        heapq.heapify(heap)
        out = []
        while heap:
            _, i = heapq.heappop(heap)
            out.append(i)
            for j in after.get(i, ()):
                waits[j] -= 1
                if not waits[j]:
                    heapq.heappush(heap, (seq[j], j))
        if len(out) < len(seq):
            raise ValueError(f"the needs of {key[0]} have a cycle")
        return pd.DataFrame({"g": [key[0]] * len(out), "item": out, "pos": range(len(out))})

    done = left.groupBy("g").cogroup(right.groupBy("g")).applyInPandas(order, f"g {kind}, item {item_kind}, pos bigint")
    return done.withColumnRenamed("g", group)
