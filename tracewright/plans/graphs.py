"""Queries of the graph operators, with their SQL.

The graphs stand on the supplier keys: ``dst = src div 2`` has no cycle, ``dst = 7 src mod 100``
has many small ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import graphs as G
from tracewright.plans import core
from tracewright.session import read_table

_ACYCLIC = "e AS (SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier WHERE s_suppkey > 0)"
_CYCLIC = "e AS (SELECT DISTINCT s_suppkey AS src, (s_suppkey * 7) % 100 AS dst FROM supplier)"


def _acyclic(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier").where("s_suppkey > 0")
    return s.select(F.col("s_suppkey").alias("src"), F.expr("s_suppkey div 2").alias("dst"))


def _cyclic(spark, sf_dir):
    return read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * 7) % 100).alias("dst"))


@core.add(
    "g01_reachability",
    f"WITH RECURSIVE {_CYCLIC}, r AS (SELECT s_suppkey AS node FROM supplier WHERE s_suppkey % 10 = 3 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r",
)
def g01_reachability(spark, sf_dir):
    seeds = read_table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 3").select("s_suppkey")
    return G.reachable(_cyclic(spark, sf_dir), seeds)


@core.add(
    "g01_distances",
    f"WITH RECURSIVE {_ACYCLIC}, r AS (SELECT s_suppkey AS node, 0 AS depth FROM supplier WHERE s_suppkey % 10 = 3 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node) SELECT node, min(depth) AS depth FROM r GROUP BY node",
)
def g01_distances(spark, sf_dir):
    seeds = read_table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 3").select("s_suppkey")
    return G.distances(_acyclic(spark, sf_dir), seeds)


_CLOSURE = "c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst)"


@core.add("g02_closure", f"WITH RECURSIVE {_CYCLIC}, {_CLOSURE} SELECT src, dst FROM c")
def g02_closure(spark, sf_dir):
    return G.closure(_cyclic(spark, sf_dir))


@core.add("g03_closure_without_start", f"WITH RECURSIVE {_CYCLIC}, {_CLOSURE} SELECT src, dst FROM c WHERE src <> dst")
def g03_closure_without_start(spark, sf_dir):
    return G.closure_without_start(_cyclic(spark, sf_dir))


@core.add(
    "g05_waves",
    f"""
    WITH RECURSIVE {_ACYCLIC}, d AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS wave UNION SELECT e.src, d.wave + 1 FROM d JOIN e ON e.dst = d.node)
    SELECT node, max(wave) AS wave FROM d GROUP BY node
    """,
)
def g05_waves(spark, sf_dir):
    e = _acyclic(spark, sf_dir)
    return G.waves(e.select(F.col("src").alias("node"), F.col("dst").alias("needs")), read_table(spark, sf_dir, "supplier").select("s_suppkey"))


_SCC = f"WITH RECURSIVE {_CYCLIC}, {_CLOSURE}, s AS (SELECT a.src AS node, min(a.dst) AS component FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)"


@core.add("g06_components_strong", f"{_SCC} SELECT node, component FROM s")
def g06_components_strong(spark, sf_dir):
    return G.strongly_connected(_cyclic(spark, sf_dir))


@core.add(
    "g07_cycle_edges",
    f"{_SCC}, big AS (SELECT node FROM s WHERE component IN (SELECT component FROM s GROUP BY component HAVING count(*) > 1)) SELECT src, dst FROM e WHERE src <> dst AND src IN (SELECT node FROM big) AND dst IN (SELECT node FROM big)",
)
def g07_cycle_edges(spark, sf_dir):
    return G.cycle_edges(_cyclic(spark, sf_dir))


@core.add(
    "g08_components",
    """
    WITH RECURSIVE e AS (SELECT s_suppkey AS src, (s_suppkey + 10) % 100 AS dst FROM supplier), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    r AS (SELECT src AS node, src AS other FROM b UNION SELECT r.node, b.dst FROM r JOIN b ON b.src = r.other) SELECT node, min(other) AS component FROM r GROUP BY node
    """,
)
def g08_components(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier")
    return G.components(s.select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") + 10) % 100).alias("dst")))


@core.add(
    "g12_ancestors",
    f"""
    WITH RECURSIVE {_ACYCLIC}, p AS (SELECT src, dst FROM e WHERE dst >= 4),
    r AS (SELECT src AS node, dst AS ancestor, 1 AS depth FROM p WHERE src % 10 = 9 UNION SELECT r.node, p.dst, depth + 1 FROM r JOIN p ON p.src = r.ancestor) SELECT node, ancestor, depth FROM r
    """,
)
def g12_ancestors(spark, sf_dir):
    e = _acyclic(spark, sf_dir)
    s = read_table(spark, sf_dir, "supplier")
    return G.chain_to_ancestor(e.select(F.col("src").alias("child"), F.col("dst").alias("parent")), s.where("s_suppkey % 10 = 9 and s_suppkey > 0").select("s_suppkey"), s.where("s_suppkey < 4").select("s_suppkey"))


_READY = """
WITH t AS (SELECT p_partkey AS id, p_size % 5 < 3 AS done, p_size % 5 = 3 AS failed FROM part), n AS (SELECT p_partkey AS id, p_partkey // 2 AS needs FROM part WHERE p_partkey > 0)
SELECT id FROM t WHERE NOT done AND NOT failed AND id NOT IN (SELECT n.id FROM n JOIN t d ON d.id = n.needs WHERE NOT d.done)
"""


@core.add("g15_ready_set", _READY)
def g15_ready_set(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    tasks = p.select(F.col("p_partkey").alias("id"), "p_size")
    needs = p.where("p_partkey > 0").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 2").alias("needs"))
    return G.ready(tasks, needs, F.col("p_size") % 5 < 3, F.col("p_size") % 5 == 3).select("id")


@core.add(
    "u02_excluded",
    f"""
    WITH RECURSIVE {_ACYCLIC}, a AS (SELECT s_suppkey AS node FROM supplier WHERE s_suppkey % 10 = 3 UNION SELECT e.dst FROM a JOIN e ON e.src = a.node),
    b AS (SELECT s_suppkey AS node FROM supplier WHERE s_suppkey % 10 = 4 UNION SELECT e.dst FROM b JOIN e ON e.src = b.node) SELECT node FROM a EXCEPT SELECT node FROM b
    """,
)
def u02_excluded(spark, sf_dir):
    s, e = read_table(spark, sf_dir, "supplier"), _acyclic(spark, sf_dir)
    skip, keep = (G.reachable(e, s.where(f"s_suppkey % 10 = {d}").select("s_suppkey")) for d in (3, 4))
    return skip.subtract(keep)
