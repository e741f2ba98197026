"""Queries of the nested-record operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import nested
from tracewright.plans import core
from tracewright.session import read_table


@core.add("p3_found")
def p3_found(spark, sf_dir):
    return nested.found_elements(read_table(spark, sf_dir, "collection_readonly_partial"), read_table(spark, sf_dir, "golden"))


@core.add("p3_groups")
def p3_groups(spark, sf_dir):
    g = read_table(spark, sf_dir, "golden").select("golden_id", F.col("response.body").alias("body"))
    return nested.groups(nested.triples(g, "golden_id", "body", at=("data",), expand_text=True))


@core.add("p3_tables")
def p3_tables(spark, sf_dir):
    g = read_table(spark, sf_dir, "golden").select("golden_id", F.col("response.body").alias("body"))
    golden = nested.triples(g, "golden_id", "body", at=("data",), expand_text=True)
    collections = nested.triples(read_table(spark, sf_dir, "collection_readonly_partial"), "col_id", "body")
    return nested.tables(golden.withColumn("source", F.lit("golden")).unionByName(collections.withColumn("source", F.lit("collection"))), "source")


@core.add("p3_table_exam")
def p3_table_exam(spark, sf_dir):
    g = read_table(spark, sf_dir, "golden").select("golden_id", F.col("response.body").alias("body"))
    t = nested.triples(g, "golden_id", "body", at=("data",), expand_text=True)
    return nested.table(t, "data.exam")


@core.add("p3_table_answers")
def p3_table_answers(spark, sf_dir):
    g = read_table(spark, sf_dir, "golden").select("golden_id", F.col("response.body").alias("body"))
    t = nested.triples(g, "golden_id", "body", at=("data",), expand_text=True)
    return nested.table(t, "data.exam[].answers", ["no", "kind", "mark"])
