"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.plans import Registry
from tracewright.session import read_table

llm = Registry()


@llm.add("p1_found")
def p1_found(spark, sf_dir):
    from tracewright.llm.spans import shared_spans

    return shared_spans(read_table(spark, sf_dir, "llm_traces"), key="id", owner="trace_id", text="prompt", min_chars=200)


@llm.add("p8_ids")
def p8_ids(spark, sf_dir):
    from tracewright.llm.encoding import encode

    return encode(read_table(spark, sf_dir, "documents"), "doc_id", "text")


@llm.add("p4_latency_percentiles")
def p4_latency_percentiles(spark, sf_dir):
    from tracewright.llm.percentiles import latency_percentiles

    return latency_percentiles(read_table(spark, sf_dir, "llm_traces"))


@llm.add("p4_run_percentiles")
def p4_run_percentiles(spark, sf_dir):
    from tracewright.llm.percentiles import run_percentiles

    return run_percentiles(read_table(spark, sf_dir, "llm_traces"))


_P6_SIZES = "list_transform(coalesce(classes, []), lambda c: coalesce(length(c.source), 0))"


@llm.add(
    "p6_found",
    f"""
    WITH s AS (SELECT unit_id, {_P6_SIZES} AS n FROM map_units),
    big AS (SELECT unit_id, n FROM s WHERE coalesce(list_sum(n), 0) > 8000)
    SELECT unit_id, CAST(-1 AS BIGINT) AS class_pos FROM big
    UNION ALL
    SELECT unit_id, pos AS class_pos FROM (SELECT unit_id, unnest(range(len(n))) AS pos, unnest(n) AS one FROM big) WHERE one > 8000
    """,
)
def p6_found(spark, sf_dir):
    from tracewright.llm.splitting import oversized

    return oversized(read_table(spark, sf_dir, "map_units"))


@llm.add("p6_pieces")
def p6_pieces(spark, sf_dir):
    from tracewright.llm.splitting import split_units

    return split_units(read_table(spark, sf_dir, "map_units"))


def _mixture(spark, sf_dir):
    from tracewright.llm.encoding import count_tokens
    from tracewright.llm.mixing import mix, quality
    from tracewright.session import cut_lineage

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text", quality(F.col("text")).alias("weight"))
    # counted once; the mixture reads the counts several times
    sized = cut_lineage(count_tokens(docs, "doc_id", "text", keep=("source", "weight")))
    targets = read_table(spark, sf_dir, "mix_targets")
    return mix(sized, targets), targets


@llm.add("p9_mixture")
def p9_mixture(spark, sf_dir):
    return _mixture(spark, sf_dir)[0]


@llm.add("p9_report")
def p9_report(spark, sf_dir):
    from tracewright.llm.mixing import report

    return report(*_mixture(spark, sf_dir))


@llm.add("p2_found")
def p2_found(spark, sf_dir):
    from tracewright.llm.credentials import found

    return found(read_table(spark, sf_dir, "llm_traces"), read_table(spark, sf_dir, "grading_controller"))


@llm.add("p2_redacted")
def p2_redacted(spark, sf_dir):
    from tracewright.llm.credentials import redacted

    return redacted(read_table(spark, sf_dir, "llm_traces"), read_table(spark, sf_dir, "grading_controller"))


@llm.add("p5_found")
def p5_found(spark, sf_dir):
    from tracewright.llm import truncation

    done = truncation.finished(read_table(spark, sf_dir, "llm_traces"))
    return truncation.flag_truncated(done, "id", "response", source="prompt").where("truncated").select("id")


@llm.add("p5_rates")
def p5_rates(spark, sf_dir):
    from tracewright.llm import truncation

    done = truncation.finished(read_table(spark, sf_dir, "llm_traces")).where("length(trim(response)) > 0").withColumn("chars", F.char_length("response"))
    return truncation.rates(truncation.flag_truncated(done, "id", "response", source="prompt", keep=("caller", "status", "output_tokens", "chars")))


@llm.add("p7_found")
def p7_found(spark, sf_dir):
    from tracewright.llm.pairs import find_defects

    return find_defects(read_table(spark, sf_dir, "llm_traces"))


def _subject_tables(spark, sf_dir):
    return tuple(read_table(spark, sf_dir, t) for t in ("documents", "subject_areas", "subject_examples"))


@llm.add("p10_found")
def p10_found(spark, sf_dir):
    from tracewright.llm import subjects

    return subjects.found(*_subject_tables(spark, sf_dir))


@llm.add("p10_composition")
def p10_composition(spark, sf_dir):
    from tracewright.llm import subjects

    return subjects.composition(*_subject_tables(spark, sf_dir))
