"""Percentiles, splitting and mixing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import mixing, percentiles, splitting

# ---------------------------------------------------------------- percentiles


def test_rank_error_and_merge_of_days(spark):
    r = random.Random(3)
    rows = [(m, f"d{i % 7}", r.choice([-1, None, 0, int(r.lognormvariate(8, 2))])) for m in ("a", "b") for i in range(20000)]
    df = spark.createDataFrame(rows, "model string, day string, latency_ms bigint")
    k = 400
    days = percentiles.sketch(df, ["model", "day"], "latency_ms", k=k, valid=F.col("latency_ms") >= 0)
    out = percentiles.percentiles(percentiles.merge(days, ["model"]), (0.1, 0.5, 0.99), k=k).collect()
    for row in out:
        v = np.sort([x for m, _, x in rows if m == row.model and x is not None and x >= 0])
        assert (row.n, row.low, row.high, row.rows) == (len(v), v[0], v[-1], 20000)
        for p, got in ((0.1, row.p10), (0.5, row.p50), (0.99, row.p99)):
            lo, hi = np.searchsorted(v, got, "left") / len(v), np.searchsorted(v, got, "right") / len(v)
            assert lo - 1.5 * row.rank_error - 1e-4 <= p <= hi + 1.5 * row.rank_error + 1e-4


def test_small_groups_are_exact_and_empty_ones_null(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", None), (None, 9)], "g string, v bigint")
    got = {r.g: r for r in percentiles.percentiles(percentiles.sketch(df, ["g"], "v"), (0.5,)).collect()}
    assert (got["a"].p50, got["a"].rank_error) == (2, 0.0)
    assert (got["b"].p50, got["b"].n, got["b"].rows) == (None, 0, 1)
    assert got[None].p50 == 9
    assert percentiles.sketch(df.limit(0), ["g"], "v").collect() == []


def test_levels_agree_with_each_other(spark):
    r = random.Random(8)
    rows = [("m", "c", f"r{i % 3}", ("2031-01-01T23:30:00Z", "2031-01-02T07:30:00+08:00", "2031-01-02T00:30:00+0000", "bad", None)[i % 5], r.choice([-1, None, 5, 7, 900])) for i in range(300)]
    df = spark.createDataFrame(rows, "model string, caller string, run_id string, ts string, latency_ms bigint")
    got = percentiles.latency_percentiles(df, points=(0.5,)).collect()
    runs = percentiles.run_percentiles(df, points=(0.5,)).collect()
    want = [("all", None, 300), ("day", "2031-01-01", 120), ("day", "2031-01-02", 60), ("day", None, 120)]
    assert sorted(((x.level, x.day and str(x.day), x.rows) for x in got), key=repr) == sorted(want, key=repr)
    assert sorted((x.run_id, x.rows) for x in runs) == [("r0", 100), ("r1", 100), ("r2", 100)]
    v = sorted(x for *_, x in rows if x is not None and x >= 0)
    total = next(x for x in got if x.level == "all")
    assert total.n == len(v) == sum(x.n for x in runs) == sum(x.n for x in got if x.level == "day")
    assert v[int(len(v) * 0.5) - 1] <= total.p50 <= v[int(len(v) * 0.5) + 1]
    assert percentiles.latency_percentiles(df.limit(0)).collect() == percentiles.run_percentiles(df.limit(0)).collect() == []


# ---------------------------------------------------------------- splitting

CLASS = "array<struct<file_path:string,class_name:string,stereotype:string,annotations:array<string>,methods:array<struct<name:string,return_type:string,has_body:boolean>>,source:string>>"
UNITS = f"unit_id bigint, label string, classes {CLASS}, piece string"


def units(spark, sources):
    rows = [(i, f"u{i}" if i % 2 else None, None if s is None else [(None, "C", None, None, None, x) for x in s], "clash") for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, UNITS)


def java(n, seed=1, eol="\n"):
    r = random.Random(seed)
    body = "".join(f"    void m{i}() {{\n" + "".join(f"        call{r.randrange(99)}();\n" for _ in range(r.randrange(1, 9))) + "    }\n\n" for i in range(n))
    return ("package a;\n\npublic class C {\n" + body + "}\n").replace("\n", eol)


def check_pieces(rows, text, limit, overlap):
    out = ""
    for k, r in enumerate(sorted(rows, key=lambda r: r.piece_no)):
        assert len(r.piece) <= limit and len(r.piece) == r.length
        assert r.overlap == (min(overlap, len(out)) if k else 0)
        assert r.piece[: r.overlap] == (out[-r.overlap :] if r.overlap else "")
        out += r.piece[r.overlap :]
    assert out == text


def test_pieces_tile_the_unit(spark):
    wide = "漢👍é" * 4000
    sources = [[java(300), None, java(20)], [java(150, 2, "\r\n")], ["x" * 30000], [wide], [java(3)], None, [], [None], ["a" * 8000], ["a" * 8001, ""], ["\r\n" * 9000]]
    df = units(spark, sources)
    got = splitting.split_units(df).collect()
    for i, s in enumerate(sources):
        text = "\n".join(x or "" for x in s or [])
        mine = [r for r in got if r.unit_id == i]
        if sum(len(x or "") for x in s or []) > 8000:
            check_pieces(mine, text, 8000, 200)
            assert all(r.label == (f"u{i}" if i % 2 else f"unit{i}") + f"_piece{r.piece_no}" for r in mine)
        else:
            assert mine == []
    found = sorted((r.unit_id, r.class_pos) for r in splitting.oversized(df).collect())
    want = [(i, -1) for i, s in enumerate(sources) if sum(len(x or "") for x in s or []) > 8000]
    want += [(i, k) for i, s in enumerate(sources) for k, x in enumerate(s or []) if len(x or "") > 8000]
    assert found == sorted(want)
    assert splitting.split_units(df.limit(0)).collect() == []


def test_cuts_after_members(spark):
    df = units(spark, [[java(300)]])
    rows = sorted(splitting.split_units(df).collect(), key=lambda r: r.piece_no)
    assert all(r.piece.endswith("    }\n\n") or r.piece.endswith("    }\n") for r in rows[:-1])


def test_small_limits(spark):
    df = spark.createDataFrame([(t,) for t in ("", "ab", "one two three four five", "a\r\nb\r\nc\r\nd\r\n", None)], "t string")
    for r in df.select("t", splitting.split_text(F.col("t"), 8, 2).alias("p")).collect():
        if r.t is None:
            assert r.p is None
            continue
        out = ""
        for p in r.p:
            assert len(p.piece) <= 8 and p.piece[: p.overlap] == out[len(out) - p.overlap :]
            out += p.piece[p.overlap :]
        assert out == r.t


# ---------------------------------------------------------------- mixing


@pytest.fixture(scope="module")
def stock(spark):
    r = random.Random(9)
    rows = [(i, r.choice(["big", "big", "Big ", "small"]) if i % 20 else "rare", r.randrange(0, 200), r.random()) for i in range(4000)]
    rows += [(5000, None, 10, 1.0), (5001, "other", 10, 1.0), (5002, "rare", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, weight double")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark, stock):
    t = targets(spark, [("big", 0.5, 2), ("small", 0.3, 2), ("rare", 0.15, 4), ("absent", 0.05, 9)])
    mixture = mixing.mix(stock, t, seed=3)
    rep = {r.source: r for r in mixing.report(mixture, t).collect()}
    assert rep["absent"].reached_share == 0.0
    for s, share in (("big", 0.5), ("small", 0.3), ("rare", 0.15)):
        assert abs(rep[s].reached_share - share / 0.95) < 0.01
        assert rep[s].most_repeats <= rep[s].max_repeats
    rows = mixture.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    assert {r.source for r in rows} == {"big", "small", "rare"}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(stock, t, seed=3).collect()))


def test_whole_epochs_come_before_the_fraction(spark, stock):
    t = targets(spark, [("rare", 1.0, 3)])
    all_rare = stock.where("source = 'rare' and tokens > 0").agg(F.sum("tokens")).first()[0]
    rows = mixing.mix(stock, t, total_tokens=int(all_rare * 2.5)).collect()
    assert {r.repeats for r in rows} == {2, 3}
    assert len(rows) == stock.where("source = 'rare' and tokens > 0").count()
    assert all_rare * 2.5 - 200 <= sum(r.tokens * r.repeats for r in rows) <= all_rare * 2.5


def test_heavier_documents_come_first(spark):
    df = spark.createDataFrame([(i, "s", 10, 1.0 if i % 2 else 0.05) for i in range(2000)], "doc_id bigint, source string, tokens bigint, weight double")
    rows = mixing.mix(df, targets(spark, [("s", 1.0, 1)]), total_tokens=5000, buckets=64).collect()
    assert len(rows) == 500
    assert sum(r.doc_id % 2 for r in rows) > 420


def test_empty_inputs(spark, stock):
    t = targets(spark, [("big", 1.0, 1)])
    assert mixing.mix(stock.limit(0), t).collect() == []
    assert mixing.mix(stock, t.limit(0)).collect() == []
    assert mixing.report(mixing.mix(stock.limit(0), t), t).first().reached_share == 0.0


def test_source_spellings(spark):
    df = spark.createDataFrame([("Bug_Report ",), ("bug-report",), ("BUG REPORT",), (" ",), (None,)], "s string")
    assert [r[0] for r in df.select(mixing.source_name(F.col("s"))).collect()] == ["bug_report"] * 3 + [None] * 2


def test_mixture_orders_the_straddling_cell_only(spark):
    """Whole cells come without an order; the budget is met to less than one document, each is there once."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(3).alias("tokens"), F.lit(1.0).alias("weight"))
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    got = mixing.mix(docs, targets, total_tokens=1900, buckets=16).collect()
    assert sum(r.tokens * r.repeats for r in got) == 1899 and {r.repeats for r in got} == {1, 2} and len({r.doc_id for r in got}) == len(got) == 400
