import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracewright.functions import scalars as X
from tracewright.operators import diffing as D
from tracewright.operators import graphs as G
from tracewright.operators import relational as R
from tracewright.operators import sourcecode as J
from tracewright.operators import traces as T


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first().r


# ---------------------------------------------------------------- scalars


@pytest.mark.parametrize("c,want", [("getHTTPCode", "get_http_code"), ("aB", "a_b"), ("Plain", "plain"), ("already_snake", "already_snake"), ("", ""), (None, None)])
def test_camel_to_snake(spark, c, want):
    assert one(spark, X.camel_to_snake(F.col("c")), c=c) == want


def test_paths_and_names(spark):
    assert one(spark, X.path_key_of_url(F.col("p")), p=["api", "12", "0b9fd6f2-7c1e-4b0a-9a55-0d6d6f8e2c11", "x"]) == "api_{id}_{id}_x"
    assert one(spark, X.path_key_of_template(F.col("p")), p="/a/{x}/b/") == "a_{id}_b_"
    assert one(spark, X.case_id(F.lit("Prüf 一"), F.lit("GET"), F.lit("/a/b")), p="") == "prüf_一_GET_a_b"
    assert one(spark, X.resource_name(F.col("p")), p="/api/v1/users/{id}") == "users"
    assert one(spark, X.resource_name(F.col("p")), p="/api/{id}") == ""
    assert one(spark, X.identifier(F.col("p")), p="9a-b") == "_9a_b"
    assert one(spark, X.slug(F.col("p")), p="--a  b--") == "a_b"
    assert one(spark, X.bean_name(F.lit("FooBar"), F.lit(None).cast("string")), p="") == "fooBar"
    assert one(spark, X.target_label(F.lit("f"), F.lit(None).cast("string"), F.lit("g")), p="") == "f::g"


def test_times(spark):
    now = F.lit("2031-01-02 00:00:00").cast("timestamp")
    assert str(one(spark, X.since(now, F.lit("25h")), p="")) == "2030-12-31 23:00:00"
    with pytest.raises(PySparkException):
        one(spark, X.since(now, F.col("p")), p="3w")
    for ts in ("2031-01-01T08:00:00+08:00", "2031-01-01T00:00:00Z", "2031-01-01T00:00:00.000000+0000"):
        assert one(spark, X.short_time(F.col("t")), t=ts) == "01-01 00:00:00"
    assert one(spark, X.short_time(F.col("t")), t="soon") == "soon"


def test_text_cuts(spark):
    md = "# x\n\n## Prompt\n\na\nb\n\n## Response\n\nc\n"
    assert one(spark, X.section(F.col("t"), "Prompt"), t=md) == "a\nb"
    assert one(spark, X.section(F.col("t"), "Response"), t=md) == "c"
    assert one(spark, X.section(F.col("t"), "Other"), t=md) is None
    assert one(spark, X.between(F.col("t"), "<a>", "</a>"), t="x<a>1\n2</a>y") == "1\n2"
    assert one(spark, X.keyword_hit(F.col("t"), "id"), t="paid") is False and one(spark, X.keyword_hit(F.col("t"), "id"), t="my id") is True
    assert one(spark, X.jdbc_host(F.col("t")), t="jdbc:postgresql://u:p@db.x:5/z") == "db.x"
    assert one(spark, X.jdbc_port(F.col("t"), 5432), t="jdbc:postgresql://db.x/z") == 5432
    assert one(spark, X.decoded_body(F.array(*[F.lit(b) for b in "é{}".encode()])), t="") == "é{}"


def test_json_get(spark):
    doc = json.dumps({"a": {"b": None, "c": 3}})
    assert one(spark, X.json_get(F.col("d"), "a.c"), d=doc) == "3"
    assert one(spark, X.json_get(F.col("d"), "a.b"), d=doc) is None
    assert one(spark, X.json_has(F.col("d"), "a.x"), d=doc) is False
    with pytest.raises(PySparkException):
        one(spark, X.json_get(F.col("d"), "a.x"), d=doc)


def test_map_type():
    assert X.map_type("Map<String, List<Optional<Integer>>>") == "dict[str, list[int | None]]"
    assert X.map_type("Foo<Bar, long>") == "Foo[Bar, int]" and X.map_type("byte[]") == "bytes" and X.map_type(None) is None
    with pytest.raises(ValueError):
        X.map_type("Map<String>")


def test_map_type_of_generics():
    # functional interfaces by their number of arguments, framework types without theirs, unknown generics with mapped ones
    cases = {
        "Supplier<String>": "Callable[[], str]", "Consumer<Integer>": "Callable[[int], None]", "Function<String, Integer>": "Callable[[str], int]", "BiFunction<A, B, Long>": "Callable[[A, B], int]", "Predicate<Foo>": "Callable[[Foo], bool]",
        "Function<String>": "Function[str]", "Specification<ExamEntity>": "ColumnElement | None", "ResponseEntity<List<Foo>>": "Response", "ResponseResult<List<Long>>": "ResponseResult[list[int]]", "HashMap<String, Integer>": "HashMap[str, int]",
        "Page<Foo>": "Page[Foo]", "Stream<int>": "Stream[int]", "Object": "Object", "Set<UUID>": "list[UUID]", "Short": "int", " Optional<BigDecimal> ": "Decimal | None",
    }
    assert {t: X.map_type(t) for t in cases} == cases


def test_simple_type_is_map_type_without_recursion(spark):
    types = ["int", "List<Long>", "Optional<Foo>", "Foo", " UUID ", "byte[]", "Set<String>"]
    df = spark.createDataFrame([(t,) for t in [*types, "List<List<int>>", "Map<String, int>"]], "t string")
    got = {r.t: r.p for r in df.select("t", X.simple_type(F.col("t")).alias("p")).collect()}
    assert {t: got[t] for t in types} == {t: X.map_type(t) for t in types} and got["List<List<int>>"] is None and got["Map<String, int>"] is None


# ---------------------------------------------------------------- relational


def test_longest_prefix(spark):
    m = spark.createDataFrame([("/a", "one", 1), ("/a/b", "two", 2), ("/a/b", "late", 9), (None, "x", 3)], "route string, target string, seq bigint")
    d = spark.createDataFrame([(1, "/a/b/c"), (2, "/ax"), (3, "/z"), (4, None), (5, "/a/b")], "id bigint, p string")
    assert rows(R.longest_prefix(d, "p", m).select("id", "target")) == [(1, "two"), (2, "one"), (3, None), (4, None), (5, "two")]
    assert rows(R.longest_prefix(d, "p", m.limit(0)).select("target").distinct()) == [(None,)]


def test_majority_ties(spark):
    d = spark.createDataFrame([(1, "b"), (1, "a"), (2, "Integer"), (2, "a"), (3, None)], "g bigint, v string")
    assert rows(R.majority(d, ["g"], "v", "Integer")) == [(1, "a", 1), (2, "Integer", 1)]


def test_pass_rate_is_half_even(spark):
    d = spark.createDataFrame([("m", i == 0) for i in range(16)], "m string, ok boolean")
    r = R.pass_summary(d, ["m"], F.col("ok")).first()
    assert (r.total, r.passed, r.failed, r.pass_rate, r.status) == (16, 1, 15, 0.062, "fail")


def test_budget_chunks(spark):
    d = spark.createDataFrame([("a", 0, "x", 5), ("a", 1, "y", 20), ("a", 2, "z", 0), ("a", 3, "w", 5), ("b", 0, "v", None)], "g string, o int, i string, s int")
    assert rows(R.budget_chunks(d, "g", "o", "i", "s", 10)) == [("a", 0, 1, 5), ("a", 1, 1, 20), ("a", 2, 2, 5), ("b", 0, 1, 0)]
    assert rows(R.budget_chunks(d.limit(0), "g", "o", "i", "s", 10)) == []


def test_retraction_and_layers(spark):
    d = spark.createDataFrame([(1, "x", 1), (1, None, 2), (2, None, 1), (2, "y", 2)], "k bigint, v string, seq bigint")
    assert rows(R.last_with_retraction(d, "k", "v", "seq")) == [(2, "y")]
    layers = spark.createDataFrame([("t", "a", 0, 3, "old"), ("t", "a", 1, 0, "new")], "t string, attr string, layer int, pos int, v string")
    assert rows(R.merged_layers(layers, "t", "attr", "layer", "pos", "v")) == [("t", "a", 0, 3, "new")]


def test_numbering_over_buckets(spark):
    d = spark.range(95).withColumn("id", F.col("id") * 3)
    got = {r.id: r.number for r in R.numbered(d, [F.col("id")], "task", F.floor(F.col("id") / 40)).collect()}
    assert got == {i * 3: f"task_{i:03d}" for i in range(95)}


# ---------------------------------------------------------------- traces


def test_fold_keeps_first_time_and_last_tag(spark):
    d = spark.createDataFrame([("t", 1, "r", "10", "running", None, None, None, "bad", None), ("t", 2, "r", "20", "ok", 200, 5, 7, None, "n")], "trace_id string, id bigint, run_id string, ts string, status string, http_code int, latency_ms bigint, output_tokens bigint, issue_tag string, note string")
    r = T.fold_events(d).first()
    assert (r.ts, r.status, r.issue_tag, r.note, r.events) == ("10", "ok", "bad", "n", 2)


def test_tags_outside_the_domain_fail(spark):
    d = spark.createDataFrame([("t", None)], "trace_id string, issue_tag string")
    with pytest.raises(PySparkException):
        T.apply_tags(d, spark.createDataFrame([("t", "odd", 1)], "trace_id string, tag string, seq bigint"), ("refused",)).collect()
    with pytest.raises(PySparkException):  # a trace the log does not have
        T.apply_tags(d, spark.createDataFrame([("u", "refused", 1)], "trace_id string, tag string, seq bigint"), ("refused",)).collect()
    noted = spark.createDataFrame([("t", None, "old"), ("v", None, "kept")], "trace_id string, issue_tag string, note string")
    tags = spark.createDataFrame([("t", "refused", None, 1)], "trace_id string, tag string, note string, seq bigint")
    assert rows(T.apply_tags(noted, tags, ("refused",))) == [("t", "refused", None), ("v", None, "kept")]


def test_stalled_reports_once(spark):
    d = spark.createDataFrame([("a", 1, "r", "2031-01-01T00:00:00Z", "running"), ("b", 2, "r", "2031-01-01T00:01:00Z", "running"), ("c", 3, "r", "bad", "running")], "trace_id string, id bigint, run_id string, ts string, status string")
    now = F.lit("2031-01-01 00:06:00").cast("timestamp")
    assert [(r.trace_id, r.elapsed) for r in T.stalled(d, now, 300).collect()] == [("b", 300)]
    assert T.stalled(d, now, 300, spark.createDataFrame([("b",)], "trace_id string")).collect() == []
    assert T.stalled(d.limit(0), now, 300).collect() == []


def test_streaks(spark):
    d = spark.createDataFrame([("r", i, s) for i, s in enumerate("FFOFOFFF")], "run string, id bigint, s string")
    for size in (1, 2, 3, 100):
        got = T.failure_streaks(d, ["run"], "id", F.col("s") == "F", F.floor(F.col("id") / size)).orderBy("id").collect()
        assert [r.streak for r in got] == [1, 2, 0, 1, 0, 1, 2, 3]


def test_buckets_do_not_change_positions_or_predecessors(spark):
    d = spark.createDataFrame([(i, f"k{i}", None if i % 7 == 0 else f"g{i % 2}", i % 3) for i in range(40)], "id bigint, k string, g string, m int")
    want_pos, want_prev, last, count = {}, {}, {}, {}
    for i in range(40):
        g, m = (None if i % 7 == 0 else f"g{i % 2}"), i % 3
        count[g] = count.get(g, 0) + 1
        want_pos[i] = count[g]
        want_prev[i] = last[g][0] if g in last and last[g][1] == m else None
        last[g] = (f"k{i}", m)
    for size in (1, 6, 1000):
        bucket = F.floor(F.col("id") / size)
        assert {r.id: r.pos for r in R.position(d, ["g"], ["id"], bucket).collect()} == want_pos
        assert {r.id: r.previous for r in R.predecessor(d, ["id"], ["m"], "k", ["g"], bucket).collect()} == want_prev


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="Foo-bar 一二 foo, é9") == ["foo", "bar", "一二", "é9"]


# ---------------------------------------------------------------- graphs


def edges(spark, pairs, kind="string"):
    return spark.createDataFrame(pairs, f"src {kind}, dst {kind}")


def test_cycles_self_loops_and_nulls(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("e", None), ("a", "b")])
    assert rows(G.reachable(e, spark.createDataFrame([("b",), (None,)], "n string"))) == [("a",), ("b",), ("c",), ("d",)]
    assert ("a", "a") in rows(G.closure(e)) and ("a", "a") not in rows(G.closure_without_start(e))
    assert rows(G.strongly_connected(e)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")]
    assert rows(G.cycle_edges(e)) == [("a", "b"), ("b", "c"), ("c", "a")]
    assert rows(G.components(e, spark.createDataFrame([("z",)], "n string"))) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("z", "z")]


def test_long_chain(spark):
    e = edges(spark, [(i, i + 1) for i in range(40)], "bigint")
    assert {r.component for r in G.components(e).collect()} == {0}
    assert G.distances(e, spark.createDataFrame([(0,)], "n bigint")).agg(F.max("depth")).first()[0] == 40
    assert rows(G.distances(e, spark.createDataFrame([(0,)], "n bigint"), 2)) == [(0, 0), (1, 1), (2, 2)]


def test_strong_components_against_the_closure(spark):
    import random

    r = random.Random(6)
    for n, m in ((12, 18), (30, 45), (40, 40)):
        pairs = {(r.randrange(n), r.randrange(n)) for _ in range(m)}
        reach = {a: {b for x, b in pairs if x == a} for a in range(n)}
        for _ in range(n):
            reach = {a: t | {c for b in t for c in reach[b]} for a, t in reach.items()}
        want = sorted((a, min(b for b in reach[a] if a in reach[b])) for a in range(n) if a in reach[a])
        e = spark.createDataFrame(sorted(pairs), "src int, dst int")
        assert rows(G.strongly_connected(e)) == sorted(want, key=repr)
    assert rows(G.strongly_connected(e.limit(0))) == []


def test_waves_and_their_errors(spark):
    n = spark.createDataFrame([(x,) for x in "abcd"], "n string")
    need = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", None)], "node string, needs string")
    assert rows(G.waves(need, n)) == [("a", 0), ("b", 1), ("c", 2), ("d", 0)]
    with pytest.raises(ValueError, match="unknown"):
        G.waves(spark.createDataFrame([("a", "x")], "node string, needs string"), n)
    with pytest.raises(ValueError, match="cycle"):
        G.waves(spark.createDataFrame([("a", "b"), ("b", "a")], "node string, needs string"), n)


def test_ready_set_a_failed_need_blocks(spark):
    t = spark.createDataFrame([(1, "done"), (2, "open"), (3, "failed"), (4, "open"), (5, "open")], "id bigint, s string")
    need = spark.createDataFrame([(2, 1), (4, 3), (5, 2)], "id bigint, needs bigint")
    assert rows(G.ready(t, need, F.col("s") == "done", F.col("s") == "failed").select("id")) == [(2,)]


# ---------------------------------------------------------------- diffing


def diff(spark, g, a, **kw):
    d = spark.createDataFrame([("k", g, a, 1)], "case_key string, golden_body string, actual_body string, body_class int")
    r = D.diff_bodies(d, **kw).first()
    return r.body_class, [(x.kind, x.way) for x in r.diffs]


@pytest.mark.parametrize(
    "g,a,kind",
    [
        (None, None, "equal"),
        ("{}", None, "body_presence_mismatch"),
        ('{"a": 1, "token": "x"}', '{"token": "y", "a": 1}', "equal"),
        ('{"a": [1, 2]}', '{"a": [2, 1]}', "array_order_only"),
        ('{"a": 1}', '{"b": 1}', "missing_fields"),
        ('{"a": 1}', '{"a": "1"}', "type_mismatch"),
        ('{"a": 1}', '{"a": true}', "type_mismatch"),
        ('{"a": 1}', '{"a": 2}', "value_mismatch"),
        ("text", "other", "value_mismatch"),
    ],
)
def test_body_classes(spark, g, a, kind):
    assert diff(spark, g, a)[0] == kind


def test_ignored_order_and_its_check(spark):
    assert diff(spark, '{"a": [1, 2], "b": 1}', '{"a": [2, 1], "b": 1}', ignore_order=["root['a']"])[0] == "equal"
    assert diff(spark, '{"a": [1, 2], "b": 1}', '{"a": [2, 1], "b": 2}', ignore_order=["root['a']"]) == ("value_mismatch", [("value_change", "root['b']")])
    with pytest.raises(ValueError):
        diff(spark, "{}", "{}", ignore_order=["a.b"])


def test_masks():
    read, change = D.Masker("readonly"), D.Masker("mutation")
    assert read.document({"token": "abc", "name": "王小明"}) == {"token": D.MASK, "name": "王小明"}
    assert read.document({"id": 1, "order_id": 2, "randomId": "xMpIV"}) == {"id": 1, "order_id": 2, "randomId": "xMpIV"}
    assert change.document({"id": 1, "order_id": 2, "user_id": 3}) == dict.fromkeys(("id", "order_id", "user_id"), D.MASK)
    assert change.document({"exam": [{"randomId": "xMpIV", "name": "a"}, {"randomId": None}]}) == {"exam": [{"randomId": D.MASK, "name": "a"}, {"randomId": D.MASK}]}
    assert read.document({"x": "2026-08-25T01:43:10.673670Z"}) == {"x": D.MASK}
    assert read.document({"items": [{"token": "a"}, {"token": {"b": 1}}]}) == {"items": [{"token": D.MASK}, {"token": D.MASK}]}
    assert read.document(["Bearer abc", "Bearer", "0a1b2c3d-0a1b-0a1b", "see 2026-08-25T01:43:10"]) == [D.MASK, "Bearer", D.MASK, "see 2026-08-25T01:43:10"]


def test_mask_of_a_part():
    said = "上傳成功: C:\\voice\\2025\\macuhau\\TAA\\xMpIV\\1_1.wav"
    assert D.Masker("mutation").document({"data": said}) == {"data": f"上傳成功: C:\\voice\\2025\\macuhau\\TAA\\{D.MASK}\\1_1.wav"}
    assert D.Masker("readonly").document({"data": said}) == {"data": said}
    assert D.Masker("mutation").document({"data": "操作成功"}) == {"data": "操作成功"}


def test_rules_from_a_table(spark):
    table = spark.createDataFrame([("field", "secret", 1), ("pattern", "^x", 2), ("mutation_part", r"\d+$", 3), ("field", None, 4)], "kind string, rule string, seq int")
    rules = D.load_rules(table)
    assert rules == D.MaskRules(("secret",), (), ("^x",), (r"\d+$",))
    assert D.Masker("mutation", rules).document({"secret": 1, "id": 2, "a": "xyz", "b": "no 12"}) == {"secret": D.MASK, "id": 2, "a": D.MASK, "b": f"no {D.MASK}"}
    with pytest.raises(ValueError):
        D.load_rules(spark.createDataFrame([("odd", "x", 1)], table.schema))
    assert D.load_rules(table.where("false")) == D.MaskRules((), (), (), ())


def test_all_failure_classes_occur(spark):
    s = "c string, status_code int, body string"
    g = [("ok", 200, "{}"), ("html", 200, "{}"), ("status", 200, "{}"), ("order", 200, "[1,2]"), ("none", 200, None), ("less", 200, '{"a":1}'), ("type", 200, '{"a":1}'), ("value", 200, '{"a":1}'), ("gone", 200, "{}")]
    a = [("ok", 200, "{}"), ("html", 200, "<p>"), ("status", 500, "{}"), ("order", 200, "[2,1]"), ("none", 200, "1"), ("less", 200, "{}"), ("type", 200, '{"a":"1"}'), ("value", 200, '{"a":2}'), ("new", 200, "{}")]
    got = {r.c: (r.failure_type, r.debug_hint) for r in D.verify(spark.createDataFrame(g, s), spark.createDataFrame(a, s), ["c"]).collect()}
    assert {c: t for c, (t, _) in got.items()} == {
        "ok": None, "html": "response_not_json", "status": "status_code_mismatch", "order": "array_order_only", "none": "body_presence_mismatch", "less": "missing_fields", "type": "type_mismatch", "value": "value_mismatch", "gone": "status_code_mismatch", "new": "golden_not_found",
    }
    unknown = spark.range(1).select(D.failure_class(F.lit(False), F.lit(False), F.lit(True), F.lit(None).cast("string")).alias("t")).first().t
    assert unknown == "unknown" and all((t is None) == (h is None) for t, h in got.values())


def test_bodies_of_any_depth_compare(spark):
    deep = lambda x: "[" * 30_000 + x + "]" * 30_000
    assert diff(spark, deep("[1,2]"), deep("[1,2]"))[0] == "equal"
    assert diff(spark, deep("[1,2]"), deep("[2,1]"))[0] == "array_order_only"


def test_verify(spark):
    s = "m string, c string, status_code int, body string"
    g = spark.createDataFrame([("m", "1", 200, '{"a": 1}'), ("m", "2", 200, None), ("m", "3", 200, "{}"), ("m", "4", 200, "{}")], s)
    a = spark.createDataFrame([("m", "1", 200, '{"a": 2}'), ("m", "2", 500, None), ("m", "3", 200, "<html>")], s)
    got = {r.c: r.failure_type for r in D.verify(g, a, ["m", "c"]).collect()}
    assert got == {"1": "value_mismatch", "2": "status_code_mismatch", "3": "response_not_json", "4": "status_code_mismatch"}


def test_repeated_cases_are_not_multiplied_and_deep_bodies_do_not_crash(spark):
    s = "c string, status_code int, body string"
    deep = '{"a":' * 950 + "[2,1]" + "}" * 950
    g = spark.createDataFrame([("1", 200, "{}"), ("1", 200, "{}"), ("2", 200, deep)], s)
    a = spark.createDataFrame([("1", 200, "{}"), ("2", 200, deep.replace("[2,1]", "[1,2]"))], s)
    got = D.verify(g, a, ["c"]).collect()
    assert sorted((r.c, r.passed) for r in got) == [("1", True), ("1", True), ("2", False)]


def test_taint_and_strip(spark):
    d = spark.createDataFrame([("f", 1, 500), ("f", 2, 200), ("g", 3, None)], "folder string, id bigint, st int")
    assert rows(D.tainted(d, "folder", F.col("st") >= 500).select("id", "tainted")) == [(1, True), (2, True), (3, False)]
    b = spark.createDataFrame([(1, '{"a": {"note": {"x": 1}, "b": [{"note": 2, "c": 3}]}}')], "id bigint, body string")
    assert [r.way for r in D.strip_keys(b, "id", "body", ["note"]).where("value is not null").collect()] == ["a.b[0].c"]


# ---------------------------------------------------------------- sources

JAVA = """package app.x;
import app.y.Other;
import java.util.List;

@RequestMapping("/api/exam")
public class Foo extends Base implements Bar, Baz {
    // helper.gone(1)
    @GetMapping("/{id}")
    public List<Other> find(Map<String, Integer> m, int n) {
        String s = "other.call(1) }";
        return other.load(n).stream();
    }

    private static void run() { find(null, 1); }
}
"""


def test_class_facts(spark):
    src = spark.createDataFrame([(1, "f", "Foo", JAVA), (2, "g", "E", "")], "unit_id bigint, file_path string, class_name string, source string")
    r = J.class_facts(src).where("unit_id = 1").first()
    assert (r.package, r.imports, r.kind, r.declared, r.extends, r.implements, r.methods) == ("app.x", ["app.y.Other", "java.util.List"], "class", "Foo", "Base", ["Bar", "Baz"], 2)
    sig = [(r.method, r.return_type, r.parameters) for r in J.signatures(src).orderBy("mpos").collect()]
    assert sig == [("find", "List<Other>", ["Map<String, Integer> m", "int n"]), ("run", "void", [])]
    assert [(r.target, r.method) for r in J.calls(src).orderBy("method").collect()] == [("", "find"), ("other", "load"), ("", "stream")]
    assert [(r.http_method, r.route) for r in J.routes(src).collect()] == [("GET", "/api/exam/{id}")]
    a, b = J.method_span(JAVA, "find")
    assert JAVA[a:b].strip().startswith("public List<Other> find") and JAVA[a:b].endswith("stream();\n    }")
    assert J.method_span(JAVA, "nope") is None
    facts = J.class_facts(src)
    names = spark.createDataFrame([("Bar",), ("E",), ("Q",)], "name string")
    assert rows(J.type_classes(names, facts)) == [("Bar", "Foo"), ("E", "E"), ("Q", None)]


def test_capped_walk(spark):
    e = spark.createDataFrame([("s", "b", 2), ("s", "a", 1), ("a", "c", 1), ("b", "c", 1), ("c", "d", 1), ("d", "s", 1)], "src string, dst string, seq int")
    seeds, stop = spark.createDataFrame([("s",)], "n string"), spark.createDataFrame([("c",)], "n string")
    assert rows(G.capped_walk(e, seeds, stop.limit(0), cap=2).select("node", "depth", "kept", "truncated")) == [("a", 1, True, True), ("b", 1, True, True), ("c", 2, False, True), ("d", 3, False, True)]
    assert rows(G.capped_walk(e, seeds, stop).select("node", "stops", "truncated")) == [("a", False, False), ("b", False, False), ("c", True, False)]


def test_stable_order_takes_the_least_ready(spark):
    items = spark.createDataFrame([("g", "c", 1), ("g", "a", 2), ("g", "b", 3), ("h", "x", 1)], "g string, item string, seq int")
    needs = spark.createDataFrame([("g", "c", "b"), ("g", "c", "zz"), ("h", "x", "x")], "g string, item string, needs string")
    assert rows(G.stable_order(items, needs, "g")) == [("g", "a", 0), ("g", "b", 1), ("g", "c", 2), ("h", "x", 0)]
    with pytest.raises(PySparkException):
        G.stable_order(items, spark.createDataFrame([("g", "a", "b"), ("g", "b", "a")], "g string, item string, needs string"), "g").collect()


def test_selection(spark):
    d = spark.createDataFrame([(1, "One"), (2, "two")], "id int, name string")
    assert [r.name for r in R.selected(d, "name", "id", ["TWO", "1"], F.lit(0)).orderBy("request").collect()] == ["two", "One"]
    with pytest.raises(PySparkException):
        R.selected(d, "name", "id", ["three"], F.lit(0)).collect()


def test_exclusion_keeps_emptied_groups(spark):
    m = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "a")], "grp string, key string")
    assert rows(R.emptied_kept(m, m, spark.createDataFrame([("a",)], "key string"), "grp", "key")) == [("g", ["b"]), ("h", [])]


def test_long_literals_do_not_use_up_the_stack(spark):
    src = spark.createDataFrame([(1, 0, 'class A { String s = "' + "x,\\\\n" * 60000 + '"; void f() { a.go(1); } }')], "unit_id bigint, pos bigint, source string")
    assert [(r.target, r.method, r.n) for r in J.calls(src).where("method = 'go'").collect()] == [("a", "go", 1)]
