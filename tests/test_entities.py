import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracewright.functions import openapi as O
from tracewright.operators import callgraph as C
from tracewright.operators import entities as E
from tracewright.operators import layout as L
from tracewright.operators import runs as S

JAVA = '''package a.b; /* class Not { */
@Entity @Table(name = NAME, schema = "s", uniqueConstraints = @UniqueConstraint(columnNames = {"a", B, "c"}))
@Where(clause = "gone = false") // }
public class Exam extends Base<Long> implements A, B<C> {
  @Id private Long id;
  @Column(name = "n", nullable = false, length = 20) String name = "}", other;
  @ManyToOne @JoinColumn(name = "s_id") private School school;
  private int[] marks[];
  @Value("${app.x}") String conf; @Value("#{1}") String spel;
  public <T> List<T> find(@Valid final Map<String, T> m, int... n) { return this.go().stay(m).gone(); }
  Exam go() { return null; } Exam stay(Object o) { return this; }
}
enum Kind { A(1, "x"), B(LATER, "y"), C; Kind(int n, String s) { } Kind() { } int n; }
'''


def scanned(spark):
    return E.scan(spark.createDataFrame([(1, JAVA), (2, None), (3, ""), (4, "class {{{ @")], "k int, source string"), ("k",))


def test_scan(spark):
    got = [(r.kind, r.owner, r.name, r.type) for r in scanned(spark).where("k = 1").orderBy("pos").collect()]
    assert got[:4] == [("class", None, "Exam", None), ("field", "Exam", "id", "Long"), ("field", "Exam", "name", "String"), ("field", "Exam", "other", "String")]
    assert ("field", "Exam", "marks", "int[][]") in got and ("method", "Exam", "find", "List<T>") in got and ("enum_field", "Kind", "n", "int") in got
    assert scanned(spark).where("k in (2, 3)").isEmpty()


def test_only_literals_count(spark):
    d = scanned(spark)
    t = E.entity_types(d, ("k",)).collect()[0]
    assert (t.class_name, t.table_name, t.schema, t.extends, t.soft_delete_clause) == ("Exam", None, "s", "Base", "gone = false")
    assert [r.columns for r in E.unique_constraints(d.withColumn("annotations", d.annotations), ("k",)).collect()] in ([["a", "c"]], [])
    assert [(r.name, r.args) for r in E.enum_values(d, ("k",)).orderBy("pos").collect()] == [("A", '[1,"x"]'), ("B", None), ("C", None)]
    assert [(r.field, r.property_key) for r in E.injected_values(d, ("k",)).collect()] == [("conf", "app.x")]
    f = {r.field: r for r in E.entity_fields(d, ("k",)).collect()}
    assert (f["name"].column_name, f["name"].nullable, f["name"].length, f["school"].column_name, f["school"].relation) == ("n", False, 20, "s_id", "ManyToOne")
    assert E.scan(spark.createDataFrame([], "k int, source string"), ("k",)).collect() == []


def test_scanner_ends_on_anything():
    r = random.Random(3)
    parts = ["class", "enum", "A", "{", "}", "(", ")", "<", ">", ";", ",", "=", "@X", "@", '"s"', "//c\n", "/*", "int", "public", "[", "]", ".", "x", "'", '"']
    for _ in range(3000):
        list(E.declarations(" ".join(r.choice(parts) for _ in range(r.randrange(30)))))


def test_call_edges(spark):
    d = scanned(spark).where("k = 1")
    assert sorted((r.src, r.dst) for r in C.call_edges(d).collect()) == [("Exam.find", "Exam.go"), ("Exam.find", "Exam.stay")]
    assert C.call_edges(d.limit(0)).collect() == []


def test_layout(spark):
    files = spark.createDataFrame([("app/services/exam_service.py",), ("app/utils/x_y.py",), ("app/core/base_repository.py",), ("app/core/exception_handlers.py",)], "file string")
    modules = spark.createDataFrame([("exam",)], "module string")
    got = {r.file: (r.module, r.layer) for r in L.classified(files, modules).collect()}
    assert list(got.values()) == [("exam", "services"), ("_utils", "utils"), ("_base_repository", "repositories"), ("_global", "routers")] or set(got.values()) == {("exam", "services"), ("_utils", "utils"), ("_base_repository", "repositories"), ("_global", "routers")}
    for bad in ("app/services/other_service.py", "app/x.py"):
        with pytest.raises(PySparkException):
            L.classified(spark.createDataFrame([(bad,)], "file string"), modules).collect()
    one = spark.range(1).select(L.layer(F.lit("Service"), F.lit("a.utils")).alias("a"), L.layer(F.lit("Service"), F.lit("a.utilsx")).alias("b"), L.layer(F.lit(None), F.lit(None)).alias("c"), L.column_type(F.lit("list[int]"), F.lit(False)).alias("d")).first()
    assert tuple(one) == ("utils", "services", None, None)


def test_states_of_modules(spark):
    e = spark.createDataFrame([("a", 1, "passed"), ("a", 2, "regression"), ("b", 1, "regression"), ("b", 2, "passed"), ("c", 1, "failed"), ("c", 2, "reopened"), ("d", 1, "failed"), ("d", 2, "regression")], "module string, seq int, event string")
    m = spark.createDataFrame([(x,) for x in "abcde"], "module string")
    states = S.module_states(m, e)
    assert {r.module: r.status for r in states.collect()} == {"a": "needs_reverify", "b": "verified", "c": "pending", "d": "failed", "e": "pending"}
    assert not S.all_done(states).first().all_done and S.all_done(states.limit(0)).first().all_done and S.all_done(states.where("module in ('b', 'd')")).first().all_done
    with pytest.raises(PySparkException):
        S.module_states(m, spark.createDataFrame([("a", 1, "odd")], e.schema)).collect()


def test_failure_contexts(spark):
    f = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("d",), (None,)], "module string")
    tasks = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "b"), ("4", "d")], "id string, module string")
    gaps = spark.createDataFrame([("2", "scaffold_skipped"), ("3", "scaffold_skipped"), ("4", "other")], "task_id string, reason string")
    blocked = spark.createDataFrame([("a",)], "module string")
    got = {r.module: (r.origin, r.failures, r.gaps) for r in S.failure_contexts(f, tasks, gaps, blocked).collect()}
    assert got == {"a": ("blocked", 1, 0), "b": ("scaffold_gap", 2, 2), "c": ("module_mismatch", 1, 0), "d": ("root_cause", 1, 0)}


def test_outcomes_and_routes(spark):
    lit = F.lit
    r = spark.range(1).select(S.outcome(lit("pass"), lit(False), lit(True)).alias("a"), S.outcome(lit("fail"), lit(False), lit(True)).alias("b"), S.outcome(lit("fail"), lit(None).cast("boolean"), lit(True)).alias("c"), S.outcome(lit(None), lit(True), lit(None).cast("boolean")).alias("d"), S.retry_route(lit("fail"), lit(1)).alias("e"), S.retry_route(lit("fail"), lit(0)).alias("f")).first()
    assert tuple(r) == ("done", "give_up_scaffold_failed", "give_up_early", "give_up_retry_exhausted", "give_up", "debug")


def test_fixes_and_groups(spark):
    fixes = spark.createDataFrame([("1", True, "x", 0), ("1", None, "", 0), ("1", None, "", 2), ("2", None, "b", 0), ("9", True, None, 0)], "task_id string, retranslate boolean, fixed_body string, file_fixes int")
    tasks = spark.createDataFrame([("1",), ("2",)], "id string")
    assert sorted(map(tuple, S.validated_fixes(fixes, tasks).collect()), key=repr) == [("1", False, None, 2), ("1", True, None, 0), ("2", False, "b", 0)]
    given = spark.createDataFrame([("c", "f", "x"), ("c", "f", "y"), ("d", "f", "x")], "by string, folder string, endpoint string")
    items = spark.createDataFrame([("c", "x"), ("c", "y"), ("d", "x"), ("d", "z")], "by string, endpoint string")
    assert sorted(map(tuple, S.singleton_groups(given, items, "by").collect())) == [("c", "f", "x"), ("c", "f", "y"), ("d", "x", "x"), ("d", "z", "z")]


def test_contracts():
    doc = {"paths": {"/p": {"post": {"requestBody": {"content": {"multipart/form-data": {"schema": {"type": "object"}}}}, "responses": {"500": {}, "200": {"content": {}}}}}}}
    got = O.boundary(doc, "/p", "POST", [("upFile", "MultipartFile"), ("n", "int"), ("req", "HttpRequest")], None)
    assert got == {"params": [{"name": "upFile", "type": "UploadFile", "place": "file"}, {"name": "n", "type": "int = Form(...)", "place": "form"}], "uncovered": ["req"], "response": "None"}
    assert O.boundary(doc, "/p", "POST", [("upFile", "MultipartFile")], "ResponseEntity<X>") == {"params": [{"name": "up_file", "type": "UploadFile", "place": "body"}], "uncovered": [], "response": "Response"}
    assert O.boundary(doc, "/q", "POST", [], None) is None
    assert O.field_declaration({"type": "object", "description": "x"}, True) == "Any" and O.field_declaration({"type": "integer", "maximum": 3, "exclusiveMaximum": True}, False) == "int | None = Field(default=None, lt=3)"
    with pytest.raises(ValueError):
        O.field_declaration({"type": "object", "oneOf": []}, True)
