"""Queries of source declarations, data models and interface contracts, with their SQL.

The model queries write a Java class or an OpenAPI document per supplier or part from the
row's values, and read it back with the scanner; their SQL states the result from the columns.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tracewright.functions import documents as Doc
from tracewright.functions import openapi as O
from tracewright.functions import scalars as X
from tracewright.operators import callgraph as G
from tracewright.operators import entities as E
from tracewright.operators import layout as L
from tracewright.operators import sourcecode as J
from tracewright.plans import core
from tracewright.session import read_table

_CLASS = """package app.m%1$d.utils;
import app.base.Base;
import app.m%4$d.utils.S%4$d;

@Entity
@Table(name = "t_%1$d", schema = SCHEMA, uniqueConstraints = {@UniqueConstraint(columnNames = {"a_%1$d", "b"}), @UniqueConstraint(columnNames = "c")})
@Where(clause = "gone = %1$d") // class Not {
public class S%1$d extends Base<Long> implements HasCode {
    @Id @GeneratedValue private Long id;
    @Column(name = "c_%1$d", nullable = %2$s, length = %3$d, unique = true) private String name, other = f("}", 2);
    @ManyToOne(fetch = LAZY) @JoinColumn(name = "p_id", nullable = false) private S%4$d parent;
    @OneToMany(mappedBy = "parent") private List<S%1$d> kids;
    @OneToOne(mappedBy = "one") private S%1$d one;
    @ManyToMany @JoinTable(name = "j_%1$d", joinColumns = @JoinColumn(name = "a_id"), inverseJoinColumns = {@JoinColumn(name = "b_id")}) private Set<S%4$d> tags;
    @Transient private int tmp;
    private boolean open;
    @Enumerated(EnumType.ORDINAL) private Kind%1$d kind;
    @Value("${app.maxSize%3$d.k}") String conf;
    @CreatedDate LocalDateTime made;
    public S%1$d(String name) { this.name = name; }
    public S%1$d load%1$d(long id) { return this; }
    S%1$d twin() { return this; }
    @ExceptionHandler(Oops%3$d.class) public void handle%3$d(Oops%3$d e) { if (open) { return; } }
}
enum Kind%1$d implements HasCode%2$s { A(%1$d, "x"), B(%1$d, X), C; private final int c; Kind%1$d(int c, String d) { this.c = c; } }
@RestController
@RequestMapping({"/api/c%1$d/", "v2"})
class C%1$d extends B%1$d {
    private final S%4$d store; private R%1$d repo;
    @GetMapping({"/x/{id}", "y"}) public S%1$d find(long id, S%4$d given) { S%1$d s = store.load%4$d(id).twin(); this.check(id); repo.findAll(); return given.load%4$d(up(s.name())); }
    @PostMapping public void check(long id) { if (id > 0) { missing.call(); new Thing(1); S%4$d.load%4$d(2); } }
}
class B%1$d { S%1$d up(String n) { return null; } }
interface R%1$d extends JpaRepository<S%1$d, Long> { }
interface HasCodetrue { int code(); }
interface HasCodefalse { int code(); }
interface HasCode { int code(); }
"""

_S = "s AS (SELECT s_suppkey AS k, s_suppkey % 2 = 0 AS even, s_suppkey % 7 + 1 AS n, s_suppkey // 2 AS half FROM supplier)"


def _sources(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("k"))
    even = F.when(F.col("k") % 2 == 0, "true").otherwise("false")
    return s.select("k", F.format_string(_CLASS, "k", even, F.col("k") % 7 + 1, F.expr("k div 2")).alias("source"))


def _declared(spark, sf_dir):
    return E.scan(_sources(spark, sf_dir), ("k",))


@core.add("src18_entities", f"WITH {_S} SELECT k, 'S' || k AS class_name, 'Entity' AS jpa_kind, 't_' || k AS table_name, CAST(NULL AS VARCHAR) AS schema, 'Base' AS extends, 'gone = ' || k AS soft_delete_clause FROM s")
def src18_entities(spark, sf_dir):
    return E.entity_types(_declared(spark, sf_dir), ("k",))


_FIELDS = """
f AS (
  SELECT k, 'S' || k AS class_name, unnest(['id', 'name', 'other', 'parent', 'kids', 'one', 'tags', 'tmp', 'open', 'kind', 'conf', 'made']) AS field,
    unnest(['Long', 'String', 'String', 'S' || half, 'List<S' || k || '>', 'S' || k, 'Set<S' || half || '>', 'int', 'boolean', 'Kind' || k, 'String', 'LocalDateTime']) AS type,
    unnest([NULL, NULL, NULL, 'ManyToOne', 'OneToMany', 'OneToOne', 'ManyToMany', NULL, NULL, NULL, NULL, NULL]) AS relation, even, n FROM s)
"""


@core.add(
    "src18_fields",
    f"""
    WITH {_S}, {_FIELDS} SELECT k, class_name, field, type, relation, field = 'id' AS is_id, field = 'tmp' AS is_transient, field IN ('tmp', 'open') AS is_primitive,
      CASE WHEN field IN ('name', 'other') THEN 'c_' || k WHEN field = 'parent' THEN 'p_id' END AS column_name, CASE WHEN field IN ('name', 'other') THEN even WHEN field = 'parent' THEN false END AS nullable,
      CASE WHEN field IN ('name', 'other') THEN n END AS length, field = 'kind' AS enum_ordinal, CASE WHEN field = 'one' THEN 'one' END AS mapped_by, CASE WHEN field = 'tags' THEN 'j_' || k END AS join_table, CASE WHEN field = 'tags' THEN 'a_id' END AS join_column,
      field = 'made' AS is_created_at FROM f
    """,
)
def src18_fields(spark, sf_dir):
    f = E.entity_fields(_declared(spark, sf_dir), ("k",), auditing=True)
    return f.select("k", "class_name", "field", "type", "relation", "is_id", "is_transient", "is_primitive", "column_name", "nullable", F.col("length").cast("bigint").alias("length"), "enum_ordinal", "mapped_by", "join_table", "join_column", "is_created_at")


@core.add("f20_renderable_fields", f"WITH {_S}, {_FIELDS} SELECT k, field FROM f WHERE field NOT IN ('kids', 'one', 'tags', 'tmp')")
def f20_renderable_fields(spark, sf_dir):
    f = E.entity_fields(_declared(spark, sf_dir), ("k",))
    return f.where(L.renderable(F.col("relation"), F.col("is_transient"), F.col("mapped_by"))).select("k", "field")


@core.add(
    "e15_column_types",
    f"""
    WITH {_S}, {_FIELDS} SELECT k, field, CASE field WHEN 'id' THEN 'Integer' WHEN 'open' THEN 'Boolean' WHEN 'tmp' THEN 'Integer' WHEN 'kind' THEN 'Enum' WHEN 'made' THEN 'DateTime' WHEN 'kids' THEN NULL WHEN 'tags' THEN NULL ELSE 'String' END AS column_type,
      CASE WHEN field IN ('name', 'other') THEN even WHEN field = 'parent' THEN false ELSE field NOT IN ('tmp', 'open') END AS nullable FROM f
    """,
)
def e15_column_types(spark, sf_dir):
    d = _declared(spark, sf_dir)
    f = E.entity_fields(d, ("k",)).withColumn("python", X.map_type_udf()(F.col("type")))
    enums = d.where("kind = 'enum'").select("k", F.col("name").alias("type"), F.lit(True).alias("is_enum"))
    j = f.join(enums, ["k", "type"], "left")
    return j.select("k", "field", L.column_type(F.col("python"), F.col("is_enum")).alias("column_type"), L.nullable(F.col("nullable"), F.col("is_primitive")).alias("nullable"))


@core.add("e16_unique_constraints", f"WITH {_S} SELECT k, 'a_' || k || ',b' AS columns FROM s")
def e16_unique_constraints(spark, sf_dir):
    """A constraint whose columns are one text has no list; the literal lists come out."""
    u = E.unique_constraints(_declared(spark, sf_dir), ("k",))
    return u.select("k", F.array_join("columns", ",").alias("columns")).where("columns <> 'c'")


@core.add("e17_enum_values", f"WITH {_S} SELECT k, unnest(['A', 'B', 'C']) AS name, unnest(['[' || k || ',\"x\"]', NULL, NULL]) AS args FROM s")
def e17_enum_values(spark, sf_dir):
    return E.enum_values(_declared(spark, sf_dir), ("k",)).select("k", "name", F.replace("args", F.lit(", "), F.lit(",")).alias("args"))


@core.add("e12_models_by_module", f"WITH {_S} SELECT n AS module, count(*) AS entities, bool_and(true) AS all_with_id FROM s GROUP BY n")
def e12_models_by_module(spark, sf_dir):
    """Entities of a module; those without an id field are told apart."""
    d = _declared(spark, sf_dir)
    ids = E.entity_fields(d, ("k",)).groupBy("k", "class_name").agg(F.bool_or("is_id").alias("has_id"))
    e = E.entity_types(d, ("k",)).join(ids, ["k", "class_name"], "left")
    return e.groupBy((F.col("k") % 7 + 1).alias("module")).agg(F.count(F.lit(1)).alias("entities"), F.bool_and("has_id").alias("all_with_id"))


@core.add(
    "e13_foreign_keys",
    f"WITH {_S} SELECT s.k, 'parent' AS field, CASE WHEN o.k IS NOT NULL THEN 't_' || half || '.id' END AS target, CASE WHEN o.k IS NOT NULL THEN 'Long' ELSE 'int' END AS key_type FROM s LEFT JOIN (SELECT k FROM s) o ON o.k = s.half",
)
def e13_foreign_keys(spark, sf_dir):
    d = _declared(spark, sf_dir)
    f = E.entity_fields(d, ("k",))
    keys = E.primary_keys(f, ()).unionByName(E.primary_keys(f.limit(0), ()))
    return E.foreign_keys(f, E.entity_types(d, ("k",)), keys, "int").select("k", "field", "target", "key_type")


@core.add("e14_join_tables", f"WITH {_S} SELECT 'j_' || s.k AS join_table, 'S' || s.k AS class_name, 'Long' AS own_type, 'S' || half AS inverse, 'Long' AS inverse_type FROM s WHERE half IN (SELECT k FROM s)")
def e14_join_tables(spark, sf_dir):
    f = E.entity_fields(_declared(spark, sf_dir), ("k",))
    return E.join_tables(f, E.primary_keys(f, ())).select("join_table", "class_name", "own_type", "inverse", "inverse_type")


@core.add("e02_injected_values", f"WITH {_S} SELECT k, 'conf' AS field, 'app.maxSize' || n || '.k' AS property_key FROM s")
def e02_injected_values(spark, sf_dir):
    return E.injected_values(_declared(spark, sf_dir), ("k",)).select("k", "field", "property_key")


@core.add("e03_config_constants", f"WITH {_S} SELECT 'app.maxSize' || n || '.k' AS property_key, min(k) AS seq, 'APP_MAX_SIZE' || n || '_K' AS constant FROM s GROUP BY n")
def e03_config_constants(spark, sf_dir):
    return E.config_constants(E.injected_values(_declared(spark, sf_dir), ("k",)), "k")


@core.add("e01_enum_interfaces", f"WITH {_S} SELECT 'HasCode' || CASE WHEN even THEN 'true' ELSE 'false' END AS interface, count(*) AS enums FROM s GROUP BY 1")
def e01_enum_interfaces(spark, sf_dir):
    return E.enum_only_interfaces(_declared(spark, sf_dir))


@core.add("e07_handler_targets", f"WITH {_S} SELECT 'handle' || n AS method, 'Oops' || n AS exception FROM s GROUP BY n")
def e07_handler_targets(spark, sf_dir):
    return E.handler_targets(_declared(spark, sf_dir), ["k", "pos"])


# ---------------------------------------------------------------- calls


@core.add("g13_import_edges", f"WITH {_S} SELECT 'app.m' || k || '.utils.S' || k AS src, 'app.m' || half || '.utils.S' || half AS dst FROM s WHERE half IN (SELECT k FROM s)")
def g13_import_edges(spark, sf_dir):
    s = _sources(spark, sf_dir).withColumn("class_name", F.concat(F.lit("S"), F.col("k").cast("string")))
    return J.import_edges(J.class_facts(s))


_EDGES = f"""
WITH {_S}, e AS (
  SELECT k, 'C' || k || '.find' AS src, unnest(['C' || k || '.check', 'B' || k || '.up', '__jpa_base_repository__::BaseRepository::findAll']) AS dst FROM s
  UNION SELECT k, 'C' || k || '.find', unnest(['S' || half || '.load' || half, 'S' || half || '.twin']) FROM s WHERE half IN (SELECT k FROM s)
  UNION SELECT k, 'C' || k || '.check', 'S' || half || '.load' || half FROM s WHERE half IN (SELECT k FROM s))
SELECT src, dst FROM e
"""


@core.add("g13_call_edges", _EDGES)
def g13_call_edges(spark, sf_dir):
    """Calls by field, parameter, class name, own and inherited methods, and on the results of calls (J18: methods a repository has by itself)."""
    return G.call_edges(_declared(spark, sf_dir)).where("src like 'C%'")


@core.add("j10_type_classes", f"WITH {_S} SELECT 'HasCode' AS name, 'S' || k AS class FROM s UNION ALL SELECT 'S' || k, 'S' || k FROM s WHERE even UNION ALL SELECT 'Gone', NULL")
def j10_type_classes(spark, sf_dir):
    """A type stands for what implements it, a class for itself, any other name for nothing."""
    facts = J.class_facts(_sources(spark, sf_dir).withColumn("class_name", F.concat(F.lit("S"), F.col("k").cast("string"))))
    names = facts.where("k % 2 = 0").select(F.col("class_name").alias("name")).unionByName(spark.createDataFrame([("HasCode",), ("Gone",)], "name string"))
    return J.type_classes(names, facts)


@core.add("j18_inherited_methods", f"WITH {_S} SELECT 'C' || k AS class, 'up' AS method, 'B' || k || '.up' AS target FROM s UNION ALL SELECT 'R' || k, unnest(['findAll', 'findById', 'save', 'deleteById', 'delete', 'count', 'existsById']), '__jpa_base_repository__::BaseRepository::' || unnest(['findAll', 'findById', 'save', 'deleteById', 'delete', 'count', 'existsById']) FROM s")
def j18_inherited_methods(spark, sf_dir):
    """Methods a class has by its ancestors, and those every repository has by itself."""
    v = G.visible_methods(_declared(spark, sf_dir))
    return v.where(F.col("target") != F.concat("class", F.lit("."), "method")).select("class", "method", "target")


@core.add("x24_nullable", f"WITH {_S}, {_FIELDS} SELECT k, field, CASE WHEN field IN ('name', 'other') THEN even WHEN field = 'parent' THEN false ELSE field NOT IN ('tmp', 'open') END AS nullable FROM f")
def x24_nullable(spark, sf_dir):
    f = E.entity_fields(_declared(spark, sf_dir), ("k",))
    return f.select("k", "field", L.nullable(F.col("nullable"), F.col("is_primitive")).alias("nullable"))


@core.add("g14_route_index", f"WITH {_S} SELECT http || ' ' || base || path AS endpoint, 'C' || k || '.' || method AS method_id FROM s, (VALUES ('GET', '/x/{{id}}', 'find'), ('GET', '/y', 'find'), ('POST', '', 'check')) r(http, path, method), (SELECT unnest(['a', 'b']) AS which) w, LATERAL (SELECT CASE which WHEN 'a' THEN '/api/c' || k || CASE WHEN path = '' THEN '/' ELSE '' END ELSE '/v2' END AS base) b")
def g14_route_index(spark, sf_dir):
    return G.route_index(_declared(spark, sf_dir))


@core.add("g11_class_references", f"WITH RECURSIVE {_S}, e AS (SELECT k AS src, half AS dst FROM s WHERE half IN (SELECT k FROM s)), r AS (SELECT k AS node FROM s WHERE k % 10 = 9 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT 'S' || node AS class_name FROM r")
def g11_class_references(spark, sf_dir):
    """Classes a set of classes needs, over the types of their fields."""
    d = _declared(spark, sf_dir)
    f = d.where("kind = 'field' and owner like 'S%' and type rlike '^S[0-9]+$'").select(F.col("owner").alias("src"), F.col("type").alias("dst"))
    known = d.where("kind = 'class'").select(F.col("name").alias("dst"))
    seeds = d.where("kind = 'class' and name like 'S%' and k % 10 = 9").select("name")
    from tracewright.operators.graphs import reachable

    return reachable(f.join(known, "dst", "left_semi").select("src", "dst"), seeds).select(F.col("node").alias("class_name"))


_FILES = "f AS (SELECT unit_id, pos, c.class_name AS class_name, coalesce(c.source, '') AS source FROM (SELECT unit_id, unnest(classes) AS c, unnest(range(len(classes))) AS pos FROM map_units))"


@core.add("src14_method_rows", rf"WITH {_FILES} SELECT unit_id, pos, method, count(*) AS n FROM (SELECT unit_id, pos, unnest(regexp_extract_all(source, '(?m)^    public \w+ (\w+)\(', 1)) AS method FROM f) GROUP BY ALL")
def src14_method_rows(spark, sf_dir):
    """Methods of the real sources as the scanner sees them."""
    files = J.files(read_table(spark, sf_dir, "map_units")).withColumn("cpos", F.col("pos").cast("bigint")).drop("pos")
    d = E.scan(files, ("unit_id", "cpos"))
    return d.where("kind = 'method'").groupBy("unit_id", F.col("cpos").alias("pos"), F.col("name").alias("method")).agg(F.count(F.lit(1)).alias("n"))


@core.add("x04_parameter_types", rf"WITH {_FILES} SELECT unit_id, pos, type, count(*) AS n FROM (SELECT unit_id, pos, unnest(regexp_extract_all(source, '(?m)^    public \w+ \w+\((\w+) \w+', 1)) AS type FROM f) GROUP BY ALL")
def x04_parameter_types(spark, sf_dir):
    files = J.files(read_table(spark, sf_dir, "map_units")).withColumn("cpos", F.col("pos").cast("bigint")).drop("pos")
    d = E.scan(files, ("unit_id", "cpos")).where("kind = 'method'")
    first = F.get_json_object("extra", "$.params[0].type")
    return d.where(first.isNotNull()).groupBy("unit_id", F.col("cpos").alias("pos"), first.alias("type")).agg(F.count(F.lit(1)).alias("n"))


@core.add("src19_project_flag", f"WITH {_FILES} SELECT count(*) FILTER (contains(source, '@EnableJpaAuditing')) > 0 AS auditing, count(*) FILTER (contains(source, 'log.info')) > 0 AS logs FROM f")
def src19_project_flag(spark, sf_dir):
    files = J.files(read_table(spark, sf_dir, "map_units"))
    return spark.createDataFrame([(E.any_file_contains(files, "@EnableJpaAuditing"), E.any_file_contains(files, "log.info"))], "auditing boolean, logs boolean")


# ---------------------------------------------------------------- contracts

_DOC = """{"paths": {"/p/{id}": {"post": {"parameters": [{"name": "id", "in": "path", "schema": {"type": "integer"}}, {"$ref": "#/components/parameters/Q"}],
"requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/P%1$d"}}}}, "responses": {"404": {}, "201": {"content": {"a/b": {"schema": {"type": "array", "items": {"$ref": "#/components/schemas/R%1$d"}}}}}}}}},
"components": {"parameters": {"Q": {"name": "q", "in": "query", "schema": {"type": "string"}}}, "schemas": {"P%1$d": {"properties": {"a": {"$ref": "#/components/schemas/A"}, "n": {"type": "number", "maximum": %1$d}}, "required": ["n"]},
"R%1$d": {"properties": {"list": {"type": "array", "items": {"$ref": "#/components/schemas/P%1$d"}}}}, "A": {"properties": {"up": {"$ref": "#/components/schemas/P%1$d"}}}}}}"""


def _documents(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("k"), F.format_string(_DOC, F.col("p_partkey").cast("bigint")).alias("doc"))


@core.add(
    "e04_parameters",
    "SELECT p_partkey AS k, unnest(['id', 'q', 'new_part']) AS name, unnest(['int', 'str', 'P' || p_partkey]) AS type, unnest(['path', 'query', 'body']) AS place FROM part",
)
def e04_parameters(spark, sf_dir):
    def rows(text: str) -> str:
        doc = json.loads(text)
        k = next(n for n in doc["components"]["schemas"] if n.startswith("P"))
        found = O.boundary(doc, "/p/{id}", "POST", [("id", "Long"), ("newPart", k), ("q", "String"), ("rest", "HttpSession")], "void")
        return json.dumps(found["params"])

    d = _documents(spark, sf_dir).select("k", F.from_json(Doc.column(rows)(F.col("doc")), "array<struct<name: string, type: string, place: string>>").alias("p"))
    return d.select("k", F.explode("p").alias("p")).select("k", "p.name", "p.type", "p.place")


@core.add("e05_boundary_signature", "SELECT p_partkey AS k, 'list[R' || p_partkey || ']' AS response, 'rest' AS uncovered FROM part")
def e05_boundary_signature(spark, sf_dir):
    def signature(text: str) -> str:
        doc = json.loads(text)
        k = next(n for n in doc["components"]["schemas"] if n.startswith("P"))
        found = O.boundary(doc, "/p/{id}", "POST", [("id", "Long"), ("newPart", k), ("q", "String"), ("rest", "HttpSession")], "void")
        return f"{found['response']}|{','.join(found['uncovered'])}"

    s = Doc.column(signature)(F.col("doc"))
    return _documents(spark, sf_dir).withColumn("s", s).select("k", F.split_part("s", F.lit("|"), F.lit(1)).alias("response"), F.split_part("s", F.lit("|"), F.lit(2)).alias("uncovered"))


@core.add("g09_named_schemas", "SELECT p_partkey AS k, unnest([0, 1, 2]) AS pos, unnest(['P' || p_partkey, 'A', 'R' || p_partkey]) AS name FROM part")
def g09_named_schemas(spark, sf_dir):
    def names(text: str) -> str:
        doc = json.loads(text)
        return ",".join(O.named_schemas(doc["paths"]["/p/{id}"]["post"], doc))

    d = _documents(spark, sf_dir).select("k", F.posexplode(F.split(Doc.column(names)(F.col("doc")), ",")).alias("pos", "name"))
    return d.select("k", "pos", "name")


@core.add("g10_expanded_refs", """SELECT p_partkey AS k, '#/components/schemas/P' || p_partkey AS circular_ref, 'true' AS circular, CAST(p_partkey AS VARCHAR) AS maximum FROM part""")
def g10_expanded_refs(spark, sf_dir):
    """The body's schema with its references replaced; the way back to itself is marked."""

    def expand(text: str) -> str:
        doc = json.loads(text)
        return json.dumps(Doc.expand_refs(doc["paths"]["/p/{id}"]["post"]["requestBody"]["content"]["application/json"]["schema"], doc))

    x = _documents(spark, sf_dir).withColumn("x", Doc.column(expand)(F.col("doc")))
    up = "$.properties.a.properties.up"
    return x.select("k", F.get_json_object("x", up + "['$ref']").alias("circular_ref"), F.get_json_object("x", up + "._circular").alias("circular"), F.get_json_object("x", "$.properties.n.maximum").alias("maximum"))


@core.add("x05_schema_types", "SELECT p_partkey AS k, unnest(['a', 'n']) AS field, unnest(['A | None = None', 'float = Field(..., le=' || p_partkey || ')']) AS declaration FROM part")
def x05_schema_types(spark, sf_dir):
    def fields(text: str) -> str:
        schemas = json.loads(text)["components"]["schemas"]
        return json.dumps([{"field": f, "declaration": d} for f, d in O.field_declarations(next(v for n, v in schemas.items() if n.startswith("P")))])

    d = _documents(spark, sf_dir).select("k", F.inline(F.from_json(Doc.column(fields)(F.col("doc")), "array<struct<field: string, declaration: string>>")))
    return d


@core.add("x17_json_pointer", "SELECT p_partkey AS k, 'P' || p_partkey AS name FROM part")
def x17_json_pointer(spark, sf_dir):
    def ref(text: str) -> str:
        return Doc.pointer(json.loads(text), "#/paths/~1p~1{id}/post/requestBody/content/application~1json/schema/$ref").rsplit("/", 1)[-1]

    return _documents(spark, sf_dir).select("k", Doc.column(ref)(F.col("doc")).alias("name"))


@core.add("x03_type_arguments", "SELECT p_partkey AS k, 3 AS parts, 'Map<String, List<P' || p_partkey || '>>' AS second FROM part")
def x03_type_arguments(spark, sf_dir):
    text = F.format_string("A, Map<String, List<P%d>>, B", F.col("p_partkey"))
    split = Doc.column(lambda t: json.dumps(Doc.split_top_level(t)))(text)
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.from_json(split, "array<string>").alias("a")).select("k", F.size("a").alias("parts"), F.get("a", 1).alias("second"))


@core.add("c08_rewritten_bodies", """SELECT p_partkey AS k, '{"a": {"b": {{v}}}, "s": "' || p_partkey || '"}' AS body FROM part""")
def c08_rewritten_bodies(spark, sf_dir):
    body = F.format_string('{"a": {"b": %d}, "s": "%d"}', F.col("p_partkey"), F.col("p_partkey"))
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), Doc.column(lambda t: Doc.rewritten(t, "a.b", "v"))(body).alias("body"))


@core.add(
    "x26_method_spans",
    "SELECT s_suppkey AS k, 'public void handle' || (s_suppkey % 7 + 1) || '(Oops' || (s_suppkey % 7 + 1) || ' e) { if (open) { return; } }' AS span FROM supplier",
)
def x26_method_spans(spark, sf_dir):
    """The text of a method with its braces, found by name."""
    text = "    public void handle%1$d(Oops%1$d e) { if (open) { return; } }\n    // handle%1$d( {\n"

    def span(source: str) -> str:
        import re

        a, b = J.method_span(source, re.search(r"void (\w+)", source).group(1))
        return source[a:b].strip()

    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.format_string(text, F.col("s_suppkey") % 7 + 1).alias("source"))
    return s.select("k", Doc.column(span)(F.col("source")).alias("span"))


@core.add(
    "e25_mechanical_summary",
    """
    SELECT unit_id, pos, m.name AS method, CASE WHEN regexp_full_match(m.name, '(find|read|get|query|stream|count|exists|delete|remove)By[A-Z].*') THEN 'derived' ELSE 'plain' END AS kind
    FROM (SELECT unit_id, pos, unnest(c.methods) AS m FROM (SELECT unit_id, unnest(classes) AS c, unnest(range(len(classes))) AS pos FROM map_units))
    WHERE NOT coalesce(m.has_body, false) AND NOT regexp_matches(m.name, '^(get|set|is)[A-Z0-9_]|^(equals|hashCode|toString|canEqual|builder|toBuilder)$')
    """,
)
def e25_mechanical_summary(spark, sf_dir):
    """Methods without a body that are no accessors, described from their names."""
    m = read_table(spark, sf_dir, "map_units").select("unit_id", F.posexplode("classes").alias("pos", "c")).select("unit_id", F.col("pos").cast("bigint").alias("pos"), F.explode("c.methods").alias("m"))
    plain = ~F.coalesce(F.col("m.has_body"), F.lit(False)) & ~F.col("m.name").rlike("^(get|set|is)[A-Z0-9_]|^(equals|hashCode|toString|canEqual|builder|toBuilder)$")
    text = Doc.column(Doc.derived_query)(F.col("m.name"))
    return m.where(plain).select("unit_id", "pos", F.col("m.name").alias("method"), F.when(text.isNotNull(), "derived").otherwise("plain").alias("kind"))


@core.add(
    "e26_known_names",
    "SELECT unit_id, pos, m.name AS method FROM (SELECT unit_id, pos, unnest(c.methods) AS m FROM (SELECT unit_id, unnest(classes) AS c, unnest(range(len(classes))) AS pos FROM map_units)) WHERE m.has_body",
)
def e26_known_names(spark, sf_dir):
    """Listed names (with a parenthesis behind them) brought to the known ones; unknown names drop out."""
    c = read_table(spark, sf_dir, "map_units").select("unit_id", F.posexplode("classes").alias("pos", "c"))
    known = F.transform(F.filter("c.methods", lambda m: m["has_body"]), lambda m: m["name"])
    e = c.select("unit_id", F.col("pos").cast("bigint").alias("pos"), known.alias("known"), F.explode("c.methods").alias("m"))
    name = X.method_name(F.concat("m.name", F.lit(" (String, int)")), F.col("known"))
    return e.select("unit_id", "pos", name.alias("method")).where("method is not null")


# ---------------------------------------------------------------- planning

_MEMBERS = "m AS (SELECT unit_id, pos, c.class_name AS class_name, c.file_path AS file, c.stereotype AS stereotype, m.name AS method, mpos, m.has_body AS has_body FROM (SELECT unit_id, pos, c, unnest(c.methods) AS m, unnest(range(len(c.methods))) AS mpos FROM (SELECT unit_id, unnest(classes) AS c, unnest(range(len(classes))) AS pos FROM map_units)))"


def _members(spark, sf_dir):
    c = read_table(spark, sf_dir, "map_units").select("unit_id", F.posexplode("classes").alias("pos", "c")).select("unit_id", F.col("pos").cast("bigint").alias("pos"), "c", F.posexplode("c.methods").alias("mpos", "m"))
    return c.select("unit_id", "pos", "c.class_name", F.col("c.file_path").alias("file"), "c.stereotype", F.col("m.name").alias("method"), F.col("mpos").cast("bigint").alias("mpos"), "m.has_body")


@core.add("e06_method_contexts", f"WITH {_MEMBERS} SELECT class_name, method, count(*) AS overloads, min(unit_id) AS first_unit FROM m WHERE class_name IS NOT NULL GROUP BY class_name, method")
def e06_method_contexts(spark, sf_dir):
    """Listed methods once per class and name, with their overloads; one without a declaration is an error."""
    m = _members(spark, sf_dir).where("class_name is not null")
    declared = m.groupBy("class_name", "method").agg(F.count(F.lit(1)).alias("overloads"), F.min("unit_id").alias("first_unit"))
    listed = m.select("class_name", "method").distinct()
    j = listed.join(declared.withColumn("_there", F.lit(True)), ["class_name", "method"], "left")
    return j.select("class_name", "method", F.when(F.col("_there"), F.col("overloads")).otherwise(F.raise_error(F.concat(F.lit("no method "), "method"))).alias("overloads"), "first_unit")


@core.add(
    "e08_module_interfaces",
    f"WITH {_MEMBERS} SELECT class_name, method, unit_id, coalesce(CASE WHEN stereotype IN ('RestController', 'Controller') THEN 'routers' WHEN stereotype IN ('Service', 'Component') THEN 'services' WHEN stereotype = 'Repository' THEN 'repositories' END, CASE WHEN has_body THEN 'services' END) AS layer, mpos FROM m WHERE stereotype IS NOT NULL OR has_body",
)
def e08_module_interfaces(spark, sf_dir):
    """The mechanical layer, else the answer given for the method; methods without either drop out."""
    m = _members(spark, sf_dir)
    answer = F.when(F.col("has_body"), F.lit("services"))
    out = m.withColumn("layer", F.coalesce(L.layer(F.col("stereotype"), F.lit(None).cast("string")), answer))
    return out.where("layer is not null").select("class_name", "method", "unit_id", "layer", "mpos")


@core.add(
    "e10_task_drafts",
    f"WITH {_MEMBERS} SELECT unit_id, pos, mpos, coalesce(class_name || '.', '') || method || ' in ' || coalesce(file, '-') || CASE WHEN stereotype = 'Service' THEN ' (see app/core/config.py)' ELSE '' END AS description FROM m",
)
def e10_task_drafts(spark, sf_dir):
    """One draft per method: a mechanical description with a hint where its class reads settings."""
    hint = F.when(F.col("stereotype") == "Service", " (see app/core/config.py)").otherwise("")
    text = F.concat(F.coalesce(F.concat("class_name", F.lit(".")), F.lit("")), "method", F.lit(" in "), F.coalesce("file", F.lit("-")), hint)
    return _members(spark, sf_dir).select("unit_id", "pos", "mpos", text.alias("description"))


@core.add("e19_interfaces_by_file", f"WITH {_MEMBERS} SELECT file, method, row_number() OVER (PARTITION BY file ORDER BY unit_id, pos, mpos) AS place FROM m WHERE file IS NOT NULL")
def e19_interfaces_by_file(spark, sf_dir):
    """The interfaces of a file in the order they came."""
    from tracewright.operators.relational import position

    m = _members(spark, sf_dir).where("file is not null")
    return position(m, ["file"], ["unit_id", "pos", "mpos"], F.floor(F.col("unit_id") / 1000)).select("file", "method", F.col("pos").cast("bigint").alias("place"))


@core.add("e21_listed_functions", f"WITH {_MEMBERS} SELECT class_name, count(*) AS kept FROM m WHERE class_name IS NOT NULL AND method LIKE 's%' GROUP BY class_name")
def e21_listed_functions(spark, sf_dir):
    """Only listed functions stay; a class that loses all goes with them."""
    m = _members(spark, sf_dir).where("class_name is not null")
    listed = m.where("method like 's%'").select("class_name", "method").distinct()
    return m.join(listed, ["class_name", "method"], "left_semi").groupBy("class_name").agg(F.count(F.lit(1)).alias("kept"))


@core.add(
    "e22_source_lookup",
    rf"WITH {_FILES.replace('c.class_name AS class_name,', 'c.class_name AS class_name, c.file_path AS file,')} SELECT file, class_name, arg_min(method, (unit_id, pos, nth)) AS first_method FROM (SELECT *, unnest(regexp_extract_all(source, '(?m)^    public \w+ (\w+)\(', 1)) AS method, unnest(range(len(regexp_extract_all(source, '(?m)^    public \w+ (\w+)\(', 1)))) AS nth FROM f) WHERE file IS NOT NULL AND class_name IS NOT NULL GROUP BY file, class_name",
)
def e22_source_lookup(spark, sf_dir):
    """The first declaration at a coordinate, as the scanner finds it."""
    files = J.files(read_table(spark, sf_dir, "map_units")).where("file_path is not null and class_name is not null").withColumn("cpos", F.col("pos").cast("bigint")).drop("pos")
    d = E.scan(files, ("unit_id", "cpos", "file_path", "class_name")).where("kind = 'method'")
    return d.groupBy(F.col("file_path").alias("file"), "class_name").agg(F.min_by("name", F.struct("unit_id", "cpos", "pos")).alias("first_method"))


@core.add(
    "e11_related_sources",
    """
    WITH f AS (SELECT DISTINCT run_id, target_file AS file FROM llm_traces WHERE status = 'error' AND target_file IS NOT NULL), t AS (SELECT DISTINCT run_id, target_file AS file FROM llm_traces WHERE target_file IS NOT NULL)
    SELECT run_id, file FROM f UNION SELECT run_id, 'app/core/config.py' FROM f UNION SELECT run_id, file FROM t WHERE run_id NOT IN (SELECT run_id FROM f WHERE run_id IS NOT NULL)
    """,
)
def e11_related_sources(spark, sf_dir):
    """Files of the failures with the common ones; a run without any gets all its targets."""
    t = read_table(spark, sf_dir, "llm_traces").where("target_file is not null").select("run_id", F.col("target_file").alias("file"), "status")
    failed = t.where("status = 'error'").select("run_id", "file").distinct()
    common = failed.select("run_id", F.lit("app/core/config.py").alias("file"))
    rest = t.where("run_id is not null").select("run_id", "file").join(failed.select("run_id"), "run_id", "left_anti")
    return failed.unionByName(common).unionByName(rest).distinct()
