"""The call graph of a source tree: who calls which method of which class.

Call sites come from the row-local scan of the sources; what they mean is resolved by joins on
names: the receiver's type by parameter, field or class, the method by class or ancestor, a
call on a result by the return type of the call before it.  Calls that cannot be resolved are
dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.graphs import closure
from tracewright.session import cut_lineage

#: Interfaces whose methods every repository has, those methods, and the class that stands for them.
REPOSITORY_BASES = ("JpaRepository", "CrudRepository", "PagingAndSortingRepository")
REPOSITORY_METHODS = ("findAll", "findById", "save", "deleteById", "delete", "count", "existsById")
SYNTHETIC = "__jpa_base_repository__::BaseRepository::"

_PARAMS = "array<struct<name: string, type: string>>"


def method_table(declared: DataFrame) -> DataFrame:
    """(class, method, returns): declared methods; overloads are one."""
    m = declared.where("kind = 'method'")
    return m.groupBy(F.col("owner").alias("class"), F.col("name").alias("method")).agg(F.min_by("type", "pos").alias("returns"))


def super_types(declared: DataFrame) -> DataFrame:
    """(src, dst): types and what they extend."""
    up = F.from_json(F.get_json_object("extra", "$.extends"), "array<string>")
    return declared.where("kind in ('class', 'interface')").select(F.col("name").alias("src"), F.explode(up).alias("dst")).distinct()


def visible_methods(declared: DataFrame) -> DataFrame:
    """(class, method, target, returns): own methods, and inherited ones the class does not declare itself."""
    own = method_table(declared)
    above = closure(super_types(declared)).where("src <> dst")
    inherited = above.join(own.withColumnsRenamed({"class": "dst"}), "dst").groupBy(F.col("src").alias("class"), "method").agg(F.min(F.struct("dst", "returns")).alias("m"))
    inherited = inherited.join(own.select("class", "method"), ["class", "method"], "left_anti")
    mine = own.select("class", "method", F.concat("class", F.lit("."), "method").alias("target"), "returns")
    rest = inherited.select("class", "method", F.concat("m.dst", F.lit("."), "method").alias("target"), "m.returns")
    # what a repository has by itself
    repos = super_types(declared).where(F.col("dst").isin(*REPOSITORY_BASES)).select(F.col("src").alias("class")).distinct()
    known = repos.select("class", F.explode(F.array(*map(F.lit, REPOSITORY_METHODS))).alias("method")).join(own.select("class", "method"), ["class", "method"], "left_anti")
    synthetic = known.select("class", "method", F.concat(F.lit(SYNTHETIC), "method").alias("target"), F.lit(None).cast("string").alias("returns"))
    return mine.unionByName(rest).unionByName(synthetic)


def bare_type(column: str):
    """The name of a type without arguments and arrays."""
    return F.regexp_extract(column, r"^(?:[\w$]+\.)*([\w$]+)", 1)


def call_edges(declared: DataFrame) -> DataFrame:
    """(src, dst): distinct ``Class.method`` pairs of caller and called method.

    Rounds over the calls on results of calls: as many as the longest chain has links.
    """
    declared = cut_lineage(declared)
    methods = cut_lineage(visible_methods(declared))
    m = declared.where("kind = 'method'").select("owner", F.col("name").alias("caller"), F.monotonically_increasing_id().alias("mid"), "extra")
    m = cut_lineage(m)
    calls = F.from_json(F.get_json_object("extra", "$.calls"), "array<array<string>>")
    site = m.select("owner", "caller", "mid", F.posexplode(calls).alias("ci", "c")).select(
        "owner", "caller", "mid", "ci", F.col("c")[0].alias("receiver"), F.col("c")[1].alias("method"), F.col("c")[2].cast("int").alias("before")
    )
    params = m.select("mid", F.inline(F.from_json(F.get_json_object("extra", "$.params"), _PARAMS))).select("mid", F.col("name").alias("receiver"), bare_type("type").alias("by_param"))
    fields = declared.where("kind = 'field'").select("owner", F.col("name").alias("receiver"), bare_type("type").alias("by_field"))
    classes = declared.where("kind in ('class', 'interface', 'enum')").select(F.col("name").alias("receiver"), F.col("name").alias("by_name")).distinct()
    first = site.where("before < 0").withColumn("receiver", F.regexp_replace("receiver", r"^this\.", ""))
    typed = first.join(params, ["mid", "receiver"], "left").join(fields.dropDuplicates(["owner", "receiver"]), ["owner", "receiver"], "left").join(classes, "receiver", "left")
    kind = F.when(F.col("receiver").isin("", "this"), F.col("owner")).otherwise(F.coalesce("by_param", "by_field", "by_name"))
    resolved = cut_lineage(typed.select("owner", "caller", "mid", "ci", "method", kind.alias("class")).join(methods, ["class", "method"]).select("owner", "caller", "mid", "ci", "target", "returns"))
    later = cut_lineage(site.where("before >= 0"))
    found, last = resolved, resolved
    while not later.isEmpty():
        on = last.select("mid", F.col("ci").alias("before"), bare_type("returns").alias("class")).where("class <> ''")
        last = cut_lineage(later.join(on, ["mid", "before"]).join(methods, ["class", "method"]).select("owner", "caller", "mid", "ci", "target", "returns"))
        if last.isEmpty():
            break
        found = found.unionByName(last)
    return found.select(F.concat("owner", F.lit("."), "caller").alias("src"), F.col("target").alias("dst")).distinct()


#: Annotations of mapped methods and their HTTP methods.
MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "PatchMapping": "PATCH", "DeleteMapping": "DELETE"}


def _texts(note):
    """The literal paths of a mapping: of ``value`` or ``path``, one text or a list; none gives the empty path."""
    def read(key: str):
        raw = F.get_json_object(note, f"$.{key}")
        return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw))

    return F.coalesce(read("value"), read("path"), F.array(F.lit("")))


def route_index(declared: DataFrame, context: str = "") -> DataFrame:
    """(endpoint, method_id): every base path of a controller times every path of its mapped methods, behind the context path."""
    control = declared.where(F.col("kind").isin("class") & (F.map_contains_key("annotations", F.lit("RestController")) | F.map_contains_key("annotations", F.lit("Controller"))))
    bases = control.select(F.col("name").alias("owner"), F.explode(_texts(F.try_element_at("annotations", F.lit("RequestMapping")))).alias("base"))
    mapped = None
    for note, http in MAPPINGS.items():
        one = F.struct(F.lit(http).alias("http"), F.try_element_at("annotations", F.lit(note)).alias("note"))
        hit = F.map_contains_key("annotations", F.lit(note))
        mapped = F.when(hit, one) if mapped is None else mapped.when(hit, one)
    m = declared.where("kind = 'method'").select("owner", F.col("name").alias("method"), mapped.alias("m")).where("m is not null")
    paths = m.select("owner", "method", "m.http", F.explode(_texts(F.col("m.note"))).alias("path"))
    j = paths.join(bases, "owner")
    joined = F.when(F.col("path") == "", F.col("base")).otherwise(F.concat(F.regexp_replace("base", "/+$", ""), F.lit("/"), F.regexp_replace("path", "^/+", "")))
    full = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    return j.select(F.concat("http", F.lit(" "), F.lit(context), full).alias("endpoint"), F.concat("owner", F.lit("."), "method").alias("method_id"))
