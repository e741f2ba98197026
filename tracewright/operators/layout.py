"""Where a class of the source belongs in the target: layers, phases, files, modules, column types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scalars import camel_to_snake

#: Layer of a stereotype, file suffix of a layer, phase of the layers translated first.
STEREOTYPE_LAYER = {"RestController": "routers", "Controller": "routers", "Service": "services", "Component": "services", "Repository": "repositories"}
LAYER_SUFFIX = {"routers": "_router", "services": "_service", "repositories": "_repository"}
FIRST_LAYERS = ("repositories", "utils")
#: Files and modules outside of the file-name rule.
EXCEPTION_HANDLERS_FILE, UTILS_PREFIX, BASE_REPOSITORY_FILE = "app/core/exception_handlers.py", "app/utils/", "app/core/base_repository.py"
GLOBAL_MODULE, UTILS_MODULE, BASE_REPOSITORY_MODULE = "_global", "_utils", "_base_repository"


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def layer(stereotype: Column, package: Column) -> Column:
    """``utils`` for classes of a package named so, else the stereotype's layer, else null."""
    return F.when(F.regexp_extract(package, r"([^.]*)$", 1) == "utils", "utils").otherwise(F.try_element_at(_table(STEREOTYPE_LAYER), stereotype))


def phase(layer_name: Column) -> Column:
    return F.when(layer_name.isin(*FIRST_LAYERS), 1).when(layer_name.isNotNull(), 2)


def layer_file(module: Column, layer_name: Column, class_name: Column) -> Column:
    """``app/<layer>/<module>_<singular>.py``; utils have a file per class."""
    suffix = F.try_element_at(_table(LAYER_SUFFIX), layer_name)
    return F.when(layer_name == "utils", F.concat(F.lit(UTILS_PREFIX), camel_to_snake(class_name), F.lit(".py"))).otherwise(
        F.concat(F.lit("app/"), layer_name, F.lit("/"), module, suffix, F.lit(".py"))
    )


def classified(files: DataFrame, modules: DataFrame, *, strict: bool = True) -> DataFrame:
    """``module`` and ``layer`` of each target ``file``.

    Fixed files and prefixes first, then ``<module>_<layer>.py`` of a known module.  A file of no
    module is an error, or has nulls with ``strict`` off.
    """
    stem = F.regexp_extract("file", r"([^/]*?)(?:\.py)?$", 1)
    named = None
    for name, suffix in LAYER_SUFFIX.items():
        hit = F.struct(F.expr(f"substring(_stem, 1, length(_stem) - {len(suffix)})").alias("module"), F.lit(name).alias("layer"))
        named = F.when(F.col("_stem").endswith(suffix), hit) if named is None else named.when(F.col("_stem").endswith(suffix), hit)

    def fixed(module: str, layer_name: str) -> Column:
        return F.struct(F.lit(module).alias("module"), F.lit(layer_name).alias("layer"))

    rule = (
        F.when(F.col("file") == EXCEPTION_HANDLERS_FILE, fixed(GLOBAL_MODULE, "routers"))
        .when(F.col("file").startswith(UTILS_PREFIX), fixed(UTILS_MODULE, "utils"))
        .when(F.col("file") == BASE_REPOSITORY_FILE, fixed(BASE_REPOSITORY_MODULE, "repositories"))
    )
    rows = files.withColumn("_stem", stem).withColumns({"_fixed": rule, "_named": named})
    known = rows.join(modules.select(F.col("module").alias("_known")).distinct(), F.col("_named.module") == F.col("_known"), "left")
    found = F.coalesce("_fixed", F.when(F.col("_known").isNotNull(), F.col("_named")))
    if strict:
        found = F.coalesce(found, F.raise_error(F.concat(F.lit("no module for "), "file")))
    return known.withColumn("_found", found).withColumns({"module": F.col("_found.module"), "layer": F.col("_found.layer")}).drop("_stem", "_fixed", "_named", "_known", "_found")


def with_schema_file(modules: DataFrame, tree: str) -> DataFrame:
    """Modules whose schema file has a heading ``### app/schemas/<module>.py`` in a listing."""
    return modules.where(F.contains(F.lit(tree), F.concat(F.lit("### app/schemas/"), "module", F.lit(".py"))))


def fill_mode(param_schema: Column) -> Column:
    """``file`` for multipart bodies, ``raw_body`` for an array body, else ``fields``; a schema that is no JSON has fields."""
    content = F.get_json_object(param_schema, "$.requestBody.content")
    kinds = F.json_object_keys(content)
    types = F.map_values(F.from_json(content, "map<string, struct<schema: struct<type: string>>>"))
    array_body = F.exists(types, lambda m: F.coalesce(m["schema"]["type"] == "array", F.lit(False)))
    return F.when(F.coalesce(F.array_contains(kinds, "multipart/form-data"), F.lit(False)), "file").when(F.coalesce(array_body, F.lit(False)), "raw_body").otherwise("fields")


def nullable(given: Column, primitive: Column) -> Column:
    """What the annotation says, else whether the type can be null at all."""
    return F.coalesce(given, ~primitive)


#: Column types of the Python types.
COLUMN_TYPES = {"int": "Integer", "str": "String", "bool": "Boolean", "float": "Float", "Decimal": "Numeric", "date": "Date", "datetime": "DateTime", "time": "Time", "bytes": "LargeBinary"}


def column_type(python_type: Column, is_enum: Column) -> Column:
    """Type of a scalar column: null for containers, ``UUID``, a known type, ``Enum`` for known enums, else ``String``."""
    return (
        F.when(python_type.rlike(r"[\[\]]"), F.lit(None).cast("string"))
        .when(python_type == "UUID", "UUID")
        .otherwise(F.coalesce(F.try_element_at(_table(COLUMN_TYPES), python_type), F.when(F.coalesce(is_enum, F.lit(False)), "Enum"), F.lit("String")))
    )


def renderable(relation: Column, transient: Column, mapped_by: Column) -> Column:
    """Does a field become a column? Not if it is transient, the many side, a join table or the side that owns no key."""
    many = F.coalesce(relation.isin("OneToMany", "ManyToMany"), F.lit(False))
    other_side = F.coalesce(relation == "OneToOne", F.lit(False)) & mapped_by.isNotNull()
    return ~(F.coalesce(transient, F.lit(False)) | many | other_side)
