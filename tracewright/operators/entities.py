"""Declarations of annotated Java sources: types, fields, methods and enum constants with their annotations.

One row-local pass reads a source token by token (comments, strings and nested brackets are
respected) and emits one row per declaration.  Annotation values are read only where they are
literals: strings, numbers, booleans, lists of them and annotations within; a reference to a
constant counts as absent.  The rules on top are relational.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|@?[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*|\d[\w.]*|[{}()\[\]<>,;=.&?:|]|\S', re.S)
#: Words before a declaration that are no part of its type.
MODIFIERS = frozenset("public protected private static final abstract transient volatile synchronized native strictfp default sealed".split())
_ABSENT = object()


def tokens(source: str) -> list[str]:
    return [t for t in _TOKEN.findall(source) if not t.startswith(("//", "/*"))]


def _literal(t: list[str]) -> Any:
    """The value of the tokens of one annotation value, ``_ABSENT`` if it is no literal."""
    if not t:
        return _ABSENT
    if t[0] == "{" and t[-1] == "}":
        items = [_literal(x) for x in _parts(t[1:-1])]
        return [x for x in items if x is not _ABSENT]
    if t[0].startswith("@"):
        return {"@": t[0][1:], **annotation_values(t[2:-1] if len(t) > 2 else [])}
    if len(t) == 1:
        if t[0][0] == '"':
            return t[0][1:-1]
        if t[0] in ("true", "false"):
            return t[0] == "true"
    text = "".join(t)
    if re.fullmatch(r"-?\d+[lL]?", text):
        return int(text.rstrip("lL"))
    if re.fullmatch(r"-?\d+\.\d*(?:[eE][+-]?\d+)?[fFdD]?|-?\d+[eE][+-]?\d+[fFdD]?|-?\d+[fFdD]", text):
        return float(text.rstrip("fFdD"))
    return _ABSENT


def _parts(t: list[str]) -> list[list[str]]:
    """Tokens between the commas outside of brackets."""
    out: list[list[str]] = [[]]
    depth = 0
    for x in t:
        depth += (x in "({[<") - (x in ")}]>") if len(x) == 1 else 0
        if x == "," and not depth:
            out.append([])
        else:
            out[-1].append(x)
    return [p for p in out if p]


def annotation_values(t: list[str]) -> dict[str, Any]:
    """Literal values of an annotation's arguments by name (``value`` without one); ``#key`` holds the text of other values."""
    out: dict[str, Any] = {}
    for part in _parts(t):
        key, value = (part[0], part[2:]) if len(part) > 2 and part[1] == "=" else ("value", part)
        read = _literal(value)
        if read is _ABSENT:
            out[f"#{key}"] = "".join(value)
        else:
            out[key] = read
    return out


def _block(t: list[str], i: int) -> int:
    """The place after the bracket that closes the one at ``i``; the end for one never closed."""
    close = {"(": ")", "{": "}", "[": "]", "<": ">"}[t[i]]
    depth = 0
    for j in range(i, len(t)):
        depth += (t[j] == t[i]) - (t[j] == close)
        if not depth:
            return j + 1
    return len(t)


def type_text(t: list[str]) -> str:
    """A type as text, one blank after the commas of its arguments, wildcards and bounds as ``?``."""
    text = re.sub(r"\?(?:extends|super)[\w.<>]+", "?", "".join(t))
    return text.replace(",", ", ")


def _annotations(t: list[str], i: int) -> tuple[list[tuple[str, dict]], int]:
    found = []
    while i < len(t) and t[i].startswith("@") and t[i] != "@interface" and len(t[i]) > 1:
        name, i = t[i][1:].rsplit(".", 1)[-1], i + 1
        values: dict = {}
        if i < len(t) and t[i] == "(":
            end = _block(t, i)
            values, i = annotation_values(t[i + 1 : end - 1]), end
        found.append((name, values))
    return found, i


def _names(t: list[str], i: int, stop: tuple[str, ...]) -> tuple[list[str], int]:
    """Simple names of a list of types up to a stop word."""
    start = i
    while i < len(t) and t[i] not in stop:
        i = _block(t, i) if t[i] == "<" else i + 1
    return [p[0].rsplit(".", 1)[-1] for p in _parts(t[start:i])], i


#: Words before a bracket that call nothing.
NO_CALLS = frozenset("if for while switch catch return new super this synchronized throw assert else do try".split())


def call_sites(t: list[str]) -> list[list]:
    """[receiver, name, before] of each call in a body, in order of the names.

    ``receiver``: a name, a dotted way, or empty for a call of the own class; ``before``: the number of
    the call whose result the method is called on, -1 otherwise.
    """
    out: list[list] = []
    ends: dict[int, int] = {}  # place after a call's bracket -> its number
    for i in range(len(t) - 1):
        if t[i + 1] != "(" or not re.match(r"[A-Za-z_$]", t[i]) or t[i] in NO_CALLS or (i and t[i - 1] == "new"):
            continue
        way, _, name = t[i].rpartition(".")
        before = ends.get(i - 1, -1) if i and t[i - 1] == "." else -1
        if i and t[i - 1] == "." and before < 0:
            continue  # on the value of something that is no call
        ends[_block(t, i + 1)] = len(out)
        out.append([way, name, before])
    return out


def declarations(source: str) -> Iterator[tuple]:
    """(owner, kind, name, type, annotations, extra) of the declarations of a source, in order.

    Kinds: class, interface, enum, field, enum_field, method, constructor, constant.  ``extra``: extends and
    implements of types, parameters of methods, arguments of constants.
    """
    t = tokens(source)
    i, n = 0, len(t)
    stack: list[tuple[str, str]] = []  # names and kinds of the owners of the open bodies
    fresh_enum = False
    while i < n:
        if t[i] == "}":
            stack and stack.pop()
            fresh_enum = False
            i += 1
            continue
        if fresh_enum:  # constants up to the semicolon or the end of the body
            fresh_enum = False
            while i < n and t[i] not in (";", "}"):
                _, i = _annotations(t, i)
                if i < n and re.match(r"[A-Za-z_$]", t[i]):
                    name, i, args = t[i], i + 1, []
                    if i < n and t[i] == "(":
                        end = _block(t, i)
                        args, i = _parts(t[i + 1 : end - 1]), end
                    if i < n and t[i] == "{":
                        i = _block(t, i)
                    values = [_literal(a) for a in args]
                    literal = not any(v is _ABSENT for v in values)
                    yield stack[-1][0], "constant", name, None, [], {"args": values if literal else None, "count": len(args)}
                else:
                    i += 1
            i += i < n and t[i] == ";"
            continue
        marks, i = _annotations(t, i)
        while i < n and t[i] in MODIFIERS:
            i += 1
            more, i = _annotations(t, i)
            marks += more
        if i >= n:
            return
        owner, owner_kind = stack[-1] if stack else (None, None)
        field = "field" if owner_kind != "enum" else "enum_field"
        if t[i] in ("class", "interface", "enum", "record", "@interface") and i + 1 < n:
            kind, name, i = t[i], t[i + 1], i + 2
            extra: dict[str, Any] = {"extends": [], "implements": []}
            while i < n and t[i] != "{":
                if t[i] in ("extends", "implements"):
                    word = t[i]
                    extra[word], i = _names(t, i + 1, ("{", "extends", "implements", "permits"))
                else:
                    i = _block(t, i) if t[i] in "<(" else i + 1
            yield owner, kind, name, None, marks, extra
            stack.append((name, kind))
            fresh_enum = kind == "enum"
            i += 1
            continue
        if t[i] in (";", "{") or t[i] in ("import", "package"):
            if t[i] == "{":
                i = _block(t, i)
            elif t[i] == ";":
                i += 1
            else:
                while i < n and t[i] != ";":
                    i += 1
            continue
        if t[i] == "<":  # type parameters of a method
            i = _block(t, i)
        start = i
        while i < n and t[i] not in ("(", "=", ";", ",", "{", "}"):
            i = _block(t, i) if t[i] == "<" else i + 1
        head = t[start:i]
        if i >= n or not head:
            i += i < n and t[i] not in ("}",)
            continue
        if t[i] == "(":
            end = _block(t, i)
            params = []
            for p in _parts(t[i + 1 : end - 1]):
                marks_p, k = _annotations(p, 0)
                p = [x for x in p[k:] if x != "final"]
                if len(p) > 1:
                    params.append({"name": p[-1], "type": type_text(p[:-1]), "annotations": [m for m, _ in marks_p]})
            i = end
            while i < n and t[i] not in ("{", ";"):
                i += 1
            body = i < n and t[i] == "{"
            calls = call_sites(t[i + 1 : _block(t, i) - 1]) if body else []
            if owner is not None and re.match(r"[A-Za-z_$]", head[-1]):
                made = len(head) == 1
                yield owner, "constructor" if made else "method", head[-1], None if made else type_text(head[:-1]), marks, {"params": params, "has_body": body, "calls": calls}
            i = _block(t, i) if body else i + 1
            continue
        # a field: one type, several names
        kind_of, name = head[:-1], head[-1]
        if head[-2:] == ["[", "]"] and len(head) > 3:
            kind_of, name = [*head[:-3], "[", "]"], head[-3]
        ok = owner is not None and kind_of and re.match(r"[A-Za-z_$]", name)
        if ok:
            yield owner, field, name, type_text(kind_of), marks, {}
        while i < n and t[i] not in (";", "}"):
            if t[i] == "=":
                i += 1
                while i < n and t[i] not in (",", ";"):
                    i = _block(t, i) if t[i] in "({[" else i + 1
            elif t[i] == ",":
                i += 1
                if ok and i < n and re.match(r"[A-Za-z_$]", t[i]):
                    yield owner, field, t[i], type_text(kind_of), marks, {}
                i += i < n and t[i] not in (";", "}")
            else:
                i += 1
        i += i < n and t[i] == ";"


_SCHEMA = "owner string, kind string, name string, type string, pos int, annotations map<string,string>, extra string"
_ARROW = [("owner", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("type", pa.string()), ("pos", pa.int32()), ("annotations", pa.map_(pa.string(), pa.string())), ("extra", pa.string())]


def scan(src: DataFrame, keep: tuple[str, ...], source: str = "source") -> DataFrame:
    """One row per declaration: the ``keep`` columns and owner, kind, name, type, pos, annotations (name -> JSON of its values), extra (JSON).

    Null and empty sources have none.  Of equal annotations of a declaration the last counts.  Row-local: no shuffle.
    """
    narrow = src.select(*keep, F.col(source).cast("string").alias("__source"))
    fields = narrow.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            cols: tuple[list, ...] = tuple([] for _ in _ARROW)
            for row, text in enumerate(b.column("__source").to_pylist()):
                for pos, (owner, kind, name, type_, marks, extra) in enumerate(declarations(text or "")):
                    at.append(row)
                    notes = {m: json.dumps(v, ensure_ascii=False) for m, v in marks}
                    for col, v in zip(cols, (owner, kind, name, type_, pos, list(notes.items()), json.dumps(extra, ensure_ascii=False))):
                        col.append(v)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(len(fields))), *(pa.array(c, t) for c, (_, t) in zip(cols, _ARROW))], [*(f.name for f in fields), *(n for n, _ in _ARROW)])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    return narrow.mapInArrow(run, kept + _SCHEMA)


# ---------------------------------------------------------------- entities

#: Annotations that make a class part of the data model, in order; those of relations.
ENTITY_MARKS = ("Entity", "Embeddable", "MappedSuperclass")
RELATIONS = ("ManyToOne", "OneToOne", "OneToMany", "ManyToMany")


def _has(name: str) -> Column:
    return F.map_contains_key("annotations", F.lit(name))


def value_of(annotation: str, key: str) -> Column:
    """A literal value of an annotation as text, null where there is none."""
    return F.get_json_object(F.try_element_at("annotations", F.lit(annotation)), f"$['{key}']")


def _first(pairs) -> Column:
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def entity_types(declared: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Classes of the data model: kind, table, schema, superclass and the clause of a soft delete."""
    kind = _first((_has(m), F.lit(m)) for m in ENTITY_MARKS)
    found = declared.where(F.col("kind") == "class").withColumn("jpa_kind", kind).where("jpa_kind is not null")
    clause = F.when(_has("Where"), value_of("Where", "clause")).when(_has("SQLRestriction"), value_of("SQLRestriction", "value"))
    return found.select(
        *keep, F.col("name").alias("class_name"), "jpa_kind", value_of("Table", "name").alias("table_name"), value_of("Table", "schema").alias("schema"), F.get_json_object("extra", "$.extends[0]").alias("extends"), clause.alias("soft_delete_clause")
    )


def entity_fields(declared: DataFrame, keep: tuple[str, ...], *, auditing: bool = False) -> DataFrame:
    """Fields of the classes of the data model with what their annotations say; ``auditing``: the project turns auditing of dates on."""
    relation = _first((_has(r), F.lit(r)) for r in RELATIONS)
    joined = F.col("relation").isin("ManyToOne", "OneToOne")

    def source(key: str) -> Column:
        return F.when(F.coalesce(joined, F.lit(False)), value_of("JoinColumn", key)).otherwise(value_of("Column", key))

    def scalar(key: str, kind: str) -> Column:
        return F.when(F.col("relation").isNull(), value_of("Column", key).try_cast(kind))

    models = entity_types(declared, keep).select(*keep, F.col("class_name").alias("owner")).distinct()
    f = declared.where(F.col("kind") == "field").join(models, [*keep, "owner"], "left_semi").withColumn("relation", relation)
    mapped = F.when(F.col("relation") == "OneToOne", value_of("OneToOne", "mappedBy")).when(F.col("relation") == "ManyToMany", value_of("ManyToMany", "mappedBy"))
    table = F.when(F.col("relation") == "ManyToMany", value_of("JoinTable", "name"))
    join_columns = F.try_element_at("annotations", F.lit("JoinTable"))

    def first_column(key: str) -> Column:
        return F.when(table.isNotNull(), F.coalesce(F.get_json_object(join_columns, f"$.{key}[0].name"), F.get_json_object(join_columns, f"$.{key}.name")))

    return f.select(
        *keep, F.col("owner").alias("class_name"), F.col("name").alias("field"), "type", "pos", "relation", _has("Id").alias("is_id"), _has("Transient").alias("is_transient"), _has("GeneratedValue").alias("is_generated"),
        F.col("type").isin("int", "long", "short", "byte", "boolean", "double", "float", "char").alias("is_primitive"), source("name").alias("column_name"), source("nullable").try_cast("boolean").alias("nullable"),
        scalar("length", "int").alias("length"), scalar("precision", "int").alias("precision"), scalar("scale", "int").alias("scale"), scalar("unique", "boolean").alias("unique"),
        F.coalesce(value_of("Enumerated", "#value") == "EnumType.ORDINAL", F.lit(False)).alias("enum_ordinal"), mapped.alias("mapped_by"), table.alias("join_table"), first_column("joinColumns").alias("join_column"), first_column("inverseJoinColumns").alias("inverse_column"),
        (_has("CreationTimestamp") | (_has("CreatedDate") & F.lit(auditing))).alias("is_created_at"), (_has("UpdateTimestamp") | (_has("LastModifiedDate") & F.lit(auditing))).alias("is_updated_at"),
    )


def unique_constraints(declared: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(.., class_name, columns): the literal column lists of the unique constraints of tables."""
    raw = F.try_element_at("annotations", F.lit("Table"))
    many = F.from_json(F.get_json_object(raw, "$.uniqueConstraints"), "array<struct<columnNames: array<string>>>")
    rows = declared.where((F.col("kind") == "class") & F.get_json_object(raw, "$.uniqueConstraints").isNotNull())
    return rows.select(*keep, F.col("name").alias("class_name"), F.explode(many).alias("c")).select(*keep, "class_name", F.col("c.columnNames").alias("columns")).where("size(columns) > 0")


def enum_values(declared: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(.., enum, pos, name, args): constants, with their arguments as JSON where all are literals and as many as the first constructor's parameters."""
    first = declared.where(F.col("kind") == "constructor").groupBy(*keep, F.col("owner").alias("enum")).agg(F.min_by(F.size(F.from_json(F.get_json_object("extra", "$.params"), "array<struct<name: string>>")), "pos").alias("_params"))
    constants = declared.where(F.col("kind") == "constant").select(*keep, F.col("owner").alias("enum"), "pos", "name", F.get_json_object("extra", "$.args").alias("_args"), F.get_json_object("extra", "$.count").cast("int").alias("_count"))
    j = constants.join(first, [*keep, "enum"], "left")
    return j.select(*keep, "enum", "pos", "name", F.when(F.col("_params").isNotNull() & (F.col("_count") == F.col("_params")), F.col("_args")).alias("args"))


def any_file_contains(files: DataFrame, marker: str, text: str = "source") -> bool:
    """Does any text hold the marker?  Stops at the first."""
    return not files.where(F.col(text).contains(marker)).limit(1).isEmpty()


def primary_keys(fields: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(.., class_name, pk_field, pk_type) of classes with exactly one id field."""
    ids = fields.where("is_id").groupBy(*keep, "class_name").agg(F.count(F.lit(1)).alias("n"), F.min("field").alias("pk_field"), F.min("type").alias("pk_type"))
    return ids.where("n = 1").drop("n")


def foreign_keys(fields: DataFrame, entities: DataFrame, keys: DataFrame, fallback: str) -> DataFrame:
    """``target`` (table.column) and ``key_type`` of each to-one relation; the fallback type and no target where the other side is unknown.

    ``entities``: ``class_name``, ``table_name``, ``schema``; ``keys``: ``class_name``, ``pk_field``, ``pk_type``.
    """
    side = entities.select(F.col("class_name").alias("type"), F.concat_ws(".", "schema", "table_name").alias("_table")).where("_table <> ''").join(keys.select(F.col("class_name").alias("type"), "pk_field", "pk_type"), "type")
    one = fields.where(F.col("relation").isin("ManyToOne", "OneToOne") & F.col("mapped_by").isNull())
    return one.join(side, "type", "left").select(*one.columns, F.when(F.col("_table").isNotNull(), F.concat("_table", F.lit("."), "pk_field")).alias("target"), F.coalesce("pk_type", F.lit(fallback)).alias("key_type"))


def join_tables(fields: DataFrame, keys: DataFrame) -> DataFrame:
    """Join tables of which both columns and both primary keys are known: owner and inverse class with their key types."""
    m = fields.where(F.col("join_column").isNotNull() & F.col("inverse_column").isNotNull()).withColumn("inverse", F.regexp_extract("type", r"<(?:.*[ ,.])?(\w+)>$", 1))
    own = keys.select("class_name", F.col("pk_type").alias("own_type"))
    other = keys.select(F.col("class_name").alias("inverse"), F.col("pk_type").alias("inverse_type"))
    return m.join(own, "class_name").join(other, "inverse").select("join_table", "class_name", "join_column", "own_type", "inverse", "inverse_column", "inverse_type")


def injected_values(declared: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(.., class_name, field, property_key): fields whose ``@Value`` is a literal ``${key}``."""
    raw = value_of("Value", "value")
    f = declared.where((F.col("kind") == "field") & raw.startswith("${") & raw.endswith("}"))
    return f.select(*keep, F.col("owner").alias("class_name"), F.col("name").alias("field"), F.expr("substring(get_json_object(annotations['Value'], '$.value'), 3, length(get_json_object(annotations['Value'], '$.value')) - 3)").alias("property_key"))


def config_constants(injected: DataFrame, order: str) -> DataFrame:
    """(property_key, constant, seq): each key once, where it first stands."""
    from tracewright.functions.scalars import camel_to_snake

    words = F.transform(F.split("property_key", r"\."), camel_to_snake)
    return injected.groupBy("property_key").agg(F.min(order).alias("seq")).withColumn("constant", F.upper(F.array_join(words, "_")))


def enum_only_interfaces(declared: DataFrame) -> DataFrame:
    """(interface, enums): interfaces that enums implement and no class does."""
    named = declared.select("kind", "name", F.explode(F.from_json(F.get_json_object("extra", "$.implements"), "array<string>")).alias("interface"))
    enums, classes = named.where("kind = 'enum'"), named.where("kind = 'class'").select("interface")
    known = declared.where("kind = 'interface'").select(F.col("name").alias("interface"))
    return enums.join(known, "interface", "left_semi").join(classes, "interface", "left_anti").groupBy("interface").agg(F.countDistinct("name").alias("enums"))


def handler_targets(declared: DataFrame, order: list[str]) -> DataFrame:
    """(method, exception): what single class each exception handler is for; of equal method names the last counts."""
    target = F.regexp_extract(value_of("ExceptionHandler", "#value"), r"^(?:.*\.)?(\w+)\.class$", 1)
    m = declared.where((F.col("kind") == "method") & (target != ""))
    return m.groupBy(F.col("name").alias("method")).agg(F.max_by(target, F.struct(*order)).alias("exception"))
