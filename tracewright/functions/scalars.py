"""Column expressions for names, paths, times and texts.

All are built from Spark's own functions, so they stay inside generated code.  Null in
gives null out unless a docstring says otherwise.  Regexes that must see letters of all
scripts carry ``(?U)``: without it Java's ``\\w`` is ASCII.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.documents import column, split_top_level

UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def camel_to_snake(c: Column) -> Column:
    """``getHTTPCode`` -> ``get_http_code``; a run of capitals is one word."""
    split = F.regexp_replace(c, r"(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(split, r"([a-z0-9])([A-Z])", "$1_$2"))


def path_key_of_url(parts: Column) -> Column:
    """Segments joined by ``_``; all-digit and lower-case UUID segments become ``{id}``."""
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$") | p.rlike(UUID), F.lit("{id}")).otherwise(p)), "_")


def path_key_of_template(path: Column) -> Column:
    """``/a/{x}/b`` -> ``a_{id}_b``; one leading slash is dropped, a trailing one stays as ``_``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"^/", ""), "/", "_"), r"\{[^}]*\}", "{id}")


def template_segments(parts: Column) -> Column:
    """``:id`` segments become ``{id}``."""
    return F.transform(parts, lambda p: F.regexp_replace(p, r"^:(.+)$", r"{$1}"))


def case_id(name: Column, method: Column, path: Column) -> Column:
    """``name_METHOD_path`` with every character that is no word character or hyphen as ``_``; letters of all scripts stay."""
    return F.regexp_replace(F.concat(F.lower(name), F.lit("_"), method, F.lit("_"), F.regexp_replace(path, r"^/", "")), r"(?U)[^\w\-]", "_")


def resource_name(path: Column, generic: tuple[str, ...] = ("api", "v1", "v2")) -> Column:
    """Last static segment that is not generic, the empty text if there is none or the path is null."""
    static = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike(r"^[{:]") & ~s.isin(*generic))
    return F.coalesce(F.get(static, F.size(static) - 1), F.lit(""))


def identifier(c: Column) -> Column:
    """ASCII word characters only; a leading digit gets a ``_`` before it."""
    s = F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    return F.when(s.rlike(r"^\d"), F.concat(F.lit("_"), s)).otherwise(s)


def slug(c: Column) -> Column:
    """Runs of other than ASCII letters and digits as one ``_``, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")


def since(as_of: Column, span: Column) -> Column:
    """``as_of`` less ``<n>h`` or ``<n>d``; any other span is an error."""
    n = F.regexp_extract(span, r"^(\d+)[hd]$", 1)
    hours = n.cast("bigint") * F.when(span.endswith("d"), 24).otherwise(1)
    return F.when(n != "", as_of - F.make_dt_interval(hours=hours)).when(span.isNotNull(), F.raise_error(F.concat(F.lit("no time span: "), span)))


def as_time(ts: Column) -> Column:
    """Timestamp of an ISO-8601 text with any zone spelling, null where it is none."""
    zoned = F.regexp_replace(F.trim(ts), r"([+-]\d{2}):?(\d{2})$", "$1:$2")
    return F.try_to_timestamp(zoned)


def short_time(ts: Column) -> Column:
    """``MM-dd HH:mm:ss`` of an ISO text; a text that is no time comes back as it is."""
    return F.coalesce(F.date_format(as_time(ts), "MM-dd HH:mm:ss"), ts)


def target_label(file: Column, cls: Column, fn: Column) -> Column:
    """``-`` without a file, ``file::fn`` without a class, else ``file::Class.fn``; a null function is left out."""
    tail = F.when(cls.isNull(), fn).when(fn.isNull(), cls).otherwise(F.concat(cls, F.lit("."), fn))
    return F.when(file.isNull(), F.lit("-")).when(tail.isNull(), file).otherwise(F.concat(file, F.lit("::"), tail))


def method_name(listed: Column, known: Column) -> Column:
    """The name if known, else without its trailing parenthesis if that is known, else null."""
    bare = F.regexp_replace(listed, r"\s*\([^()]*\)$", "")
    return F.when(F.array_contains(known, listed), listed).when(F.array_contains(known, bare), bare)


def constant_name(key: Column) -> Column:
    """``app.max-size`` -> ``APP_MAX_SIZE``."""
    return F.upper(F.regexp_replace(key, r"[^A-Za-z0-9]+", "_"))


def bean_name(name: Column, override: Column) -> Column:
    """The override, else the class name with a small first letter."""
    return F.coalesce(override, F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, 2, 1_000_000)))


def keyword_hit(text: Column, keyword: str) -> Column:
    """Whole-word match where the keyword ends in a letter or digit, else substring."""
    if keyword[-1:].isalnum():
        return text.rlike(rf"(?U)\b{re.escape(keyword)}\b")
    return text.contains(keyword)


def jdbc_host(url: Column) -> Column:
    """Host of a JDBC URL with or without credentials, null where there is none."""
    h = F.regexp_extract(url, r"^jdbc:[a-z0-9]+://(?:[^@/]*@)?([^:/?]+)", 1)
    return F.when(h != "", h)


def jdbc_port(url: Column, default: int) -> Column:
    p = F.regexp_extract(url, r"^jdbc:[a-z0-9]+://(?:[^@/]*@)?[^:/?]+:(\d+)", 1)
    return F.when(url.isNotNull(), F.when(p != "", p.cast("int")).otherwise(F.lit(default)))


def section(text: Column, title: str) -> Column:
    """What stands under ``## title`` up to the next ``## ``, null without that header."""
    body = F.regexp_extract(text, rf"(?s)(?:^|\n)## {title}\n\n(.*?)(?=\n## |\z)", 1)
    has = text.rlike(rf"(?s)(?:^|\n)## {title}\n\n")
    return F.when(has, F.regexp_replace(body, r"\n+\z", ""))


def between(text: Column, opening: str, closing: str) -> Column:
    """What stands between two marks, null where they do not both occur in order."""
    p = rf"(?s){re.escape(opening)}(.*?){re.escape(closing)}"
    return F.when(text.rlike(p), F.regexp_extract(text, p, 1))


def json_get(doc: Column, dotted: str) -> Column:
    """Text at a dotted path of a JSON object; a miss is an error, as a JSON null is not."""
    value = F.get_json_object(doc, "$." + dotted)
    keys = dotted.split(".")
    parent = "$" + "".join(f".{k}" for k in keys[:-1])
    there = F.array_contains(F.json_object_keys(F.get_json_object(doc, parent)), keys[-1])
    return F.when(F.coalesce(there, F.lit(False)), value).when(doc.isNotNull(), F.raise_error(F.lit(f"no value at {dotted}")))


def json_has(doc: Column, dotted: str) -> Column:
    keys = dotted.split(".")
    parent = "$" + "".join(f".{k}" for k in keys[:-1])
    return F.coalesce(F.array_contains(F.json_object_keys(F.get_json_object(doc, parent)), keys[-1]), F.lit(False))


def decoded_body(data: Column) -> Column:
    """UTF-8 text of an array of byte values; null for null and empty arrays."""
    hexed = F.array_join(F.transform(data, lambda b: F.lpad(F.hex(b.cast("bigint")), 2, "0")), "")
    return F.when(F.size(data) > 0, F.decode(F.unhex(hexed), "UTF-8"))


#: Simple source types and what they map to.
JAVA_TYPES = {
    "int": "int", "Integer": "int", "short": "int", "Short": "int", "long": "int", "Long": "int", "String": "str", "boolean": "bool", "Boolean": "bool", "double": "float", "Double": "float", "float": "float", "Float": "float",
    "BigDecimal": "Decimal", "void": "None", "LocalDate": "date", "LocalDateTime": "datetime", "LocalTime": "time", "Date": "datetime", "Instant": "datetime", "UUID": "UUID", "byte[]": "bytes", "Byte[]": "bytes",
}
#: One-argument containers, and functional interfaces by their number of arguments.
CONTAINERS = {"List": "list[{0}]", "Set": "list[{0}]", "Collection": "list[{0}]", "Optional": "{0} | None"}
CALLABLES = {
    ("Supplier", 1): "Callable[[], {0}]", ("Consumer", 1): "Callable[[{0}], None]", ("BiConsumer", 2): "Callable[[{0}, {1}], None]", ("Function", 2): "Callable[[{0}], {1}]",
    ("BiFunction", 3): "Callable[[{0}, {1}], {2}]", ("Predicate", 1): "Callable[[{0}], bool]", ("BiPredicate", 2): "Callable[[{0}, {1}], bool]",
}
#: Framework types whose argument is dropped.
FRAMEWORK_TYPES = {"Specification": "ColumnElement | None", "ResponseEntity": "Response"}
_GENERIC = re.compile(r"(\w+)<(.+)>", re.S)


def map_type(t: str | None) -> str | None:
    """The Python type text of a Java one; unknown names stay as they are, unknown generics keep their name with mapped arguments.

    ``Map`` needs exactly two arguments, anything else is an error; a functional interface
    with another number of arguments than it has counts as an unknown generic.
    """
    if t is None:
        return None
    t = t.strip()
    m = None if t in JAVA_TYPES else _GENERIC.fullmatch(t)
    if not m:
        return JAVA_TYPES.get(t, t)
    head, inner = m.groups()
    if head in FRAMEWORK_TYPES:
        return FRAMEWORK_TYPES[head]
    if head in CONTAINERS:
        return CONTAINERS[head].format(map_type(inner))
    args = [map_type(a) for a in split_top_level(inner)]
    if head == "Map":
        if len(args) != 2:
            raise ValueError(f"Map needs two arguments: {t}")
        return f"dict[{args[0]}, {args[1]}]"
    known = CALLABLES.get((head, len(args)))
    return known.format(*args) if known else f"{head}[{', '.join(args)}]"


def map_type_udf():
    """``map_type`` as a column function."""
    return column(map_type)


def simple_type(t: Column) -> Column:
    """The simple part of :func:`map_type` inside generated code: scalars, one container of a scalar; null for everything else."""
    table = F.create_map(*[F.lit(x) for kv in JAVA_TYPES.items() for x in kv])
    t = F.trim(t)
    head, inner = F.regexp_extract(t, r"^(\w+)<([^<>]+)>$", 1), F.trim(F.regexp_extract(t, r"^(\w+)<([^<>]+)>$", 2))
    arg = F.coalesce(F.try_element_at(table, inner), inner)
    return (
        F.when(F.try_element_at(table, t).isNotNull(), F.try_element_at(table, t))
        .when(head.isin("List", "Set", "Collection"), F.concat(F.lit("list["), arg, F.lit("]")))
        .when(head == "Optional", F.concat(arg, F.lit(" | None")))
        .when(~t.contains("<"), t)
    )
